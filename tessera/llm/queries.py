"""The corpus operators' queries, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op11_alignment
from .ann import op1_nearest
from .chat import op13_chat
from .decontaminate import op3_decontaminate
from .jaccard import op10_jaccard
from .licenses import op2_licenses
from .line_dedup import op9_line_dedup
from .merkle import op12_merkle
from .packing import op8_packing
from .quality import op4_quality
from .secrets import op7_secrets
from .token_counts import op6_token_counts
from .urls import op5_urls


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_nearest, op2_licenses, op3_decontaminate, op4_quality, op5_urls, op6_token_counts, op7_secrets, op8_packing, op9_line_dedup, op10_jaccard, op11_alignment, op12_merkle, op13_chat, pipeline)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op3_decontaminate": rf"""
with d as (select doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, list_slice(w, i, i + least(13, len(w)) - 1) as g
        from (select item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct len(g) as n from win),
starts as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, w from d, sizes where len(w) >= n),
runs as (select doc_id, i, n, list_slice(w, i, i + n - 1) as g from starts),
hits as (select r.doc_id, r.i, r.n, win.item_id from runs r join win on r.g = win.g),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as l from (select distinct doc_id, item_id::varchar as s from hits) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
""",
    "op9_line_dedup": rf"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
k as (select doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
bad as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select doc_id, count(*)::bigint as n_lines, count(*) filter (keeper is not null and keeper <> doc_id)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (keeper is null or keeper = doc_id), '')) as kept_sha256
from k left join bad using (key) group by doc_id
""",
    "op10_jaccard": rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, s from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w)),
n as (select doc_id, count(*) as c from sh group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.c + y.c - i)),
e as (select a, b from l union all select b, a from l),
r(node, seen) as (select doc_id, doc_id from documents union select e.b, r.seen from r join e on e.a = r.node),
linked as (select a, count(*) as k from e group by 1)
select d.doc_id, coalesce(any_value(c), 0)::bigint as n_shingles, min(seen) as component_id, coalesce(any_value(k), 0)::bigint as n_links
from documents d left join n on n.doc_id = d.doc_id left join linked on linked.a = d.doc_id join r on r.node = d.doc_id group by d.doc_id
""",
    "op12_merkle": r"""
with recursive v as (select doc_id, lang, n_chars, unnest([0, 1]) as plus, source, text from documents),
f as (select *, list_transform([doc_id::varchar, source, lang, (n_chars + plus)::varchar, text],
        lambda x: coalesce(strlen(x)::varchar || ':' || x, '-')) as told from v),
h as (select doc_id, lang, plus, sha256(array_to_string(told, '')) as leaf from f),
crcs(doc_id, crc) as (select doc_id, (4294967295 - list_reduce(
        list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
        lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0],
          lambda p, q: case when p % 2 = 1 then xor(p // 2, 3988292384) else p // 2 end))) from documents),
d as (select a.doc_id, coalesce('=' || a.lang, '-') as tree, a.leaf,
        case when crc % 7 = 0 then b.leaf else a.leaf end as changed
      from h a join h b on a.doc_id = b.doc_id and a.plus = 0 and b.plus = 1
      join crcs on crcs.doc_id = a.doc_id),
p as (select *, row_number() over (partition by tree order by doc_id, leaf) - 1 as i, count(*) over (partition by tree) as n from d),
up(tree, level, i, node, n) as (select tree, 0, i, leaf, n from p
  union all select tree, level + 1, i // 2, sha256(string_agg(node, '' order by i)), (n + 1) // 2 from up where n > 1 group by tree, level, i // 2, n),
sub as (select tree, node, row_number() over (order by tree) - 1 as i, count(*) over () as n from up where n = 1),
over(level, i, node, n) as (select 0, i, node, n from sub
  union all select level + 1, i // 2, sha256(string_agg(node, '' order by i)), (n + 1) // 2 from over where n > 1 group by level, i // 2, n),
sib as (select p.doc_id, u.level, u.node, u.i % 2 = 0 as before from p join up u on u.tree = p.tree and u.n > 1 and u.i = xor(p.i // (1 << u.level), 1)
  union all select p.doc_id, o.level + 1000, o.node, o.i % 2 = 0 from p join sub on sub.tree = p.tree join over o on o.n > 1 and o.i = xor(sub.i // (1 << o.level), 1)),
steps as (select p.doc_id, l.level from p join (select distinct tree, level from up where n > 1) l using (tree)
  union all select doc_id, level + 1000 from p, (select distinct level from over where n > 1)),
way as (select s.doc_id, row_number() over (partition by s.doc_id order by s.level) as k, coalesce(case when before then node end, '') as l, coalesce(case when not before then node end, '') as r
  from steps s left join sib using (doc_id, level)),
fold(doc_id, k, node) as (select doc_id, 0, changed from d
  union all select fold.doc_id, fold.k + 1, sha256(l || node || r) from fold join way on way.doc_id = fold.doc_id and way.k = fold.k + 1),
ends as (select doc_id, arg_max(node, k) as folded_root from fold group by 1),
proof as (select doc_id, sha256(string_agg(l || r, '' order by k)) as proof_sha256 from way group by 1)
select d.doc_id, d.leaf, sub.node as subroot, top.node as root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = top.node as verified
from d join sub using (tree) join ends using (doc_id) left join proof using (doc_id), (select node from over where n = 1) top
""",
    "op13_chat": r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
m as (select *, len(regexp_extract_all(role || chr(10) || text, '<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*\|endoftext\|>')) as n from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  (3 + sum(17 + length(role) + length(text) + n))::bigint as formatted_chars
from m group by conv_id
""",
}
