"""Transcript queries: cleaning, references, lines, failures, triples, windows over events."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators.lifecycle import usage_signals
from tessera.functions import dates as D
from tessera.functions import lexicon as X
from tessera.functions import text as T
from tessera.operators import transcripts as R
from tessera.sources.tables import messages, table


@query("page_clean_text", r"select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as clean from pages")
def page_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_html(F.col("html")).alias("clean"))


@query("file_refs", rf"select page_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(html, '{X.FILE_REF}'), lambda r: regexp_replace(r, '^[.,);\]]+|[.,);\]]+$', '', 'g')), lambda r: contains(r, '/') and length(r) > 2))) as refs from pages")
def file_refs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.file_refs(F.col("html")).alias("refs"))


@query("w8_line_offsets", r"with l as (select doc_id as id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents) select id, line_no::int as line_no, length(line)::int as n, coalesce(sum(length(line) + 1) over (partition by id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as start from l")
def w8(spark, sf_dir):
    return R.line_starts(table(spark, sf_dir, "documents"), "doc_id", F.col("text")).select("id", "line_no", F.length("line").alias("n"), "start")


@query("grep_lines", r"with l as (select doc_id as id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents), s as (select *, coalesce(sum(length(line) + 1) over (partition by id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as start from l), m as (select *, regexp_extract(line, '[0-9]{4,}') as match from s) select id, line_no::int as line_no, (start + instr(line, match) - 1)::bigint as start, match from m where match <> ''")
def grep_lines(spark, sf_dir):
    lines = R.line_starts(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return R.grep(lines, "[0-9]{4,}").select("id", "line_no", "start", "match")


def calls(spark, sf_dir):
    """Events as tool calls of sessions: an error fails, anything else succeeds."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.row_number().over(w).cast("long").alias("idx"), F.concat(F.lit("t"), F.col("event_id") % 4).alias("tool"), (F.col("event_type") != "error").alias("ok"), "props")


CALLS = "cl as (select user_id::varchar as session, row_number() over (partition by user_id order by ts, event_id) as idx, 't' || (event_id % 4) as tool, event_type <> 'error' as ok, props from events)"


@query("st3_failure_arcs")
def st3(spark, sf_dir):
    """Order decides, so SQL has no short form: tests hold it against a plain loop."""
    return R.failure_arcs(calls(spark, sf_dir).withColumn("signature", F.col("props")).select("session", "idx", "tool", "ok", "signature"))


@query("j16_failure_then_fix", f"with {CALLS}, j as (select session, tool, idx as fixed_at, ok, max(case when not ok then idx end) over (partition by session, tool order by idx range between 25 preceding and 1 preceding) as failed_at from cl) select session, tool, fixed_at, failed_at from j where ok and failed_at is not null")
def j16(spark, sf_dir):
    return R.failure_then_fix(calls(spark, sf_dir))


@query("a28_arc_candidates", "with a as (select 't' || (event_id % 4) as tool, props as signature, event_type as rule, user_id as session, 1 + event_id % 3 as repeats from events where event_type in ('error', 'view')) select tool, signature, sum(repeats)::bigint as repeats, count(distinct session)::bigint as sessions, any_value(rule) as rule from a group by all having count(distinct rule) = 1 and (sum(repeats) >= 3 or count(distinct session) >= 2)".replace("group by all", "group by tool, signature"))
def a28(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'view')")
    return R.arc_candidates(e.select(F.concat(F.lit("t"), F.col("event_id") % 4).alias("tool"), F.col("props").alias("signature"), F.col("event_type").alias("rule"), F.col("user_id").alias("session"), (1 + F.col("event_id") % 3).alias("repeats")))


TYPES = ["WORKING_SOLUTION", "GOTCHA", "PATTERN", "DECISION", "FAILURE", "PREFERENCE", "TOOL_RULE", "NOTE"]
TOLD = ["try {n} to fix {b}", "{n} causes {b} trouble", "avoid {n}", "the {b} team uses {n}", "we chose {n} over {b}", "{n} fails with {b}", "prefer {n}", "{n} is broken", "nothing at all", "using {n} because {b} is better", "{n} worked for {b}"]


def told_sql() -> str:
    cases = " ".join(f"when {i} then " + " || ".join({"{n}": "p_name", "{b}": "p_brand"}.get(x, f"'{x}'") for x in re.split(r"(\{n\}|\{b\})", t) if x) for i, t in enumerate(TOLD))
    types = " ".join(f"when {i} then '{t}'" for i, t in enumerate(TYPES))
    return f"told as (select p_partkey as id, case p_partkey % {len(TYPES)} {types} end as type, case p_partkey % {len(TOLD)} {cases} end as t from part)"


def triples_sql() -> str:
    q = lambda p: "(?i)" + p.replace("'", "''")
    g = lambda p, i: f"substr(trim(regexp_extract(t, '{q(p)}', {i})), 1, 80)"
    rows = []
    for kind, patterns in (("WORKING_SOLUTION", X.SOLUTION), ("GOTCHA", X.GOTCHA), ("PATTERN", X.FOLLOWS), ("DECISION", X.DECISION), ("FAILURE", X.FAILURE), ("PREFERENCE", X.PREFERENCE)):
        for i, p in enumerate(patterns):
            earlier = "".join(f" and not regexp_matches(t, '{q(e)}')" for e in patterns[:i])
            one, two = g(p, 1), g(p, 2) if re.compile(p).groups > 1 else "''"
            spo = {
                "WORKING_SOLUTION": (one, "solves", two), "GOTCHA": (one, "has_pitfall", f"case when {two} = '' then 'warning' else {two} end"), "PATTERN": (one, "follows_pattern", two),
                "DECISION": ("'project'", "chose", f"{one} || case when {two} = '' then '' else ' (' || {two} || ')' end"), "FAILURE": (one, "fails_for", f"case when {two} = '' then 'unknown reason' else {two} end"), "PREFERENCE": ("'user'", "prefers", one),
            }[kind]
            rows.append(f"select id, {spo[0]} as subject, '{spo[1]}' as predicate, {spo[2]} as object from told where type = '{kind}' and regexp_matches(t, '{q(p)}'){earlier}")
    return f"with {told_sql()} " + " union all ".join(rows)


@query("extract_triples", triples_sql())
def extract_triples(spark, sf_dir):
    """Parts told as memories of several types; the first pattern that fits a memory's text gives its triple."""
    from tessera.operators.triples import triples

    piece = {"{n}": F.col("p_name"), "{b}": F.col("p_brand")}
    told = F.lit(None).cast("string")
    for i, t in enumerate(TOLD):
        told = F.when(F.col("p_partkey") % len(TOLD) == i, F.concat(*[piece.get(x, F.lit(x)) for x in re.split(r"(\{n\}|\{b\})", t) if x])).otherwise(told)
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("p_partkey") % len(TYPES) + 1).cast("int"))
    m = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("type"), told.alias("content"))
    return triples(m, "id", "type", "content")


@query("bridge_entities", r"select page_id, list_sort(list_distinct(list_transform(regexp_extract_all(t, '[A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+)*'), lambda s: array_to_string(string_split(regexp_replace(regexp_replace(lower(s), '^(the |a |an )', ''), '\s+', ' ', 'g'), ' ')[1:2], ' ')))) as keys from (select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as t from pages)")
def bridge_entities(spark, sf_dir):
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.array_sort(T.entity_spans(title)).alias("keys"))


@query("dims_first_date", r"select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate, '%Y') as bare from orders")
def dims_first_date(spark, sf_dir):
    d = F.col("o_orderdate")
    told = F.concat(F.lit("from "), F.date_format(d, "yyyy/MM/dd"), F.lit(" to 2030-01-01"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.first_date(told).alias("day"), D.first_date(F.concat(F.lit("in "), F.date_format(d, "yyyy"), F.lit(" and 12345"))).alias("bare"))


@query("narrative_dates", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate, '%Y-%m-%d') as mdy, strftime(o_orderdate, '%Y-%m-%d') as dmy, strftime(o_orderdate, '%Y-%m-01') as my, strftime(o_orderdate - interval 1 day, '%Y-%m-%d') as rel, strftime(o_orderdate - interval 21 days, '%Y-%m-%d') as ago from orders")
def narrative_dates(spark, sf_dir):
    """Ways to tell a day in text, read back."""
    d = F.col("o_orderdate")
    told = {"iso": F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd"), F.lit(" it was")), "mdy": F.date_format(d, "MMM dd, yyyy"), "dmy": F.concat(F.lit("the "), F.date_format(d, "d MMMM yyyy")), "my": F.concat(F.lit("in "), F.date_format(d, "MMMM yyyy")), "rel": F.lit("it was yesterday"), "ago": F.lit("3 weeks ago")}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[D.occurred_on(t, F.to_date(d)).cast("string").alias(n) for n, t in told.items()])


FAULTS = ["TypeError: x at /srv/app/k{e}.js:{e}:7", "job failed with 0xdeadbeef", "Cannot find module m{e}", "done 170000000{e}0", "ENOENT /tmp/a/b/c{e}"]


def fault_sql() -> str:
    cases = " ".join(f"when {i} then " + " || ".join("event_id" if x == "{e}" else f"'{x}'" for x in re.split(r"(\{e\})", t) if x) for i, t in enumerate(FAULTS))
    kinds = " ".join(f"when regexp_matches(m, '(?i){p}') then replace(replace(lower(regexp_extract(m, '(?i){p}')), ':', ''), ' ', '')" for p in X.ERRORS)
    tidy = "m"
    for p, by in X.ERROR_PARTS:
        tidy = f"regexp_replace({tidy}, '{p}', '{by}', 'g')"
    return f"with f as (select event_id, case event_id % {len(FAULTS)} {cases} end as m from events), t as (select event_id, case {kinds} else 'unknown' end as error_type, {tidy} as normalized from f) select event_id, error_type, normalized, error_type || '-' || regexp_extract(normalized, '\\w+(?:\\s+\\w+)?') as signature from t"


@query("error_signatures", fault_sql())
def error_signatures(spark, sf_dir):
    """Error texts made of the events: their type, normalized text and signature."""
    m = F.lit(None).cast("string")
    for i, t in enumerate(FAULTS):
        m = F.when(F.col("event_id") % len(FAULTS) == i, F.concat(*[F.col("event_id").cast("string") if x == "{e}" else F.lit(x) for x in re.split(r"(\{e\})", t) if x])).otherwise(m)
    return table(spark, sf_dir, "events").select("event_id", T.error_type(m).alias("error_type"), T.normalized_error(m).alias("normalized"), T.error_signature(m).alias("signature"))


@query("fn_error_snippet", r"with f as (select doc_id, substr(text, 1, 150) || ' Uncaught thing ' || text as m from documents where length(text) > 150) select doc_id, substr(m, 1 + greatest(0, instr(m, 'Uncaught') - 101), least(instr(m, 'Uncaught') - 1, 100) + 500) as part from f where not regexp_matches(m, '(?i)Error:|failed|ENOENT|EACCES|Cannot find module|Cannot read properties')")
def fn_error_snippet(spark, sf_dir):
    """Texts with an error set into them, and what stands around it."""
    m = F.concat(F.substring("text", 1, 150), F.lit(" Uncaught thing "), "text")
    d = table(spark, sf_dir, "documents").where(F.length("text") > 150).select("doc_id", m.alias("m"))
    return d.where(~F.col("m").rlike("(?i)Error:|failed|ENOENT|EACCES|Cannot find module|Cannot read properties")).select("doc_id", T.error_snippet(F.col("m")).alias("part"))


@query("fn_snippet", "with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as ws from documents), p as (select doc_id, ws, list_min(list_filter([list_position(ws, 'that'), list_position(ws, 'de')], lambda x: x > 0)) as hit from w) select doc_id, array_to_string(ws[greatest(1, coalesce(hit, 1) - 8):greatest(1, coalesce(hit, 1) - 8) + 15], ' ') as part from p where len(ws) > 0")
def fn_snippet(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    return d.select("doc_id", T.snippet(F.col("ws"), F.array(F.lit("that"), F.lit("de")), 16).alias("part"))


@query("json_props", "select event_id, (props->>'k')::int as k, props->>'missing' as missing from events")
def json_props(spark, sf_dir):
    j = F.from_json("props", "k int, missing string")
    return table(spark, sf_dir, "events").select("event_id", j.alias("j")).select("event_id", "j.k", "j.missing")


@query("d31_snapshot_latest", "select conv_id, max(turn) as turn, arg_max(role, turn) as role from conversations group by conv_id")
def d31(spark, sf_dir):
    return messages(spark, sf_dir).groupBy(F.col("session_id").alias("conv_id")).agg(F.max("message_index").alias("turn"), F.max_by("role", "message_index").alias("role"))


@query("a32_curator_metrics", "select user_id as idx, arg_max(props, event_id) filter (event_type = 'view') as last_view, count(*) filter (event_type = 'error')::bigint as rejected, count(*) filter (event_type = 'purchase')::bigint as accepted from events group by 1")
def a32(spark, sf_dir):
    """A trace folded by candidate: the last payload of one kind and counts of others."""
    e = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("idx")).agg(F.max_by("props", F.when(e == "view", F.col("event_id"))).alias("last_view"), F.count_if(e == "error").alias("rejected"), F.count_if(e == "purchase").alias("accepted"))


ST9 = """with t as (select conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}')) as terms from conversations),
i as (select a.conv_id, a.turn, a.turn % 3 as memory, len(a.terms) as n, len(list_intersect(a.terms, coalesce(b.terms, []))) as cited from t a left join t b on b.conv_id = a.conv_id and b.turn = a.turn + 1 where a.role = 'user'),
m as (select conv_id, memory, count(*)::bigint as injects, count(*) filter (n > 0 and cited >= least(2, n))::bigint as uses from i group by all)
select conv_id, memory, injects, uses, case when uses > 0 then 'good' when injects >= 2 then 'bad' else 'none' end as signal, case when uses > 0 then 1.0 when injects >= 2 then 0.1 else 0.0 end::double as weight from m"""


@query("st9_turn_usage_signals", ST9)
def st9(spark, sf_dir):
    """A memory (here one of three a session) counts as used if the next turn cites two of its distinctive words, or its only one.

    What was put in twice and more and never used is flagged once a session, weakly.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0)))
    m = messages(spark, sf_dir).select("session_id", "message_index", "role", words.alias("terms"))
    w = Window.partitionBy("session_id").orderBy("message_index")
    nxt = m.withColumn("then", F.when(F.lead("message_index").over(w) == F.col("message_index") + 1, F.lead("terms").over(w)))
    cited = F.size(F.array_intersect("terms", F.coalesce("then", F.array().cast("array<string>"))))
    used = (F.size("terms") > 0) & (cited >= F.least(F.lit(2), F.size("terms")))
    injected = nxt.where("role = 'user'").select(F.col("session_id").alias("conv_id"), (F.col("message_index") % 3).alias("memory"), used.alias("used"))
    return usage_signals(injected, ["conv_id", "memory"])


@query("st4_bounded_body", "with t as (select conv_id, turn, length(text) as n, case role when 'user' then 0 when 'assistant' then 1 else 2 end as tier from conversations), s as (select *, sum(n) over (partition by conv_id order by tier, turn desc) as used from t) select conv_id, turn, tier::int as tier from s where used <= 3000")
def st4(spark, sf_dir):
    """A buffer of 3,000 characters: better tiers first, newer turns first within a tier."""
    tier = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    m = messages(spark, sf_dir).select(F.col("session_id").alias("conv_id"), F.col("message_index").alias("turn"), F.length("text").alias("n"), tier.alias("tier"))
    w = Window.partitionBy("conv_id").orderBy("tier", F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return m.withColumn("used", F.sum("n").over(w)).where("used <= 3000").select("conv_id", "turn", "tier")


@query("sc8_markdown_export", "select conv_id, '# Session ' || conv_id || chr(10) || string_agg('- **' || role || '**: ' || length(text), chr(10) order by turn) as markdown from conversations group by conv_id")
def sc8(spark, sf_dir):
    line = lambda x: F.concat(F.lit("- **"), x["role"], F.lit("**: "), x["n"])
    rows = F.sort_array(F.collect_list(F.struct("message_index", "role", F.length("text").alias("n"))))
    return messages(spark, sf_dir).groupBy("session_id").agg(F.concat_ws("\n", F.concat(F.lit("# Session "), "session_id"), F.transform(rows, line)).alias("markdown")).withColumnRenamed("session_id", "conv_id")


@query("sc9_rebuild_index", "select term, count(*)::bigint as df, sum(f)::bigint as cf from (select doc_id, term, count(*) as f from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents) group by all) group by term")
def sc9(spark, sf_dir):
    """The derived keyword index, rebuilt from the texts."""
    from tessera.operators.bm25 import postings

    return postings(table(spark, sf_dir, "documents"), "doc_id", F.col("text")).groupBy("term").agg(F.count("*").alias("df"), F.sum("f").alias("cf"))


@query("sc11_pooled_corpus", "select md5(text) as pool_id, min(doc_id) as first_id, count(*)::bigint as n from documents group by 1")
def sc11(spark, sf_dir):
    """A benchmark's pooled corpus: equal paragraphs of all questions once."""
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("pool_id")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query("st1_sync_watermark", "select event_type as tbl, max(event_id) as last_cursor, count(*)::bigint as rows_seen, count(*) filter (value > 50)::bigint as rows_changed from events group by 1")
def st1(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tbl")).agg(F.max("event_id").alias("last_cursor"), F.count("*").alias("rows_seen"), F.count_if(F.col("value") > 50).alias("rows_changed"))


ST5 = """with t as (select conv_id, turn, turn // 2 as batch, length(text) % 7 = 0 as failed from conversations),
b as (select conv_id, min(batch) filter (failed) as stop from t group by 1)
select conv_id, max(turn) filter (stop is null or batch < stop) as watermark, max(turn) as last_turn, count(*)::bigint as n, stop is null as complete, stop is null and count(*) >= 5 as eligible from t join b using (conv_id) group by conv_id, stop"""


@query("st5_episode_watermark", ST5)
def st5(spark, sf_dir):
    """A session's watermark stands before its first failed batch; a session that is not read whole is never told to be small."""
    t = messages(spark, sf_dir).select(F.col("session_id").alias("conv_id"), F.col("message_index").alias("turn"), F.expr("message_index div 2").alias("batch"), (F.length("text") % 7 == 0).alias("failed"))
    b = t.groupBy("conv_id").agg(F.min(F.when(F.col("failed"), F.col("batch"))).alias("stop"))
    g = t.join(b, "conv_id").groupBy("conv_id", "stop").agg(F.max(F.when(F.col("stop").isNull() | (F.col("batch") < F.col("stop")), F.col("turn"))).alias("watermark"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))
    whole = F.col("stop").isNull()
    return g.select("conv_id", "watermark", "last_turn", "n", whole.alias("complete"), (whole & (F.col("n") >= 5)).alias("eligible"))


@query("sc9_reembed", "select vec_id, len(embedding)::int as dim, round(list_inner_product(embedding::double[], embedding::double[]), 6) as before, case when list_inner_product(embedding::double[], embedding::double[]) > 0 then 1.0 else 0.0 end::double as after, round(embedding[1]::double / sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as first from embeddings")
def sc9_reembed(spark, sf_dir):
    """Every vector rewritten by an embedding function (here to length one), with its dimension guarded."""
    from tessera.operators.vector import dot, reembedded, unit

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    new = reembedded(e, unit(F.col("embedding")), 64)
    both = new.select("vec_id", F.size("embedding").alias("dim"), F.round(dot(F.col("former"), F.col("former")), 6).alias("before"), F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("after"), F.round(F.col("embedding")[0], 6).alias("first"))
    return both


@query("events_tumbling", "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by all")
def events_tumbling(spark, sf_dir):
    w = F.window("ts", "1 hour")
    return table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query("events_sliding", "with e as (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as window_start, value from events) select window_start, count(*)::bigint as n, round(max(value), 4) as top from e group by 1")
def events_sliding(spark, sf_dir):
    w = F.window("ts", "1 hour", "30 minutes")
    return table(spark, sf_dir, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("top")).select(F.col("w.start").alias("window_start"), "n", "top")


@query("events_sessionized", "with g as (select user_id, ts, (coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval '6 hours', true))::int as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as sid from g) select user_id, min(ts) as session_start, count(*)::bigint as n from s group by user_id, sid")
def events_sessionized(spark, sf_dir):
    w = F.session_window("ts", "6 hours")
    return table(spark, sf_dir, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


@query("events_dedup", "select user_id, event_type, props, min(event_id) as event_id from events group by all")
def events_dedup(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", "props").agg(F.min("event_id").alias("event_id"))


@query("asof_last_error", "select e.event_id, r.event_id as last_error from (select * from events where event_type = 'purchase') e asof left join (select * from events where event_type = 'error') r on e.user_id = r.user_id and e.ts >= r.ts")
def asof_last_error(spark, sf_dir):
    """The last error before each purchase of a user: a union and a running last instead of a range join."""
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") != "error").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'error')").select("event_id", "user_id", "event_type", "ts")
    return e.withColumn("last_error", F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "last_error")


@query("relational_rollup", "select l_returnflag, l_linestatus, count(*)::bigint as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem group by cube(l_returnflag, l_linestatus)")
def relational_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("relational_star_join", "select r_name, year(o_orderdate)::int as y, count(*)::bigint as n, round(sum(l_extendedprice), 2) as total from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def relational_star_join(spark, sf_dir):
    l, o, c, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
