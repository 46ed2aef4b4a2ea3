"""Scans, projections, filters and predicates over the memories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import lexicon as X_
from tessera.functions import text as T
from tessera.operators import filters as X
from tessera.operators.ordered import placed
from tessera.operators.redirect import Pattern, decisions, rules_of
from tessera.sources.tables import SQL_EDGES, SQL_MEMORIES, SQL_USAGE, edges, memories, messages, table, usage_events

WITH_MEM = f"with {SQL_MEMORIES}"


@query("sc1_list_memories", f"{WITH_MEM} select id, type, project, created_at from mem where type = 'EN' and created_at >= timestamp '2024-01-05' order by created_at desc, id limit 20 offset 10")
def sc1(spark, sf_dir):
    """The page of a filtered, projected listing: offset and limit are the feature."""
    rows = memories(spark, sf_dir).where("type = 'EN' and created_at >= timestamp '2024-01-05'")
    return rows.select("id", "type", "project", "created_at").orderBy(F.desc("created_at"), "id").offset(10).limit(20)


@query("sc2_memories_stats", f"{WITH_MEM} select type, count(*)::bigint as n, round(avg(confidence), 2) as avg_confidence, min(created_at) as first_created, max(created_at) as last_created from mem group by type")
def sc2(spark, sf_dir):
    return memories(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 2).alias("avg_confidence"), F.min("created_at").alias("first_created"), F.max("created_at").alias("last_created"))


@query("sc3_point_reads", f"{WITH_MEM} select id, session, type from mem where id in (select doc_id from labels where toxic = 1)")
def sc3(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return memories(spark, sf_dir).select("id", "session", "type").join(ids, "id", "left_semi")


@query(
    "sc4_session_jsonl_scan",
    r"""select conv_id as session_id, turn as message_index, role, length(text)::bigint as n_chars from conversations where role in ('user', 'assistant') and trim(text) <> ''""",
)
def sc4(spark, sf_dir):
    """Transcript lines as JSON, parsed tolerantly: lines that are no objects or have no role are passed over."""
    from tessera.sources.transcripts import parse_jsonl

    rows = messages(spark, sf_dir)
    lines = rows.select(F.col("session_id"), F.col("message_index"), F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message"))).alias("value"))
    return parse_jsonl(lines).select("session_id", "message_index", "role", F.length("text").cast("long").alias("n_chars"))


SC6 = """with s as (select conv_id, turn, sum(strlen(text) + 1) over (partition by conv_id order by turn) as hi, strlen(text) + 1 as n, sum(strlen(text) + 1) over (partition by conv_id) as size, (conv_id % 9) * 400 as cursor from conversations),
w as (select *, case when size < cursor then 0 else cursor end as start from s)
select conv_id, any_value(start)::bigint as start, bool_or(size < cursor) as shrunk, count(*) filter (hi - n >= start)::bigint as new_lines, coalesce(max(hi) filter (hi - n >= start and hi <= start + 4000), any_value(start))::bigint as next_cursor from w group by conv_id"""


@query("sc6_byte_window", SC6)
def sc6(spark, sf_dir):
    """Lines that begin at or behind a file's cursor are new; a file shorter than its cursor is read anew; the cursor moves over whole lines within 4,000 bytes."""
    w = Window.partitionBy("session_id")
    rows = messages(spark, sf_dir).withColumn("n", F.octet_length("text") + 1).withColumn("cursor", (F.col("session_id") % 9) * 400)
    rows = rows.withColumn("hi", F.sum("n").over(w.orderBy("message_index"))).withColumn("size", F.sum("n").over(w))
    rows = rows.withColumn("start", F.when(F.col("size") < F.col("cursor"), 0).otherwise(F.col("cursor")))
    new, upto = F.col("hi") - F.col("n") >= F.col("start"), F.col("hi") <= F.col("start") + 4000
    out = rows.groupBy(F.col("session_id").alias("conv_id")).agg(F.first("start").alias("start"), F.bool_or(F.col("size") < F.col("cursor")).alias("shrunk"), F.count_if(new).alias("new_lines"), F.max(F.when(new & upto, F.col("hi"))).alias("next"))
    return out.select("conv_id", "start", "shrunk", "new_lines", F.coalesce("next", "start").alias("next_cursor"))


@query("sc7_watermark_poll", "select event_id, event_type, 'event ' || event_id || ' by ' || user_id || ': ' || event_type as rendered from events where event_id > 100 order by event_id limit 500")
def sc7(spark, sf_dir):
    """One poll: the next batch behind the cursor; its size is the feature."""
    e = table(spark, sf_dir, "events").where("event_id > 100")
    return e.select("event_id", "event_type", F.concat(F.lit("event "), "event_id", F.lit(" by "), "user_id", F.lit(": "), "event_type").alias("rendered")).orderBy("event_id").limit(500)


@query("sc10_dataset_validate", "select 'duplicate' as problem, doc_id as id, count(*)::bigint as n from documents group by doc_id having count(*) > 1 union all select 'dangling', doc_id, count(*)::bigint from labels where doc_id not in (select doc_id from documents) group by doc_id union all select 'checked', null, count(*)::bigint from labels")
def sc10(spark, sf_dir):
    """Corpus ids are unique and every judged id resolves."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    twice = docs.groupBy("doc_id").count().where("count > 1").select(F.lit("duplicate").alias("problem"), F.col("doc_id").alias("id"), F.col("count").alias("n"))
    dangling = labels.join(docs, "doc_id", "left_anti").groupBy("doc_id").count().select(F.lit("dangling"), "doc_id", "count")
    return twice.union(dangling).union(labels.agg(F.count("*")).select(F.lit("checked"), F.lit(None).cast("long"), "count(1)"))


@query("sc13_ledger_fingerprint", "select conv_id as session_id, sha256(string_agg(text, chr(10) order by turn)) as fingerprint, count(*)::bigint as n from conversations group by conv_id")
def sc13(spark, sf_dir):
    """The digest of a transcript tells whether it was extracted already."""
    w = F.sort_array(F.collect_list(F.struct("message_index", "text")))
    return messages(spark, sf_dir).groupBy("session_id").agg(F.sha2(F.concat_ws("\n", F.transform(w, lambda x: x["text"])), 256).alias("fingerprint"), F.count("*").alias("n"))


@query("fp1_query_filter_grammar", f"{WITH_MEM} select id, type, created_at from mem where type = 'EN' and strftime(created_at, '%Y-%m-%d') >= '2024-01-03' and strftime(created_at, '%Y-%m-%d') <= '2024-02-02' and contains(lower(content), 'th')")
def fp1(spark, sf_dir):
    m = memories(spark, sf_dir)
    _, parts = X.inline_filters(F.lit("find type:EN after:2024-01-03 before:2024-02-02 symbol:TH words"))
    return m.where(X.allowed(parts, X.SEARCH_KEYS + X.RESULT_KEYS, m.content, m.created_at, m.type, m.project)).select("id", "type", "created_at")


@query("fp2_scope_filter", f"{WITH_MEM} select id, project from mem where project in ('src1', 'src3') or project = ''")
def fp2(spark, sf_dir):
    m = memories(spark, sf_dir)
    return m.where(X.in_scope(m.project, ["src1", "src3"])).select("id", "project")


@query("fp3_path_fold_plan", r"with p as (select url, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '://(www|m|blog)\.', '://') as folded from pages) select folded, count(*)::bigint as n, count(distinct url)::bigint as n_forms from p where folded <> url group by folded")
def fp3(spark, sf_dir):
    """Which spellings fold onto which path, with counts."""
    u = F.col("url")
    folded = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "/+$", ""), r"://(www|m|blog)\.", "://")
    return table(spark, sf_dir, "pages").select("url", folded.alias("folded")).where("folded <> url").groupBy("folded").agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_forms"))


@query("fp4_rejection_gate", "with r as (select user_id as query_id, event_id, row_number() over (partition by user_id order by event_id) as rank, value as score from events) select query_id, event_id, rank::bigint as rank, score from r where query_id in (select query_id from r where rank = 1 and score >= 40)")
def fp4(spark, sf_dir):
    w = Window.partitionBy("query_id").orderBy("event_id")
    ranked = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), "event_id", F.col("value").alias("score")).withColumn("rank", F.row_number().over(w).cast("long"))
    return X.rejection_gate(ranked, 40.0).select("query_id", "event_id", "rank", "score")


@query("fp5_budget_truncate", f"{WITH_MEM}, c as (select project as query_id, id, greatest(1, length(content) // 4)::bigint as cost, row_number() over (partition by project order by confidence desc, id) as rank from mem), t as (select *, sum(cost) over (partition by query_id order by rank)::bigint as total from c) select query_id, id, cost, total from t where rank = 1 or total <= 2000")
def fp5(spark, sf_dir):
    """Projects may hold a third of all rows: their running costs are added up over partitions."""
    cost = F.greatest(F.lit(1), F.floor(F.length("content") / 4)).cast("long")
    rows = memories(spark, sf_dir).select(F.col("project").alias("query_id"), "id", "confidence", cost.alias("cost"))
    return placed(rows, ["query_id"], [F.desc("confidence"), F.col("id")], {"total": F.col("cost")}).where("place = 1 or total <= 2000").select("query_id", "id", "cost", "total")


@query("fp6_dormant_filter", f"{WITH_MEM}, {SQL_USAGE}, dorm as (select memory_id from ev group by 1 having count(*) filter (kind = 'use') < count(*) filter (kind = 'noise')) select id, type from mem where id not in (select memory_id from dorm)")
def fp6(spark, sf_dir):
    u = usage_events(spark, sf_dir).groupBy("memory_id").agg((F.count_if(F.col("kind") == "use") < F.count_if(F.col("kind") == "noise")).alias("dormant"))
    return X.not_dormant(memories(spark, sf_dir).select("id", "type"), u)


@query("fp8_dimension_predicate", "select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderpriority as keyword from orders where strftime(o_orderdate, '%Y-%m-%d') between '1997-01-01' and '1998-06-30' and lower(o_orderpriority) = lower('1-urgent')")
def fp8(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").where(day.between("1997-01-01", "1998-06-30") & (F.lower("o_orderpriority") == "1-urgent")).select(F.col("o_orderkey").alias("id"), day.alias("day"), F.col("o_orderpriority").alias("keyword"))


@query("fp9_bitemporal_filter", f"with {SQL_EDGES} select id, subject, predicate, object from kg where valid_from <= timestamp '1998-01-01' and (valid_to is null or timestamp '1998-01-01' < valid_to) and occurred_at >= timestamp '1996-01-01'")
def fp9(spark, sf_dir):
    return X.as_of(edges(spark, sf_dir), at="1998-01-01 00:00:00", since="1996-01-01 00:00:00").select("id", "subject", "predicate", "object")


def _claim_sql(c: str) -> str:
    words = ", ".join(f"'{w}'" for w in X_.CLAIM_STOP + X_.NEGATIONS)
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9''\\-]*'), lambda x: not list_contains([{words}], x)), lambda x: case when length(x) > 3 and x like '%s' then substr(x, 1, length(x) - 1) else x end))"


def _values_sql(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, '\\d[\\d,./:\\-]*\\d|\\d'), lambda x: trim(replace(x, ',', ''), '.:-/')), lambda x: x <> '')"


def _negated_sql(c: str) -> str:
    return f"(list_has_any(regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9''\\-]*'), [{', '.join(repr(w) for w in X_.NEGATIONS)}]) or contains(lower({c}), 'n''t'))"


@query(
    "fp10_extraction_validation",
    f"""with s as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as source from conversations),
t as (select conv_id, turn, {_claim_sql('text')} as claim, {_claim_sql('source')} as src, {_values_sql('text')} as nums, {_values_sql('source')} as src_nums, {_negated_sql('text')} = {_negated_sql('source')} as same from s where source is not null),
v as (select conv_id, turn, case when len(claim) = 0 then 1 else len(list_intersect(claim, src))::double / len(claim) end as support, len(list_filter(nums, lambda x: not list_contains(src_nums, x))) = 0 as values_ok, same as polarity_ok from t)
select conv_id, turn, round(support, 3) as support, values_ok, polarity_ok, support >= 0.5 and values_ok and polarity_ok as ok from v""",
)
def fp10(spark, sf_dir):
    """A turn as a claim on the turn before: shared content words, numbers found there, the same polarity."""
    w = Window.partitionBy("session_id").orderBy("message_index")
    rows = messages(spark, sf_dir).withColumn("source", F.lag("text").over(w)).where("source is not null")
    t, s = F.col("text"), F.col("source")
    rows = rows.select(F.col("session_id").alias("conv_id"), F.col("message_index").alias("turn"), T.claim_words(t).alias("claim"), T.claim_words(s).alias("src"), (F.size(F.array_except(T.hard_values(t), T.hard_values(s))) == 0).alias("values_ok"), (T.negated(t) == T.negated(s)).alias("polarity_ok"))
    support = F.when(F.size("claim") == 0, 1.0).otherwise(F.size(F.array_intersect("claim", "src")) / F.size("claim"))
    return rows.select("conv_id", "turn", F.round(support, 3).alias("support"), "values_ok", "polarity_ok", ((support >= 0.5) & F.col("values_ok") & F.col("polarity_ok")).alias("ok"))


@query("fp11_freshness_window", "select event_id, event_type from events where ts is null or epoch_us(timestamp '2024-01-31') - epoch_us(ts) <= 7 * 86400000000")
def fp11(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(X.fresh(F.col("ts").cast("timestamp"), F.lit("2024-01-31 00:00:00").cast("timestamp"), 7)).select("event_id", "event_type")


def _said(pattern: str, c: str) -> str:
    return f"regexp_matches({c}, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"


@query("fp12_recall_triage", f"select conv_id, turn, case when t = '' then 'skip' when {_said(X_.NEEDS_MEMORY, 't')} then 'recall' when {_said(X_.ACKNOWLEDGED, 't')} then 'skip' when {_said(X_.ASKS_TIME, 't')} then 'skip' when {_said(X_.SELF_CONTAINED, 't')} and length(t) < 400 then 'skip' else 'uncertain' end as verdict from (select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from conversations where role = 'user')")
def fp12(spark, sf_dir):
    from tessera.operators.planning import triage

    return messages(spark, sf_dir).where("role = 'user'").select(F.col("session_id").alias("conv_id"), F.col("message_index").alias("turn"), triage(F.col("text")).alias("verdict"))


PATTERNS = [Pattern(r"--force\b", "--force-with-lease"), Pattern("("), Pattern(r"rm -rf /", "", "deny")]
PROGRAMS = {"grep": "rg", "pip": "uv pip", "npm": "bun", "pytest": "pytest -q"}
SHAPES = {
    "click": ["grep -r x{} src", "cat a | grep x", 'echo "grep"', "  grep y"],
    "view": ["git push --force", "sudo rm -rf / now", "cd /tmp && pip install k", "PYTHON=3 pip list"],
    "purchase": ['bash -c "npm test"', "npm run build", "/usr/bin/npm ci", "sh -lc 'cd x; npm i'"],
    "signup": ["uv run --with x pytest -q", "uv run python a.py", "env A=1 time grep z", "ls"],
    "error": ["pip install 'a", "", "pip", "python -m pip list"],
}
#: What must come out, worked out by hand: by kind and shape, the action, the rule and the new command.
EXPECTED = [
    ("click", 0, "rewrite", "grep", "rg -r x{} src"), ("click", 1, "deny", "grep", None), ("click", 3, "rewrite", "grep", "  rg y"),
    ("view", 0, "rewrite", "1", "git push --force-with-lease"), ("view", 1, "deny", "3", None), ("view", 2, "deny", "pip", None), ("view", 3, "deny", "pip", None),
    ("purchase", 0, "deny", "npm", None), ("purchase", 1, "rewrite", "npm", "bun run build"), ("purchase", 2, "deny", "npm", None), ("purchase", 3, "deny", "npm", None),
    ("signup", 0, "deny", "pytest", None), ("signup", 2, "deny", "grep", None), ("error", 0, "deny", "pip", None), ("error", 2, "rewrite", "pip", "uv pip"),
]
SQL_EXPECTED = ", ".join(f"('{e}', {v}, '{a}', '{r}', {'null' if c is None else chr(39) + c + chr(39)})" for e, v, a, r, c in EXPECTED)


@query("fp13_redirect_rules", f"with x(e, v, action, rule, command) as (values {SQL_EXPECTED}) select event_id, action, rule, replace(command, '{{}}', event_id::varchar) as command from events left join x on e = event_type and v = user_id % 4")
def fp13(spark, sf_dir):
    """Commands of many shapes through pattern and program rules; the malformed pattern is left out."""
    command = F.lit(None).cast("string")
    for kind, forms in SHAPES.items():
        for v, form in enumerate(forms):
            made = F.replace(F.lit(form), F.lit("{}"), F.col("event_id").cast("string"))
            command = F.when((F.col("event_type") == kind) & (F.col("user_id") % 4 == v), made).otherwise(command)
    rows = table(spark, sf_dir, "events").select("event_id", command.alias("command"))
    return rows.select("event_id", decisions(F.col("command"), PATTERNS, PROGRAMS).alias("d")).select("event_id", "d.action", "d.rule", "d.command")


RULES = (
    """
[redirect]
mode = "rewrite"
[[redirect.rules]]
program = "grep"
replacement = "rg"
[[redirect.rules]]
program = "NPM.cmd"
replacement = "bun"
[[redirect.rules]]
pattern = "curl (\\\\S+) \\\\| sh"
mode = "deny"
[[redirect.rules]]
program = "make"
replacement = "just"
""",
    "not [ toml",
    """
[[redirect.rules]]
program = "grep"
replacement = "ugrep"
[[redirect.rules]]
program = "make"
enabled = false
[[redirect.rules]]
pattern = "v(\\\\d+)-old"
rewrite = "v$1-new"
""",
)


@query(
    "sc14_redirect_rules",
    r"""with c as (select event_id, user_id % 10 as p, case event_id % 6 when 0 then 'cmd /c ' when 1 then 'pwsh -NoProfile -Command ' when 2 then '' when 3 then 'X=1 ' when 4 then '' else 'bash -c ' end as pre,
  ['grep', 'npm', 'make', 'C:/bin/Grep.EXE', 'ls'][1 + event_id % 5] as prog, event_type as arg, event_id % 7 as old from events),
f as (select event_id, pre, prog, case when pre = 'bash -c ' then pre || chr(39) || prog || ' ' || arg || chr(39) else pre || prog || ' ' || arg end as plain,
  case when old = 0 then ' v' || p || '-old' when old = 1 then ' ; curl ' || p || ' | sh' else '' end as tail, old, p from c),
d as (select event_id, plain || tail as cmd, case lower(replace(replace(prog, 'C:/bin/', ''), '.EXE', '')) when 'grep' then 'ugrep' when 'npm' then 'bun' end as new, lower(replace(replace(prog, 'C:/bin/', ''), '.EXE', '')) as name, pre, prog, plain, tail, old, p from f)
select event_id, case when old = 1 then 'deny' when old = 0 then 'rewrite' when new is null then null when pre = '' and prog in ('grep', 'npm') then 'rewrite' else 'deny' end as action,
  case when old = 1 then '1' when old = 0 then '2' when new is not null then name end as rule,
  case when old = 0 then plain || ' v' || p || '-new' when old <> 1 and new is not null and pre = '' and prog in ('grep', 'npm') then new || substr(plain, length(prog) + 1) end as command from d""",
)
def sc14_rules(spark, sf_dir):
    """Commands made from events, decided by rules of layered TOML files (one of them broken)."""
    e = table(spark, sf_dir, "events")
    at = lambda items, k: F.element_at(F.array(*map(F.lit, items)), (k + 1).cast("int"))
    pre = at(["cmd /c ", "pwsh -NoProfile -Command ", "", "X=1 ", "", "bash -c "], F.col("event_id") % 6)
    said = F.concat(at(["grep", "npm", "make", "C:/bin/Grep.EXE", "ls"], F.col("event_id") % 5), F.lit(" "), F.col("event_type"))
    plain = F.when(F.col("event_id") % 6 == 5, F.concat(pre, F.lit("'"), said, F.lit("'"))).otherwise(F.concat(pre, said))
    p = (F.col("user_id") % 10).cast("string")
    tail = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit(" v"), p, F.lit("-old"))).when(F.col("event_id") % 7 == 1, F.concat(F.lit(" ; curl "), p, F.lit(" | sh"))).otherwise("")
    patterns, programs, mode = rules_of(*RULES)
    rows = e.select("event_id", F.concat(plain, tail).alias("command"))
    return rows.select("event_id", decisions(F.col("command"), patterns, programs, mode).alias("d")).select("event_id", "d.action", "d.rule", "d.command")


@query("fp14_field_projection", f"{WITH_MEM} select id, confidence, session from mem")
def fp14(spark, sf_dir):
    m = memories(spark, sf_dir)
    return m.select(*[c for c in ("id", "confidence", "session", "nothing") if c in m.columns])
