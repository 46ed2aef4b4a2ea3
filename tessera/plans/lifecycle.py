"""Lifecycle queries: usage events, versions, demand, decay, sets and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import lexicon as X
from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.operators import lifecycle as L
from tessera.operators.ordered import placed
from tessera.sources.tables import SQL_MEMORIES, SQL_USAGE, memories, table, usage_events

EV = f"with {SQL_USAGE}"
COUNTERS = "cnt as (select memory_id, count(*) filter (kind = 'match')::bigint as match_count, count(*) filter (kind = 'inject')::bigint as inject_count, count(*) filter (kind = 'use')::bigint as use_count, count(*) filter (kind = 'noise')::bigint as noise_count, count(*) filter (kind = 'save')::bigint as save_count, max(ts) filter (kind = 'use') as last_used from ev group by 1)"
NOW = "2024-02-01 00:00:00"


@query("a1_demand_log", "select lower(event_type) || ' ' || props as q, count(*)::bigint as ask_count, count(*) filter (value < 10)::bigint as zero_count, round(sum(value / 500), 4) as best_sum, greatest(0.0, max(value / 500)) as best_max, max(ts) as last_asked from events group by 1")
def a1(spark, sf_dir):
    return L.demand_log(asks(spark, sf_dir))


def asks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws("  ", F.upper("event_type"), "props").alias("query"), (F.col("value") / 500).alias("best"), F.when(F.col("value") < 10, 0).otherwise(1).alias("hits"), "ts")


@query("a2_demand_gaps", "with d as (select lower(event_type) || ' ' || props as q, count(*)::bigint as ask_count, round(sum(value / 500), 4) as best_sum, greatest(0.0, max(value / 500)) as best_max from events group by 1) select q, ask_count, best_max, round(best_sum / ask_count, 4) as avg_best from d where ask_count >= 3 and best_max < 0.35")
def a2(spark, sf_dir):
    return L.demand_gaps(L.demand_log(asks(spark, sf_dir)), max_best=0.35).select("q", "ask_count", "best_max", "avg_best")


@query("a3_promotion_candidates", f"{EV}, {COUNTERS}, s as (select memory_id, count(distinct session)::bigint as use_sessions from ev where kind = 'use' group by 1) select c.memory_id, use_count, noise_count, coalesce(use_sessions, 0)::bigint as use_sessions from cnt c left join s using (memory_id) where use_count >= 3 and not noise_count / use_count >= 1.0")
def a3(spark, sf_dir):
    ev = usage_events(spark, sf_dir)
    return L.promotion_candidates(L.usage_counters(ev), ev, max_noise=1.0).withColumn("use_sessions", F.col("use_sessions").cast("long"))


@query("a4_distinct_use_sessions", f"{EV} select memory_id, count(distinct session)::bigint as use_sessions, min(ts) as first_use from ev where kind = 'use' group by memory_id")
def a4(spark, sf_dir):
    return usage_events(spark, sf_dir).where("kind = 'use'").groupBy("memory_id").agg(F.countDistinct("session").alias("use_sessions"), F.min("ts").alias("first_use"))


@query("a5_repeat_failures", r"""with e as (select event_id, ts, props as signature, user_id::varchar as session, 'E' || (event_id % 3) as error_type from events where event_type = 'error'),
c as (select signature, count(distinct session)::bigint as sessions, count(*)::bigint as occurrences, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6, 4) as span_days, arg_min(error_type, struct_pack(t := ts, e := event_id)) as first_type from e group by 1)
select * from c where sessions >= 2 and span_days >= 3""")
def a5(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return L.repeat_failures(e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("signature"), F.col("user_id").cast("string").alias("session"), F.concat(F.lit("E"), F.col("event_id") % 3).alias("error_type")))


@query("a6_error_type_counts", "select event_type, props, count(*)::bigint as n from events where event_type = 'error' group by all order by n desc, props limit 10")
def a6(spark, sf_dir):
    """The ten most frequent errors: a top-k report."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("event_type", "props").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "props").limit(10)


@query("a7_error_cooccurrence", "with n as (select event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events) select least(a, b) || '|' || greatest(a, b) as pair, count(*)::bigint as n from n where b is not null group by 1")
def a7(spark, sf_dir):
    return L.cooccurrence(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], ["user_id"])


STRENGTH = f"""{COUNTERS}, st as (select id, type, project, created_at, round(greatest(0, least(1, (pow(0.5, greatest((epoch_us(timestamp '{NOW}') - epoch_us(created_at)) / 86400e6, 0) / 30) + (1 - pow(0.5, greatest((epoch_us(timestamp '{NOW}') - epoch_us(created_at)) / 86400e6, 0) / 30)) * (1 - exp(-coalesce(use_count, 0)::double / 5))) * (1 + 0.2 * 0.0))), 6) as strength from mem left join cnt on memory_id = id)"""


def strengths(spark, sf_dir):
    c = L.usage_counters(usage_events(spark, sf_dir)).select(F.col("memory_id").alias("id"), "use_count")
    m = memories(spark, sf_dir).join(c, "id", "left")
    age = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros("created_at")) / 86400e6
    return m.select("id", "type", "project", "created_at", F.round(S.strength(age, F.coalesce("use_count", F.lit(0)).cast("double"), F.lit(0.0)), 6).alias("strength"))


@query("memory_strength", f"with {SQL_MEMORIES}, {SQL_USAGE}, {STRENGTH} select id, strength from st")
def strength(spark, sf_dir):
    return strengths(spark, sf_dir).select("id", "strength")


@query("a8_decay_capacity", f"with {SQL_MEMORIES}, {SQL_USAGE}, {STRENGTH} select id, type, project, row_number() over (partition by type, project order by strength desc, id)::int as place from st qualify place > 5")
def a8(spark, sf_dir):
    return L.over_capacity(strengths(spark, sf_dir), ["type", "project"], 5).select("id", "type", "project", F.col("place").cast("int").alias("place"))


@query("st11_decay_transitions", f"with {SQL_MEMORIES}, {SQL_USAGE}, {STRENGTH} select id, strength, case when type = 'SYSTEM' then 'keep' when strength < 0.6 then 'demote' when strength >= 0.95 then 'revive' else 'keep' end as proposed from st")
def st11(spark, sf_dir):
    """The proposed changes of a maintenance pass, not applied."""
    s = F.col("strength")
    proposed = F.when(F.col("type") == "SYSTEM", "keep").when(s < 0.6, "demote").when(s >= 0.95, "revive").otherwise("keep")
    return strengths(spark, sf_dir).select("id", "strength", proposed.alias("proposed"))


@query("a12_usage_counters", f"{EV}, {COUNTERS} select * from cnt")
def a12(spark, sf_dir):
    return L.usage_counters(usage_events(spark, sf_dir))


@query("a13_feedback_score", f"{EV} select memory_id, round(list_reduce(list_prepend(0.0::double, list(case kind when 'use' then 0.25 when 'noise' then -0.4 when 'save' then 0.1 else 0.05 end::double order by ts, event_id)), lambda a, x: greatest(-1, least(1, a + x))), 6) as feedback from ev group by memory_id")
def a13(spark, sf_dir):
    k = F.col("kind")
    delta = F.when(k == "use", 0.25).when(k == "noise", -0.4).when(k == "save", 0.1).otherwise(0.05)
    return L.feedback_scores(usage_events(spark, sf_dir), delta, ["ts", "event_id"]).select("memory_id", F.round("feedback", 6).alias("feedback"))


@query("a14_graduation_readiness", f"{EV}, {COUNTERS} select round((epoch_us(timestamp '{NOW}') - (select epoch_us(min(ts)) from ev)) / 86400e6, 4) as signal_days, round(count(*) filter (last_used is not null)::double / count(*) filter (match_count > 0), 6) as used_ratio from cnt")
def a14(spark, sf_dir):
    ev = usage_events(spark, sf_dir)
    first = ev.agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("t"))
    c = L.usage_counters(ev).agg(F.round(F.count_if(F.col("last_used").isNotNull()) / F.count_if(F.col("match_count") > 0), 6).alias("used_ratio"))
    return first.join(F.broadcast(c)).select(F.round((F.unix_micros(F.lit(NOW).cast("timestamp")) - F.col("t")) / 86400e6, 4).alias("signal_days"), "used_ratio")


SOURCE_CASE = " ".join(f"when {i} then {w}" for i, w in enumerate(X.SOURCE_WEIGHTS.values()))
ORIGIN_CASE = " ".join(f"when {i} then {w}" for i, w in enumerate(X.ORIGIN_WEIGHTS.values()))


@query("trust_score", f"{EV}, {COUNTERS} select memory_id, round(0.9::double * (case memory_id % 7 {SOURCE_CASE} else 0.85 end)::double * (case memory_id % 8 {ORIGIN_CASE} else 1.0 end)::double * (case memory_id % 2 when 0 then 1.08 else 1.0 end)::double + least(0.2, 0.03 * use_count + 0.02 * save_count + 0.01 * match_count)::double, 4) as trust from cnt")
def trust(spark, sf_dir):
    """Sources and origins in turn, unknown ones among them."""
    c = L.usage_counters(usage_events(spark, sf_dir))
    turn = lambda names, n: F.element_at(F.array(*map(F.lit, [*names, "other"])), (F.col("memory_id") % n + 1).cast("int"))
    kind = F.when(F.col("memory_id") % 2 == 0, "decision").otherwise("whatever")
    return c.select("memory_id", S.trust(F.lit(0.9), turn(X.SOURCE_WEIGHTS, 7), turn(X.ORIGIN_WEIGHTS, 8), kind, F.col("use_count"), F.col("save_count"), F.col("match_count")).alias("trust"))


@query("w1_latest_version", "select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def w1(spark, sf_dir):
    return L.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("w2_latest_pending", "select o_custkey, o_orderkey from orders p where o_orderstatus = 'P' and not exists (select 1 from orders d where d.o_custkey = p.o_custkey and d.o_orderstatus <> 'P' and d.o_orderpriority = p.o_orderpriority) qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def w2(spark, sf_dir):
    """The last pending row of each key among those that no decision settles."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    decided = o.where("o_orderstatus <> 'P'").select("o_custkey", "o_orderpriority")
    return L.latest(o.where("o_orderstatus = 'P'").join(decided, ["o_custkey", "o_orderpriority"], "left_anti"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("w4_minmax_normalise", "select event_id, round(case when max(value) over w = min(value) over w then 1 else (value - min(value) over w) / (max(value) over w - min(value) over w) end, 6) as scaled from events window w as (partition by user_id)")
def w4(spark, sf_dir):
    from tessera.operators.fusion import min_max

    return table(spark, sf_dir, "events").select("event_id", F.round(min_max(F.col("value"), Window.partitionBy("user_id")), 6).alias("scaled"))


@query("w7_latest_two_delta", "with r as (select o_orderpriority as dataset, o_orderstatus as split, o_orderkey as run, o_totalprice as score, row_number() over (partition by o_orderpriority, o_orderstatus order by o_orderdate desc, o_orderkey desc) as n from orders) select a.dataset, a.split, a.run, a.score, b.run as previous, round(a.score - b.score, 4) as delta from r a left join r b on a.dataset = b.dataset and a.split = b.split and b.n = 2 where a.n = 1")
def w7(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("split"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("score"), "o_orderdate")
    w = Window.partitionBy("dataset", "split").orderBy(F.desc("o_orderdate"), F.desc("run"))
    two = o.withColumn("n", F.row_number().over(w)).where("n <= 2")
    return two.groupBy("dataset", "split").agg(F.max(F.when(F.col("n") == 1, F.col("run"))).alias("run"), F.max(F.when(F.col("n") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("n") == 2, F.col("run"))).alias("previous"), F.max(F.when(F.col("n") == 2, F.col("score"))).alias("s2")).select("dataset", "split", "run", "score", "previous", F.round(F.col("score") - F.col("s2"), 4).alias("delta"))


@query("w9_ring_buffer", "select user_id, event_id from events qualify row_number() over (partition by user_id order by event_id desc) <= 20")
def w9(spark, sf_dir):
    """The last twenty rows of each log: the bound is the feature."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id").withColumn("n", F.row_number().over(w)).where("n <= 20").drop("n")


@query("w10_lru_evict", "with c as (select event_type as cache, user_id as key, max(ts) as last_used from events group by all), n as (select *, row_number() over (partition by cache order by last_used, key) as r, count(*) over (partition by cache) as n from c) select cache, key from n where n > 100 and r <= n - 90")
def w10(spark, sf_dir):
    """Caches over 100 keys lose the least recently used down to 90."""
    c = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("cache"), F.col("user_id").alias("key")).agg(F.max("ts").alias("last_used"))
    return placed(c, ["cache"], [F.col("last_used"), F.col("key")]).where("group_size > 100 and place <= group_size - 90").select("cache", "key")


@query("w11_superseded_demote", "with o as (select o_custkey, o_orderkey, lead(o_orderkey) over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as successor, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) select o_custkey, o_orderkey, successor, row_number() over (partition by o_custkey order by (successor is not null)::int, rank)::int as new_rank from o")
def w11(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    o = o.withColumn("successor", F.lead("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey"))).withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    return o.select("o_custkey", "o_orderkey", "successor", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("successor").isNotNull().cast("int"), "rank")).alias("new_rank"))


@query("w12_cases_per_category", "select source, doc_id from documents where length(text) > 200 qualify row_number() over (partition by source order by doc_id) <= 3")
def w12(spark, sf_dir):
    """A balanced sample: the first three answerable cases of each category."""
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf_dir, "documents").where(F.length("text") > 200).select("source", "doc_id").withColumn("n", F.row_number().over(w)).where("n <= 3").drop("n")


@query("g7_supersession_chain", "with recursive l as (select o_orderkey as old, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as new from orders), k as (select old, new from l where new is not null), c as (select old as start, new as last, 1 as hops from k union all select c.start, k.new, c.hops + 1 from c join k on k.old = c.last) select start, arg_max(last, hops) as last, max(hops)::int as hops from c group by start")
def g7(spark, sf_dir):
    """Where each version's chain of successors ends."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("old"), F.lead("o_orderkey").over(w).alias("new")).where("new is not null")
    return L.supersession_chain(links)


@query("j13_drift_audit", "with p as (select doc_id as id from documents), m as (select doc_id as id from labels union select page_id * 4 + 100 from pages), u as (select distinct user_id * 9 as id from events) select id, 'missing' as drift from p where id not in (select id from m) union all select id, 'ghost' from m where id not in (select id from p) union all select id, 'orphan' from u where id not in (select id from p)")
def j13(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    m = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).union(table(spark, sf_dir, "pages").select((F.col("page_id") * 4 + 100).alias("id")))
    return L.drift(p, m, table(spark, sf_dir, "events").select((F.col("user_id") * 9).alias("id")))


@query("conflict_pairs", "select distinct least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b, first_value(l_orderkey) over (partition by least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) order by l_shipdate, l_orderkey, l_linenumber) as first_order from lineitem")
def conflict_pairs(spark, sf_dir):
    """Unordered pairs, the first record of each wins."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.min_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("first_order"))


@query("t4_hash_split", "select doc_id, case when ('0x' || substr(sha1(doc_id::varchar), 1, 8))::ubigint / 4294967295.0 < 0.3 then 'dev' else 'test' end as split from documents")
def t4(spark, sf_dir):
    h = F.conv(F.substring(F.sha1(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("double") / 4294967295
    return table(spark, sf_dir, "documents").select("doc_id", F.when(h < 0.3, "dev").otherwise("test").alias("split"))


@query("t6_stable_digests", "select doc_id, substr(sha256(text), 1, 16) as digest, substr(sha1(lang || '|' || source), 1, 12) as scope from documents")
def t6(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("digest"), F.substring(F.sha1(F.concat_ws("|", "lang", "source")), 1, 12).alias("scope"))


@query("so4_triple_dedup", "select lower(trim(o_orderpriority)) as s, o_orderstatus as p, o_custkey as o, min(o_orderkey) as first_id from orders group by all")
def so4(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.lower(F.trim("o_orderpriority")).alias("s"), F.col("o_orderstatus").alias("p"), F.col("o_custkey").alias("o")).agg(F.min("o_orderkey").alias("first_id"))


@query("so2_set_differences", "select 'except' as op, count(*)::bigint as n from (select p_partkey from part except select l_partkey from lineitem) union all select 'intersect', count(*)::bigint from (select c_custkey from customer intersect select o_custkey from orders) union all select 'union', count(*)::bigint from (select s_nationkey from supplier union select c_nationkey from customer)")
def so2(spark, sf_dir):
    t = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("k"))
    parts = [("except", t("part", "p_partkey").subtract(t("lineitem", "l_partkey"))), ("intersect", t("customer", "c_custkey").intersect(t("orders", "o_custkey"))), ("union", t("supplier", "s_nationkey").union(t("customer", "c_nationkey")).distinct())]
    out = [d.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, d in parts]
    return out[0].union(out[1]).union(out[2])


@query("so6_insert_ignore", "select doc_id from labels where doc_id not in (select doc_id from labels where toxic = 1) group by doc_id")
def so6(spark, sf_dir):
    """New keys only: an anti-join append."""
    l = table(spark, sf_dir, "labels")  # noqa: E741
    return l.select("doc_id").join(l.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").distinct()


@query("a29_token_df", "select t, count(*)::bigint as df from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from documents) group by t")
def a29(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))


@query("a30_surprisal", "with d as (select t, count(*) as df from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from documents) group by t) select t, round(-log2((df + 0.5) / ((select count(*) from documents) + 1)), 6) as bits from d where length(t) >= 6")
def a30(spark, sf_dir):
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return a29(spark, sf_dir).where(F.length("t") >= 6).join(F.broadcast(n)).select("t", F.round(T.surprisal(F.col("df"), F.col("n")), 6).alias("bits"))


@query("a31_session_groups", f"with {SQL_MEMORIES} select session, count(*) filter (type <> 'SYSTEM')::bigint as members, bool_or(type = 'ES') as has_episode from mem where session <> '' group by session having count(*) filter (type <> 'SYSTEM') >= 5 and not bool_or(type = 'ES')")
def a31(spark, sf_dir):
    return memories(spark, sf_dir).where("session <> ''").groupBy("session").agg(F.count_if(F.col("type") != "SYSTEM").alias("members"), F.bool_or(F.col("type") == "ES").alias("has_episode")).where("members >= 5 and not has_episode")


@query("a35_activity_tally", "select event_type, count(*)::bigint as n from events group by event_type")
def a35(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("a37_digest", f"{EV}, {COUNTERS} select (select count(*) from cnt where use_count >= 3)::bigint as promotable, (select count(*) from orders where o_orderstatus = 'P')::bigint as pending, (select count(*) from (select props from events where event_type = 'error' group by 1 having count(distinct user_id) >= 2))::bigint as repeated, (select round(avg(value), 4) from events) as mean_value")
def a37(spark, sf_dir):
    """A dashboard of one row: scalars of single-row aggregates."""
    c = L.usage_counters(usage_events(spark, sf_dir)).agg(F.count_if(F.col("use_count") >= 3).alias("promotable"))
    p = table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderstatus") == "P").alias("pending"))
    r = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("props").agg(F.countDistinct("user_id").alias("u")).agg(F.count_if(F.col("u") >= 2).alias("repeated"))
    m = table(spark, sf_dir, "events").agg(F.round(F.avg("value"), 4).alias("mean_value"))
    return c.join(F.broadcast(p)).join(F.broadcast(r)).join(F.broadcast(m))


@query("st8_asset_staleness", "with a as (select user_id, max(ts) filter (event_type = 'purchase') as made from events group by 1) select e.user_id, made is null or count(*) filter (e.ts > made) >= 15 or epoch_us(max(e.ts)) - epoch_us(made) >= 5 * 86400000000 as stale from events e join a using (user_id) group by e.user_id, made")
def st8(spark, sf_dir):
    """Stale: never made, fifteen new events since, or five days."""
    e = table(spark, sf_dir, "events")
    made = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("made"))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    j = e.select("user_id", "ts").join(made, "user_id").groupBy("user_id", "made").agg(F.count_if(F.col("ts") > F.col("made")).alias("n"), F.max("ts").alias("last"))
    return j.select("user_id", (F.col("made").isNull() | (F.col("n") >= 15) | (us(F.col("last")) - us(F.col("made")) >= 5 * 86400000000)).alias("stale"))


@query("st6_task_queue_states", "with t as (select user_id as task, event_id, event_type, row_number() over (partition by user_id order by event_id desc) as n, count(*) filter (event_type = 'error') over (partition by user_id) as attempts from events) select task, case when event_type = 'purchase' then 'done' when attempts >= 15 then 'dead' when event_type = 'error' then 'retry' else 'ready' end as state, least(pow(2, attempts), 3600)::double as backoff_s from t where n = 1")
def st6(spark, sf_dir):
    """Each task's state from its log, with the capped exponential delay of its next attempt."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("task")).agg(F.max_by("event_type", "event_id").alias("last"), F.count_if(F.col("event_type") == "error").alias("attempts"))
    state = F.when(F.col("last") == "purchase", "done").when(F.col("attempts") >= 15, "dead").when(F.col("last") == "error", "retry").otherwise("ready")
    return e.select("task", state.alias("state"), F.least(F.pow(F.lit(2.0), "attempts"), F.lit(3600.0)).alias("backoff_s"))
