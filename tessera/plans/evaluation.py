"""Evaluation: retrieval metrics, accuracy by category, uncertain aggregates and diagnostics."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators import bm25
from tessera.operators import metrics as M
from tessera.operators import uncertain as U
from tessera.operators.graph import kept
from tessera.plans.recall import bm25_sql
from tessera.plans.retrieval import near_sql, vectors
from tessera.operators.ordered import placed
from tessera.operators.selection import percentiles
from tessera.operators.vector import topk
from tessera.sources.tables import messages, table

RANKED = f"""{near_sql(10)}, gold as (select q.vec_id as case_id, c.vec_id as id from embeddings q join embeddings c on q.label = c.label and q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
sz as (select case_id, count(*) as n from gold group by 1), hits as (select n.query_id as case_id, n.rank, (n.query_id, n.vec_id) in (select case_id, id from gold) as rel from near n)"""
METRICS = f"""{RANKED}, mt as (select h.case_id, round(count(*) filter (rel)::double / any_value(n), 6) as recall, case when count(*) filter (rel) = any_value(n) then 1.0 else 0.0 end::double as bridge, round(count(*) filter (rel) / 10, 6)::double as precision,
 count(*) filter (rel) > 0 as hit, round(coalesce(1 / min(rank) filter (rel), 0), 6)::double as mrr, round(coalesce(sum(1 / log2(rank + 1)) filter (rel), 0) / list_sum(list_transform(range(1, least(any_value(n), 10) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg from hits h join sz using (case_id) group by 1)"""


def metrics(spark, sf_dir):
    """The gold of a case are all other rows of its label: told by comparing labels, never as pairs."""
    q, e = vectors(spark, sf_dir)
    own = q.select(F.col("vec_id").alias("case_id"), F.col("label").alias("own"))
    ranked = topk(q, e, 10).select(F.col("query_id").alias("case_id"), F.col("vec_id").alias("id"), "rank")
    marked = ranked.join(own, "case_id").join(e.select(F.col("vec_id").alias("id"), "label"), "id").select("case_id", "id", "rank", (F.col("label") == F.col("own")).alias("hit"))
    return M.marked_metrics(marked, gold_sizes(q, e), 10)


def gold_sizes(q, e):
    """(case_id, n_gold): how many other rows have a case's label."""
    sizes = e.groupBy(F.col("label").alias("own")).agg((F.count("*") - 1).alias("n_gold"))
    return q.select(F.col("vec_id").alias("case_id"), F.col("label").alias("own")).join(sizes, "own").where("n_gold > 0").select("case_id", "n_gold")


for _name, _col in (("e1_recall_at_k", "recall"), ("e2_bridge_recall_at_k", "bridge"), ("e3_precision_at_k", "precision"), ("e4_hit_at_k", "hit"), ("e5_mrr", "mrr"), ("e6_ndcg_at_k", "ndcg")):
    query(_name, f"with {METRICS} select case_id, {_col} from mt")(lambda spark, sf_dir, c=_col: metrics(spark, sf_dir).select("case_id", c))


LATENCY = "lat as (select percentile_cont(0.5) within group (order by value) as p50, percentile_cont(0.95) within group (order by value) as p95 from events where event_type = 'view')"


@query("e7_run_eval", f"with {METRICS}, {LATENCY} select count(*)::bigint as cases, round(avg(recall), 6) as recall, round(avg(precision), 6) as precision, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg, round((select p50 from lat), 6) as latency_p50, round((select p95 from lat), 6) as latency_p95 from mt")
def e7(spark, sf_dir):
    """The mean metrics of a run, with its latencies' percentiles (here the values of the view events)."""
    lat = percentiles(table(spark, sf_dir, "events").where("event_type = 'view'"), [], "value", {"latency_p50": 0.5, "latency_p95": 0.95})
    lat = lat.select(*[F.round(c, 6).alias(c) for c in ("latency_p50", "latency_p95")])
    return metrics(spark, sf_dir).agg(F.count("*").alias("cases"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg")]).join(F.broadcast(lat), F.lit(True), "left")


@query("e8_run_recall_by_category", f"with {METRICS} select coalesce('label' || label, 'all') as category, count(*)::bigint as n, round(avg(recall), 6) as recall from mt join embeddings on vec_id = case_id group by rollup(label)")
def e8(spark, sf_dir):
    rows = metrics(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), "label"), "case_id")
    return rows.rollup("label").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall")).select(F.coalesce(F.concat(F.lit("label"), "label"), F.lit("all")).alias("category"), "n", "recall")


READBACK = f"""{near_sql(10)}, q as (select vec_id as case_id, label as session from embeddings where vec_id % 20 = 0),
held as (select case_id, session, vec_id as id, (vec_id + case_id) % 3 = 0 as answer from q join embeddings on label = session and vec_id <> case_id),
narrow as (select case_id, count(*) as width, count(*) filter (answer) as n from held group by 1), gold as (select case_id, id from held join narrow using (case_id) where answer or n = 0),
sz as (select case_id, count(*) as n from gold group by 1), rd as (select case_id, id, row_number() over (partition by case_id order by id) as place from held),
slow as (select case_id, count(*) filter (place <= 10) as hits, min(place) as first from rd join gold using (case_id, id) group by 1),
fast as (select query_id as case_id, count(*) as hits from near join gold on gold.case_id = query_id and id = vec_id group by 1)"""


@query("e9_readback_ceiling", f"with {READBACK} select case_id, width::bigint as width, sz.n::bigint as gold, round(s.hits / sz.n::double, 6) as ceiling, round(1 / first::double, 6) as mrr, round(coalesce(f.hits, 0) / sz.n::double, 6) as recall, round((s.hits - coalesce(f.hits, 0)) / sz.n::double, 6) as delta, width > 10 as too_wide from sz join slow s using (case_id) join narrow using (case_id) left join fast f using (case_id)")
def e9(spark, sf_dir):
    """Reading the gold sessions back in the corpus's order: recall at ten and the first hit, and what the search misses of it.

    The gold is narrower than its session: the rows that answer (told by the remainders of the ids), or the whole
    session where none does. A session's rows are put in order once, and a case is told from counts, from the first
    rows and from the first two of each remainder: no list of (case, row) pairs.
    """
    q, e = vectors(spark, sf_dir)
    at = placed(e.select(F.col("vec_id").alias("id"), F.col("label").alias("session")), ["session"], [F.col("id")])
    at = kept(at.select("session", "id", F.col("place").alias("p"), F.col("group_size").alias("size"), F.pmod("id", F.lit(3)).alias("kind")))
    first = at.groupBy("session", "kind").agg(F.count("*").alias("of_kind"), F.min("p").alias("p1"))
    second = at.join(first, ["session", "kind"]).where("p > p1").groupBy("session", "kind").agg(F.min("p").alias("p2"))
    kinds = first.join(second, ["session", "kind"], "left").withColumnRenamed("kind", "want")
    early = at.where("p <= 11").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("p", "kind"))).alias("early"))  # eleven rows at most
    cases = at.join(q.select(F.col("vec_id").alias("id")), "id", "left_semi").where("size > 1").withColumn("want", F.pmod(-F.col("kind"), F.lit(3))).withColumnRenamed("id", "case_id")
    c = cases.join(kinds, ["session", "want"], "left").join(early, "session")
    n = F.coalesce("of_kind", F.lit(0)) - (F.col("kind") == F.col("want")).cast("long")
    c = c.withColumn("some", n > 0).withColumn("gold", F.when(n > 0, n).otherwise(F.col("size") - 1))
    hit = F.when(F.col("p1") != F.col("p"), F.col("p1")).otherwise(F.col("p2"))
    place = F.when(F.col("some"), hit - (F.col("p") < hit).cast("long")).otherwise(1)
    read = F.slice(F.filter("early", lambda x: x["p"] != F.col("p")), 1, 10)
    c = c.withColumn("hits", F.size(F.filter(read, lambda x: ~F.col("some") | (x["kind"] == F.col("want"))))).withColumn("first", place)
    near = topk(q, e, 10).select(F.col("query_id").alias("case_id"), F.col("vec_id").alias("id")).join(at.select("id", F.col("session").alias("s"), F.col("kind").alias("k")), "id")
    found = near.join(c.select("case_id", "session", "want", "some"), "case_id").where("s = session and (not some or k = want)").groupBy("case_id").agg(F.count("*").alias("found"))
    g, got = F.col("gold"), F.coalesce("found", F.lit(0))
    out = c.join(found, "case_id", "left").withColumn("width", F.col("size") - 1)
    return out.select("case_id", "width", "gold", F.round(F.col("hits") / g, 6).alias("ceiling"), F.round(1 / F.col("first"), 6).alias("mrr"), F.round(got / g, 6).alias("recall"), F.round((F.col("hits") - got) / g, 6).alias("delta"), (F.col("width") > 10).alias("too_wide"))


GATE = """with r as (select o_orderstatus as run, o_orderpriority = '1-URGENT' as contradictory, o_totalprice / 500000 as recall, 1.0 / (1 + o_orderkey % 10) as mrr from orders where o_orderstatus in ('F', 'O')),
d as (select avg(recall) filter (run = 'F') - avg(recall) filter (run = 'O') as recall, avg(mrr) filter (run = 'F') - avg(mrr) filter (run = 'O') as mrr,
  avg(recall) filter (run = 'F' and contradictory) - avg(recall) filter (run = 'O' and contradictory) as c_recall, avg(mrr) filter (run = 'F' and contradictory) - avg(mrr) filter (run = 'O' and contradictory) as c_mrr from r)
select round(recall, 6) as overall_recall_delta, round(c_recall, 6) as contradictory_recall_delta, round(mrr, 6) as overall_mrr_delta, round(c_mrr, 6) as contradictory_mrr_delta, 2 * c_recall + recall > 0 as objective_positive,
  c_recall > 0 as contradictory_lift, recall > 0 as overall_lift, c_mrr >= -0.01 as contradictory_mrr_guard, mrr >= -0.005 as overall_mrr_guard,
  2 * c_recall + recall > 0 and c_recall > 0 and recall > 0 and c_mrr >= -0.01 and mrr >= -0.005 as promote from d"""


@query("e10_promotion_gate", GATE)
def e10(spark, sf_dir):
    """Whether a run may replace another: its objective and both recalls gain, and neither early rank loses more than its guard."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')")
    rows = o.select((F.col("o_orderstatus") == "F").alias("new"), (F.col("o_orderpriority") == "1-URGENT").alias("contradictory"), (F.col("o_totalprice") / 500000).alias("recall"), (F.lit(1.0) / (1 + F.col("o_orderkey") % 10)).alias("mrr"))
    return M.promotion_gate(rows)


@query("e11_recurrence_hit_rate", "with f as (select props, min(ts) as first from events where event_type = 'view' group by 1) select round(count(*) filter (f.first < e.ts) / count(*)::double, 6) as rate, count(*)::bigint as n from events e left join f using (props) where e.event_type = 'click'")
def e11(spark, sf_dir):
    """The share of later questions that an earlier conclusion matches."""
    e = table(spark, sf_dir, "events")
    f = e.where("event_type = 'view'").groupBy("props").agg(F.min("ts").alias("first"))
    return e.where("event_type = 'click'").join(f, "props", "left").agg(F.round(F.count_if(F.col("first") < F.col("ts")) / F.count("*"), 6).alias("rate"), F.count("*").alias("n"))


@query("a23_qa_accuracy", "select coalesce(c, 'all') as category, count(*)::bigint as n, round(avg(quality::double), 6) as accuracy from (select case when doc_id % 31 = 0 then '?' else lang end as c, quality from labels join documents using (doc_id)) group by rollup(c)")
def a23(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 31 == 0, "").otherwise(F.col("lang")).alias("lang"))
    return M.accuracy_by(table(spark, sf_dir, "labels").join(d, "doc_id"), "lang", F.col("quality") == 1)


@query("a24_halumem_rates", "select coalesce(lang, 'all') as type, round(avg((quality = 1 and toxic = 0)::int), 6) as accuracy, round(avg((toxic = 1)::int), 6) as hallucination, round(avg((quality = 0 and toxic = 0)::int), 6) as omission from labels join documents using (doc_id) group by grouping sets ((lang), ())")
def a24(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rate = lambda c: F.round(F.avg(F.expr(c).cast("double")), 6)
    out = rows.groupingSets([["lang"], []], "lang").agg(rate("quality = 1 and toxic = 0").alias("accuracy"), rate("toxic = 1").alias("hallucination"), rate("quality = 0 and toxic = 0").alias("omission"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("type"), "accuracy", "hallucination", "omission")


@query("a25_relation_accuracy", "select coalesce(l_returnflag, 'all') as relation, count(*)::bigint as n, round(avg((l_linestatus = 'F')::int), 6) as accuracy, round(avg((l_discount > 0.05)::int), 6) as contradictory from lineitem group by rollup(l_returnflag)")
def a25(spark, sf_dir):
    rate = lambda c: F.round(F.avg(F.expr(c).cast("double")), 6)
    out = table(spark, sf_dir, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("n"), rate("l_linestatus = 'F'").alias("accuracy"), rate("l_discount > 0.05").alias("contradictory"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("relation"), "n", "accuracy", "contradictory")


A26 = """with c as (select o_orderkey, o_orderpriority as relation, count(l_orderkey) as target, count(*) filter (l_returnflag = 'A') as hit, count(*) filter (l_linestatus = 'F') as readback from orders left join lineitem on l_orderkey = o_orderkey group by all),
g as (select relation, case when target = 0 then 'no_target' when hit = target then 'complete' when readback > hit then 'retrieval_gap' when hit > 0 then 'partial' else 'missing' end as gap from c),
n as (select relation, gap, count(*)::bigint as n from g group by all)
select relation, gap, n, case when gap in ('complete', 'no_target') then 'keep' when gap = 'retrieval_gap' then 'widen_retrieval' when gap = 'partial' then 'expand_sessions' else 'check_index' end as recommendation,
  row_number() over (partition by relation order by (gap in ('complete', 'no_target'))::int, n desc, gap) = 1 as first_to_do from n"""


@query("a26_failure_ledger", A26)
def a26(spark, sf_dir):
    """Cases by what stands between what was found and what reading back would find, with what to do about it; the commonest gap comes first."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("relation"))
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("target"), F.count_if(F.col("l_returnflag") == "A").alias("hit"), F.count_if(F.col("l_linestatus") == "F").alias("readback"))  # noqa: E741
    c = o.join(l, "o_orderkey", "left").fillna(0)
    gap = F.when(F.col("target") == 0, "no_target").when(F.col("hit") == F.col("target"), "complete").when(F.col("readback") > F.col("hit"), "retrieval_gap").when(F.col("hit") > 0, "partial").otherwise("missing")
    n = c.groupBy("relation", gap.alias("gap")).agg(F.count("*").alias("n"))  # at most five rows a relation
    g, fine = F.col("gap"), F.col("gap").isin("complete", "no_target")
    do = F.when(fine, "keep").when(g == "retrieval_gap", "widen_retrieval").when(g == "partial", "expand_sessions").otherwise("check_index")
    w = Window.partitionBy("relation").orderBy(fine.cast("int"), F.desc("n"), "gap")
    return n.select("relation", "gap", "n", do.alias("recommendation"), (F.row_number().over(w) == 1).alias("first_to_do"))


@query("a27_latency_percentiles", "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def a27(spark, sf_dir):
    return percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}).select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("a27_exclusive_percentile", "with r as (select user_id, value, row_number() over (partition by user_id order by value) as i, count(*) over (partition by user_id) as n from events), p as (select user_id, n, 0.95 * (n + 1) as place, greatest(1, least(floor(0.95 * (n + 1)), n - 1)) as j from r group by all), e as (select p.user_id, p.n, place - j as frac, min(value) filter (i = j) as lo, min(value) filter (i = j + 1) as hi from p join r using (user_id) group by all) select user_id, case when n < 2 then 0.0 else round(lo + frac * (hi - lo), 6) end as percentile from e")
def a27x(spark, sf_dir):
    return percentiles(table(spark, sf_dir, "events"), ["user_id"], "value", {"percentile": 0.95}, exclusive=True).select("user_id", F.round("percentile", 6).alias("percentile"))


@query("a33_keep_drop_prf", "with s as (select count(*) filter (quality = 1 and toxic = 0)::double as tp, count(*) filter (quality = 1)::double as kept, count(*) filter (toxic = 0)::double as gold from labels) select round(tp / kept, 6) as precision, round(tp / gold, 6) as recall, round(2 * tp / (kept + gold), 6) as f1 from s")
def a33(spark, sf_dir):
    s = table(spark, sf_dir, "labels").agg(F.count_if(F.expr("quality = 1 and toxic = 0")).alias("tp"), F.count_if(F.expr("quality = 1")).alias("kept"), F.count_if(F.expr("toxic = 0")).alias("gold"))
    return s.select(F.round(F.col("tp") / F.col("kept"), 6).alias("precision"), F.round(F.col("tp") / F.col("gold"), 6).alias("recall"), F.round(2 * F.col("tp") / (F.col("kept") + F.col("gold")), 6).alias("f1"))


@query("a34_detection_prf", "with p as (select l_orderkey as a, l_partkey as b from lineitem where l_discount >= 0.09), f as (select distinct o_orderkey as id from orders where o_totalprice > 400000) select count(*) filter (a in (select id from f) or b in (select id from f))::bigint as tp, count(*)::bigint as pairs, (select count(*) from f where id not in (select a from p) and id not in (select b from p))::bigint as fp from p")
def a34(spark, sf_dir):
    """A pair is found if either of its ends is flagged; flags outside all pairs are false."""
    p = table(spark, sf_dir, "lineitem").where("l_discount >= 0.09").select(F.monotonically_increasing_id().alias("i"), F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))
    f = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("id")).distinct()
    ends = p.select("i", F.explode(F.array("a", "b")).alias("id"))
    flagged = ends.join(f.withColumn("x", F.lit(1)), "id", "left").groupBy("i").agg(F.max("x").alias("x"))
    fp = f.join(ends.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("fp"))
    return flagged.agg(F.count("x").alias("tp"), F.count("*").alias("pairs")).join(F.broadcast(fp))


@query("a36_kg_ceiling", "select round(avg((quality = 1)::int), 6) as baseline, round(avg((quality = 1 or toxic = 0)::int), 6) as reachable, count(*) filter (quality = 0 and toxic = 0)::bigint as headroom from labels")
def a36(spark, sf_dir):
    rate = lambda c: F.round(F.avg(F.expr(c).cast("double")), 6)
    return table(spark, sf_dir, "labels").agg(rate("quality = 1").alias("baseline"), rate("quality = 1 or toxic = 0").alias("reachable"), F.count_if(F.expr("quality = 0 and toxic = 0")).alias("headroom"))


STATUS = "case when l_returnflag = 'R' then 'Excluded' when l_linestatus = 'F' then 'In' else 'Possible' end"
INDIV = f"mn as (select l_orderkey as grp, l_suppkey as label, {STATUS} as status, case when l_linenumber % 5 = 0 then null else l_extendedprice end as value, l_linenumber * 1000000 + l_partkey as ord from lineitem), iv as (select grp, label, bool_or(status = 'In') as certain, coalesce(arg_min(value, struct_pack(a := (status <> 'In')::int, b := ord)) filter (value is not null), 0) as amount from mn where status <> 'Excluded' group by all)"


def individuals(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "R", "Excluded").when(F.col("l_linestatus") == "F", "In").otherwise("Possible")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_suppkey").alias("label"), status.alias("status"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_extendedprice")).alias("value"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"))
    return U.individuals(rows, ["grp"], "label", "status", "value", F.col("ord"))


@query("a15_individuate_count", f"with {INDIV} select grp, count(*) filter (certain)::bigint as count_lower, count(*)::bigint as count_upper from iv group by grp")
def a15(spark, sf_dir):
    return U.count_and_sum(individuals(spark, sf_dir), ["grp"]).select("grp", "count_lower", "count_upper")


@query("a16_individuate_sum", f"with {INDIV} select grp, round(coalesce(sum(amount) filter (certain), 0), 2) as sum_lower, round(sum(amount), 2) as sum_upper from iv group by grp")
def a16(spark, sf_dir):
    return U.count_and_sum(individuals(spark, sf_dir), ["grp"]).select("grp", "sum_lower", "sum_upper")


@query("a17_envelope_aggregate", f"with b as (select l_suppkey as grp, {STATUS} as tag, l_extendedprice as usd, strftime(l_shipdate, '%Y-%m-%d') as day from lineitem) select grp, round(coalesce(sum(usd) filter (tag = 'In'), 0), 2) as certain_usd, round(coalesce(sum(usd) filter (tag <> 'Excluded'), 0), 2) as possible_usd, count(distinct day) filter (tag = 'In')::bigint as certain_days, count(distinct day) filter (tag <> 'Excluded')::bigint as possible_days from b group by grp")
def a17(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "R", "Excluded").when(F.col("l_linestatus") == "F", "In").otherwise("Possible")
    b = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), status.alias("tag"), F.col("l_extendedprice").alias("usd"), F.to_date("l_shipdate").alias("day"))
    sure, may = F.col("tag") == "In", F.col("tag") != "Excluded"
    total = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("usd"))), F.lit(0.0)), 2)
    return b.groupBy("grp").agg(total(sure).alias("certain_usd"), total(may).alias("possible_usd"), F.countDistinct(F.when(sure, F.col("day"))).alias("certain_days"), F.countDistinct(F.when(may, F.col("day"))).alias("possible_days"))


@query("a18_vote_tag", "with v as (select user_id % 50 as unit, props, case event_type when 'purchase' then 'in' when 'error' then 'out' when 'view' then 'contested' else 'unsure' end as tag, event_id from events), c as (select unit, props, tag, count(*) as c, min(event_id) as seen from v group by all), s as (select unit, props, coalesce(sum(c) filter (tag = 'in'), 0) as i, coalesce(sum(c) filter (tag = 'out'), 0) as o, coalesce(sum(c) filter (tag = 'contested'), 0) as x, sum(c) as n, arg_max(tag, struct_pack(c := c, s := -seen)) as mode from c group by all) select unit, props, case when i > 0 and o > 0 then 'contested' when x * 2 >= n then 'contested' else mode end as tag, n::bigint as votes from s")
def a18(spark, sf_dir):
    e = F.col("event_type")
    tag = F.when(e == "purchase", "in").when(e == "error", "out").when(e == "view", "contested").otherwise("unsure")
    v = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("unit"), "props", tag.alias("tag"), "event_id")
    return U.vote_tag(v, ["unit", "props"], "tag", "event_id")


@query("a19_answer_space", "select o_orderpriority as question, min(o_totalprice) as lower, max(o_totalprice) as upper, round(min(least(o_totalprice / 500000, 0.9, 0.5 + (o_orderkey % 40) / 100.0)), 6)::double as reliability from orders group by 1")
def a19(spark, sf_dir):
    r = F.least(F.col("o_totalprice") / 500000, F.lit(0.9), 0.5 + (F.col("o_orderkey") % 40) / 100)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("question")).agg(F.min("o_totalprice").alias("lower"), F.max("o_totalprice").alias("upper"), F.round(F.min(r), 6).alias("reliability"))


@query("a20_above_average", "select c_custkey, c_mktsegment from customer c where c_acctbal > (select avg(c_acctbal) from customer x where x.c_mktsegment = c.c_mktsegment)")
def a20(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    mean = c.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m"))
    return c.join(mean, "c_mktsegment").where("c_acctbal > m").select("c_custkey", "c_mktsegment")


PLACES = """with s as (select s_suppkey, n_name as city, r_name as metro, s_acctbal from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
c as (select n_name as city, r_name as metro from nation join region on n_regionkey = r_regionkey),
k as (select c.city, count(s_suppkey) filter (s.city = c.city) as in_city, count(s_suppkey) as in_metro, count(s_suppkey) filter (s_acctbal <= 3000) as in_radius from c left join s on s.metro = c.metro group by 1)
select city, in_city::bigint as in_city, in_metro::bigint as in_metro, in_radius::bigint as in_radius, least(in_city, in_metro, in_radius)::bigint as lower, greatest(in_city, in_metro, in_radius)::bigint as upper from k"""


@query("a20_place_programs", PLACES)
def a20_places(spark, sf_dir):
    """How many suppliers are in a city, as its bounds, its metropolitan area or a distance (here the balance) are meant, and the answers between which that leaves.

    Counts of a city and of its area are joined, never the area's suppliers to each of its cities.
    """
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("metro"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("in_city"), F.count_if(F.col("s_acctbal") <= 3000).alias("near"))
    rows = c.join(s, "n_nationkey", "left").fillna(0)
    metro = rows.groupBy("metro").agg(F.sum("in_city").alias("in_metro"), F.sum("near").alias("in_radius"))
    k = rows.join(metro, "metro")
    cols = ["in_city", "in_metro", "in_radius"]
    return k.select("city", *cols, F.least(*cols).alias("lower"), F.greatest(*cols).alias("upper"))


BRANDS = """with b as (select p_brand as name, count(*) as as_brand from lineitem join part on p_partkey = l_partkey group by 1), m as (select 'Brand#' || (l_suppkey % 60) as name, count(*) as as_merchant from lineitem group by 1)
select coalesce(b.name, m.name) as name, coalesce(as_brand, 0)::bigint as as_brand, coalesce(as_merchant, 0)::bigint as as_merchant, least(coalesce(as_brand, 0), coalesce(as_merchant, 0))::bigint as lower, (coalesce(as_brand, 0) + coalesce(as_merchant, 0))::bigint as upper from b full join m using (name)"""


@query("a20_brand_or_merchant", BRANDS)
def a20_brands(spark, sf_dir):
    """A name as a brand or as the one who sells: both counts, and the answers between which that leaves."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")  # noqa: E741
    b = l.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("as_brand"))
    m = l.groupBy(F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 60).cast("string")).alias("name")).agg(F.count("*").alias("as_merchant"))
    return b.join(m, "name", "full_outer").fillna(0, ["as_brand", "as_merchant"]).select("name", "as_brand", "as_merchant", F.least("as_brand", "as_merchant").alias("lower"), (F.col("as_brand") + F.col("as_merchant")).alias("upper"))


@query("a20_top_percentile", "select c_custkey from (select c_custkey, percent_rank() over (partition by c_nationkey order by c_acctbal) as p from customer) where p >= 0.9")
def a20p(spark, sf_dir):
    """Equal balances share the first one's place; a nation may hold a third of all customers."""
    c = placed(table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", "c_custkey"), ["c_nationkey"], [F.col("c_acctbal"), F.col("c_custkey")])
    first = c.groupBy("c_nationkey", "c_acctbal").agg(F.min("place").alias("first"))
    p = F.when(F.col("group_size") == 1, 0.0).otherwise((F.col("first") - 1) / (F.col("group_size") - 1))
    return c.join(first, ["c_nationkey", "c_acctbal"]).where(p >= 0.9).select("c_custkey")


@query("a20_recent_births", "select o_orderkey, case when o_orderdate >= timestamp '1998-01-01' then 'must' when o_orderdate >= timestamp '1997-06-01' then 'possible' else 'outside' end as status from orders")
def a20b(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(d >= F.lit("1998-01-01").cast("timestamp"), "must").when(d >= F.lit("1997-06-01").cast("timestamp"), "possible").otherwise("outside").alias("status"))


@query("a21_semantic_sum", "with d as (select l_orderkey as q, l_partkey as key, max(l_quantity) as v from lineitem group by all) select q, sum(v) as total, count(*)::bigint as bindings, (select 1)::int * (max(v) - min(v)) as difference from d group by q")
def a21(spark, sf_dir):
    """Facts with one key count once; the sum, the number of bindings and a difference."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("key")).agg(F.max("l_quantity").alias("v"))
    return d.groupBy("q").agg(F.sum("v").alias("total"), F.count("*").alias("bindings"), (F.max("v") - F.min("v")).alias("difference"))


@query("a22_compiled_answer", "select l_suppkey as unit, count(distinct l_partkey) filter (l_returnflag <> 'R')::bigint as n, case when count(*) filter (l_linenumber = 7) > 0 then null else round(sum(l_quantity), 2) end as total from lineitem group by 1")
def a22(spark, sf_dir):
    value = F.when(F.col("l_linenumber") != 7, F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(F.countDistinct(F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))).alias("n"), F.round(U.null_strict_sum(value), 2).alias("total"))


@query("x1_recompute_answer", "select l_orderkey as q, count(*) filter (l_linestatus = 'F')::bigint as n, round(coalesce(sum(l_extendedprice) filter (l_linestatus = 'F'), 0), 2) as total, case when count(*) filter (l_linestatus = 'F') = 1 then max(l_extendedprice) filter (l_linestatus = 'F') end as lookup from lineitem group by 1")
def x1(spark, sf_dir):
    inc = F.col("l_linestatus") == "F"
    v = F.when(inc, F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.count_if(inc).alias("n"), F.round(F.coalesce(F.sum(v), F.lit(0.0)), 2).alias("total"), F.when(F.count_if(inc) == 1, F.max(v)).alias("lookup"))


X2 = """with s as (select conv_id, string_agg(text, ' ' order by turn) as whole, arg_max(text, turn) as last from conversations group by 1),
q as (select conv_id, case when conv_id % 3 = 0 then translate(last, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') when conv_id % 3 = 1 then last || ' never said' else last end as span, case when conv_id % 7 = 0 then conv_id + 1000000000 else conv_id end as session from s)
select q.conv_id, s.conv_id is not null as session_exists, coalesce(contains(lower(whole), lower(span)), false) as resolved from q left join s on s.conv_id = q.session"""


@query("x2_span_resolution", X2)
def x2(spark, sf_dir):
    """Whether a quoted span stands, in any case, in the session that it names; the spans are whole last turns, some of them changed."""
    c = messages(spark, sf_dir).groupBy("session_id").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("message_index", "text"))), lambda x: x["text"])).alias("whole"), F.max_by("text", "message_index").alias("last"))
    k = F.col("session_id")
    span = F.when(k % 3 == 0, F.translate("last", ascii_lowercase, ascii_uppercase)).when(k % 3 == 1, F.concat("last", F.lit(" never said"))).otherwise(F.col("last"))
    q = c.select(k.alias("conv_id"), span.alias("span"), F.when(k % 7 == 0, k + 1000000000).otherwise(k).alias("session_id"))
    j = q.join(c.select("session_id", "whole"), "session_id", "left")
    return j.select("conv_id", F.col("whole").isNotNull().alias("session_exists"), F.coalesce(F.contains(F.lower("whole"), F.lower("span")), F.lit(False)).alias("resolved"))


@query("x4_decision_histogram", "select props as label, count(*) filter (event_type = 'purchase')::bigint as included, count(*)::bigint as samples, count(*) filter (event_type = 'purchase') > 0 and count(*) filter (event_type = 'purchase') < count(*) as unstable from events group by 1")
def x4(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("props").alias("label")).agg(F.count_if(F.col("event_type") == "purchase").alias("included"), F.count("*").alias("samples"))
    return e.withColumn("unstable", (F.col("included") > 0) & (F.col("included") < F.col("samples")))


@query("x5_mutation_sensitivity", "with u as (select l_orderkey as q, l_quantity as v, l_linestatus = 'F' as inc from lineitem), i as (select q, v, count(*) as n from u where inc group by all), x as (select q, v, count(*) as n from u where not inc group by all) select q, coalesce(sum(i.n * x.n), 0)::bigint as unchanged_swaps, (select count(*) from u u1 where u1.q = i.q and inc)::bigint as included from i left join x using (q, v) group by q")
def x5(spark, sf_dir):
    """Swapping an included for an excluded unit leaves a sum as it is exactly if their values are equal."""
    u = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_quantity").alias("v"), (F.col("l_linestatus") == "F").alias("inc"))
    c = u.groupBy("q", "v").agg(F.count_if("inc").alias("i"), F.count_if(~F.col("inc")).alias("x"))
    return c.groupBy("q").agg(F.sum(F.col("i") * F.col("x")).alias("unchanged_swaps"), F.sum("i").alias("included")).where("included > 0")


@query("x6_fact_consistency", "with f as (select l_orderkey as session, least(l_partkey % 20, l_suppkey % 20) as a, greatest(l_partkey % 20, l_suppkey % 20) as b, l_returnflag as rel from lineitem) select distinct x.session, x.a, x.b from f x join f y using (session, a, b) where x.rel = 'A' and y.rel = 'R'")
def x6(spark, sf_dir):
    """Pairs that one session holds to be the same and to be distinct."""
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), F.least(F.col("l_partkey") % 20, F.col("l_suppkey") % 20).alias("a"), F.greatest(F.col("l_partkey") % 20, F.col("l_suppkey") % 20).alias("b"), "l_returnflag")
    return f.groupBy("session", "a", "b").agg(F.bool_or(F.col("l_returnflag") == "A").alias("same"), F.bool_or(F.col("l_returnflag") == "R").alias("other")).where("same and other").select("session", "a", "b")


@query("x7_missing_units", "with u as (select l_suppkey as s, count(*) as n, count(*) filter (l_partkey not in (select p_partkey from part where p_size <= 40)) as missing from lineitem where l_linestatus = 'F' group by 1) select s, n::bigint as n, missing::bigint as missing, case when missing = 0 then 'complete' when missing * 4 <= n then 'minor' when missing < n then 'major' else 'empty' end as verdict from u")
def x7(spark, sf_dir):
    have = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("ok"))
    u = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select("l_partkey", F.col("l_suppkey").alias("s")).join(have, "l_partkey", "left")
    g = u.groupBy("s").agg(F.count("*").alias("n"), F.count_if(F.col("ok").isNull()).alias("missing"))
    v = F.when(F.col("missing") == 0, "complete").when(F.col("missing") * 4 <= F.col("n"), "minor").when(F.col("missing") < F.col("n"), "major").otherwise("empty")
    return g.withColumn("verdict", v)


@query("x8_duplicate_interpretations", "select user_id as case_id, event_id from events qualify row_number() over (partition by user_id, props order by event_id) > 1")
def x8(spark, sf_dir):
    w = Window.partitionBy("user_id", "props").orderBy("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), "event_id", F.row_number().over(w).alias("n")).where("n > 1").drop("n")


CONCEPTS = {"tools": ["bolt", "gear"], "jewels": ["ring"], "things": ["widget", "thing"]}


@query("x9_concept_match", "select p_partkey, concept from part, (values ('tools', '(bolt|gear)'), ('jewels', '(ring)'), ('things', '(widget|thing)')) c(concept, pattern) where regexp_matches(lower(p_name), pattern)")
def x9(spark, sf_dir):
    """A concept applies if any of its terms is in the text; the lexicon is written by people and small."""
    hits = F.array_compact(F.array(*[F.when(F.lower("p_name").rlike("(" + "|".join(ts) + ")"), c) for c, ts in CONCEPTS.items()]))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(hits).alias("concept"))


@query("x10_weakest_link", "select l_orderkey as q, round(min(1 - l_discount), 6) as reliability from lineitem group by 1")
def x10(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.round(F.min(1 - F.col("l_discount")), 6).alias("reliability"))


@query("x12_candidate_select", "select o_orderkey, case when o_orderpriority like '1%' and o_totalprice > 0 then 'priced' when o_orderdate >= timestamp '1999-01-01' then 'dated' when o_orderstatus = 'F' then 'typed' end as kind from orders where (o_orderpriority like '1%' and o_totalprice > 0) or o_orderdate >= timestamp '1999-01-01' or o_orderstatus = 'F'")
def x12(spark, sf_dir):
    kind = F.when(F.startswith("o_orderpriority", F.lit("1")) & (F.col("o_totalprice") > 0), "priced").when(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp"), "dated").when(F.col("o_orderstatus") == "F", "typed")
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind")).where("kind is not null")


X15 = f"""with terms as (select 0 as query_id, unnest(['license', 'apache', 'mit']) as term), {bm25_sql("found", "select doc_id as id, text from documents")},
facts as (select 1 as section, row_number() over (order by o_orderdate desc, o_orderkey) as place, 'order ' || o_orderkey || ' ' || o_orderpriority as line from orders qualify place <= 5),
top as (select id, row_number() over (order by score, id) as rank from found qualify rank <= 50),
areas as (select 2 as section, row_number() over (order by min(rank)) as place, source || ' by ' || arg_min(doc_id, rank) as line from top join documents on doc_id = id group by source qualify place <= 3),
sess as (select 3 as section, row_number() over (order by conv_id desc) as place, 'session ' || conv_id || ' of ' || count(*) || ' turns' as line from conversations group by conv_id qualify place <= 3),
hits as (select 4 as section, rank as place, 'hit ' || id as line from top where rank <= 5),
u as (select * from facts union all select * from areas union all select * from sess union all select * from hits),
c as (select section, place, line, sum(length(line) + 3) over (order by section, place) as upto from u)
select section, place::int as place, case when upto <= 400 then line else left(line, (length(line) - (upto - 400))::int) end as line from c where upto - length(line) < 400"""


@query("x15_project_context", X15)
def x15(spark, sf_dir):
    """The sections of a context, five latest facts, the three areas of the best hits, three latest sessions and five hits of a keyword search, cut at 400 characters. Limits are the feature."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_orderpriority").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5)
    docs = table(spark, sf_dir, "documents")
    asked = spark.createDataFrame([(0, t) for t in ("license", "apache", "mit")], "query_id long, term string")
    top = bm25.search(docs, asked, 50).select(F.col("id").alias("doc_id"), "rank")
    areas = docs.select("doc_id", "source").join(top, "doc_id").groupBy("source").agg(F.min("rank").alias("rank"), F.min_by("doc_id", "rank").alias("doc_id"))  # fifty rows at most
    s = messages(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n")).orderBy(F.desc("session_id")).limit(3)
    words = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    c = F.col
    sections = [
        (o, [F.desc("o_orderdate"), c("o_orderkey")], words("order ", c("o_orderkey"), " ", c("o_orderpriority"))),
        (areas.orderBy("rank").limit(3), [c("rank")], words(c("source"), " by ", c("doc_id"))),
        (s, [F.desc("session_id")], words("session ", c("session_id"), " of ", c("n"), " turns")),
        (top.where("rank <= 5"), [c("rank")], words("hit ", c("doc_id"))),
    ]
    rows = None
    for i, (df, order, line) in enumerate(sections, 1):  # at most sixteen rows
        part = df.select(F.lit(i).alias("section"), F.row_number().over(Window.partitionBy(F.lit(i)).orderBy(*order)).alias("place"), line.alias("line"))
        rows = part if rows is None else rows.unionByName(part)
    upto = F.sum(F.length("line") + 3).over(Window.partitionBy(F.lit(0)).orderBy("section", "place"))
    rows = rows.withColumn("upto", upto).where(c("upto") - F.length("line") < 400)
    return rows.select("section", "place", F.expr("case when upto <= 400 then line else left(line, cast(length(line) - (upto - 400) as int)) end").alias("line"))


X16 = """with s as (select source, doc_id, length(text) >= 100 as ok from documents), n as (select source, doc_id, row_number() over (partition by source order by doc_id desc) as r, count(*) over (partition by source) as n from s where ok)
select source, any_value(n)::bigint as n, count(*)::bigint as used, min(doc_id) as oldest, any_value(n) >= 10 as enough, (abs(hash_cycle) % 5 = 0) and any_value(n) >= 10 as eligible from (select *, ascii(right(source, 1)) as hash_cycle from n where r <= 100) group by source, hash_cycle"""


@query("x16_reflection_eligibility", X16)
def x16(spark, sf_dir):
    """Sources with ten usable rows reflect every fifth cycle (here the source's number), over their newest hundred rows."""
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 100).select("source", "doc_id")
    n = d.groupBy("source").agg(F.count("*").alias("n"))
    new = d.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))).where("r <= 100").groupBy("source").agg(F.count("*").alias("used"), F.min("doc_id").alias("oldest"))
    enough = F.col("n") >= 10
    return n.join(new, "source").select("source", "n", "used", "oldest", enough.alias("enough"), (enough & (F.ascii(F.substring("source", -1, 1)) % 5 == 0)).alias("eligible"))


@query("x17_digest_corpus", "select conv_id || '::dig' || j as id, length(part)::bigint as n_chars from (select conv_id, unnest(string_split(string_agg(text, chr(10) order by turn), chr(10))) as part, generate_subscripts(string_split(string_agg(text, chr(10) order by turn), chr(10)), 1) - 1 as j from conversations group by conv_id) where trim(part) <> ''")
def x17(spark, sf_dir):
    """A session's text through a digest callback (here: its lines) becomes new memories; empty replies none."""
    turns = F.transform(F.sort_array(F.collect_list(F.struct("message_index", "text"))), lambda x: x["text"])
    s = messages(spark, sf_dir).groupBy("session_id").agg(F.concat_ws("\n", turns).alias("whole"))
    p = s.select("session_id", F.posexplode(F.split("whole", "\n")).alias("j", "part")).where(F.trim("part") != "")
    return p.select(F.concat("session_id", F.lit("::dig"), "j").alias("id"), F.length("part").cast("long").alias("n_chars"))


@query("x18_provenance_report", "select sum(('0x' || substr(md5(doc_id || ':' || quality), 1, 8))::bigint)::bigint as dataset_hash, count(*)::bigint as n, count(*) filter (toxic = 1)::bigint as excluded from labels")
def x18(spark, sf_dir):
    """A digest of the judged set that its order does not change, with its counts."""
    h = F.conv(F.substring(F.md5(F.concat("doc_id", F.lit(":"), "quality")), 1, 8), 16, 10).cast("long")
    return table(spark, sf_dir, "labels").agg(F.sum(h).alias("dataset_hash"), F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("excluded"))


@query("x19_payload_ab_diff", "with a as (select l_orderkey as k, sum(l_quantity) as v from lineitem where l_linestatus = 'F' group by 1), b as (select l_orderkey as k, sum(l_quantity) as v from lineitem where l_returnflag <> 'R' group by 1) select coalesce(a.k, b.k) as k, case when a.k is null then 'added' when b.k is null then 'removed' when a.v = b.v then 'same' when b.v > a.v then 'better' else 'worse' end as outcome from a full join b on a.k = b.k")
def x19(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    g = l.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("a"), F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).alias("b")).where("a is not null or b is not null")
    o = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").when(F.col("b") > F.col("a"), "better").otherwise("worse")
    return g.select("k", o.alias("outcome"))


@query("e12_leaderboard", "with m as (select o_orderpriority as dataset, year(o_orderdate) as run, round(avg(o_totalprice), 4) as score from orders group by all) select dataset, run::int as run, score, round(score - lag(score) over (partition by dataset order by run), 4) as delta from m")
def e12(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), F.year("o_orderdate").alias("run")).agg(F.round(F.avg("o_totalprice"), 4).alias("score"))
    return m.withColumn("delta", F.round(F.col("score") - F.lag("score").over(Window.partitionBy("dataset").orderBy("run")), 4))
