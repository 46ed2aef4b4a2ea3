"""Retrieval: vector and keyword searches, and what decides how to search.

Queries of searches are the rows whose id is divisible by 20; every row can answer.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import lexicon as X_
from tessera.functions import text as T
from tessera.operators import bm25, vector
from tessera.operators import graph as G
from tessera.sources.tables import messages, table

SIM = "round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6)"


def near_sql(k: int, extra: str = "") -> str:
    return f"near as (select q.vec_id as query_id, c.vec_id, {SIM} as similarity, row_number() over (partition by q.vec_id order by {SIM} desc, c.vec_id) as rank from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0 {extra} qualify rank <= {k})"


def vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 20 = 0"), e


@query("r1_vector_topk", f"with {near_sql(10)} select query_id, vec_id, similarity from near")
def r1_vector_topk(spark, sf_dir):
    return vector.topk(*vectors(spark, sf_dir), 10).select("query_id", "vec_id", "similarity")


@query("r1_vector_topk_filtered", f"with {near_sql(15)} select query_id, vec_id, similarity, r::int as rank from (select query_id, n.vec_id, similarity, row_number() over (partition by query_id order by similarity desc, n.vec_id) as r from near n join embeddings e on e.vec_id = n.vec_id where similarity >= 0.1 and e.label <> 3) where r <= 5")
def r1_filtered(spark, sf_dir):
    q, e = vectors(spark, sf_dir)
    return vector.filtered_topk(q, e, e.select("vec_id", "label"), F.col("label") != 3, 5, 0.1)


@query("r2_near_duplicate", f"with {near_sql(5)} select query_id, vec_id, similarity from near where similarity >= 0.35 qualify row_number() over (partition by query_id order by rank) = 1")
def r2(spark, sf_dir):
    return vector.near_duplicates(*vectors(spark, sf_dir), 0.35)


@query("r3_supersede_candidates", f"with {near_sql(3)} select n.query_id, n.vec_id, similarity from near n join embeddings a on a.vec_id = n.query_id join embeddings b on b.vec_id = n.vec_id where a.label = b.label and similarity >= 0.2 qualify row_number() over (partition by n.query_id order by similarity desc, n.vec_id) = 1")
def r3(spark, sf_dir):
    q, e = vectors(spark, sf_dir)
    own = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    near = vector.topk(q, e, 3).join(e.select("vec_id", "label"), "vec_id").join(own, "query_id").where("label = own and similarity >= 0.2")
    return near.groupBy("query_id").agg(F.max_by(F.struct("vec_id", "similarity"), F.struct("similarity", -F.col("vec_id"))).alias("b")).select("query_id", "b.vec_id", "b.similarity")


WORDS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3)"
BM25_SQL = """asked as (select distinct item_id as query_id, unnest({terms}) as term from benchmark),
toks as (select doc_id as id, regexp_extract_all(lower(text), '[a-z0-9]+') as ts from documents),
st as (select count(*)::double as nd, avg(len(ts)) as ad from toks),
post as (select id, d, term, count(*) as f from (select id, len(ts) as d, unnest(ts) as term from toks) where term in (select term from asked) group by all),
df as (select term, count(*) as n from post group by term),
idf as (select term, greatest(ln((nd - n + 0.5) / (n + 0.5)), 1e-6) as idf, ad from df, st),
hit as (select query_id, p.id, count(*) as terms, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / ad))), 6) as score from asked a join post p on a.term = p.term join idf i on i.term = p.term group by all)"""
OR_TERMS = BM25_SQL.format(terms=WORDS)


def terms(spark, sf_dir):
    words = F.filter(T.tokens(F.col("text")), lambda t: F.length(t) >= 3)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(words).alias("term"))


@query("r4_bm25_keyword", f"with {OR_TERMS} select query_id, id, score, row_number() over (partition by query_id order by score, id)::int as rank from hit qualify rank <= 20")
def r4(spark, sf_dir):
    return bm25.search(table(spark, sf_dir, "documents"), terms(spark, sf_dir), 20)


@query(
    "r4_bm25_trigram",
    f"""with recursive asked as (select distinct item_id as query_id, unnest({WORDS}) as term from benchmark),
t as (select term, len(list_filter(range(1, length(term)), lambda b: left(term, b) = right(term, b))) > 0 as bordered from (select distinct term from asked)),
docs as (select doc_id as id, lower(coalesce(text, '')) as low from documents),
st as (select count(*)::double as nd, avg(greatest(0, length(low) - 2)) as ad from docs),
pairs as (select id, low, term, bordered from docs join t on contains(low, term)),
places(id, term, pos) as (select id, term, instr(low, term) from pairs where bordered
  union all select p.id, p.term, pos + instr(substr(low, pos + 1), p.term) from places p join docs d on d.id = p.id where instr(substr(low, pos + 1), p.term) > 0),
counts as (select id, term, len(string_split(low, term)) - 1 as f from pairs where not bordered union all select id, term, count(*) from places group by all),
post as (select c.id, greatest(0, length(low) - 2) as d, term, f from counts c join docs using (id)),
df as (select term, count(*) as n from post group by term),
idf as (select term, greatest(ln((nd - n + 0.5) / (n + 0.5)), 1e-6) as idf, ad from df, st),
hit as (select query_id, p.id, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / ad))), 6) as score from asked a join post p on a.term = p.term join idf i on i.term = p.term group by all)
select query_id, id, score, row_number() over (partition by query_id order by score, id)::int as rank from hit qualify rank <= 10""",
)
def r4_trigram(spark, sf_dir):
    """Words as substrings in any case, all of an item's together by or."""
    return bm25.search(table(spark, sf_dir, "documents"), terms(spark, sf_dir), 10, mode=bm25.TRIGRAM)


@query("r5_anticipated_search", f"with {OR_TERMS}, top as (select query_id, id, row_number() over (partition by query_id order by score, id) as r from hit qualify r <= 20), mem as (select query_id, id // 10 as memory_id, min(r) as r from top group by all) select query_id, memory_id, row_number() over (partition by query_id order by r)::int as rank from mem")
def r5(spark, sf_dir):
    """Ten phrasings to a memory: the limit first, then the best phrasing of each memory."""
    top = bm25.search(table(spark, sf_dir, "documents"), terms(spark, sf_dir), 20)
    best = top.groupBy("query_id", F.expr("id div 10").alias("memory_id")).agg(F.min("rank").alias("r"))
    return best.select("query_id", "memory_id", F.row_number().over(Window.partitionBy("query_id").orderBy("r")).alias("rank"))


@query(
    "r6_message_search",
    """with asked as (select distinct conv_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) as term from conversations where conv_id % 20 = 0 and turn = 0),
need as (select query_id, count(*) as need from asked group by 1), toks as (select conv_id * 1000 + turn as id, regexp_extract_all(lower(text), '[a-z0-9]+') as ts from conversations),
st as (select count(*)::double as nd, avg(len(ts)) as ad from toks), post as (select id, d, term, count(*) as f from (select id, len(ts) as d, unnest(ts) as term from toks) where term in (select term from asked) group by all),
df as (select term, count(*) as n from post group by term), idf as (select term, greatest(ln((nd - n + 0.5) / (n + 0.5)), 1e-6) as idf, ad from df, st),
hit as (select query_id, p.id, count(*) as terms, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / ad))), 6) as score from asked a join post p on a.term = p.term join idf i on i.term = p.term group by all)
select query_id, id, score, row_number() over (partition by query_id order by score, id)::int as rank from hit join need using (query_id) where terms = need qualify rank <= 10""",
)
def r6(spark, sf_dir):
    """The messages that hold every word of a conversation's first message."""
    rows = messages(spark, sf_dir).select((F.col("session_id") * 1000 + F.col("message_index")).alias("id"), "session_id", "message_index", "text")
    first = rows.where("session_id % 20 = 0 and message_index = 0")
    asked = first.select(F.col("session_id").alias("query_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0))).alias("term"))
    return bm25.search(rows, asked, 10, id_col="id", all_terms=True)


FOCUS_SQL = """f as (select {id} as id, unnest(list_filter(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_.\\-]*'), lambda t: length(t) >= 3 and not list_contains([{stop}], lower(t)))) as term,
  generate_subscripts(list_filter(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_.\\-]*'), lambda t: length(t) >= 3 and not list_contains([{stop}], lower(t))), 1) as pos from {table}),
g as (select id, arg_min(term, pos) as term, min(pos) as pos from f group by id, lower(term)),
s as (select *, (case when regexp_matches(term, '[_./\\-0-9]') then 2 else 0 end) + (case when regexp_matches(term, '^[A-Z]') then 1 else 0 end) + (case when length(term) > 6 then 1 else 0 end) as salience from g)"""


@query("r9_focus_terms", "with " + FOCUS_SQL.format(id="doc_id", table="documents", stop=", ".join(f"'{w}'" for w in X_.STOP_WORDS)) + " select id, term, salience::int as salience, row_number() over (partition by id order by salience desc, pos)::int as rank from s qualify rank <= 12")
def r9(spark, sf_dir):
    """The twelve most salient words of each text, distinct without case, first spelling kept."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    again = G.kept(docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("twice")))
    # A text with an id of its own is told where it is read; only those of a shared id are shuffled by words.
    own = docs.join(again, docs["id"].eqNullSafe(again["twice"]), "left_anti")
    words = F.array_sort(F.transform(T.focus_candidates(F.col("text")), lambda t, i: F.struct(F.lower(t).alias("low"), i.alias("pos"), t.alias("term"))))
    own = own.select("id", words.alias("words"))
    first = F.filter("words", lambda t, i: ~t["low"].eqNullSafe(F.get("words", i - 1)["low"]))
    best = F.slice(F.array_sort(F.transform(first, lambda t: F.struct((-T.salience(t["term"])).alias("s"), t["pos"].alias("pos"), t["term"].alias("term")))), 1, 12)
    own = own.select("id", F.posexplode(best).alias("i", "t")).select("id", "t.term", (-F.col("t.s")).alias("salience"), (F.col("i") + 1).alias("rank"))
    rows = docs.join(again, docs["id"].eqNullSafe(again["twice"]), "left_semi").select("id", F.posexplode(T.focus_candidates(F.col("text"))).alias("pos", "term"))
    rows = rows.groupBy("id", F.lower("term").alias("low")).agg(F.min_by("term", "pos").alias("term"), F.min("pos").alias("pos"))
    w = Window.partitionBy("id").orderBy(F.desc("salience"), "pos")
    rows = rows.select("id", "term", "pos", T.salience(F.col("term")).alias("salience")).withColumn("rank", F.row_number().over(w)).where("rank <= 12").select("id", "term", "salience", "rank")
    return own.unionByName(rows)


def said(pattern: str) -> str:
    return f"regexp_matches(text, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"


COUNTING = f"({said(X_.COUNT)} and not {said(X_.COUNT_NOT)})"
AGGREGATING = f"({said(X_.AGGREGATE)} and not {said(X_.AGGREGATE_NOT)})"


@query(
    "r20_recall_plan",
    f"select conv_id, turn, case when {COUNTING} then 'count' when {AGGREGATING} then 'aggregation' when {said(X_.BROAD)} then 'broad' else 'precise' end as mode, case when {COUNTING} then 40 when {AGGREGATING} then 80 when {said(X_.BROAD)} then 8 else 3 end as k, case when {COUNTING} or {AGGREGATING} then 80 when {said(X_.BROAD)} then 40 else 20 end as pool, case when {said(X_.BROAD)} then 0.28 else 0.35 end::double as floor from conversations",
)
def r20(spark, sf_dir):
    """Each question's plan: its mode, how many rows it wants, from how wide a pool, above which floor."""
    from tessera.operators.planning import plan_columns

    return messages(spark, sf_dir).select(F.col("session_id").alias("conv_id"), F.col("message_index").alias("turn"), *plan_columns(F.col("text")))


@query("r21_query_intent", f"select conv_id, turn, {said(X_.BROAD)} as broad, {COUNTING} as counting, {AGGREGATING} as aggregating, {said(X_.CURRENT)} as current_value from conversations")
def r21(spark, sf_dir):
    from tessera.operators.planning import intents

    return messages(spark, sf_dir).select(F.col("session_id").alias("conv_id"), F.col("message_index").alias("turn"), *[c.alias(n) for n, c in intents(F.col("text")).items()])


@query("r23_doctrine_match", "select e.vec_id as query_id, d.label as doctrine, max(round(list_cosine_similarity(e.embedding::double[], d.embedding::double[]), 6)) as similarity from embeddings e, (select label, embedding from embeddings qualify row_number() over (partition by label order by vec_id) <= 2) d group by all having similarity >= 0.3")
def r23(spark, sf_dir):
    """Doctrines have two triggers each; a text follows those whose best trigger is near enough."""
    e = table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    triggers = e.withColumn("n", F.row_number().over(w)).where("n <= 2").select(F.col("label").alias("doctrine"), "vec_id", "embedding")
    return vector.best_trigger(e, triggers, 0.3)


@query("r24_pitfall_select", f"with {near_sql(10)}, l as (select n.*, e.label from near n join embeddings e on e.vec_id = n.vec_id) select query_id, max(case when rank = 1 and similarity >= 0.4 then vec_id end) as pitfall, arg_min(vec_id, rank) filter (label = 2 and similarity >= 0.2) as failure from l group by query_id")
def r24(spark, sf_dir):
    """Two rules: only the first row can be the pitfall; the failure is the first failure row that is near enough."""
    q, e = vectors(spark, sf_dir)
    near = vector.topk(q, e, 10).join(e.select("vec_id", "label"), "vec_id")
    return near.groupBy("query_id").agg(F.max(F.when((F.col("rank") == 1) & (F.col("similarity") >= 0.4), F.col("vec_id"))).alias("pitfall"), F.min_by("vec_id", F.when((F.col("label") == 2) & (F.col("similarity") >= 0.2), F.col("rank"))).alias("failure"))


R26 = """with asked as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark),
tok as (select conv_id, (case when role = 'user' then 'user' else 'assistant' end) as side, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from conversations),
u as (select distinct conv_id, side, term from tok), len as (select conv_id, sum(length(text))::bigint as chars from conversations group by 1),
rare as (select term from (select distinct conv_id, term from tok) group by 1 having count(*) <= 3),
m as (select query_id, conv_id, count(*) filter (side = 'user') as by_user, count(*) filter (side = 'assistant') as by_assistant, 2 * count(*) filter (side = 'user' and term in (select term from rare)) as boost from asked join u using (term) group by all),
r as (select *, (4 * by_user + by_assistant + boost)::bigint as score, row_number() over (partition by query_id order by 4 * by_user + by_assistant + boost desc, by_user desc, conv_id) as rank from m where 4 * by_user + by_assistant + boost > 0 qualify rank <= 10),
c as (select query_id, conv_id, score, boost::bigint as boost, rank::int as rank, chars, coalesce(sum(least(chars, 3000)) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0)::bigint as before from r join len using (conv_id))
select query_id, conv_id, score, boost, rank, case when rank <= 6 then greatest(0, least(chars, 3000, 8000 - before)) else 0 end::bigint as used_chars, rank <= 6 and before < 8000 as selected, rank <= 6 and before < 8000 and chars > least(3000, 8000 - before) as truncated from c"""


@query("r26_session_overlap_rank", R26)
def r26(spark, sf_dir):
    """Sessions by the question's words: a user's count four times, rare ones of theirs twice more; the best six within 8,000 characters, 3,000 each."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    m = messages(spark, sf_dir).select(F.col("session_id").alias("conv_id"), (F.col("role") == "user").alias("user"), "text")
    words = m.select("conv_id", "user", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("conv_id", "term").agg(F.bool_or("user").alias("user"), F.bool_or(~F.col("user")).alias("other"))
    words = words.join(words.groupBy("term").agg((F.count("*") <= 3).alias("rare")), "term")
    s = words.join(asked, "term").groupBy("query_id", "conv_id").agg(F.count_if("user").alias("by_user"), F.count_if("other").alias("by_other"), (2 * F.count_if(F.col("user") & F.col("rare"))).alias("boost"))
    s = s.withColumn("score", 4 * F.col("by_user") + F.col("by_other") + F.col("boost")).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("by_user"), "conv_id")
    s = s.withColumn("rank", F.row_number().over(w)).where("rank <= 10").join(m.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars")), "conv_id")
    before = F.coalesce(F.sum(F.least("chars", F.lit(3000))).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.least(F.lit(3000), 8000 - F.col("before"))
    took = (F.col("rank") <= 6) & (F.col("before") < 8000)
    return s.withColumn("before", before).select("query_id", "conv_id", "score", "boost", "rank", F.when(took, F.least("chars", left)).otherwise(0).cast("long").alias("used_chars"), took.alias("selected"), (took & (F.col("chars") > left)).alias("truncated"))


@query("r28_focus_overlap", "select d.doc_id, item_id, n::int as overlap from (select doc_id, item_id, count(*) as n from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{8,}')) as t from documents) d join (select distinct item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{8,}')) as t from benchmark) b using (t) group by all) d where n >= 3")
def r28(spark, sf_dir):
    """How many of an item's long words a text shares, where it is three or more."""
    long = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{8,}"), F.lit(0))))
    d = table(spark, sf_dir, "documents").select("doc_id", long("text").alias("t"))
    b = table(spark, sf_dir, "benchmark").select("item_id", long("text").alias("t"))
    return d.join(b, "t").groupBy("doc_id", "item_id").agg(F.count("*").cast("int").alias("overlap")).where("overlap >= 3")
