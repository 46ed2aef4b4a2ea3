"""Further retrieval and set queries: stemmed search, routes, pairs of results, alignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import lexicon as X_
from tessera.functions.porter import stems
from tessera.operators import bm25, vector
from tessera.operators import filters as X
from tessera.operators.windows import select_windows
from tessera.plans.retrieval import near_sql, vectors
from tessera.sources.tables import SQL_EDGES, edges, messages, table


@query("r7_project_search")
def r7(spark, sf_dir):
    """The documents that hold the stems of all an item's words; the stemmer has no SQL form, tests hold the search against a plain loop."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(stems(F.col("text"))).alias("term"))
    return bm25.search(table(spark, sf_dir, "documents"), asked, 10, all_terms=True, mode=bm25.STEMS)


@query("r27_window_select")
def r27(spark, sf_dir):
    """Windows of every session for its own first question. Order-dependent: tests hold it against a plain loop over rendered texts."""
    m = messages(spark, sf_dir).select(F.col("session_id").alias("session"), F.col("message_index").alias("index"), "role", "text")
    asked = m.where("role = 'user'").groupBy("session").agg(F.min_by("text", "index").alias("question")).select(F.col("session").alias("query_id"), "session", "question")
    return select_windows(m, asked)


@query("fp7_min_similarity_floor", f"with {near_sql(10)} select query_id, vec_id, similarity from near where similarity >= 0.3")
def fp7(spark, sf_dir):
    return vector.topk(*vectors(spark, sf_dir), 10, floor=0.3).select("query_id", "vec_id", "similarity")


@query("j11_pair_enumeration", f"with {near_sql(10)} select a.query_id, a.vec_id as a, b.vec_id as b from near a join near b on a.query_id = b.query_id and a.rank < b.rank")
def j11(spark, sf_dir):
    """The pairs of a result of ten rows: forty-five at most."""
    near = vector.topk(*vectors(spark, sf_dir), 10)
    held = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda x: F.transform(F.filter("v", lambda y: y["rank"] > x["rank"]), lambda y: F.struct(x["vec_id"].alias("a"), y["vec_id"].alias("b")))))
    return held.select("query_id", F.explode(pairs).alias("p")).select("query_id", "p.a", "p.b")


@query("j12_write_neighbours", f"with {near_sql(5)} select query_id as new_id, n.vec_id as old_id, similarity, a.label <> b.label as conflict from near n join embeddings a on a.vec_id = query_id join embeddings b on b.vec_id = n.vec_id where similarity >= 0.2")
def j12(spark, sf_dir):
    """Rows being written against their five nearest, flagged where they say something else."""
    q, e = vectors(spark, sf_dir)
    near = vector.topk(q, e, 5, floor=0.2)
    return near.join(q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").join(e.select("vec_id", "label"), "vec_id").select(F.col("query_id").alias("new_id"), F.col("vec_id").alias("old_id"), "similarity", (F.col("own") != F.col("label")).alias("conflict"))


@query("so3_gold_in_topk", f"with {near_sql(10)}, t as (select query_id, list(vec_id order by rank) as top from near group by 1), g as (select q.vec_id as query_id, list(c.vec_id) as gold from embeddings q join embeddings c on q.label = c.label and q.vec_id <> c.vec_id where q.vec_id % 20 = 0 group by 1) select query_id, len(list_intersect(top, gold))::int as n, list_sort(list_intersect(top, gold)) as found from t join g using (query_id)")
def so3(spark, sf_dir):
    """The gold rows within the first ten."""
    q, e = vectors(spark, sf_dir)
    top = vector.topk(q, e, 10).join(e.select("vec_id", "label"), "vec_id").join(q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    found = F.sort_array(F.collect_list(F.when(F.col("label") == F.col("own"), F.col("vec_id"))))
    return top.groupBy("query_id").agg(found.alias("found")).select("query_id", F.size("found").alias("n"), "found")


@query("so5_triples_union", r"with t as (select p_partkey as id, 0 as src, regexp_extract(p_name, '^(\w+) (\w+)$', 2) as s, 'colour' as p, regexp_extract(p_name, '^(\w+) (\w+)$', 1) as o from part union all select p_partkey, 1, upper(regexp_extract(p_name, '(\w+)$', 1)), 'colour', regexp_extract(p_name, '^(\w+)', 1) from part) select lower(trim(s)) as s, p, lower(trim(o)) as o, arg_min(s, struct_pack(a := id, b := src)) as first_form, count(*)::bigint as n from t group by lower(trim(s)), p, lower(trim(o))")
def so5(spark, sf_dir):
    """Triples of two extractors together, each once in any spelling, the first kept."""
    part = table(spark, sf_dir, "part")
    rx = lambda p, g: F.regexp_extract("p_name", p, g)
    a = part.select("p_partkey", F.lit(0).alias("src"), rx(r"^(\w+) (\w+)$", 2).alias("form"), F.lit("colour").alias("p"), rx(r"^(\w+) (\w+)$", 1).alias("obj"))
    b = part.select("p_partkey", F.lit(1).alias("src"), F.upper(rx(r"(\w+)$", 1)).alias("form"), F.lit("colour").alias("p"), rx(r"^(\w+)", 1).alias("obj"))
    u = a.unionByName(b)
    return u.groupBy(F.lower(F.trim("form")).alias("s"), "p", F.lower(F.trim("obj")).alias("o")).agg(F.min_by("form", F.struct("p_partkey", "src")).alias("first_form"), F.count("*").alias("n"))


@query("a11_corpus_kg_density", "with e as (select distinct l_partkey as a, l_suppkey + 10000000 as b from lineitem), v as (select count(*)::bigint as n from (select a as x from e union select b from e)) select n as n_nodes, (select count(*) from e)::bigint as n_edges, round(2 * (select count(*) from e) / (n * (n - 1)), 9)::double as density from v")
def a11(spark, sf_dir):
    """Undirected: 2 E / (n (n - 1))."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 10000000).alias("b")).distinct()
    n = e.select(F.explode(F.array("a", "b")).alias("x")).distinct().agg(F.count("*").alias("n_nodes"))
    return e.agg(F.count("*").alias("n_edges")).join(F.broadcast(n)).select("n_nodes", "n_edges", F.round(2 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 9).alias("density"))


@query("x3_exclusion_contradictions", "with ex as (select doc_id from labels where quality = 0) select doc_id, length(text)::int as n from documents where doc_id in (select doc_id from ex) and regexp_matches(text, '[A-Za-z]{3,}')")
def x3(spark, sf_dir):
    """Rows left out as having no evidence, although evidence is found in them."""
    ex = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").join(ex, "doc_id", "left_semi").where(F.col("text").rlike("[A-Za-z]{3,}")).select("doc_id", F.length("text").alias("n"))


@query("x11_fold_relations", "with r as (select l_orderkey as s, l_linenumber as n, l_partkey as a, l_suppkey as b, l_quantity as v from lineitem), k as (select * from r where v >= 5 and exists (select 1 from part where p_partkey = a)) select s, a, b, min(n)::int as first_line from k group by all")
def x11(spark, sf_dir):
    """Recovered relations stay if their span resolves, they are no bare values and no repeats."""
    have = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"))
    r = table(spark, sf_dir, "lineitem").where("l_quantity >= 5").select(F.col("l_orderkey").alias("s"), "l_linenumber", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return r.join(have, "a", "left_semi").groupBy("s", "a", "b").agg(F.min("l_linenumber").alias("first_line"))


FACTS = [(1, "what was urgent for c77"), (2, "not specified by c10"), (3, "is it low that causes"), (4, "high prevents c5"), (5, "c5")]
FACT_STOP = ", ".join(f"'{w}'" for w in X_.STOP_WORDS)
FACT_SQL = f"""{SQL_EDGES}, ask(query_id, text) as (values {", ".join(f"({i}, '{t}')" for i, t in FACTS)}),
w as (select query_id, unnest(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_.\\-]*')) as word, generate_subscripts(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_.\\-]*'), 1) as pos from ask),
u as (select query_id, lower(word) as term, min(pos) as pos from w where length(word) >= 2 and lower(word) not in ({FACT_STOP}) group by all),
asked as (select query_id, term from u qualify row_number() over (partition by query_id order by pos) <= 3),
need as (select query_id, count(*) as need from asked group by 1),
docs as (select id, [lower(subject), lower(predicate), lower(object)] as parts, greatest(0, length(subject) - 2) + greatest(0, length(predicate) - 2) + greatest(0, length(object) - 2) as d from kg),
st as (select count(*)::double as nd, avg(d) as ad from docs),
post as (select id, d, term, list_sum(list_transform(parts, lambda p: len(string_split(p, term)) - 1)) as f from docs, (select distinct term from asked where length(term) >= 3)),
df as (select term, count(*) as n from post where f > 0 group by term),
idf as (select term, greatest(ln((nd - n + 0.5) / (n + 0.5)), 1e-6) as idf, ad from df, st),
hit as (select query_id, p.id, count(*) as terms, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / ad))), 6) as score from asked a join post p on a.term = p.term join idf i on i.term = p.term where f > 0 group by all)"""


def fact_questions(spark):
    """The first three words of each question that are no stop words, each once in any case, in their order."""
    words = F.regexp_extract_all("text", F.lit(r"[a-zA-Z_][a-zA-Z0-9_.\-]*"), F.lit(0))
    known = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: (F.length(w) >= 2) & ~w.isin(X_.STOP_WORDS))
    return spark.createDataFrame(FACTS, "query_id long, text string").select("query_id", F.explode(F.slice(F.array_distinct(known), 1, 3)).alias("term"))


def fact_hits(spark, sf_dir, k, keep):
    e = edges(spark, sf_dir)
    return bm25.search(e, fact_questions(spark), k, id_col="id", text=[F.col(c) for c in ("subject", "predicate", "object")], all_terms=True, mode=bm25.TRIGRAM, keep=keep(e).select("id"))


@query("r8_kg_fts", f"with {FACT_SQL} select query_id, h.id, score, row_number() over (partition by query_id order by score, h.id)::int as rank from hit h join need using (query_id) join kg on kg.id = h.id where terms = need and valid_to is null qualify rank <= 10")
def r8(spark, sf_dir):
    """Open edges whose triple holds every keyword as a substring, by the substring score over all edges."""
    return fact_hits(spark, sf_dir, 10, X.as_of)


@query("x14_kg_fact_lookup", f"with {FACT_SQL}, top as (select query_id, h.id, row_number() over (partition by query_id order by score, h.id)::int as place from hit h join need using (query_id) join kg on kg.id = h.id where terms = need and valid_from <= timestamp '1998-01-01' and (valid_to is null or timestamp '1998-01-01' < valid_to) and not dormant qualify place <= 3) select query_id, place, subject, predicate, object from top join kg using (id)")
def x14(spark, sf_dir):
    """The three best facts for a question's keywords, as believed at a time."""
    top = fact_hits(spark, sf_dir, 3, lambda e: X.as_of(e, "1998-01-01 00:00:00").where("not dormant"))
    return top.join(edges(spark, sf_dir), "id").select("query_id", F.col("rank").alias("place"), "subject", "predicate", "object")


@query("g19_semantic_graph_align", "with ev as (select p_type as concept, n_name as place, l_quantity as v from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey), q as (select concept, place, v from ev), c(concept, place) as (values ('ECONOMY', 'NATION_3'), ('SMALL', 'NATION_7'), ('ECONOMY', 'NATION_20')) select q.concept, q.place, count(*)::bigint as bindings, sum(v) as total from q join c on c.concept = q.concept and c.place = q.place group by all")
def g19(spark, sf_dir):
    """Question constraints (concept and role value) matched to the evidence graph's edges."""
    ask = spark.createDataFrame([("ECONOMY", "NATION_3"), ("SMALL", "NATION_7"), ("ECONOMY", "NATION_20")], "concept string, place string")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("concept"))
    place = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("place"))
    ev = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(place.join(F.broadcast(ask.select("place").distinct()), "place"), "l_suppkey").join(part, "l_partkey")
    return ev.join(F.broadcast(ask), ["concept", "place"]).groupBy("concept", "place").agg(F.count("*").alias("bindings"), F.sum("l_quantity").alias("total"))


@query("x20_ranked_sessions", "with asked as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark), tok as (select distinct conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from conversations), m as (select query_id, conv_id, count(*)::bigint as score from asked join tok using (term) group by all) select query_id, conv_id, score from m qualify row_number() over (partition by query_id order by score desc, conv_id) <= 5")
def x20(spark, sf_dir):
    from tessera.functions.text import tokens

    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    tok = messages(spark, sf_dir).select(F.col("session_id").alias("conv_id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    m = tok.join(asked, "term").groupBy("query_id", "conv_id").agg(F.count("*").alias("score"))
    return m.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "conv_id"))).where("n <= 5").drop("n")


@query("t3_recent_per_group", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 3")
def t3(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("n")).where("n <= 3").drop("n")


@query("st2_projection", "select user_id, count(*)::bigint as applied, max(event_id) as position, round(sum(case when event_type = 'purchase' then value else 0 end), 4) as spent from events group by 1")
def st2(spark, sf_dir):
    """What a replay of the whole log must give: the streaming projection is tested against it."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("applied"), F.max("event_id").alias("position"), F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)), 4).alias("spent"))


@query("st7_lease_states", "with l as (select props as lock, arg_max(event_type, event_id) as last, max(ts) as seen, bool_or(event_type = 'purchase') as done from events group by 1) select lock, case when done then 'done' when epoch_us(timestamp '2024-01-31') - epoch_us(seen) > 600 * 1000000 then 'stale' else 'held' end as state from l")
def st7(spark, sf_dir):
    """A lock is done for ever, or stale ten minutes after its last sign of life, or held."""
    l = table(spark, sf_dir, "events").groupBy(F.col("props").alias("lock")).agg(F.max("ts").alias("at"), F.bool_or(F.col("event_type") == "purchase").alias("done"))  # noqa: E741
    age = F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    return l.select("lock", F.when(F.col("done"), "done").when(age > 600 * 1000000, "stale").otherwise("held").alias("state"))


@query("d6_latest_provenance", "select l_orderkey as memory, arg_max(l_shipdate, struct_pack(a := l_shipdate, b := l_linenumber, c := l_partkey, d := l_returnflag)) as last_at, arg_max(l_returnflag, struct_pack(a := l_shipdate, b := l_linenumber, c := l_partkey, d := l_returnflag)) as origin, count(*)::bigint as events from lineitem group by 1")
def d6(spark, sf_dir):
    order = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("memory")).agg(F.max_by("l_shipdate", order).alias("last_at"), F.max_by("l_returnflag", order).alias("origin"), F.count("*").alias("events"))


@query("g10_synonyms", f"with {near_sql(5)} select q.vec_id as query_id, coalesce(min(n.vec_id) filter (similarity >= 0.45), q.vec_id) as canonical, count(n.vec_id) filter (similarity >= 0.45)::bigint as synonyms from (select vec_id from embeddings where vec_id % 20 = 0) q left join near n on n.query_id = q.vec_id group by q.vec_id")
def g10_synonyms(spark, sf_dir):
    """New names take the first of the known ones whose vectors are near enough, among the five nearest."""
    q, e = vectors(spark, sf_dir)
    near = vector.topk(q, e, 5, floor=0.45).groupBy("query_id").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    return q.select(F.col("vec_id").alias("query_id")).join(near, "query_id", "left").select("query_id", F.coalesce("first", "query_id").alias("canonical"), F.coalesce("n", F.lit(0)).alias("synonyms"))
