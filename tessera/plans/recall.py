"""The whole recall, stage by stage: arms, folds, rescoring, cuts, and the route around it.

Questions are the benchmark's items, each with the vector of the row 20 times its id; memories
are the documents, phrases the users' turns of the conversation with the memory's id, usage the
events of the user with that id. The SQL of a stage is the SQL of all stages before it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import lexicon as X_
from tessera.functions import scoring as S
from tessera.operators import filters as X
from tessera.operators import graph as G
from tessera.operators import recall as R
from tessera.plans.retrieval import AGGREGATING, COUNTING, FOCUS_SQL, said
from tessera.sources.tables import SQL_MEMORIES, SQL_USAGE, memories, messages, table, usage_events

NOW, SEEN = "2025-06-01 00:00:00", "2024-02-01 00:00:00"
STOP = ", ".join(f"'{w}'" for w in X_.STOP_WORDS)
ASKS = "select item_id as query_id, text, item_id * 20 as vec_id from benchmark"
NAMES = """list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({t}, ''), '[A-Z][a-zA-Z0-9]+(?:\\s+[A-Z][a-zA-Z0-9]+)*'),
  lambda s: array_to_string(string_split(regexp_replace(regexp_replace(lower(s), '^(the |a |an )', ''), '\\s+', ' ', 'g'), ' ')[1:2], ' ')), lambda k: k <> ''))"""


def bm25_sql(name: str, rows: str) -> str:
    """CTEs of the scores of all asked terms over (id, text) rows."""
    return f"""{name}_toks as (select id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as ts from ({rows})),
{name}_st as (select count(*)::double as nd, avg(len(ts)) as ad from {name}_toks),
{name}_post as (select id, d, term, count(*) as f from (select id, len(ts) as d, unnest(ts) as term from {name}_toks) where term in (select term from terms) group by all),
{name}_idf as (select term, greatest(ln((any_value(nd) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) as idf, any_value(ad) as ad from {name}_post, {name}_st group by term),
{name} as (select query_id, p.id, count(*) as terms, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / ad))), 6) as score from terms t join {name}_post p on p.term = t.term join {name}_idf i on i.term = p.term group by all)"""


def _near(name: str, vector: str, source: str, other: str, allowed: str) -> str:
    sim = f"round(list_cosine_similarity({vector}, c.embedding::double[]), 6)"
    return f"""{name}_near as (select query_id, c.vec_id as id, {sim} as similarity, row_number() over (partition by query_id order by {sim} desc, c.vec_id) as r from {source} join embeddings c on {other}),
{name} as (select n.query_id, n.id, n.similarity, row_number() over (partition by n.query_id order by n.similarity desc, n.id) as rank, pool from {name}_near n join asks a on a.query_id = n.query_id join mem m on m.id = n.id
  where r <= 3 * pool and type <> 'SYSTEM' and n.similarity >= floor and {allowed} qualify rank <= pool)"""


def _fold(name: str, base: str, arm: str) -> str:
    return f"""{name}_j as (select query_id, id, round(coalesce(rrf_score, 0) + coalesce(1 / (20 + {arm}.rank), 0), 6) as rrf_score from {base} full join {arm} using (query_id, id)),
{name} as (select query_id, id, rrf_score, row_number() over (partition by query_id order by rrf_score desc, id) as rank from {name}_j)"""


def _narrow(arm: str, allowed: str) -> str:
    """The allowed rows of an arm, ranked anew."""
    return f"select x.query_id, x.id, row_number() over (partition by x.query_id order by x.rank) as rank from ({arm}) x join mem m on m.id = x.id join asks a on a.query_id = x.query_id where {allowed}"


def recall_sql(asks: str = ASKS, allowed: str = "true") -> str:
    n = lambda arm: _narrow(arm, allowed)
    step = """union all select query_id, node, mass * 0.15 from walk0) group by all)"""
    return f"""{SQL_MEMORIES}, {SQL_USAGE}, ask0 as ({asks}),
asks as (select a.*, e.embedding, case when {COUNTING} or {AGGREGATING} then 80 when {said(X_.BROAD)} then 40 else 20 end as pool, case when {said(X_.BROAD)} then 0.28 else 0.35 end as floor,
  {COUNTING} or regexp_matches(text, '(?i){R.ENDPOINTS}') as as_is from ask0 a join embeddings e on e.vec_id = a.vec_id),
usg as (select memory_id, count(*) filter (kind = 'use') as uses, count(*) filter (kind = 'noise') as noises, pow(0.5, (epoch_us(timestamp '{SEEN}') - epoch_us(max(ts))) / 86400e6 / 30) as d from ev group by 1),
used as (select memory_id, uses < noises as dormant, round(d + (1 - d) * (case when uses = 0 then 0 else 1 - exp(-uses / 5) end), 6) as strength from usg),
{FOCUS_SQL.format(id="query_id", table="asks", stop=STOP)},
terms as (select query_id, term from (select id as query_id, lower(term) as term from s qualify row_number() over (partition by id order by salience desc, pos) <= 12) where regexp_matches(term, '^[a-z0-9]+$')),
{bm25_sql("found", "select doc_id as id, text from documents")},
{_near("by_v", "a.embedding::double[]", "asks a", "c.vec_id <> a.vec_id", allowed)},
by_k as (select f.query_id, f.id, row_number() over (partition by f.query_id order by f.score, f.id) as rank, pool from found f join asks a on a.query_id = f.query_id join mem m on m.id = f.id where type <> 'SYSTEM' and {allowed} qualify rank <= pool),
x0 as (select query_id, embedding from by_k join embeddings on vec_id = id qualify row_number() over (partition by query_id order by rank) <= 3),
x1 as (select query_id, pos, avg(x::double) as x from (select query_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from x0) group by all),
x2 as (select query_id, list(x order by pos) as v from x1 group by 1),
{_near("by_x", "x2.v", "x2", "true", allowed)},
un as (select query_id, id, 1 / (20 + rank) as s, 0 as arm, rank from by_v union all select query_id, id, 1 / (20 + rank), 1, rank from by_x union all select query_id, id, 1 / (20 + rank), 2, rank from by_k),
fu as (select query_id, id, round(sum(s), 6) as rrf_score, min(struct_pack(arm := arm, rank := rank)) as seen from un group by all),
fused as (select query_id, id, rrf_score, row_number() over (partition by query_id order by rrf_score desc, seen, id) as rank from fu),
{bm25_sql("said", "select conv_id * 1000 + turn as id, text from conversations where role = 'user'")},
top as (select query_id, id // 1000 as id, row_number() over (partition by query_id order by score, id) as r from said qualify r <= 20),
phrase as ({n("select query_id, id, row_number() over (partition by query_id order by min(r)) as rank from top where id in (select id from mem where type <> 'SYSTEM') group by query_id, id")}),
{_fold("f1", "fused", "phrase")},
se as (select query_id, session, min(rank) as r from f1 join mem using (id) group by query_id, session qualify row_number() over (partition by query_id order by r) <= 3),
sr as (select id, session, type, row_number() over (partition by session order by id) as n from mem),
sess as ({n("select query_id, id, row_number() over (partition by query_id order by r, n) as rank from se join sr using (session) where n <= 12 and type <> 'SYSTEM'")}),
{_fold("f2", "f1", "sess")},
nm0 as (select id as item, unnest({NAMES.format(t="content")}) as entity from mem),
nm as (select item, entity from nm0 where entity in (select entity from nm0 group by 1 having count(*) <= 40)),
seed as (select query_id, id as item from f2 where rank <= 5),
asked as (select distinct query_id, entity from seed join nm using (item)),
br as (select query_id, item as id, count(*) as shared from asked join nm using (entity) anti join seed using (query_id, item) group by all),
bridge as ({n("select query_id, id, row_number() over (partition by query_id order by shared desc, id) as rank from br qualify rank <= 10")}),
miss as (select query_id, id, rank from bridge anti join f2 using (query_id, id)),
f3_j as (select query_id, id, rrf_score from f2 union all select query_id, id, round(1 / (20 + row_number() over (partition by query_id order by rank, id)), 6) from miss),
f3 as (select query_id, id, rrf_score, row_number() over (partition by query_id order by rrf_score desc, id) as rank from f3_j),
ws as (select distinct query_id, unnest({NAMES.format(t="text")}) as node from asks),
walk0 as (select query_id, node, 1 / count(*) over (partition by query_id) as mass from ws where node in (select entity from nm)),
lk as (select entity as src, '#' || item::varchar as dst from nm union all select '#' || item::varchar, entity from nm),
lw as (select src, dst, 0.85 / count(*) over (partition by src) as w from lk),
walk1 as (select query_id, node, sum(mass) as mass from (select query_id, dst as node, w * mass as mass from walk0 join lw on src = node {step},
walk2 as (select query_id, node, sum(mass) as mass from (select query_id, dst as node, w * mass as mass from walk1 join lw on src = node {step},
wm as (select query_id, item as id, round(max(mass), 9) as mass from walk2 join nm on entity = node group by all),
walk as ({n("select query_id, id, row_number() over (partition by query_id order by mass desc, id) as rank from wm qualify rank <= 10")}),
{_fold("f4", "f3", "walk")},
sc as (select f.query_id, f.id, f.rank, round((case when max(rrf_score) over w = min(rrf_score) over w then 1 else (rrf_score - min(rrf_score) over w) / (max(rrf_score) over w - min(rrf_score) over w) end)
  + 0.5 * pow(0.5, greatest((epoch_us(timestamp '{NOW}') - epoch_us(created_at)) / 86400e6, 0) / 90) + 0.3 * greatest(0, least(1, confidence)) + 0.4 * coalesce(strength, 1.0), 6) as composite
  from f4 f join mem m on m.id = f.id left join used u on u.memory_id = f.id window w as (partition by f.query_id)),
co as (select query_id, id, composite, row_number() over (partition by query_id order by composite desc, rank) as rank from sc),
rk as (select c.query_id, c.id, c.composite, row_number() over (partition by c.query_id order by (c.rank > 20)::int, case when c.rank <= 20 then case when as_is then 0 else -coalesce(f.terms, 0) end end nulls last, c.rank) as rank
  from co c join asks a on a.query_id = c.query_id left join found f on f.query_id = c.query_id and f.id = c.id),
rt0 as (select distinct query_id, lower(word) as term from (select query_id, unnest(regexp_extract_all(text, '{R.TOKEN}')) as word from asks) where regexp_matches(word, '[0-9._%]') or regexp_matches(word, '^..*[A-Z]') or lower(word) not in ({STOP})),
rdf as (select term, count(*) as df from (select distinct doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{R.TOKEN.replace("A-Za-z", "a-z")}')) as term from documents) where term in (select term from rt0) group by 1),
rt as (select query_id, term, round(-log2((coalesce(df, 0) + 0.5) / ((select count(*) from documents) + 1)), 6) as bits from rt0 left join rdf using (term)),
live as (select * from rk where id not in (select memory_id from used where dormant)),
runs as (select distinct id, unnest(regexp_extract_all(lower(content), '{R.RUN}')) as term from mem where id in (select id from live)),
bo0 as (select l.query_id, l.id, round(sum(bits), 6) as boost from live l join rt on rt.query_id = l.query_id and bits >= 5 join runs on runs.id = l.id and runs.term = rt.term group by all),
bo as (select l.query_id, l.id, l.composite, coalesce(boost, 0.0)::double as boost, row_number() over (partition by l.query_id order by coalesce(boost, 0.0) desc, l.rank) as rank from live l left join bo0 b on b.query_id = l.query_id and b.id = l.id),
cut as (select b.*, sum(greatest(1, length(content) // 4)) over (partition by b.query_id order by b.rank) as total from bo b join mem m on m.id = b.id),
sims as (select query_id, id, max(similarity) as similarity from (select query_id, id, similarity from by_v union all select query_id, id, similarity from by_x) group by all),
recalled as (select c.query_id, c.id, c.composite, c.boost, coalesce(similarity, 0.0)::double as similarity, c.rank from cut c left join sims s on s.query_id = c.query_id and s.id = c.id where c.rank = 1 or total <= 6000)"""


SQL = recall_sql()


def of(spark, sf_dir, asks=None, parts=None) -> R.Recall:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    if asks is None:
        asks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asks = asks.withColumn("vec_id", F.col("query_id") * 20).join(vectors.withColumnRenamed("id", "vec_id"), "vec_id")
    k = F.col("kind")
    u = usage_events(spark, sf_dir).groupBy("memory_id").agg(F.count_if(k == "use").alias("uses"), F.count_if(k == "noise").alias("noises"), F.max("ts").alias("last"))
    age = (F.unix_micros(F.lit(SEEN).cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 86400e6
    usage = u.select("memory_id", (F.col("uses") < F.col("noises")).alias("dormant"), F.round(S.strength(age, F.col("uses"), F.lit(0.0)), 6).alias("strength"))
    phrases = messages(spark, sf_dir).where("role = 'user'").select((F.col("session_id") * 1000 + F.col("message_index")).alias("phrase_id"), F.col("session_id").alias("memory_id"), "text")
    return R.Recall(asks, memories(spark, sf_dir), vectors, usage, phrases, NOW, parts=parts)


def _ranked(df):
    return df.select("query_id", "id", "rrf_score", F.col("rank").cast("int").alias("rank"))


FOLDED = "select query_id, id, rrf_score, rank::int as rank from {}"


@query("r10_rrf_fuse", f"with {SQL} {FOLDED.format('fused')}")
def r10(spark, sf_dir):
    """The vector arm, the expansion's vector arm and the keyword arm, fused."""
    return G.only(lambda: _ranked(of(spark, sf_dir).fused()))


@query("r11_fold_ranked_arm", f"with {SQL} {FOLDED.format('f1')}")
def r11(spark, sf_dir):
    """Memories whose phrases answer the question, folded in as a further ranked arm."""
    return G.only(lambda: _ranked(of(spark, sf_dir).with_phrases()))


@query("r12_session_expand", f"with {SQL} {FOLDED.format('f2')}")
def r12(spark, sf_dir):
    """Rows of the three sessions that the best rows touch, up to twelve each, folded in."""
    return G.only(lambda: _ranked(of(spark, sf_dir).with_sessions()))


@query("r14_bridge_fold", f"with {SQL} {FOLDED.format('f3')}")
def r14(spark, sf_dir):
    """Memories that share names with the first five, where they were missing."""
    return G.only(lambda: _ranked(of(spark, sf_dir).with_bridges()))


@query("r15_ppr_fold", f"with {SQL} {FOLDED.format('f4')}")
def r15(spark, sf_dir):
    """Memories near the question's names in the graph of names, folded in."""
    return G.only(lambda: _ranked(of(spark, sf_dir).with_walks()))


@query("r16_composite_rescore", f"with {SQL} select query_id, id, composite, rank::int as final_rank from co")
def r16(spark, sf_dir):
    return G.only(lambda: of(spark, sf_dir).rescored().select("query_id", "id", "composite", "final_rank"))


@query("r18_rerank", f"with {SQL} select query_id, id, rank::int as new_rank from rk")
def r18(spark, sf_dir):
    """A scorer (how many of the question's words a row holds) reorders the first twenty; the tail stays."""
    return G.only(lambda: of(spark, sf_dir).reranked().select("query_id", "id", F.col("rank").alias("new_rank")))


@query("r17_exact_boost", f"with {SQL} select query_id, id, boost, rank::int as new_rank from bo")
def r17(spark, sf_dir):
    """Rows with rare words of the question move up by their surprisal."""
    return G.only(lambda: of(spark, sf_dir).boosted().select("query_id", "id", "boost", F.col("rank").alias("new_rank")))


@query("r19_hybrid_recall", f"with {SQL} select query_id, id, composite, similarity, rank::int as rank from recalled")
def r19(spark, sf_dir):
    """The whole recall: three arms, fusion, four folds, rescoring, reranking, dormant rows out, rare words up, the token budget."""
    return G.only(lambda: of(spark, sf_dir).recalled().select("query_id", "id", "composite", "similarity", "rank"))


ROUTE_ASKS = "select item_id as query_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text, item_id * 20 as vec_id from benchmark"
ROUTE_SQL = recall_sql(ROUTE_ASKS, "(a.query_id % 3 <> 0 or type in ('EN', 'FR'))")


@query(
    "r22_recall_route",
    f"""with {ROUTE_SQL}, gated as (select * from recalled where query_id in (select query_id from recalled where rank = 1 and similarity >= 0.2)),
kept as (select g.query_id, g.id, g.similarity, g.rank from gated g join mem m on m.id = g.id where (g.query_id % 3 <> 1 or strftime(created_at, '%Y-%m-%d') >= '2024-01-03') and (g.query_id % 3 <> 2 or contains(lower(content), 'th'))),
repl as (select distinct doc_id as id, doc_id + 1 as superseded_by from labels where toxic = 1)
select query_id, id, round(similarity, 2) as similarity, superseded_by, row_number() over (partition by query_id order by (superseded_by is not null)::int, rank)::int as place from kept left join repl using (id)""",
)
def r22(spark, sf_dir):
    """The route: inline filters, the plan, the recall, the gate on the first row, result filters, superseded rows last."""
    suffix = F.when(F.col("item_id") % 3 == 0, " type:en,fr").when(F.col("item_id") % 3 == 1, " after:2024-01-03").otherwise(" symbol:TH")
    text, parts = X.inline_filters(F.concat("text", suffix))
    asks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text"), parts.alias("parts"))
    replaced = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), (F.col("doc_id") + 1).alias("by")).distinct()
    return G.only(lambda: R.route(of(spark, sf_dir, asks, F.col("parts")), replaced, 0.2))


@query("r25_transcript_pointers", f"with {SQL} select query_id, id, session, session in (select 's' || conv_id::varchar from conversations) as available from recalled join mem using (id) where rank <= 5")
def r25(spark, sf_dir):
    """A pointer for each recalled row, with whether its session was exported; unavailable ones stay."""
    have = messages(spark, sf_dir).select(F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("session"), F.lit(True).alias("available")).distinct()
    p = G.only(lambda: of(spark, sf_dir).recalled().where("rank <= 5").select("query_id", "id")).join(memories(spark, sf_dir).select("id", "session"), "id")
    return p.join(have, "session", "left").select("query_id", "id", "session", F.coalesce("available", F.lit(False)).alias("available"))


@query("j15_conflicts_among", f"with {SQL}, cf as (select distinct least(l_partkey % 500, l_suppkey) as a, greatest(l_partkey % 500, l_suppkey) as b from lineitem where l_partkey % 500 <> l_suppkey) select x.query_id, cf.a, cf.b from cf join fused x on x.id = cf.a join fused y on y.id = cf.b and x.query_id = y.query_id")
def j15(spark, sf_dir):
    """Conflict pairs whose two ends are both in a recalled set."""
    l = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("p"), "l_suppkey").where("p <> l_suppkey")  # noqa: E741
    cf = l.select(F.least("p", "l_suppkey").alias("a"), F.greatest("p", "l_suppkey").alias("b")).distinct()
    rr = G.only(lambda: of(spark, sf_dir).fused().select("query_id", "id"))
    return cf.join(rr.withColumnRenamed("id", "a"), "a").join(rr.withColumnRenamed("id", "b"), ["query_id", "b"]).select("query_id", "a", "b")


@query("so1_union_of_arms", f"with {SQL} select query_id, id, count(*)::bigint as arms from (select query_id, id from by_v union all select query_id, id from by_k) group by all")
def so1(spark, sf_dir):
    def arms():
        r = of(spark, sf_dir)
        return r.by_vector.select("query_id", "id").unionByName(r.by_keyword.select("query_id", "id")).groupBy("query_id", "id").agg(F.count("*").alias("arms"))

    return G.only(arms)
