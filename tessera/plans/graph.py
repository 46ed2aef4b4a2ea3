"""Knowledge-graph queries: neighbourhoods, rank, rules, conflicts and resolution on the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import text as T
from tessera.functions.lexicon import ANTONYMS
from tessera.operators import entities as EN
from tessera.operators import graph as G
from tessera.operators.graph import kept
from tessera.operators.rules import TRANSITIVE, Rule, derived
from tessera.sources import versions as V
from tessera.sources.tables import SQL_EDGES, edges, table

PLACES = """pl as (select 's' || s_suppkey as subject, 'uses' as predicate, 'n' || s_nationkey as object from supplier
 union all select 'n' || n_nationkey, 'uses', 'r' || n_regionkey from nation union all select 'c' || c_custkey, 'causes', 'n' || c_nationkey from customer)"""


def places(spark, sf_dir):
    """Suppliers and customers in nations, nations in regions."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("subject"), F.lit("uses").alias("predicate"), F.concat(F.lit("n"), "s_nationkey").alias("object"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.lit("uses"), F.concat(F.lit("r"), "n_regionkey"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.lit("causes"), F.concat(F.lit("n"), "c_nationkey"))
    return s.union(n).union(c).toDF("subject", "predicate", "object")


def numbered(df):
    return df.withColumn("id", F.concat_ws(">", "subject", "object"))


@query("g1_kg_neighbors", f"with {PLACES}, e as (select subject || '>' || object as id, subject, object from pl), h1 as (select * from e where subject = 'r1' or object = 'r1'), f1 as (select distinct v from (select unnest([subject, object]) as v from h1)), h2 as (select * from e where (subject in (select v from f1) or object in (select v from f1)) and id not in (select id from h1)) select id, 1 as hop from h1 union all select id, 2 from h2")
def g1(spark, sf_dir):
    """Everything within two hops of a region, each edge with its first hop."""
    e = numbered(places(spark, sf_dir))
    return G.neighbors(e, spark.createDataFrame([("r1",)], "node string"), 2)


@query("g2_kg_expand", f"with {PLACES}, e as (select subject || '>' || object as id, subject, object from pl), hit as (select * from e where subject in ('s1', 's2', 's3')), f as (select distinct unnest([subject, object]) as v from hit), x as (select * from e where subject in (select v from f) or object in (select v from f)) select distinct id from (select id from hit union all select id from x)")
def g2(spark, sf_dir):
    """Query hits with what lies a hop around them, each edge once."""
    e = numbered(places(spark, sf_dir))
    hits = e.where(F.col("subject").isin("s1", "s2", "s3"))
    ends = hits.select(F.explode(F.array("subject", "object")).alias("node"))
    return hits.select("id").union(G.neighbors(e, ends, 1).select("id")).distinct()


def ppr_sql(iterations: int) -> str:
    steps = ["m0 as (select 's' || s_suppkey as node, 1.0::double / (select count(*) from supplier) as mass from supplier)"]
    for i in range(1, iterations + 1):
        steps.append(f"m{i} as (select node, sum(mass) as mass from (select l.dst as node, 0.85 * m.mass / d.d as mass from lk l join deg d on d.src = l.src join m{i - 1} m on m.node = l.src union all select node, 0.15 * mass from m0) group by node)")
    return f"with {PLACES}, lk as (select subject as src, object as dst from pl union select object, subject from pl), deg as (select src, count(*) as d from lk group by 1), " + ", ".join(steps)


def rank(spark, sf_dir):
    p = places(spark, sf_dir)
    links = p.select(F.col("subject").alias("src"), F.col("object").alias("dst")).union(p.select("object", "subject")).distinct()
    return G.pagerank(links, table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node")), 6)


@query("g3_ppr", ppr_sql(6) + " select node, round(mass, 8) as mass from m6")
def g3(spark, sf_dir):
    return rank(spark, sf_dir).select("node", F.round("mass", 8).alias("mass"))


@query("g4_ppr_rank_memories", ppr_sql(6) + ", b as (select o_orderkey as id, max(round(mass, 8)) as mass from orders join m6 on node = 'c' || o_custkey group by 1) select id, mass from b order by mass desc, id limit 50")
def g4(spark, sf_dir):
    """The fifty orders whose entities have most mass: a top-k report."""
    members = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("node"))
    return G.best_per(members, rank(spark, sf_dir).withColumn("mass", F.round("mass", 8)), "id").orderBy(F.desc("mass"), "id").limit(50)


@query("g5_corpus_kg", "with t as (select distinct l_orderkey as item, 'p' || l_partkey as e from lineitem) select a.e as a, b.e as b, count(*)::bigint as n from t a join t b on a.item = b.item and a.e < b.e group by all having count(*) >= 2")
def g5(spark, sf_dir):
    """Entities of one order are linked; counted links of two and more orders. Orders hold a few lines."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.concat(F.lit("p"), "l_partkey").alias("a")).distinct()
    return G.shared_counts(t, "item", "a")


@query("g6_reachable", f"with recursive {PLACES}, lk as (select subject as a, object as b from pl union select object, subject from pl), r as (select 'c7' as node, 0 as h union all select distinct lk.b, h + 1 from r join lk on lk.a = r.node where h < 2) select node, min(h)::int as hops from r group by node")
def g6(spark, sf_dir):
    """Entities within two hops of a customer."""
    p = places(spark, sf_dir)
    links = p.select(F.col("subject").alias("a"), F.col("object").alias("b")).union(p.select("object", "subject")).distinct()
    seen = spark.createDataFrame([("c7", 0)], "node string, hops int")
    frontier = seen
    for h in (1, 2):
        step = links.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(h))
        frontier, seen = step, seen.unionByName(step)
    return seen


@query("g8_containment_path", "select 's' || s_suppkey as place, [n_name, r_name] as path, 2 as depth from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey union all select 'n' || n_nationkey, [r_name], 1 from nation join region on n_regionkey = r_regionkey")
def g8(spark, sf_dir):
    """The chain of places that hold each supplier and nation, at most eight."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    key = lambda c, k: F.concat(F.lit(c), k)
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(key("n", "n_nationkey").alias("child"), key("r", "r_regionkey").alias("parent"), F.col("r_name").alias("name"))
    up = up.unionByName(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(key("s", "s_suppkey").alias("child"), key("n", "n_nationkey").alias("parent"), F.col("n_name").alias("name")))
    return G.containment_paths(up, s.select(key("s", "s_suppkey").alias("place")).unionByName(n.select(key("n", "n_nationkey").alias("place"))))


@query("g9_connected_components", "select 's' || s_suppkey as node, min('s' || s_suppkey) over (partition by s_nationkey) as component from supplier")
def g9(spark, sf_dir):
    """Suppliers that nations tie together; the label is the smallest supplier."""
    s = table(spark, sf_dir, "supplier")
    links = s.select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("t"), "s_nationkey").alias("b"))
    return G.components(links).where(F.startswith("node", F.lit("s")))


@query(
    "g10_entity_resolution",
    r"""with k as (select l_orderkey * 10 + l_linenumber as ord, case l_linenumber % 3 when 0 then 'The ' || p_name when 1 then upper(p_name) else '"' || p_name || '"' end as form from lineitem join part on l_partkey = p_partkey),
n as (select form, ord, regexp_replace(trim(regexp_replace(lower(trim(form, '" ')), '^(the |a |an )', '')), '\s+', ' ', 'g') as key from k)
select key, arg_min(form, struct_pack(o := ord, f := form)) as canonical, count(distinct form)::bigint as forms from n group by key""",
)
def g10(spark, sf_dir):
    """Spellings by their normalized key; the first spelling is the canonical one."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    form = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("The "), "p_name")).when(F.col("l_linenumber") % 3 == 1, F.upper("p_name")).otherwise(F.concat(F.lit('"'), "p_name", F.lit('"')))
    rows = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), form.alias("form"))
    return rows.groupBy(T.entity_key(F.col("form")).alias("key")).agg(F.min_by("form", F.struct("ord", "form")).alias("canonical"), F.countDistinct("form").alias("forms"))


@query("j7_derive_transitive", f"with {PLACES} select distinct a.subject, 'transitively_uses' as predicate, b.object from pl a join pl b on a.object = b.subject where a.predicate = 'uses' and b.predicate = 'uses' and a.subject <> b.object")
def j7(spark, sf_dir):
    return G.derive_transitive(places(spark, sf_dir))


NUMBERED = PLACES + ", pe as (select *, subject || '>' || object as id from pl)"
CO = "co as (select subject, object, min(id) as via1, count(*) over (partition by object) - 1 as n from pe where predicate = 'causes' group by subject, object)"


@query("j8_derive_cooccur", f"with {NUMBERED}, {CO} select subject, object as cause, n::bigint as others from co where n > 0")
def j8(spark, sf_dir):
    """Customers of one nation co-occur: the classes of a common cause, one row a member, with how many others it has."""
    return G.derive(numbered(places(spark, sf_dir))).where("rule = 'co_occurs_with'").select("subject", F.col("object").alias("cause"), F.col("n").alias("others"))


@query("g11_derive", f"with {NUMBERED}, {CO} select distinct 'transitively_uses' as rule, a.subject, b.object, a.id as via1, b.id as via2, 1::bigint as n from pe a join pe b on a.object = b.subject where a.predicate = 'uses' and b.predicate = 'uses' and a.subject <> b.object union all select 'co_occurs_with', subject, object, via1, null, n::bigint from co where n > 0")
def g11(spark, sf_dir):
    return G.derive(numbered(places(spark, sf_dir)))


@query(
    "g8_containment_to",
    """with a as (select s_suppkey as ask_id, s_nationkey as n, n_regionkey as r, s_suppkey % 5 as want, n_name, case when s_suppkey % 3 = 0 then (s_suppkey // 3) % 5 end as direct from supplier join nation on s_nationkey = n_nationkey)
select ask_id, case when ask_id % 11 = 0 or ask_id % 13 = 0 then ask_id % 11 <> 0 when ask_id % 7 = 0 or ask_id % 17 = 0 then false else r = want or coalesce(direct = want, false) end as ratified,
  case when ask_id % 11 = 0 then 'empty' when ask_id % 13 = 0 then 'same' when ask_id % 17 = 0 then 'source_not_found' when ask_id % 7 = 0 then 'target_not_found' when r = want or coalesce(direct = want, false) then 'path' else 'no_path' end as reason,
  case when ask_id % 11 = 0 then []::varchar[] when ask_id % 13 = 0 then ['supplier ' || ask_id] when ask_id % 7 = 0 or ask_id % 17 = 0 then []::varchar[] when coalesce(direct = want, false) then ['s' || ask_id, 'r' || want] when r = want then ['s' || ask_id, 'n' || n, 'r' || want] else []::varchar[] end as path from a""",
)
def g8_to(spark, sf_dir):
    """Whether suppliers lie within stated regions, by their nation or, for some, directly: the shorter way, or why there is none."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    key = lambda c, k: F.concat(F.lit(c), k)
    k = F.col("s_suppkey")
    up = n.select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent")).unionByName(s.select(key("s", k).alias("child"), key("n", "s_nationkey").alias("parent")))
    up = up.unionByName(s.where("s_suppkey % 3 = 0").select(key("s", k).alias("child"), key("r", F.floor(k / 3) % 5).alias("parent")))
    named = lambda x: F.concat(F.lit("Supplier  "), x.cast("string"))
    terms = s.select(named(k).alias("term"), key("s", k).alias("node")).unionByName(r.select(F.col("r_name").alias("term"), key("r", "r_regionkey").alias("node")))
    region = s.withColumn("want", k % 5).join(r, F.col("want") == F.col("r_regionkey"))
    source = F.when(k % 11 == 0, " ").when(k % 13 == 0, named(k)).when(k % 17 == 0, "nobody").otherwise(named(k))
    target = F.when(k % 13 == 0, F.upper(named(k))).when(k % 7 == 0, "nowhere").otherwise(F.col("r_name"))
    return EN.ratified(region.select(k.alias("ask_id"), source.alias("source"), target.alias("target")), terms, up)


FACTS = """same as (select 'c' || c_custkey as a, 'c' || (c_custkey + 1) as b from customer where c_custkey % 3 = 0), more as (select 'c' || c_custkey as a, 'c' || (c_custkey + 5) as b from customer where c_custkey % 10 = 0),
apart as (select 'c' || (c_custkey + 1) as a, 'c' || c_custkey as b from customer where c_custkey % 12 = 0),
o as (select *, o_orderkey % 8 as k, 'c' || o_custkey as h, 's' || (o_orderkey % 50) as session, 'e' || (o_orderkey // 8 * 8) as ev, strftime(o_orderdate, '%Y-%m-%d') as d from orders)"""


def facts(spark, sf_dir):
    """Orders as facts of their customers: of eight, in turn, an event, what it included, types, prices, names, statuses, actions and dates."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    key = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    k = F.col("k")
    tie = lambda n, step, kind: c.where(k % n == 0).select(F.lit(kind).alias("predicate"), key("c", k).alias("handle"), key("c", k + step).alias("other"))
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 8)
    kinds = ["event", "relation", "object_type", "value", "value", "status", "action", "time"]
    pick = lambda **of: F.coalesce(*[F.when(k == int(i[1:]), v) for i, v in of.items()])
    event = key("e", F.floor(F.col("o_orderkey") / 8) * 8)
    said = o.select(
        F.col("o_orderkey").alias("no"), key("s", F.col("o_orderkey") % 50).alias("session"), F.element_at(F.array(*map(F.lit, kinds)), (k + 1).cast("int")).alias("predicate"),
        F.when(k <= 1, event).otherwise(key("c", F.col("o_custkey"))).alias("handle"), F.when(k == 1, key("c", F.col("o_custkey"))).alias("other"),
        pick(k1=F.lit("included"), k3=F.lit("price"), k4=F.lit("Name"), k6=F.lit("ordered")).alias("attribute"),
        pick(k2=F.col("o_orderpriority"), k3=F.col("o_orderkey").cast("string"), k4=key("name ", F.col("o_orderkey") % 7), k5=F.col("o_orderstatus"), k6=F.col("o_orderstatus")).alias("value"),
        pick(k3=F.lit("usd")).alias("unit"), pick(k3=F.col("o_totalprice")).alias("usd"), F.when(k.isin(0, 7), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
    )
    return said.unionByName(tie(3, 1, "coreference").unionByName(tie(12, 1, "distinct")), allowMissingColumns=True), tie(10, 5, "").select(F.col("handle").alias("a"), F.col("other").alias("b"))


@query(
    "g9_entity_bundles",
    f"""with recursive {FACTS}, h as (select a as handle from same union select b from same union select a from apart union select b from apart union select case when k <= 1 then ev else h end from o union select h from o where k = 1),
tied as (select a, b from same union all select a, b from more where a in (select handle from h) and b in (select handle from h)),
tie as (select a, b from tied s where not exists (select 1 from apart x where least(x.a, x.b) = least(s.a, s.b) and greatest(x.a, x.b) = greatest(s.a, s.b))),
e as (select a, b from tie union all select b, a from tie), reach(node, seen) as (select handle, handle from h union select e.b, reach.seen from reach join e on e.a = reach.node),
root as (select node as handle, min(seen) as root from reach group by 1),
ed as (select ev, arg_max(d, o_orderkey) as d from o where k = 0 group by 1),
dt as (select case when k = 0 then ev else h end as handle, d from o where k in (0, 7) union select h, ed.d from o join ed using (ev) where k = 1),
f as (select root, list_sort(list(distinct o_orderpriority) filter (k = 2)) as types, arg_max(o_totalprice, o_orderkey) filter (k = 3) as usd, arg_min('name ' || (o_orderkey % 7), o_orderkey) filter (k = 4) as name,
  list_sort(list(distinct case k when 3 then 'price|' || o_orderkey || '|usd' else 'Name|name ' || (o_orderkey % 7) || '|' end) filter (k in (3, 4))) as "values", list_sort(list(distinct o_orderstatus) filter (k = 5)) as statuses,
  list_sort(list(distinct 'included|' || h) filter (k = 1)) as relations, list_sort(list(distinct 'ordered|' || o_orderstatus) filter (k = 6)) as actions, list_sort(list(distinct session)) as sessions from o join root on handle = case when k <= 1 then ev else h end group by 1),
ds as (select root, list_sort(list(distinct d)) as dates from dt join root using (handle) group by 1),
mine as (select root, list_sort(list(handle)) as handles from root group by 1)
select root, handles, coalesce(types, []) as types, usd, name, coalesce("values", []) as "values", coalesce(dates, []) as dates, coalesce(statuses, []) as statuses, coalesce(relations, []) as relations, coalesce(actions, []) as actions, coalesce(sessions, []) as sessions
from mine left join f using (root) left join ds using (root)""",
)
def g9_bundles(spark, sf_dir):
    """Facts folded over tied handles, with extra ties and event dates passed on to what the events included."""
    rows, extra = facts(spark, sf_dir)
    return EN.bundles(rows, extra)


WITHIN = "w as (select 'o' || o_orderkey as a, 'o' || (o_orderkey // 10) as b from orders where o_orderkey >= 10)"
#: Orders are within the order that a tenth of their key names: a chain of one step a digit.
REACHES = [
    Rule(("?a", "reaches", "?b"), (("?a", "within", "?b"),)),
    Rule(("?a", "reaches", "?c"), (("?a", "reaches", "?b"), ("?b", "within", "?c")), unequal=(("?a", "?c"),)),
    Rule(("?a", "far_within", "?c"), (("?a", "reaches", "?c"),), unless=(("?a", "within", "?c"),)),
    Rule(("?a", "next_within", "?c"), (("?a", "reaches", "?c"),), unless=(("?a", "far_within", "?c"),)),
]


@query(
    "g11_user_rules",
    f"""with recursive {PLACES}, {WITHIN}, r(a, b, round) as (select a, b, 1 from w union select r.a, w.b, round + 1 from r join w on w.a = r.b),
deep as (select max(round) as k from r)
select distinct x.subject, 'transitively_uses' as predicate, y.object, 1 as round from pl x join pl y on x.object = y.subject and x.predicate = 'uses' and y.predicate = 'uses' and x.subject <> y.object
union all select a, 'reaches', b, round from r union all select a, 'far_within', b, round + 1 from r where round > 1
union all select a, 'next_within', b, k + 2 from r, deep where round = 1""",
)
def g11_rules(spark, sf_dir):
    """A built-in rule, a recursive one, and two that ask for what does not hold, one of them in a stratum of its own, to their fixed point; rounds count through the strata."""
    o = table(spark, sf_dir, "orders").where("o_orderkey >= 10").select(F.concat(F.lit("o"), "o_orderkey").alias("subject"), F.lit("within").alias("predicate"), F.concat(F.lit("o"), F.floor(F.col("o_orderkey") / 10)).alias("object"))
    return derived(numbered(places(spark, sf_dir).unionByName(o)), [TRANSITIVE, *REACHES], provenance=False).select("subject", "predicate", "object", "round")


PAIRS = """same as (select 'c' || c_custkey as a, 'c' || (c_custkey + 1) as b from customer where c_custkey % 3 = 0 union all select 'c' || c_custkey, 'c' || (c_custkey + 5) from customer where c_custkey % 10 = 0),
apart as (select 'c' || (c_custkey + 1) as a, 'c' || c_custkey as b from customer where c_custkey % 12 = 0)"""


@query(
    "g9_resolve_entities",
    f"""with recursive {PAIRS}, tie as (select a, b from same s where not exists (select 1 from apart x where least(x.a, x.b) = least(s.a, s.b) and greatest(x.a, x.b) = greatest(s.a, s.b))),
e as (select a, b from tie union all select b, a from tie), h as (select 'c' || c_custkey as handle from customer union select b from same),
r(node, seen) as (select handle, handle from h union select e.b, r.seen from r join e on e.a = r.node),
root as (select node as handle, min(seen) as root from r group by 1),
f as (select root, o_orderkey as id, o_totalprice as usd, o_orderdate as day, o_orderstatus as status from orders join root on handle = 'c' || o_custkey),
folded as (select root, arg_max(usd, struct_pack(a := day, b := id)) as usd, count(distinct strftime(day, '%Y-%m-%d'))::bigint as dates, list_sort(list(distinct status)) as statuses, count(*)::bigint as facts from f group by 1)
select n.root, n.handles::bigint as handles, usd, coalesce(dates, 0) as dates, coalesce(statuses, []) as statuses, coalesce(facts, 0) as facts from (select root, count(*) as handles from root group by 1) n left join folded using (root)""",
)
def g9_resolve(spark, sf_dir):
    """Handles tied by coreferences but not by a pair told distinct; each entity's facts folded: the last price, its dates, its statuses."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    key = lambda x: F.concat(F.lit("c"), x.cast("string"))
    k = F.col("k")
    pairs = lambda n, step: c.where(k % n == 0).select(key(k).alias("a"), key(k + step).alias("b"))
    same = pairs(3, 1).unionByName(pairs(10, 5))
    handles = c.select(key(k).alias("handle")).unionByName(same.select(F.col("b").alias("handle")))
    root = kept(G.resolve_entities(handles, same, pairs(12, 1)))
    o = table(spark, sf_dir, "orders").select(key(F.col("o_custkey")).alias("handle"), "o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    folded = o.join(root, "handle").groupBy("root").agg(
        F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("usd"), F.countDistinct(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("dates"), F.sort_array(F.collect_set("o_orderstatus")).alias("statuses"), F.count("*").alias("facts")
    )
    out = root.groupBy("root").agg(F.count("*").alias("handles")).join(folded, "root", "left")
    return out.select("root", "handles", "usd", F.coalesce("dates", F.lit(0)).alias("dates"), F.coalesce("statuses", F.array().cast("array<string>")).alias("statuses"), F.coalesce("facts", F.lit(0)).alias("facts"))


SPANS = "sp as (select o_orderkey as id, o_custkey as s, case o_orderstatus when 'F' then 'prefers' when 'O' then 'avoids' else 'causes' end as p, o_orderpriority as o, o_orderdate as f, case when o_orderkey % 17 = 0 then null else o_orderdate + to_days((o_totalprice / 5000)::int) end as t, round(o_totalprice / 500000, 4) as confidence from orders)"


def spans(spark, sf_dir):
    days = F.round(F.col("o_totalprice") / 5000).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.when(F.col("o_orderstatus") == "F", "prefers").when(F.col("o_orderstatus") == "O", "avoids").otherwise("causes").alias("predicate"), F.col("o_orderpriority").alias("object"), F.col("o_orderdate").alias("valid_from"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate") + F.make_dt_interval(days)).alias("valid_to"), F.round(F.col("o_totalprice") / 500000, 4).alias("confidence"))


J9 = f"{SPANS}, cf as (select a.id as a, b.id as b from sp a join sp b on a.s = b.s and a.p = b.p and a.o <> b.o and a.id < b.id and a.f < b.t and b.f < a.t)"
J10 = f"{SPANS}, cf as (select a.id as a, b.id as b from sp a join sp b on a.s = b.s and a.o = b.o and (a.p = b.p or (a.p, b.p) in (('prefers', 'avoids'), ('avoids', 'prefers'))) and a.id < b.id and a.f < coalesce(b.t, timestamp '9999-12-31') and b.f < coalesce(a.t, timestamp '9999-12-31'))"


@query("j9_contradiction_overlap", f"with {J9} select a, b from cf")
def j9(spark, sf_dir):
    """A missing end never overlaps here."""
    return G.overlapping_conflicts(spans(spark, sf_dir), ["subject", "predicate"], "object", open_ended=False)


@query("j10_verify_exclusions", f"with {J10} select a, b from cf")
def j10(spark, sf_dir):
    """A missing end lasts for ever here."""
    return G.overlapping_conflicts(spans(spark, sf_dir), ["subject", "object"], "predicate", excludes=ANTONYMS)


@query("g12_verify", f"with {J10} select distinct unnest([a, b]) as id from cf")
def g12(spark, sf_dir):
    """The conflict core: the ids of all conflicting rows, told by counting."""
    return G.conflicting(spans(spark, sf_dir), ["subject", "object"], "predicate", excludes=ANTONYMS).select("id")


@query("g12_conflict_degrees", f"with {J9}, e as (select unnest([a, b]) as id from cf) select id, count(*)::bigint as n from e group by 1")
def g12_degrees(spark, sf_dir):
    """With how many others each edge contradicts itself, without a pair."""
    return G.conflicting(spans(spark, sf_dir), ["subject", "predicate"], "object", open_ended=False)


@query("g13_resolve_lww", "select o_custkey as subject, case o_orderstatus when 'F' then 'prefers' when 'O' then 'avoids' else 'causes' end as predicate, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) as winner, (count(*) - 1)::bigint as beaten from orders group by all having count(distinct o_orderpriority) > 1")
def g13(spark, sf_dir):
    """Of conflicting facts the last written wins."""
    s = spans(spark, sf_dir)
    many = s.groupBy("subject", "predicate").agg(F.countDistinct("object").alias("n")).where("n > 1").select("subject", "predicate")
    return G.winners(s.join(many, ["subject", "predicate"], "left_semi"), ["subject", "predicate"], ["valid_from", "id"])


@query("g13_resolve_evidence", "select o_custkey as subject, case o_orderstatus when 'F' then 'prefers' when 'O' then 'avoids' else 'causes' end as predicate, arg_max(o_orderkey, struct_pack(c := round(o_totalprice / 500000, 4), d := o_orderdate, k := o_orderkey)) as winner, (count(*) - 1)::bigint as beaten from orders group by all")
def g13e(spark, sf_dir):
    return G.winners(spans(spark, sf_dir), ["subject", "predicate"], ["confidence", "valid_from", "id"])


@query("g14_resolve_replay", "with v as (select user_id as r_key, event_type as theta, (value > 40)::int as vote, event_id as seq from events) select r_key, theta, arg_max(vote, seq) as verdict, count(*)::bigint as verdicts from v group by all")
def g14(spark, sf_dir):
    """On replay the last verdict of a key counts."""
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("r_key"), F.col("event_type").alias("theta"), (F.col("value") > 40).cast("int").alias("vote"), F.col("event_id").alias("seq"))
    return v.groupBy("r_key", "theta").agg(F.max_by("vote", "seq").alias("verdict"), F.count("*").alias("verdicts"))


@query("d11_first_decision", "select user_id as key, arg_min(event_type, event_id) as decision, count(*)::bigint as tries from events group by 1")
def d11(spark, sf_dir):
    """In the decision log the first decision of a key counts."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.min_by("event_type", "event_id").alias("decision"), F.count("*").alias("tries"))


@query("g15_revise_dormant", f"with {J10}, fl as (select * from sp where id in (select unnest([a, b]) from cf)), n as (select id, s, o, row_number() over (partition by s, o order by f, confidence, id) as n, count(*) over (partition by s, o) as k, min(struct_pack(f := f, c := confidence)) over (partition by s, o) = max(struct_pack(f := f, c := confidence)) over (partition by s, o) as alike from fl) select id from n where n = 1 and k >= 2 and not alike")
def g15(spark, sf_dir):
    """Of each flagged group exactly the weakest goes dormant."""
    s = spans(spark, sf_dir)
    flagged = s.join(g12(spark, sf_dir), "id", "left_semi")
    return G.weakest(flagged, ["subject", "object"], ["valid_from", "confidence"]).select("id")


@query("g16_kg_supersede", f"with {SQL_EDGES} select id, valid_to is not null as closed, coalesce(date_diff('day', valid_from, valid_to), -1)::int as days from kg")
def g16(spark, sf_dir):
    """Each new belief closes the open one before it."""
    return edges(spark, sf_dir).select("id", F.col("valid_to").isNotNull().alias("closed"), F.coalesce(F.datediff("valid_to", "valid_from"), F.lit(-1)).alias("days"))


@query(
    "g16_belief_sink",
    """with o as (select o_orderkey as id, 'c' || o_custkey as subject, o_orderstatus as predicate, o_orderpriority as object, o_orderdate as valid_from, lead(o_orderdate) over (partition by o_custkey, o_orderstatus order by o_orderkey) as next from orders where o_orderkey % 5 <> 0),
gone as (select o_orderkey - 4 as id, min(o_orderdate) as since, min(o_orderkey) as seq from orders where o_orderkey % 5 = 0 group by 1),
n as (select *, lead(id) over (partition by subject, predicate order by id) as next_id from o)
select n.id, subject, predicate, object, valid_from, case when next_id is null or coalesce(seq < next_id, false) then coalesce(since, next) else next end as valid_to from n left join gone on gone.id = n.id""",
)
def g16_sink(spark, sf_dir):
    """Orders applied to a versioned table in three changes: each supersedes its customer's last of the status, every fifth takes a belief back."""
    o = table(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("subject"))
    gone = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") - 4).alias("id"), F.col("o_orderdate").alias("at")).join(old, "id")
    gone = gone.select("seq", F.lit("invalidate").alias("op"), "id", "subject", F.lit(None).cast("string").alias("predicate"), F.lit(None).cast("string").alias("object"), "at")
    news = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("seq"), F.lit("supersede").alias("op"), F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("subject"), F.col("o_orderstatus").alias("predicate"), F.col("o_orderpriority").alias("object"), F.col("o_orderdate").alias("at"))
    changes = kept(news.unionByName(gone))
    store = V.Versioned(f"{G.shared_folder(spark)}/tessera/beliefs-{uuid.uuid4().hex}", ("subject",), V.BELIEFS)
    third = changes.agg(F.max("seq")).first()[0] // 3
    for k, part in enumerate((F.col("seq") <= third, F.col("seq").between(third + 1, 2 * third), F.col("seq") > 2 * third)):
        V.believe(spark, store, changes.where(part), f"part {k}")
    G.forgotten(changes)
    store.vacuum(spark)
    return store.read(spark)


@query("g17_distill", f"with {PLACES}, dv as (select distinct a.subject, b.object from pl a join pl b on a.object = b.subject where a.predicate = 'uses' and b.predicate = 'uses'), have as (select 's' || s_suppkey as subject, 'r' || (s_suppkey % 5) as object from supplier) select subject, object from dv anti join have using (subject, object)")
def g17(spark, sf_dir):
    """Derived edges that do not hold already are appended."""
    have = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("subject"), F.concat(F.lit("r"), F.col("s_suppkey") % 5).alias("object"))
    return G.derive_transitive(places(spark, sf_dir)).select("subject", "object").join(have, ["subject", "object"], "left_anti")


@query("a9_induce_rules", "select l_returnflag as rule_id, l_linestatus as predicate, count(*)::bigint as support, round(avg(1 - l_discount * 4), 6) as confidence from lineitem group by all having count(*) >= 3 and avg(1 - l_discount * 4) >= 0.7")
def a9(spark, sf_dir):
    c = F.avg(1 - F.col("l_discount") * 4)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("rule_id"), F.col("l_linestatus").alias("predicate")).agg(F.count("*").alias("support"), F.round(c, 6).alias("confidence")).where("support >= 3 and confidence >= 0.7")


@query("a10_kg_density", f"with {SQL_EDGES}, o as (select * from kg where valid_to is null and not dormant), v as (select count(distinct x)::bigint as n_nodes from (select unnest([subject, object]) as x from o)) select n_nodes, (select count(*) from o)::bigint as n_edges, round(least(1, (select count(*) from o) / (n_nodes * (n_nodes - 1))), 9) as density from v")
def a10(spark, sf_dir):
    d = G.density(edges(spark, sf_dir).where("valid_to is null and not dormant"))
    return d.select("n_nodes", "n_edges", F.round("density", 9).alias("density"))


@query("r13_entity_bridge", "with m as (select distinct l_orderkey as item, l_partkey as entity from lineitem), d as (select entity from m group by 1 having count(*) <= 40), k as (select * from m where entity in (select entity from d)), s as (select o_orderkey as item, o_custkey as query_id from orders where o_orderkey % 20 = 0), a as (select distinct query_id, entity from s join k using (item)) select query_id, item, count(*)::bigint as shared from a join k using (entity) where (query_id, item) not in (select query_id, item from s) group by all having count(*) >= 2")
def r13(spark, sf_dir):
    """Orders that share parts with a customer's seed orders."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("entity"))
    seeds = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("query_id"))
    return G.bridged(m, seeds, 2, 40)


@query("x13_contradiction_inject", "with p as (select o_orderkey as id, o_orderpriority as o from orders order by sha1(o_orderkey::varchar) limit 30) select id, kind, case kind when 'antonym' then 'not ' || o else o end as object, id + case kind when 'antonym' then 10000000 when 'overlap' then 20000000 else 30000000 end as new_id from p, (values ('antonym'), ('overlap'), ('duplicate')) k(kind)")
def x13(spark, sf_dir):
    """A seeded sample of edges, each cloned as an antonym, an overlap and a duplicate."""
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("o")).orderBy(F.sha1(F.col("id").cast("string"))).limit(30)
    kinds = F.explode(F.array(*map(F.lit, ("antonym", "overlap", "duplicate"))))
    k = p.withColumn("kind", kinds)
    shift = F.when(F.col("kind") == "antonym", 10000000).when(F.col("kind") == "overlap", 20000000).otherwise(30000000)
    return k.select("id", "kind", F.when(F.col("kind") == "antonym", F.concat(F.lit("not "), "o")).otherwise(F.col("o")).alias("object"), (F.col("id") + shift).alias("new_id"))


G18 = f"""with {NUMBERED}, {CO}, {J10}, core as (select distinct unnest([a, b]) as id from cf),
walked as (select distinct a.subject, b.object, a.id, b.id from pe a join pe b on a.object = b.subject where a.predicate = 'uses' and b.predicate = 'uses' and a.subject <> b.object),
fl as (select * from sp where id in (select id from core)),
n as (select id, row_number() over (partition by s, o order by f, confidence, id) as n, count(*) over (partition by s, o) as k, min(struct_pack(f := f, c := confidence)) over (partition by s, o) = max(struct_pack(f := f, c := confidence)) over (partition by s, o) as alike from fl),
have as (select 's' || s_suppkey as subject, 'r' || (s_suppkey % 5) as object from supplier)
select (select count(*) from walked)::bigint + (select count(*) from co where n > 0)::bigint as candidates, (select count(*) from core) = 0 as satisfiable, (select count(*) from core)::bigint as unsat_core,
  (select count(*) from n where n = 1 and k >= 2 and not alike)::bigint as dormant, (select count(*) from (select distinct subject, object from walked) anti join have using (subject, object))::bigint as distilled,
  (select count(*) from (select 1 from lineitem group by l_returnflag, l_linestatus having count(*) >= 3 and avg(1 - l_discount * 4) >= 0.7))::bigint as promoted"""


@query("g18_pipeline", G18)
def g18(spark, sf_dir):
    """Derive, verify, revise, distill and induce as one job: its report."""
    derived = kept(g11(spark, sf_dir))
    s = spans(spark, sf_dir)
    core = kept(g12(spark, sf_dir))
    dormant = G.weakest(s.join(core, "id", "left_semi"), ["subject", "object"], ["valid_from", "confidence"])
    have = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("subject"), F.concat(F.lit("r"), F.col("s_suppkey") % 5).alias("object"))
    distilled = derived.where("rule = 'transitively_uses'").select("subject", "object").distinct().join(have, ["subject", "object"], "left_anti")
    out = None
    for name, rows in (("candidates", derived), ("unsat_core", core), ("dormant", dormant), ("distilled", distilled), ("promoted", a9(spark, sf_dir))):
        n = rows.agg(F.count("*").alias(name))  # one row each
        out = n if out is None else out.join(F.broadcast(n))
    return out.select("candidates", (F.col("unsat_core") == 0).alias("satisfiable"), "unsat_core", "dormant", "distilled", "promoted")


@query("j6_shared_entity_pairs", "with m as (select distinct l_orderkey as item, l_partkey as entity from lineitem), k as (select item, entity from m where entity in (select entity from m group by 1 having count(*) <= 40)) select a.item as a, b.item as b, count(*)::bigint as shared from k a join k b on a.entity = b.entity and a.item < b.item group by all having count(*) >= 2")
def j6(spark, sf_dir):
    """Items that share two entities and more; entities of more than forty items tie nothing, which bounds an entity's pairs."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("entity")).distinct()
    m = m.join(m.groupBy("entity").agg(F.count("*").alias("df")).where("df <= 40").select("entity"), "entity", "left_semi")
    return G.shared_counts(m, "entity", "item").withColumnRenamed("n", "shared")


@query("w13_best_of_group", "select l_partkey as part, arg_max(l_orderkey, struct_pack(a := l_extendedprice, b := -l_orderkey)) as best, max(l_extendedprice) as mass from lineitem group by 1")
def w13(spark, sf_dir):
    """The best member of each group by its mass; equal masses go to the smaller one."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(F.col("l_partkey").alias("part")).agg(F.max_by("l_orderkey", F.struct("l_extendedprice", -F.col("l_orderkey"))).alias("best"), F.max("l_extendedprice").alias("mass"))
