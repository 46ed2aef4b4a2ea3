"""Graph operators: neighbourhoods, rank, density, components, paths and rule derivation.

Loops join a frontier once a hop and cut lineage with tables in the shared folder; every hop
is bounded by its depth, and minima and sums are combined before shuffles.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only in local sessions without any."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage is cut, and the optimizer knows its size.

    (A checkpoint keeps the estimate of the plan that made it, which the joins of a loop square each round.)
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    if _open.get() is not None:
        _open.get().append(out)
    return out


#: What the innermost ``only`` of this thread has to take away: tables and broadcasts.
_open: ContextVar[list | None] = ContextVar("open", default=None)


def sent(spark: SparkSession, value: Any):
    """A broadcast, taken away with the tables of the ``only`` that it is made in."""
    out = spark.sparkContext.broadcast(value)
    if _open.get() is not None:
        _open.get().append(out)
    return out


def only(make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``make()`` as a table; all tables and broadcasts that were made for them are taken away."""
    outer, inner, out = _open.get(), [], None
    mark = _open.set(inner)
    try:
        out = kept(make())
    finally:
        _open.reset(mark)
        for x in inner:
            if not isinstance(x, DataFrame):
                x.destroy()
            elif x is not out:
                forgotten(x)
    if outer is not None:
        outer.append(out)
    return out


def forgotten(df: DataFrame) -> None:
    """Deletes a table of ``kept`` that nothing reads any more."""
    spark, path = df.sparkSession, df._kept_at
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def neighbors(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """(id, hop): edges within ``depth`` hops of the seeds (node), each with its first hop.

    The frontier grows from both endpoints of the edges found, whatever the direction.
    """
    return only(lambda: _neighbors(edges, seeds, depth, direction))


def _neighbors(edges: DataFrame, seeds: DataFrame, depth: int, direction: str) -> DataFrame:
    cols = edges.select("id", "subject", "object")
    out = cols.select("id", F.col("subject").alias("node"))
    into = cols.select("id", F.col("object").alias("node"))
    touch = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    frontier, seen_nodes, found = seeds.select("node").distinct(), seeds.select("node").distinct(), None
    for hop in range(1, depth + 1):
        ids = touch.join(frontier, "node", "left_semi").select("id").distinct()
        if found is not None:
            ids = ids.join(found, "id", "left_anti")
        step = kept(ids.withColumn("hop", F.lit(hop)))
        found = step if found is None else found.unionByName(step)
        ends = cols.join(step.select("id"), "id", "left_semi").select(F.explode(F.array("subject", "object")).alias("node")).distinct()
        frontier = kept(ends.join(seen_nodes, "node", "left_anti"))
        seen_nodes = seen_nodes.unionByName(frontier)
        if frontier.isEmpty():
            break
    return found


def pagerank(links: DataFrame, seeds: DataFrame, iterations: int = 10, damping: float = 0.85, every: int = 5) -> DataFrame:
    """(node, mass): personalized rank over (src, dst); mass of nodes without links is not given back."""
    seeds = kept(seeds.select("node").distinct().join(links.select(F.col("src").alias("node")).distinct(), "node", "left_semi"))
    n = seeds.count()
    if not n:
        return seeds.select("node", F.lit(0.0).alias("mass")).limit(0)
    degree = links.groupBy("src").agg(F.count("*").alias("d"))
    weighted = kept(links.join(degree, "src").select("src", "dst", (F.lit(damping) / F.col("d")).alias("w")))
    restart = seeds.select("node", F.lit((1 - damping) / n).alias("mass"))
    mass = seeds.select("node", F.lit(1.0 / n).alias("mass"))
    for i in range(1, iterations + 1):
        flow = weighted.join(mass.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), (F.col("w") * F.col("mass")).alias("mass"))
        mass = flow.unionByName(restart).groupBy("node").agg(F.sum("mass").alias("mass"))
        if i % every == 0:
            mass = kept(mass)
            if i > every:
                forgotten(held)
            held = mass
    return mass


def pageranks(links: DataFrame, seeds: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(query_id, node, mass): the personalized rank of many questions at once, from each one's own seeds (query_id, node).

    Each round is a table; mass only stands where a question's walk got to.
    """
    return only(lambda: _pageranks(links, seeds, iterations, damping))


def _pageranks(links: DataFrame, seeds: DataFrame, iterations: int, damping: float) -> DataFrame:
    seeds = seeds.distinct().join(links.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    share = seeds.groupBy("query_id").agg(F.count("*").alias("n"))
    start = kept(seeds.join(share, "query_id").select("query_id", "node", (F.lit(1.0) / F.col("n")).alias("mass")))
    degree = links.groupBy("src").agg(F.count("*").alias("d"))
    weighted = kept(links.join(degree, "src").select("src", "dst", (F.lit(damping) / F.col("d")).alias("w")))
    restart = start.select("query_id", "node", (F.col("mass") * (1 - damping)).alias("mass"))
    mass = start
    for _ in range(iterations):
        flow = weighted.join(mass.withColumnRenamed("node", "src"), "src").select("query_id", F.col("dst").alias("node"), (F.col("w") * F.col("mass")).alias("mass"))
        mass = kept(flow.unionByName(restart).groupBy("query_id", "node").agg(F.sum("mass").alias("mass")))
    return mass


def best_per(members: DataFrame, mass: DataFrame, group: str) -> DataFrame:
    """(group, mass): each group's largest mass over its nodes."""
    return members.join(mass, "node").groupBy(group).agg(F.max("mass").alias("mass"))


def density(edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, density): E / (n (n - 1)) of directed edges, held in [0, 1]."""
    e = edges.agg(F.count("*").alias("n_edges"))
    v = edges.select(F.explode(F.array("subject", "object")).alias("v")).distinct().agg(F.count("*").alias("n_nodes"))
    d = F.when(F.col("n_nodes") < 2, 0.0).otherwise(F.least(F.lit(1.0), F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))))
    return e.join(F.broadcast(v)).select("n_nodes", "n_edges", d.alias("density"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reached over (a, b), for every node of a link.

    Alternating stars to the fixed point: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours to the smallest, until no link changes, in about
    log2 of the longest path many rounds. A node linked with itself alone is its own component.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null").distinct()
    now, state = kept(pairs.where("u <> v")), None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if seen == state or not seen["n"]:
            break
        state, last = seen, now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = kept(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        forgotten(last)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = pairs.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component")).join(stars.select("node"), "node", "left_anti")
    return stars.unionByName(roots.unionByName(alone).distinct())


def derive_transitive(edges: DataFrame, predicate: str = "uses", name: str = "transitively_uses") -> DataFrame:
    """derived(A, name, C) from edge(A, p, B), edge(B, p, C) with A <> C: one step, as a set."""
    e = edges.where(F.col("predicate") == predicate).select("subject", "object").distinct()
    second = e.select(F.col("subject").alias("object"), F.col("object").alias("then"))
    return e.join(second, "object").where("subject <> then").select("subject", F.lit(name).alias("predicate"), F.col("then").alias("object")).distinct()


def _windows(edges: DataFrame, key: list[str], other: str, open_ended: bool) -> DataFrame:
    end = F.coalesce("valid_to", F.lit("9999-12-31").cast("timestamp")) if open_ended else F.col("valid_to")
    return edges.select("id", *key, other, F.col("valid_from").alias("s"), end.alias("e")).where(F.col(other).isNotNull())


def overlapping_conflicts(edges: DataFrame, key: list[str], other: str, open_ended: bool = True, excludes: list[tuple[str, str]] | None = None) -> DataFrame:
    """(a, b): edges with the same key and overlapping belief windows that contradict, a < b.

    They contradict if ``other`` differs; with ``excludes``, if it is the same or a pair of
    those. ``open_ended``: a missing end lasts for ever; otherwise it never overlaps. Keys of
    many rows are swept (``intervals``); where only the rows are asked for, ``conflicting`` makes
    no pairs of them.
    """
    def found():
        small, large = intervals.by_size(_windows(edges, key, other, open_ended), key)
        out = intervals.joined_pairs(small, key, other)
        if large is not None:
            out = out.unionByName(intervals.overlapping_pairs(large, key, other))
        return out.where(_clash(excludes)).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))

    from tessera.operators import intervals

    return only(found)


def _clash(excludes: list[tuple[str, str]] | None):
    x, y = F.col("other"), F.col("other2")
    if excludes is None:
        return x != y
    clash = x == y
    for p, q in excludes:
        clash = clash | ((x == p) & (y == q)) | ((x == q) & (y == p))
    return clash


def conflicting(edges: DataFrame, key: list[str], other: str, open_ended: bool = True, excludes: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, n): the edges of ``overlapping_conflicts``, with how many others each contradicts; where a key has many rows they are counted without pairs."""
    from tessera.operators import intervals

    def counted():
        small, rows = intervals.by_size(_windows(edges, key, other, open_ended), key)
        met = intervals.joined_pairs(small, key, other).where(_clash(excludes))
        found = met.select(F.explode(F.array("id", "id2")).alias("id"), F.lit(1).cast("long").alias("n"))
        if rows is not None:
            same = intervals.overlap_counts(rows, [*key, other])
            if excludes is None:
                found = found.unionByName(intervals.overlap_counts(rows, key)).unionByName(same.select("id", (-F.col("n")).alias("n")))
            else:
                found, pairs = found.unionByName(same), [p for p in excludes if p[0] != p[1]]
                sides = [F.struct(F.lit(i).alias("pair"), F.lit(k).alias("side"), F.lit(v).alias("value")) for i, p in enumerate(pairs) for k, v in enumerate(p)]
                if sides:  # a value of several pairs stands once in each
                    apart = rows.withColumn("of", F.explode(F.filter(F.array(*sides), lambda v: v["value"] == F.col(other)))).select("*", "of.pair", "of.side")
                    found = found.unionByName(intervals.overlap_counts(apart, [*key, "pair"], "side"))
        return found.groupBy("id").agg(F.sum("n").alias("n")).where("n > 0")

    return only(counted)


def winners(rows: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """The row of each conflict group that is last in the order, with how many it beat."""
    return rows.groupBy(*group).agg(F.max_by("id", F.struct(*by)).alias("winner"), (F.count("*") - 1).alias("beaten"))


def weakest(rows: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """Exactly one row of each group of two and more, unless its weakest and strongest are alike."""
    order = F.struct(*by)
    every = F.struct(*[F.col(c) for c in rows.columns])
    told = rows.groupBy(*[F.col(c).alias(f"of_{c}") for c in group]).agg(F.min_by(every, F.struct(*by, "id")).alias("row"), F.count("*").alias("k"), F.min(order).alias("low"), F.max(order).alias("high"))
    return told.where((F.col("k") >= 2) & ~F.col("low").eqNullSafe(F.col("high"))).select("row.*")


def bridged(members: DataFrame, seeds: DataFrame, min_shared: int = 2, max_df: int | None = None) -> DataFrame:
    """(query_id, item, shared): other items that share enough entities with a query's seed items.

    ``members`` (item, entity); entities of more than ``max_df`` items connect nothing.
    """
    m = members.distinct()
    if max_df:
        m = m.join(m.groupBy("entity").agg(F.count("*").alias("df")).where(F.col("df") <= max_df).select("entity"), "entity", "left_semi")
    asked = seeds.join(m, "item").select("query_id", "entity").distinct()
    out = asked.join(m, "entity").join(seeds, ["query_id", "item"], "left_anti")
    return out.groupBy("query_id", "item").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)


#: Pairs that one task of ``shared_counts`` counts, about.
PAIRS = 2_000_000


def shared_counts(members: DataFrame, group: str, item: str, least: int = 2) -> DataFrame:
    """(a, b, n): pairs of items, a < b, that share at least ``least`` groups, from distinct (group, item).

    The pairs are counted before they are made, and tasks are as many as that number asks for:
    no task holds more of them when the tables grow.
    """
    m = kept(members.select(F.col(group).alias("g"), F.col(item).alias("a")))
    size = F.col("c").cast("double")
    made = m.groupBy("g").agg(F.count("*").alias("c")).agg(F.sum(size * (size - 1) / 2)).first()[0] or 0
    tasks = max(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(made // PAIRS) + 1)
    sides = m.repartition(tasks, "g"), m.withColumnRenamed("a", "b").repartition(tasks, "g")
    pairs = sides[0].hint("merge").join(sides[1], "g").where("a < b").select("a", "b").repartition(tasks, "a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def containment_paths(up: DataFrame, starts: DataFrame, depth: int = 8) -> DataFrame:
    """(place, path, depth): the shortest way up from each place, the holders' names from the nearest to the last.

    ``up`` (child, parent, name of the parent). A place goes on while it has a holder that its
    way has not met; of several holders the smallest is taken; ways end after ``depth`` steps.
    """
    up = up.groupBy("child").agg(F.min(F.struct("parent", "name")).alias("to"))
    now = kept(starts.select(F.col("place"), F.col("place").alias("at"), F.array().cast("array<string>").alias("path"), F.array("place").alias("met")))
    done = None
    for _ in range(depth):
        step = now.join(up.withColumnRenamed("child", "at"), "at", "left")
        goes = F.col("to").isNotNull() & ~F.array_contains("met", F.col("to.parent"))
        step = kept(step.select("place", F.when(goes, F.col("to.parent")).alias("at"), F.when(goes, F.concat("path", F.array("to.name"))).otherwise(F.col("path")).alias("path"), F.when(goes, F.concat("met", F.array("to.parent"))).otherwise(F.col("met")).alias("met")))
        ended = step.where("at is null and size(path) > 0").select("place", "path")
        done = ended if done is None else done.unionByName(ended)
        now = step.where("at is not null")
        if now.isEmpty():
            break
    return done.unionByName(now.select("place", "path")).select("place", "path", F.size("path").alias("depth"))


def derive(edges: DataFrame, uses: str = "uses", causes: str = "causes") -> DataFrame:
    """(rule, subject, object, via1, via2, n) of both derivation rules in one job, from (id, subject, predicate, object).

    Transitive use is told edge pair by edge pair. Co-occurrence by a common cause is told as
    classes, one row a subject and cause with how many others the class has: all its pairs are
    the class with itself, and a cause that holds a third of all subjects makes no more rows
    than it has subjects.
    """
    e = edges.where(F.col("predicate") == uses).select("id", "subject", "object")
    then = e.select(F.col("subject").alias("object"), F.col("object").alias("end"), F.col("id").alias("via2"))
    walked = e.join(then, "object").where("subject <> end").select(F.lit("transitively_uses").alias("rule"), "subject", F.col("end").alias("object"), F.col("id").alias("via1"), "via2", F.lit(1).cast("long").alias("n")).distinct()
    c = edges.where(F.col("predicate") == causes).groupBy("subject", "object").agg(F.min("id").alias("via1"))
    size = c.groupBy("object").agg((F.count("*") - 1).alias("n")).where("n > 0")
    shared = c.join(size, "object").select(F.lit("co_occurs_with").alias("rule"), "subject", "object", "via1", F.lit(None).cast(edges.schema["id"].dataType).alias("via2"), "n")
    return walked.unionByName(shared)


def resolve_entities(handles: DataFrame, same: DataFrame, distinct: DataFrame) -> DataFrame:
    """(handle, root): handles that coreferences (a, b) tie together, by the smallest; pairs told ``distinct`` (a, b) tie nothing themselves."""
    pair = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = components(pair(same).join(pair(distinct), ["a", "b"], "left_anti"))
    return handles.select("handle").distinct().join(found.withColumnRenamed("node", "handle"), "handle", "left").select("handle", F.coalesce("component", "handle").alias("root"))
