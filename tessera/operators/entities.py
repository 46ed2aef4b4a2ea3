"""Entities: ways from a place or type up to a stated one, and facts folded over tied handles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import kept, only, resolve_entities

# Relations along which an event's date passes on, and attributes that name a thing.
HOLDS = ("included", "includes", "part_of", "contains", "installed_during", "done_during")
NAMES = ("name", "brand_model", "model", "title", "label", "brand")


def canonical(text: Column) -> Column:
    """Lower case, single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def ratified(asks: DataFrame, terms: DataFrame, up: DataFrame, depth: int = 6) -> DataFrame:
    """(ask_id, ratified, reason, path) of ``asks`` (ask_id, source, target): whether the source lies within the target.

    ``terms`` (term, node) names nodes, several by one term and one by several; ``up`` (child,
    parent) are the holders, several of a node. The shortest way of at most ``depth`` steps from
    any node of the source to any of the target is told, of several the one with the smallest
    nodes from the source on. Both ends are searched at once, a step each in turn, so a frontier
    is as wide as half the way makes it. A frontier belongs to a term, not to a question: what lies
    below a target is told once for all questions that ask for it. A question leaves when its ends
    have met, and a term with its last question. Reasons: empty, same, source_not_found,
    target_not_found, no_path, path.
    """
    return only(lambda: _ratified(asks, terms, up, depth))


def _ratified(asks: DataFrame, terms: DataFrame, up: DataFrame, depth: int) -> DataFrame:
    asks = kept(asks.select("ask_id", canonical(F.col("source")).alias("source"), canonical(F.col("target")).alias("target")))
    names = terms.select(canonical(F.col("term")).alias("term"), F.col("node").cast("string").alias("node")).where("term <> '' and node is not null").distinct()
    links = kept(up.select(F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent")).where("child is not null and parent is not null").distinct())
    open_ = asks.where("source <> '' and target <> '' and source <> target")

    def ends(side: str) -> DataFrame:
        return kept(open_.select(side).distinct().join(names, F.col(side) == F.col("term")).select(side, "node", F.array("node").alias("path")))

    down, back = ends("source"), ends("target")
    seen = [down.select("source", "node"), back.select("target", "node")]
    has_source, has_target = down.select("source").distinct(), back.select("target").distinct()
    asked = kept(open_.select("source", "target").distinct().join(has_source, "source", "left_semi").join(has_target, "target", "left_semi"))
    down, back, told = down.join(asked, "source", "left_semi"), back.join(asked, "target", "left_semi"), None
    for step in range(depth + 1):
        if step % 2:  # the sources go up
            grown = down.join(links, F.col("node") == F.col("child")).select("source", F.col("parent").alias("node"), F.concat("path", F.array("parent")).alias("path"))
            down = kept(grown.groupBy("source", "node").agg(F.min("path").alias("path")).join(seen[0], ["source", "node"], "left_anti"))
            seen[0] = seen[0].unionByName(down.select("source", "node"))
        elif step:  # the targets go down
            grown = back.join(links, F.col("node") == F.col("parent")).select("target", F.col("child").alias("node"), F.concat(F.array("child"), "path").alias("path"))
            back = kept(grown.groupBy("target", "node").agg(F.min("path").alias("path")).join(seen[1], ["target", "node"], "left_anti"))
            seen[1] = seen[1].unionByName(back.select("target", "node"))
        rest = F.expr("slice(behind, 2, size(behind))")
        met = asked.join(down, "source").join(back.withColumnRenamed("path", "behind"), ["target", "node"])
        met = kept(met.groupBy("source", "target").agg(F.min(F.concat("path", rest)).alias("path")))
        told = met if told is None else told.unionByName(met)
        asked = kept(asked.join(met, ["source", "target"], "left_anti"))
        down, back = kept(down.join(asked, "source", "left_semi")), kept(back.join(asked, "target", "left_semi"))
        if down.isEmpty() or back.isEmpty():
            break
    found = asks.join(told, ["source", "target"], "left").join(has_source.withColumn("s", F.lit(True)), "source", "left").join(has_target.withColumn("t", F.lit(True)), "target", "left")
    empty, same = (F.col("source") == "") | (F.col("target") == ""), F.col("source") == F.col("target")
    reason = F.when(empty, "empty").when(same, "same").when(F.col("s").isNull(), "source_not_found").when(F.col("t").isNull(), "target_not_found").when(F.col("path").isNull(), "no_path").otherwise("path")
    path = F.when(empty, F.array().cast("array<string>")).when(same, F.array("source")).otherwise(F.coalesce("path", F.array().cast("array<string>")))
    return found.select("ask_id", reason.isin("same", "path").alias("ratified"), reason.alias("reason"), path.alias("path"))


FACTS = "no long, session string, predicate string, handle string, other string, attribute string, value string, unit string, usd double, date string"


def bundles(facts: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """A row an entity, by the smallest of its handles, with what the facts say of it.

    ``facts`` (FACTS), told in the order of ``no``: `coreference` ties ``handle`` and ``other``,
    `distinct` keeps that very pair from being tied; ``extra`` (a, b) are further ties of known
    handles, under the same guard. `object_type` gives a type (``value``); `value` an attribute
    with value and unit, the last ``usd`` and the first name; `time` and `event` a date (an
    event's handle is ``handle``); `status` a status; `relation` a relation (``attribute``) of
    ``handle`` to ``other``; `action` a verb (``attribute``) with a status (``value``). The last
    date of an event passes on to what a relation says it holds. Sets are sorted; nulls are not
    kept in them.
    """
    return only(lambda: _bundles(facts, extra))


def _bundles(facts: DataFrame, extra: DataFrame | None) -> DataFrame:
    facts = kept(facts)
    p = F.col("predicate")
    handles = facts.select(F.explode(F.array("handle", F.when(p.isin("coreference", "distinct", "relation"), F.col("other")))).alias("handle")).where("handle is not null").distinct()
    pairs = lambda kind: facts.where((p == kind) & F.col("handle").isNotNull() & F.col("other").isNotNull()).select(F.col("handle").alias("a"), F.col("other").alias("b"))
    same = pairs("coreference")
    if extra is not None:
        for side in ("a", "b"):
            extra = extra.join(handles.withColumnRenamed("handle", side), side, "left_semi")
        same = same.unionByName(extra.select("a", "b"))
    root = kept(resolve_entities(handles, same, pairs("distinct")))
    dated = facts.where((p == "event") & F.col("date").isNotNull()).groupBy("handle").agg(F.max_by("date", "no").alias("date"))
    passed = facts.where((p == "relation") & F.col("attribute").isin(*HOLDS)).select("handle", F.col("other").alias("to")).join(dated, "handle")
    passed = passed.select(F.lit(None).cast("long").alias("no"), F.lit("time").alias("predicate"), F.col("to").alias("handle"), "date").distinct()
    said = facts.where(~p.isin("distinct")).unionByName(passed, allowMissingColumns=True).join(root, "handle")
    of = lambda kind, x: F.sort_array(F.collect_set(F.when(p.isin(*kind) & x.isNotNull(), x)))
    text = lambda *cols: F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cols])
    named = (p == "value") & F.col("usd").isNull() & F.lower("attribute").isin(*NAMES) & (F.col("value") != "")
    folded = said.groupBy("root").agg(
        of(["object_type"], F.col("value")).alias("types"), F.max_by(F.col("usd"), F.when(p.isin("value", "quantity") & F.col("usd").isNotNull(), F.col("no"))).alias("usd"),
        F.min_by("value", F.when(named, F.col("no"))).alias("name"), of(["value"], F.when(F.col("value").isNotNull(), text(*map(F.col, ("attribute", "value", "unit"))))).alias("values"),
        of(["time", "event"], F.col("date")).alias("dates"), of(["status"], F.col("value")).alias("statuses"),
        of(["relation"], F.when(F.col("attribute").isNotNull(), text(F.col("attribute"), F.col("other")))).alias("relations"),
        of(["action"], F.when(F.col("attribute").isNotNull(), text(F.col("attribute"), F.col("value")))).alias("actions"), F.sort_array(F.collect_set("session")).alias("sessions"),
    )
    mine = root.groupBy("root").agg(F.sort_array(F.collect_set("handle")).alias("handles"))
    lists = ("types", "values", "dates", "statuses", "relations", "actions", "sessions")
    none = F.array().cast("array<string>")
    out = mine.join(folded, "root", "left")  # handles that only a distinct pair names have no facts
    return out.select("root", "handles", *[F.coalesce(c, none).alias(c) if c in lists else F.col(c) for c in folded.columns if c != "root"])
