"""Usage, feedback, decay, supersession and demand over append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions.text import normalized_query
from tessera.operators.graph import kept
from tessera.operators.ordered import placed


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def usage_counters(events: DataFrame) -> DataFrame:
    """One row a memory: counts of each kind, the last use; counted before the shuffle."""
    kinds = ("match", "inject", "use", "noise", "save")
    return events.groupBy("memory_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in kinds], F.max(F.when(F.col("kind") == "use", F.col("ts"))).alias("last_used"))


def feedback_scores(events: DataFrame, delta: Column, order: list[str], chunk: Column | None = None) -> DataFrame:
    """The running sum of feedback held in [-1, 1] after each step: order decides.

    Clamped additions are closed under composition, so each chunk of a memory's events (by
    default a day of ``order``'s first column, which must rise with it) is folded to one
    function on its own, and a memory only gathers its chunks.
    """
    rows = events.withColumn("d", delta).where("d is not null").withColumn("__chunk", F.to_date(order[0]) if chunk is None else chunk)
    part = rows.groupBy("memory_id", "__chunk").agg(F.array_sort(F.collect_list(F.struct(*order, "d"))).alias("steps"))
    part = part.select("memory_id", F.struct(F.col("__chunk").alias("at"), S.clamp_function(F.transform("steps", lambda x: x["d"])).alias("f")).alias("p"))
    whole = part.groupBy("memory_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return whole.select("memory_id", F.aggregate("ps", F.lit(0.0), lambda x, p: F.greatest(p["f"]["low"], F.least(p["f"]["high"], x + p["f"]["add"]))).alias("feedback"))


def over_capacity(rows: DataFrame, group: list[str], cap: int, strength: str = "strength", key: str = "id") -> DataFrame:
    """The weakest rows beyond a group's capacity."""
    return placed(rows, group, [F.desc(strength), F.col(key)]).where(F.col("place") > cap)


def usage_signals(injected: DataFrame, key: list[str], min_injects: int = 2, weak: float = 0.1) -> DataFrame:
    """(key, injects, uses, signal, weight): ``good`` for what was ever ``used``, a weak ``bad`` for what was put in often and never."""
    rows = injected.groupBy(*key).agg(F.count("*").alias("injects"), F.count_if("used").alias("uses"))
    noise = F.col("injects") >= min_injects
    return rows.select("*", F.when(F.col("uses") > 0, "good").when(noise, "bad").otherwise("none").alias("signal"), F.when(F.col("uses") > 0, 1.0).when(noise, weak).otherwise(0.0).alias("weight"))


def demand_log(asks: DataFrame, query: str = "query", best: str = "best", hits: str = "hits", at: str = "ts") -> DataFrame:
    """Per normalized query: asks, asks without result, best scores, the last ask. Empty queries go."""
    rows = asks.withColumn("q", normalized_query(F.col(query))).where("q <> ''")
    return rows.groupBy("q").agg(F.count("*").alias("ask_count"), F.count_if(F.col(hits) == 0).alias("zero_count"), F.round(F.sum(best), 4).alias("best_sum"), F.greatest(F.lit(0.0), F.max(best)).alias("best_max"), F.max(at).alias("last_asked"))


def demand_gaps(log: DataFrame, min_asks: int = 3, max_best: float = 0.5) -> DataFrame:
    return log.where((F.col("ask_count") >= min_asks) & (F.col("best_max") < max_best)).withColumn("avg_best", F.round(F.col("best_sum") / F.col("ask_count"), 4))


def promotion_candidates(counters: DataFrame, events: DataFrame, min_use: int = 3, max_noise: float = 0.5) -> DataFrame:
    sessions = events.where("kind = 'use'").groupBy("memory_id").agg(F.countDistinct("session").alias("use_sessions"))
    rows = counters.where((F.col("use_count") >= min_use) & ~(F.col("noise_count") / F.col("use_count") >= max_noise))
    return rows.join(sessions, "memory_id", "left").select("memory_id", "use_count", "noise_count", F.coalesce("use_sessions", F.lit(0)).alias("use_sessions"))


def repeat_failures(errors: DataFrame, min_sessions: int = 2, min_days: float = 3.0) -> DataFrame:
    """(signature, session, ts, error_type) as clusters that come again over sessions and days."""
    rows = errors.withColumn("signature", F.trim("signature")).where("signature <> ''")
    out = rows.groupBy("signature").agg(
        F.countDistinct(F.when(F.trim("session") != "", F.col("session"))).alias("sessions"),
        F.count("*").alias("occurrences"),
        F.round((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 86400e6, 4).alias("span_days"),
        F.min_by("error_type", F.struct("ts", "event_id")).alias("first_type"),
    )
    return out.where((F.col("sessions") >= min_sessions) & (F.col("span_days") >= min_days))


def cooccurrence(events: DataFrame, item: str, order: list[str], by: list[str]) -> DataFrame:
    """Counts of neighbouring items, the pair in alphabetical order."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = events.withColumn("next", F.lead(item).over(w)).where("next is not null")
    return rows.groupBy(F.concat_ws("|", F.least(item, "next"), F.greatest(item, "next")).alias("pair")).agg(F.count("*").alias("n"))


def supersession_chain(links: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, last, hops): from each row along (old, new) links, one an old id, until none or a cycle.

    Doubling: after k rounds an open row knows where 2^k hops lead, so chains take log2 of the
    longest many joins, each written. Rows at their end leave the join. While any chain is open,
    the row 2^k + 1 links from its end closes next; so once a round closes none, all open rows
    lead into cycles. Those end where they first meet a row again. ``depth`` stops early, at the
    next power of two, for callers who want no more; none is the default.
    """
    one = kept(links.select(F.col("old").alias("start"), F.col("new").alias("last"), F.lit(1).alias("hops")))
    olds = one.select(F.col("start").alias("last"), F.lit(True).alias("open"))
    now = kept(one.join(olds, "last", "left").select("start", "last", "hops", F.coalesce("open", F.lit(False)).alias("open")))
    n_open, before, step = now.where("open").count(), None, 1
    while n_open and n_open != before and (depth is None or step < depth):
        jump = now.select(F.col("start").alias("last"), F.col("last").alias("then"), F.col("hops").alias("more"), F.col("open").alias("still"))
        moved = now.where("open").join(jump, "last").select("start", F.col("then").alias("last"), (F.col("hops") + F.col("more")).alias("hops"), F.col("still").alias("open"))
        now = kept(now.where("not open").unionByName(moved))
        n_open, before, step = now.where("open").count(), n_open, 2 * step
    if not n_open or n_open != before:
        return now.select("start", "last", "hops")
    return now.where("not open").select("start", "last", "hops").unionByName(_into_cycles(one, now.where("open").select("start", "last")))


def _into_cycles(one: DataFrame, leap: DataFrame) -> DataFrame:
    """(start, last, hops) of rows that lead into cycles, by their links and their leaps of the same many hops.

    Leaps are doubled until they reach no fewer rows than before: those are the cycles' own.
    """
    starts, size, before = leap.select("start"), leap.select("last").distinct().count(), None
    while size != before:
        leap = kept(leap.join(leap.select(F.col("start").alias("last"), F.col("last").alias("then")), "last").select("start", F.col("then").alias("last")))
        size, before = leap.select("last").distinct().count(), size
    ring = kept(leap.select(F.col("last").alias("start")).distinct())
    # Each cycle by its least row: minima over 1, 2, 4... rows, until none changes.
    seen, changed = kept(one.join(ring, "start").select("start", F.col("last").alias("then"), F.col("start").alias("least"))), True
    while changed:
        ahead = seen.select(F.col("start").alias("then"), F.col("then").alias("then2"), F.col("least").alias("least2"))
        seen = kept(seen.join(ahead, "then").select("start", F.col("then2").alias("then"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("changed")))
        changed = not seen.where("changed").isEmpty()
        seen = seen.drop("changed")
    length = seen.groupBy("least").agg(F.count("*").cast("int").alias("n"))
    turns = kept(seen.join(length, "least").select("start", F.col("start").alias("last"), F.col("n").alias("hops")))
    tails = one.join(starts, "start", "left_semi").join(ring, "start", "left_anti")
    tails = supersession_chain(tails.select(F.col("start").alias("old"), F.col("last").alias("new")))
    tails = tails.join(turns.select("last", F.col("hops").alias("n")), "last").select("start", "last", (F.col("hops") + F.col("n")).alias("hops"))
    return turns.unionByName(tails)


def drift(primary: DataFrame, mirror: DataFrame, usage: DataFrame, key: str = "id") -> DataFrame:
    """(id, drift): missing from the mirror, ghosts in the mirror, orphans of the usage table; one outer join."""
    side = lambda d, c: d.select(key).distinct().withColumn(c, F.lit(1))
    rows = side(primary, "p").join(side(mirror, "m"), key, "full_outer").join(side(usage, "u"), key, "full_outer")
    kind = F.array_compact(F.array(F.when(F.col("p").isNotNull() & F.col("m").isNull(), "missing"), F.when(F.col("p").isNull() & F.col("m").isNotNull(), "ghost"), F.when(F.col("p").isNull() & F.col("u").isNotNull(), "orphan")))
    return rows.select(key, F.explode(kind).alias("drift"))
