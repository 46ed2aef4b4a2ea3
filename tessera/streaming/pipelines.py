"""Structured Streaming twins: the same folds over arriving files.

Sources are files (event rows as Parquet or JSON, or growing line files: ``sources.lines``).
State is bounded: windows by watermarks, folds by the watermark and an idle time. Sinks are the caller's: each function returns a streaming DataFrame or starts a query whose
batches are written idempotently by their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.operators.transcripts import Arcs

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1000, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of each window and type; rows later than ``late`` are left out."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once, as long as its repeats come within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


class OrderedFold(StatefulProcessor):
    """A fold over each session's rows in the order of (ts, event_id), however batches bring them.

    Rows wait in the state until the watermark has passed them, as none before them can come any
    more (later ones are dropped by the source of the watermark); then they are folded in order.
    A session that has been idle for ``idle_ms`` of event time tells what it ends with and leaves
    the state; rows that come after that begin a session anew.

    ``fold()`` makes a fold with ``step(row)``, which returns output rows, and ``end()``. Rows are
    dicts of the payload; outputs are tuples of ``columns`` without the session.
    """

    def __init__(self, fold: Callable[[], object], columns: list[str], idle_ms: int):
        self.fold, self.columns, self.idle = fold, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "fold binary, last long")
        self.waiting = handle.getListState("waiting", "ts long, event_id long, payload binary")

    def _told(self, key, rows):
        import pandas as pd

        return pd.DataFrame([(key[0], *r) for r in rows], columns=["session", *self.columns])

    def _drained(self, key, timer_values, fresh):
        """Folds what the watermark has passed, keeps the rest, and sets the next timer."""
        import pickle

        mark = timer_values.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = sorted([*held, *fresh], key=lambda r: r[:2])
        fold, last = self.fold(), -1
        if self.state.exists():
            told, last = self.state.get()
            fold = pickle.loads(bytes(told))
        due = [r for r in rows if r[0] <= mark]
        rest, out = rows[len(due) :], []
        for _, _, payload in due:
            out += fold.step(pickle.loads(bytes(payload)))
        last = max([last, *[r[0] for r in rows]])
        leaves = last // 1000 + self.idle
        if not rest and leaves <= mark // 1000:
            out += fold.end()
            self.state.clear()
            self.waiting.clear()
            return self._told(key, out)
        self.state.update((pickle.dumps(fold), last))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.handle.registerTimer(max(-(-rest[0][0] // 1000) if rest else leaves, mark // 1000 + 1))
        return self._told(key, out)

    def handleInputRows(self, key, rows, timerValues):
        import pickle

        fresh = []
        for pdf in rows:
            ts = pdf["ts"].astype("datetime64[us]").astype("int64")
            payload = pdf.drop(columns=["ts", "session"]).to_dict("records")
            fresh += [(int(t), int(r["event_id"]), pickle.dumps(r)) for t, r in zip(ts, payload, strict=True)]
        yield self._drained(key, timerValues, fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():  # a session that has left may have timers
            yield self._drained(key, timerValues, [])

    def close(self) -> None:
        pass


class ArcFold:
    """The batch fold of failures and fixes; with ``final`` all arcs are told at the session's end, otherwise each when it is resolved."""

    def __init__(self, window: int, most: int, final: bool):
        self.arcs, self.calls, self.final = Arcs(window, most), 0, final

    def step(self, row: dict) -> list[tuple]:
        self.calls += 1
        before = {k for k, a in self.arcs.found.items() if a["fixed_at"] is not None} if row["ok"] and not self.final else set()
        self.arcs.call(self.calls, row["tool"], bool(row["ok"]), row["signature"])
        if self.final or not row["ok"]:
            return []
        return [r[1:] for r in self.arcs.rows("") if r[4] is not None and (r[1], r[2]) not in before]

    def end(self) -> list[tuple]:
        return [r[1:] for r in self.arcs.rows("")] if self.final else []


class UsageFold:
    """Whether what was put into a session's turns is cited by the next turn; signals are told at the session's end."""

    def __init__(self, min_injects: int, weak: float):
        self.least, self.weak, self.before, self.counts = min_injects, weak, None, {}

    def step(self, row: dict) -> list[tuple]:
        terms = set(row["terms"]) if row["terms"] is not None else set()
        if self.before is not None and self.before[0] + 1 == row["event_id"]:
            memory, held = self.before[1:]
            if held and len(held & terms) >= min(2, len(held)):
                self.counts[memory][1] += 1
        self.before = None
        if row["injected"]:
            self.counts.setdefault(row["memory"], [0, 0])[0] += 1
            self.before = (row["event_id"], row["memory"], terms)
        return []

    def end(self) -> list[tuple]:
        said = lambda n, used: ("good", 1.0) if used else ("bad", self.weak) if n >= self.least else ("none", 0.0)
        return [(m, n, used, *said(n, used)) for m, (n, used) in sorted(self.counts.items())]


ARC_COLUMNS = {"tool": "string", "signature": "string", "failed_at": "long", "fixed_at": "double", "repeats": "int"}
USAGE_COLUMNS = {"memory": "long", "injects": "long", "uses": "long", "signal": "string", "weight": "double"}


def _folded(rows: DataFrame, fold: Callable[[], object], columns: dict[str, str], late: str, idle_ms: int) -> DataFrame:
    schema = ", ".join(f"{n} {t}" for n, t in {"session": "string", **columns}.items())
    return rows.withWatermark("ts", late).groupBy("session").transformWithStateInPandas(OrderedFold(fold, list(columns), idle_ms), schema, "Append", "EventTime")


def failure_arcs(calls: DataFrame, window: int = 25, most: int = 2000, late: str = "1 hour", idle_ms: int = 86_400_000, final: bool = False) -> DataFrame:
    """Streaming twin of the batch fold; ``calls`` (session, ts, event_id, tool, ok, signature)."""
    out = _folded(calls, lambda: ArcFold(window, most, final), ARC_COLUMNS, late, idle_ms)
    return out.withColumn("fixed_at", F.col("fixed_at").cast("long"))


def usage_signals(turns: DataFrame, min_injects: int = 2, weak: float = 0.1, late: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """Signals of what was put into turns; ``turns`` (session, ts, event_id: the turn's number, memory, terms, injected)."""
    return _folded(turns, lambda: UsageFold(min_injects, weak), USAGE_COLUMNS, late, idle_ms)


def touched(key: list[str], read_all: Callable[[SparkSession], DataFrame], fold: Callable[[DataFrame], DataFrame], store) -> Callable[[DataFrame, int], None]:
    """For ``project``: reads again, whole, the groups that a batch touches, folds them, and replaces their rows in ``store``.

    The batch tells only which groups changed, so rows that come late, twice or out of order
    change exactly their groups and give what a batch job over all rows would. ``read_all``
    reads the stored events, the batch's among them; ``store`` is a ``versions.Versioned``
    table, which applies a batch's number once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = batch.select(*key).distinct()
        fresh = fold(read_all(spark).join(keys, key, "left_semi"))
        store.replace(spark, fresh, keys, f"batch-{number}")

    return apply


def project(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """A projection kept up to date: ``apply(batch, number)`` must overwrite what that number wrote before.

    Rebuilding is a new checkpoint folder: every event is replayed.
    """
    writer = events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
