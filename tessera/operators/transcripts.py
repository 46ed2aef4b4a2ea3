"""Documents and transcripts: lines with offsets, search in lines, failures and their fixes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_starts(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, line_no, line, start): every line with the place of its first character, by a running sum of lengths."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("long"))


def grep(lines: DataFrame, pattern: str, context: int = 0) -> DataFrame:
    """(id, line_no, start, match): the first match of each line, with its absolute place."""
    hit = lines.withColumn("match", F.regexp_extract("line", pattern, 0)).where(F.col("match") != "")
    return hit.select("id", "line_no", (F.col("start") + F.instr("line", F.col("match")) - 1).alias("start"), "match", F.greatest(F.lit(0), F.col("line_no") - context).alias("from_line"), (F.col("line_no") + context).alias("to_line"))


ARC_SCHEMA = "session string, tool string, signature string, failed_at long, fixed_at long, repeats int"


class Arcs:
    """A session's failures by tool and signature, and which of them still wait for a fix."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.found: dict[tuple[str, str], dict] = {}
        self.waiting: deque[tuple[int, str, str]] = deque()

    def call(self, at: int, tool: str, ok: bool, signature: str) -> None:
        while self.waiting and at - self.waiting[0][0] > self.window:
            self.waiting.popleft()
        if ok:
            latest = next((w for w in reversed(self.waiting) if w[1] == tool), None)
            if latest:
                self.waiting.remove(latest)
                arc = self.found[latest[1:]]
                if arc["fixed_at"] is None:
                    arc["fixed_at"] = at
        elif (tool, signature) in self.found or len(self.found) < self.most:
            arc = self.found.setdefault((tool, signature), {"failed_at": at, "fixed_at": None, "repeats": 0})
            arc["repeats"] += 1
            self.waiting.append((at, tool, signature))

    def rows(self, session: str) -> list[tuple]:
        return [(session, *key, a["failed_at"], a["fixed_at"], a["repeats"]) for key, a in self.found.items()]


def failure_arcs(calls: DataFrame, window: int = 25, most: int = 2000) -> DataFrame:
    """Each session's distinct failures, how often they came, and the success that first resolved them.

    ``calls`` (session, idx, tool, ok, signature). A success resolves the latest failure of
    its tool that waits, at most ``window`` calls old. A failure that comes again counts on
    the first, whenever it comes. At most ``most`` distinct failures of a session are kept.
    The order of calls decides: sorted calls stream by, and only a session's arcs are held.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["session", "tool", "signature", "failed_at", "fixed_at", "repeats"]
        table = lambda rows: pd.DataFrame(rows, columns=names).astype({"fixed_at": "Int64"})
        session, arcs = None, Arcs(window, most)
        for pdf in pdfs:
            out = []
            for s, at, tool, ok, sig in zip(pdf["session"], pdf["idx"], pdf["tool"], pdf["ok"], pdf["signature"], strict=True):
                if s != session:
                    out += arcs.rows(session)
                    session, arcs = s, Arcs(window, most)
                arcs.call(int(at), tool, bool(ok), sig)
            yield table(out)
        yield table(arcs.rows(session))

    ordered = calls.select("session", "idx", "tool", "ok", "signature").repartition("session").sortWithinPartitions("session", "idx")
    return ordered.mapInPandas(run, ARC_SCHEMA)


def failure_then_fix(calls: DataFrame, window: int = 25) -> DataFrame:
    """(session, tool, fixed_at, failed_at): a success with the latest failure of its tool within ``window`` calls."""
    w = Window.partitionBy("session", "tool").orderBy("idx").rangeBetween(-window, -1)
    last = F.last(F.when(~F.col("ok"), F.col("idx")), ignorenulls=True).over(w)
    return calls.withColumn("failed_at", last).where("ok and failed_at is not null").select("session", "tool", F.col("idx").alias("fixed_at"), "failed_at")


def arc_candidates(arcs: DataFrame, min_repeats: int = 3) -> DataFrame:
    """Rules that many arcs agree on: one signature, one rule, enough repeats or several sessions."""
    g = arcs.groupBy("tool", "signature").agg(F.countDistinct("rule").alias("rules"), F.sum("repeats").alias("repeats"), F.countDistinct("session").alias("sessions"), F.max_by("rule", F.struct("repeats", "session")).alias("rule"))
    return g.where((F.col("rules") == 1) & ((F.col("repeats") >= min_repeats) | (F.col("sessions") >= 2))).drop("rules")
