"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A document's strength is linear in features of its whole text. Every pair of a preferred
(label 1) and a rejected (label 0) document adds the logistic loss of the difference of
their strengths, so only differences of features matter. Scores are thresholded at a
quantile of the strengths of the fitted rows: by default the share of rejected rows; the
score is the logistic of the strength shifted so that the threshold gets ``CUT``.

The fit uses all labelled rows and all their pairs. A pair's loss depends on two strengths
only, so rows are put into bins of strength (``STEP`` wide, each at its mean), and pairs of bins
are weighed by their rows: each of Newton's steps is one pass over the rows. The threshold is
exact: strengths are counted in ever narrower ranges until the two places next to the quantile
are found, both in the same passes. Parts' sums are merged by ``MERGERS`` tasks, however many
shuffle partitions are set. Sums are sums of whole numbers, the same in every order. What reaches the driver is
a row of sums a class and bin, or the counts of one range.

Cases: null texts count as empty and get a score; labels that are null, contradict each
other or have no document are not used; with fewer than two classes nothing is learned
and every document gets ``CUT``, so that nothing is rejected. Documents and labels may
repeat. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forgotten, map_columns, written

CUT = 0.7
STEP = 1 / 16
FAR = 32.0  # strengths beyond it share its bin: their pairs have hardly any loss
FINE = float(1 << 34)  # strengths are put in order as whole numbers of this part
END = 1 << 61  # those whole numbers lie between -END and END
MERGERS = 8  # tasks that merge the parts' sums: a part has one row a class and bin at most

#: Character groups whose shares of the text are features.
GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n\r",
    "stop": b".",
    "comma": b",;:",
    "bang": b"!?",
    "bar": b"|",
    "sign": b"#$%&*@^~+=<>/\\_",
    "quote": b"\"'`()[]{}-",
}
GROUP_OF = np.full(256, len(GROUPS), np.int64)  # bytes of characters beyond ASCII come last
for _i, _chars in enumerate(GROUPS.values()):
    GROUP_OF[np.frombuffer(_chars, np.uint8)] = _i


def features(text: str | None) -> list[float]:
    """Of the whole text; any text, the empty one too, has finite features."""
    raw = (text or "").encode("utf-8", "replace")
    counts = np.bincount(GROUP_OF, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), len(GROUPS) + 1)
    shares = np.log(counts / max(len(raw), 1) + 1e-3)
    words = raw.lower().split()
    n = max(len(words), 1)
    parts = raw.replace(b"\n", b". ").split(b". ")
    size = sum(map(len, words))
    return [
        *shares.tolist(),
        np.log1p(len(words)),
        np.log(len(set(words)) / n + 0.02) + 0.25 * np.log1p(len(words)),  # variety, for its length
        np.log(sum(map(eq, words, words[1:])) / n + 0.01),  # words that repeat at once
        np.log(len(set(parts)) / len(parts) + 0.05),
        np.log(sum(map(eq, parts, parts[1:])) / len(parts) + 0.02),
        size / n / 10,
        np.log(n / len(parts) + 1),
    ]


N_FEATURES = len(features(""))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.strength(x) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def whole(v: np.ndarray) -> np.ndarray:
    """The sums of the columns in two parts, high and low, of whole numbers; values beyond 2 ** 20 count as that."""
    q = np.rint(np.clip(v, -(2.0**20), 2.0**20) * 2.0**40).astype(np.int64)
    return np.concatenate(((q >> 30).sum(0), (q & (2**30 - 1)).sum(0)))


def summed(v: np.ndarray) -> np.ndarray:
    high, low = v.reshape(2, -1).astype(float)
    return high / 2.0**10 + low / 2.0**40


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def strengths(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``z @ w``, added column by column, so that a row's strength does not depend on its batch."""
    out = np.zeros(len(z))
    for j, by in enumerate(w):
        out = out + z[:, j] * by
    return out


def ordered(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(strengths(z, w), -END / FINE, END / FINE) * FINE).astype(np.int64)


def binned(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bin and class, [rows, sums, sums of products]) of a part, as whole numbers of 2 ** -20."""
    key = np.rint(np.clip(strengths(z, w), -FAR, FAR) / STEP).astype(np.int64) * 2 + y
    order = np.argsort(key, kind="stable")
    key, z = key[order], z[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else []
    a, b = np.triu_indices(z.shape[1])
    rows = np.concatenate((np.full((len(z), 1), 2.0**-20), z, z[:, a] * z[:, b]), axis=1)
    return list(zip(key[first].tolist(), np.add.reduceat(np.rint(rows * 2.0**20).astype(np.int64), first, axis=0), strict=True)) if len(key) else []


def newton(bins: dict[int, np.ndarray], w: np.ndarray, ridge: float) -> np.ndarray:
    """The step of Newton's method on the mean logistic loss of all pairs, from bins of both classes."""
    k = len(w)
    (nb, zb, mb), (ng, zg, mg) = ((v[:, 0], v[:, 1 : k + 1] / 2.0**20, v[:, k + 1 :] / 2.0**20) for v in (np.array([v for key, v in sorted(bins.items()) if key % 2 == y], float) for y in (0, 1)))
    p = 1 / (1 + np.exp(-np.clip((zg @ w / ng)[:, None] - (zb @ w / nb)[None, :], -40, 40)))
    pairs = ng.sum() * nb.sum()
    lost, h = p - 1, p * (1 - p)
    grad = ((lost @ nb) @ zg - (ng @ lost) @ zb) / pairs + ridge * w
    own = np.zeros((k, k))
    own[np.triu_indices(k)] = (h @ nb) @ mg + (ng @ h) @ mb
    own = own + np.triu(own, 1).T
    cross = zg.T @ h @ zb
    return np.linalg.solve((own - cross - cross.T) / pairs + ridge * np.eye(k), grad)


def fitted(sums, rank, quantile: float | None = None, ridge: float = 1e-3) -> Model | None:
    """``sums(f)`` merges the (key, whole numbers) that ``f(x, y)`` gives of each part; ``rank(f, *ranks)`` tells order statistics of the whole numbers that ``f(x)`` gives, from 1."""
    first = sums(lambda x, y: [(0, np.array([(y == 0).sum(), (y == 1).sum()])), (1, whole(x))])
    bad, good = map(int, first[0]) if first else (0, 0)
    n = good + bad
    if not good or not bad:
        return None
    mean = summed(first[1]) / n
    scale = np.sqrt(summed(sums(lambda x, y: [(0, whole((x - mean) ** 2))])[0]) / n) + 1e-6
    w = np.zeros(len(mean))
    for _ in range(30):
        step = newton(sums(lambda x, y, w=w: binned(standard(x, mean, scale), y, w)), w, ridge)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    at = min(max(round((bad / n if quantile is None else quantile) * n), 1), n - 1)
    low, high = rank(lambda x: ordered(standard(x, mean, scale), w), at, at + 1)
    return Model(mean, scale, w, (low + high) / FINE / 2)


def fit_pairs(x: np.ndarray, y: np.ndarray, quantile: float | None = None, pairs_per_row: int | None = None, ridge: float = 1e-3) -> Model | None:
    """The fit of rows in memory. All pairs count, whatever ``pairs_per_row`` says; it was the number of partners drawn for a row."""
    y = y.astype(np.int64)
    return fitted(lambda f: dict(f(x, y)), lambda f, *ranks: [int(np.sort(f(x))[r - 1]) for r in ranks], quantile, ridge)


def bucket_of_id(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4


def fit(docs: DataFrame, labels: DataFrame, quantile: float | None = None) -> Model | None:
    """Learns from all labelled documents; ids whose crc32 leaves 2 on division by 4 are held out."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").where(bucket_of_id() != 2)
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2").select("doc_id", F.col("y").cast("int").alias("y"))

    def task():
        return lambda ids, texts, digests: {"doc_id": ids, "digest": digests, "x": [features(t) for t in texts]}

    # Features are made where texts are read, so that no text is shuffled; of an id's rows the one with the greatest digest is taken.
    told = docs.where("doc_id is not null").where(bucket_of_id() != 2).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    told = map_columns(told, ["doc_id", "text", "digest"], "doc_id long, digest string, x array<double>", task)
    rows = written(told.join(marks, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.max_by("x", "digest").alias("x")).select("x", "y"), "features")
    try:
        return fitted(lambda f: _sums(rows, f), lambda f, *ranks: _ranks(rows, f, ranks), quantile)
    finally:
        forgotten(rows)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)


def _sums(rows: DataFrame, f) -> dict[int, np.ndarray]:
    def told(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["key", "v"])

    def add(sums: dict, key: int, v: np.ndarray) -> None:
        sums[key] = sums[key] + v if key in sums else v

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                for key, v in f(*_arrays(b.slice(at, 4096))):
                    add(sums, key, v)
        yield told(sums)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                add(sums, r["key"], np.array(r["v"], np.int64))
        yield told(sums)

    got = rows.mapInArrow(part, "key long, v array<long>").repartition("key").coalesce(MERGERS).mapInArrow(merge, "key long, v array<long>")
    return {r["key"]: np.array(r["v"], np.int64) for r in got.collect()}  # a row a class and bin at most


def _ranks(rows: DataFrame, f, ranks: tuple[int, ...], most: int = 4096) -> list[int]:
    """The order statistics, all in the same passes: a pass counts the bins of each rank's range."""
    spans = [(r, -END, END) for r in ranks]
    while any(low < high for _, low, high in spans):
        ranges = sorted({s[1:] for s in spans})
        widths = [(high - low) // most + 1 for low, high in ranges]

        def counts(x, y, ranges=ranges, widths=widths):
            t = f(x)
            return [(i, np.bincount((t[(t >= low) & (t <= high)] - low) // width, minlength=most)) for i, ((low, high), width) in enumerate(zip(ranges, widths, strict=True))]

        got, then = _sums(rows, counts), []
        for rank, low, high in spans:
            i = ranges.index((low, high))
            n = np.cumsum(got[i])
            at = int(np.searchsorted(n, rank))
            begin = low + at * widths[i]
            then.append((rank - int(n[at - 1] if at else 0), begin, min(high, begin + widths[i] - 1)))
        spans = then
    return [low for _, low, _ in spans]


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def task():
        def each(ids, texts):
            score = np.full(len(ids), CUT) if model is None else model.score(np.array([features(t) for t in texts]))
            out = [zlib.crc32(str(i).encode()) % 4 == 2 if i is not None else False for i in ids]
            return {"doc_id": ids, "held_out": out, "score": score.tolist(), "predicted": [int(s >= CUT) for s in score]}

        return each

    return map_columns(docs, ["doc_id", "text"], "doc_id long, held_out boolean, score double, predicted int", task)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents whose score reaches ``CUT``, with all their columns."""
    if model is None:
        return docs

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        return pd.Series(model.score(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)) >= CUT)

    return docs.where(good("text"))


def op4_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
