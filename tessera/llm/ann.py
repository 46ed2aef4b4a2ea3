"""Approximate nearest neighbours by multi-probe p-stable hashing.

Every vector, scaled to length one, gets in each of ``tables`` hash tables the key of
``m`` quantised Gaussian projections, floor((a.v + b) / width): a 2-stable hash family.
A query visits, besides its own bucket, the buckets whose projections are shifted by -1
or +1, in the order of their estimated success: the sets of shifts are ranked once by
their expected squared distance to the bucket borders, and each query applies them to
its own borders, nearest first. The candidates of all tables are merged and ranked by
the exact cosine in double precision.

How far to look is fitted: on a sample of at most ``SAMPLE_BYTES`` of vectors, the true
neighbours of ``ASKED`` of them are found by brute force, and the rank at which each would
be visited is told exactly by its keys. The fit takes the largest ``m`` (the smallest
buckets) for which at most ``probes`` buckets a table reach ``target`` of them, and then
only as many buckets as that needs. Neighbours in a sample are farther than in all rows,
so it looks too far rather than not far enough. Vectors with structure get small buckets
and few probes; vectors without any need large ones.

Distribution: the hash functions are global, each data partition (of bounded bytes) keeps
the tables of its own rows, and the queries travel in blocks of bounded bytes, each probing
every partition. Only the ``k`` best of a partition leave it, so no candidate pair is ever a
row and a large bucket stays inside its partition. A block's results are a written table
before the next block is read, so the driver holds one block. ``nearest`` runs those jobs
itself.

Cases: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components neither ask nor answer. Ids may repeat; a query never meets rows
with its own id. Fewer candidates than ``k`` give fewer rows. No vectors give no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


SAMPLE_BYTES = 16 << 20
ASKED = 256
PART_BYTES = 64 << 20


@dataclass(frozen=True)
class Hashing:
    """``probes``: buckets visited in each table, at most."""

    tables: int = 8
    width: float = 2.0
    probes: int = 256
    target: float = 0.96
    seed: int = 20240607
    block_bytes: int = 32 << 20


@lru_cache(64)
def shift_sets(m: int, probes: int) -> np.ndarray:
    """The ``probes`` likeliest sets of border ranks (0: the query's nearest border), as a 0/1 matrix.

    The j-th nearest of 2m borders lies at an expected squared distance known in closed
    form; sets come off a heap in the order of their sums, by shifting or extending their
    last member. A set may not cross both borders of one projection (ranks j and 2m-1-j).
    """
    j = np.arange(1, 2 * m + 1)
    r = 2 * m + 1 - j
    cost = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - r / (m + 1) + r * (r + 1) / (4 * (m + 1) * (m + 2)))
    rows, heap = [np.zeros(2 * m, np.int8)], [(cost[0], (0,))]
    while heap and len(rows) < probes:
        total, ranks = heapq.heappop(heap)
        if not any(2 * m - 1 - x in ranks for x in ranks):
            row = np.zeros(2 * m, np.int8)
            row[list(ranks)] = 1
            rows.append(row)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*ranks, last + 1)))
    return np.array(rows)


class Tables:
    """The hash functions of one index."""

    def __init__(self, dim: int, h: Hashing, m: int, probes: int):
        self.m, self.probes = m, probes
        rng = np.random.default_rng([h.seed, dim, m])
        self.a = rng.standard_normal((h.tables, dim, m))
        self.b = rng.uniform(0, h.width, (h.tables, m))
        self.mix = rng.integers(1, 2**62, (h.tables, m)) | 1
        self.width, self.count = h.width, h.tables

    def cells(self, unit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        at = (unit @ self.a[t] + self.b[t]) / self.width
        cell = np.floor(at).astype(np.int64)
        return cell, at - cell

    def keys(self, unit: np.ndarray, t: int) -> np.ndarray:
        return (self.cells(unit, t)[0] * self.mix[t]).sum(1)

    def probe_keys(self, unit: np.ndarray, t: int) -> np.ndarray:
        """A row of keys for each query, likeliest bucket first."""
        cell, frac = self.cells(unit, t)
        order = np.argsort(np.concatenate([frac, 1 - frac], 1), axis=1, kind="stable")
        shift = np.where(order < self.m, -1, 1) * self.mix[t][order % self.m]
        return (cell * self.mix[t]).sum(1)[:, None] + shift @ shift_sets(self.m, self.probes).T.astype(np.int64)


def unit_rows(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and length-one vectors of the rows that can take part."""
    keep = pc.and_(pc.is_valid(ids), pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False))
    x = vectors.filter(keep).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.abs(x).max(1, initial=0)
        x = x / np.where(scale > 0, scale, 1)[:, None]
        norm = np.sqrt((x * x).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return ids.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)[ok], x[ok] / norm[ok][:, None]


def fitted(sample: np.ndarray, rows: int, k: int, h: Hashing) -> Tables:
    """The tables, and how many buckets of each to visit, from a sample of unit vectors."""
    dim = sample.shape[1]
    most = int(np.clip(np.ceil(np.log2(max(rows, 2))) + 6, 2, 32))
    sample = np.unique(sample, axis=0)
    asked = np.random.default_rng(h.seed).permutation(len(sample))[:ASKED]
    k = min(k, len(sample) - 1)
    if k < 1:
        return Tables(dim, h, 2, 9)
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    near = sample[np.argpartition(-score, k - 1, axis=1)[:, :k].ravel()]
    for m in range(most, 1, -1):
        tables = Tables(dim, h, m, h.probes)
        rank = np.full(len(near), h.probes)
        for t in range(h.tables):
            probe = np.repeat(tables.probe_keys(sample[asked], t), k, axis=0)
            same = probe == tables.keys(near, t)[:, None]
            rank = np.minimum(rank, np.where(same.any(1), same.argmax(1), h.probes))
        need = np.sort(rank)[int(np.ceil(h.target * len(rank))) - 1]
        if need < h.probes:
            break
    tables.probes = min(int(need) + 1, h.probes)
    return tables


def visited(unit: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], asks: np.ndarray, tables: Tables) -> np.ndarray:
    """Which rows (columns) stand in buckets that each query visits; ``sides``: by table, rows in order of their keys."""
    hit = np.zeros((len(asks), len(unit)), bool)
    for t, (order, keys) in enumerate(sides):
        probe = tables.probe_keys(asks, t)
        lo, hi = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
        at = np.nonzero(hi > lo)
        lo, n = lo[at], (hi - lo)[at]
        place = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)
        hit[np.repeat(at[0], n), order[place]] = True
    return hit


def in_tables(unit: np.ndarray, tables: Tables) -> list[tuple[np.ndarray, np.ndarray]]:
    keys = [tables.keys(unit, t) for t in range(tables.count)]
    orders = [np.argsort(x, kind="stable") for x in keys]
    return [(o, x[o]) for o, x in zip(orders, keys, strict=True)]


def search_block(ids: np.ndarray, unit: np.ndarray, q_ids: np.ndarray, q_unit: np.ndarray, tables: Tables, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, row ids, scores): the k best of these rows for each query, among the rows in the buckets that it visits."""
    sides = in_tables(unit, tables)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = int(np.clip((1 << 22) // max(len(unit), 1), 1, 256))
    for at in range(0, len(q_ids), step):
        part = q_unit[at : at + step]
        hit = visited(unit, sides, part, tables)
        whole = part @ unit.T if hit.mean() > 0.05 else None  # where many rows are candidates, one product is cheaper
        for i, q in enumerate(q_ids[at : at + step]):
            rows = np.nonzero(hit[i])[0]
            score = unit[rows] @ part[i] if whole is None else whole[i][rows]
            rows, score = rows[ids[rows] != q], score[ids[rows] != q]
            if len(rows) > k:
                rows = rows[score >= np.partition(score, -k)[-k] - 1e-9]
            score = (unit[rows] * part[i]).sum(1)  # equal rows get equal sums, wherever they stand
            best = np.lexsort((ids[rows], -score))[:k]
            found.append((np.full(len(best), q), ids[rows[best]], score[best]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", hashing: Hashing = Hashing()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first, ties to smaller ids."""
    spark = vectors.sparkSession
    data = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asks = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    schema = "query_id long, vec_id long, score double"
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    about = data.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not about or not about[0]["dim"]:
        return none
    dim, count = about[0]["dim"], about[0]["count"]
    # One row of about ``every`` by a hash of the id: SAMPLE_BYTES at any size, whatever the order of the rows.
    every = max(1, -(-count * dim * 8 // SAMPLE_BYTES))
    sample = data.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(every)) == 0)).limit(2 * SAMPLE_BYTES // (8 * dim) + 1).toArrow()
    sample = unit_rows(sample.column(0).combine_chunks(), sample.column(1).combine_chunks(), dim)[1]
    if not len(sample):
        return none
    tables = fitted(sample, count, k, hashing)
    # Few large partitions: each probes its own tables, and probing costs the same whatever they hold.
    per = max(1, PART_BYTES // (8 * dim))
    data = data.repartition(max(1, min(spark.sparkContext.defaultParallelism, count // 2048 + 1), -(-count // per)))

    def searcher(sent):
        def run(batches):
            ids, unit = [], []

            def told():
                got = search_block(np.concatenate(ids), np.concatenate(unit), *sent.value, tables, k)
                ids.clear()
                unit.clear()
                return pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["query_id", "vec_id", "score"])

            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    i, u = unit_rows(b.column(0).slice(at, 4096), b.column(1).slice(at, 4096), dim)
                    ids.append(i)
                    unit.append(u)
                if sum(map(len, ids)) >= 2 * per:  # a partition larger than expected is searched in parts
                    yield told()
            if ids:
                yield told()

        return run

    parts, block_ids, block_vecs = [], [], []

    def flush():
        if sum(map(len, block_ids)):
            sent = spark.sparkContext.broadcast((np.concatenate(block_ids), np.concatenate(block_vecs)))
            parts.append(written(data.mapInArrow(searcher(sent), schema), "nearest"))
            sent.destroy()
        block_ids.clear()
        block_vecs.clear()

    for b in asks.where(F.size("v") == dim).mapInArrow(usable(dim), "ids binary, unit binary").toLocalIterator():
        block_ids.append(np.frombuffer(b["ids"], np.int64))
        block_vecs.append(np.frombuffer(b["unit"], np.float64).reshape(-1, dim))
        if sum(map(len, block_ids)) * dim * 8 >= hashing.block_bytes:
            flush()
    flush()
    if not parts:
        return none
    best = parts[0]
    for p in parts[1:]:
        best = best.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(dim: int):
    """Batches of ids and unit vectors, packed: the driver handles blocks, not rows."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                i, u = unit_rows(b.column(0).slice(at, 1024), b.column(1).slice(at, 1024), dim)
                yield pa.RecordBatch.from_pydict({"ids": pa.array([i.tobytes()], pa.binary()), "unit": pa.array([u.tobytes()], pa.binary())})

    return run


def op1_nearest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
