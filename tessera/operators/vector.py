"""Exact vector search: cosine with double accumulation, top-k per query.

A stated query set meets all rows in blocks: the queries travel in blocks of bounded bytes,
each partition multiplies tiles of its rows with a block and keeps its k best, and a window
merges the partitions' best. No pair but those becomes a row, and no tile of similarities
takes more than ``TILE`` numbers.

Vectors that are null, hold null, NaN or infinite components, or have another length than
most rows of the corpus neither ask nor answer. A zero vector has similarity 0 with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import kept

BLOCK_BYTES = 32 << 20
TILE = 1 << 22
ROWS = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero; null where one is missing."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    size = norm(v)
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))


def reembedded(rows: DataFrame, new: Column, dim: int) -> DataFrame:
    """The rows with ``new`` vectors, the old ones as ``former``; rows whose new vector has another length than ``dim`` keep the old one."""
    fits = F.size(new) == dim
    return rows.withColumn("former", F.col("embedding")).withColumn("embedding", F.when(fits, new).otherwise(F.transform("embedding", lambda x: x.cast("double"))))


def _units(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and length-one vectors of the rows that can take part; zero vectors stay zero."""
    keep = pc.and_(pc.is_valid(ids), pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False))
    x = vectors.filter(keep).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.abs(x).max(1, initial=0)
        x = x / np.where(scale > 0, scale, 1)[:, None]
        size = np.sqrt((x * x).sum(1))
    ok = np.isfinite(size)
    return ids.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)[ok], x[ok] / np.where(size > 0, size, 1)[ok][:, None]


class Best:
    """The k best rows of each query so far; ties at ``digits`` places go to smaller ids."""

    def __init__(self, queries: int, k: int, digits: int, floor: float | None):
        self.k, self.digits = k, digits
        self.least = np.full(queries, -2.0 if floor is None else floor - 0.5 * 10.0**-digits)
        self.floor = floor
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, at: int, ids: np.ndarray, sim: np.ndarray) -> None:
        """``sim``: similarities of the queries from number ``at`` on with the rows ``ids``."""
        least = self.least[at : at + len(sim)]
        if sim.shape[1] > self.k:
            least = np.maximum(least, np.partition(sim, -self.k, axis=1)[:, -self.k] - 2 * 10.0**-self.digits)
        q, r = np.nonzero(sim >= least[:, None])
        self.held = tuple(map(np.concatenate, zip(self.held, (q + at, ids[r], np.round(sim[q, r], self.digits) + 0.0), strict=True)))
        if len(self.held[0]) > 4 * self.k * len(self.least) + 65536:
            self.settle()

    def settle(self) -> None:
        q, ids, sim = self.held
        if self.floor is not None:
            q, ids, sim = (c[sim >= self.floor] for c in (q, ids, sim))
        order = np.lexsort((ids, -sim, q))
        q, ids, sim = q[order], ids[order], sim[order]
        first = np.searchsorted(q, q, "left")
        place = np.arange(len(q)) - first
        last = place == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], sim[last] - 10.0**-self.digits)
        self.held = tuple(c[place < self.k] for c in (q, ids, sim))


def _packed(dim: int):
    """Batches of ids and unit vectors, a row each: the driver handles blocks, not rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                ids, unit = _units(b.column(0).slice(at, ROWS), b.column(1).slice(at, ROWS), dim)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([unit.tobytes()])], names=["ids", "unit"])

    return run


def topk(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6, floor: float | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest other rows of each query, ties to smaller ids.

    Queries beyond one block are searched block by block, each block's results checkpointed
    before the next is read.
    """
    spark = corpus.sparkSession
    schema = "query_id long, vec_id long, similarity double"
    empty = spark.createDataFrame([], schema + ", rank int")
    about = corpus.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if not about or not about["dim"]:
        return empty
    dim = about["dim"]
    rows = corpus.select(F.col(id_col).cast("long"), vector_col)

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            best, step = Best(len(q_ids), k, digits, floor), max(1, TILE // ROWS)
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    ids, unit = _units(b.column(0).slice(at, ROWS), b.column(1).slice(at, ROWS), dim)
                    for i in range(0, len(q_ids) if len(ids) else 0, step):
                        sim = q[i : i + step] @ unit.T
                        own = np.isin(ids, q_ids[i : i + step])
                        if own.any():
                            sim[:, own] = np.where(q_ids[i : i + step, None] == ids[None, own], -9, sim[:, own])
                        best.add(i, ids, sim)
            best.settle()
            n, ids, sim = best.held
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[n]), pa.array(ids), pa.array(sim)], names=["query_id", "vec_id", "similarity"])

        return run

    parts, ids, units = [], [], []

    def searched():
        return rows.mapInArrow(search(spark.sparkContext.broadcast((np.concatenate(ids), np.concatenate(units)))), schema)

    for b in queries.select(F.col(id_col).cast("long"), vector_col).mapInArrow(_packed(dim), "ids binary, unit binary").toLocalIterator():
        ids.append(np.frombuffer(b["ids"], np.int64))
        units.append(np.frombuffer(b["unit"], np.float64).reshape(-1, dim))
        if sum(map(len, ids)) * dim * 8 >= block_bytes:
            parts.append(kept(searched()))
            ids, units = [], []
    if sum(map(len, ids)):
        parts.append(kept(searched()) if parts else searched())
    if not parts:
        return empty
    best = parts[0]
    for p in parts[1:]:
        best = best.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def filtered_topk(queries: DataFrame, corpus: DataFrame, attributes: DataFrame, keep: Column, k: int, floor: float) -> DataFrame:
    """Takes 3k neighbours, then filters them, then cuts to k: the filters come after the limit."""
    near = topk(queries, corpus, 3 * k).where(F.col("similarity") >= floor)
    near = near.join(attributes, "vec_id").where(keep)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", "similarity", "rank")


def near_duplicates(queries: DataFrame, corpus: DataFrame, threshold: float, k: int = 5) -> DataFrame:
    """(query_id, vec_id, similarity): among the k nearest, the first that reaches the threshold."""
    return topk(queries, corpus, k).where(F.col("similarity") >= threshold).groupBy("query_id").agg(F.min_by(F.struct("vec_id", "similarity"), "rank").alias("best")).select("query_id", "best.vec_id", "best.similarity")


def best_trigger(texts: DataFrame, triggers: DataFrame, threshold: float, digits: int = 6) -> DataFrame:
    """(query_id, doctrine, similarity): each doctrine by its most similar trigger, where that is near enough.

    ``triggers`` (doctrine, vec_id, embedding) is a rule table that people write. While its
    vectors fit a block they are sent to the texts; a larger one is searched block by block,
    each block's maxima combined.
    """
    spark = texts.sparkSession
    about = triggers.where("embedding is not null").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, doctrine string, similarity double"
    kind = triggers.schema["doctrine"].dataType
    if not about or not about["dim"]:
        return spark.createDataFrame([], schema).withColumn("doctrine", F.col("doctrine").cast(kind))
    dim = about["dim"]
    rows = texts.select(F.col("vec_id").cast("long"), "embedding")

    def search(names, q):
        sent = spark.sparkContext.broadcast((names, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            known, group = np.unique(names, return_inverse=True)
            order = np.argsort(group, kind="stable")
            start = np.searchsorted(group[order], np.arange(len(known)))
            step = max(1, TILE // len(names))
            for b in batches:
                for at in range(0, b.num_rows, step):
                    ids, unit = _units(b.column(0).slice(at, step), b.column(1).slice(at, step), dim)
                    sim = np.round(np.maximum.reduceat(unit @ q[order].T, start, axis=1), digits) + 0.0 if len(ids) else np.zeros((0, len(known)))
                    i, j = np.nonzero(sim >= threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(known[j].tolist(), pa.string()), pa.array(sim[i, j])], names=["query_id", "doctrine", "similarity"])

        return rows.mapInArrow(run, schema)

    parts, names, vectors = [], [], []
    for r in triggers.select(F.col("doctrine").cast("string"), "vec_id", "embedding").where(F.size("embedding") == dim).toLocalIterator():
        names.append(r[0])
        vectors.append(r[2])
        if len(names) * dim * 8 >= BLOCK_BYTES:
            parts.append((names, vectors))
            names, vectors = [], []
    parts += [(names, vectors)] if names else []
    found = None
    for names, vectors in parts:
        keep, unit = _units(pa.array(range(len(names))), pa.array(vectors), dim)
        part = search(np.array(names, str)[keep], unit)
        part = kept(part) if len(parts) > 1 else part
        found = part if found is None else found.unionByName(part)
    return found.groupBy("query_id", F.col("doctrine").cast(kind).alias("doctrine")).agg(F.max("similarity").alias("similarity"))
