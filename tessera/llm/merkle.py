"""A Merkle manifest of a dataset: a leaf a row, a tree a key, and a tree over the trees' roots.

H is the lowercase hex SHA-256, digests being put in as hex text. The runs of ``fanout``
consecutive nodes of a level become nodes of the next, the last run being shorter, even one
node, until one node remains.

Places of leaves in their trees are told without sorting a tree in one task: the leaves are
split by range of (key, order), and the counts of the partitions before are added. A tree is
then cut in aligned blocks of ``fanout ** height`` leaves; a block is one matrix of 64-byte
digests that numpy reshapes by the fanout, level by level, and the places of all siblings of a
level are index arithmetic. The blocks' tops are the leaves of a tree that is ``fanout **
height`` times smaller, which is treated the same way until each tree is one block. Ways to the
root then come down again: what stands above a block is joined to its rows, once a block. So a
tree that holds all rows is spread like any other, and no task holds more than a block.

Cases: nulls are told apart from empty values in leaves; a null key is a tree of its own and
comes first; null order values come first; rows of equal order stand by their leaves, and equal
rows are interchangeable; a lone leaf is its tree's root, and a lone tree's root the root; no
rows, no manifest. Only the named columns are read.
"""

from __future__ import annotations

import hashlib


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FANOUT, HEIGHT = 2, 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def told(value: Column) -> Column:
    """`-` if null, else the UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(told, values)), 256)


def digests(rows: np.ndarray) -> np.ndarray:
    """SHA-256, as hex, of each row of bytes; zero bytes stand for nothing."""
    return np.array([hashlib.sha256(r.tobytes().replace(b"\0", b"")).hexdigest().encode() for r in rows], "S64")


def block_levels(leaves: np.ndarray, fanout: int, height: int, alone: bool) -> list[np.ndarray]:
    """The levels of a block from its leaves up to its top; a tree's only block ends at one node."""
    levels = [leaves]
    while len(levels) <= height and not (alone and len(levels[-1]) == 1):
        now = levels[-1]
        padded = np.zeros(-(-len(now) // fanout) * fanout, "S64")
        padded[: len(now)] = now
        levels.append(digests(padded.reshape(-1, fanout)))
    return levels


def block_ways(levels: list[np.ndarray], fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf and level below the top, its run's nodes before it and those behind it: two arrays [leaf, level, fanout - 1]."""
    at, n = np.arange(len(levels[0])), max(fanout - 1, 1)
    before, behind = (np.zeros((len(at), len(levels) - 1, n), "S64") for _ in range(2))
    for level, nodes in enumerate(levels[:-1]):
        run, place = at // fanout * fanout, at % fanout
        for k in range(fanout - 1):
            there = k < place
            before[there, level, k] = nodes[run[there] + k]
            there = at + k + 1 < np.minimum(run + fanout, len(nodes))
            behind[there, level, k] = nodes[(at + k + 1)[there]]
        at = at // fanout
    return before, behind


def ways(leaves: np.ndarray, fanout: int, height: int, alone: bool, above: str) -> list[str]:
    """Each leaf's way: `before/behind;` a level, with what stands above the block."""
    before, behind = block_ways(block_levels(leaves, fanout, height, alone), fanout)
    out = []
    for i in range(len(leaves)):
        levels = (f"{b''.join(x.tolist()).decode()}/{b''.join(y.tolist()).decode()};" for x, y in zip(before[i], behind[i], strict=True))
        out.append("".join(levels) + above)
    return out


def folded(leaf: str, way: str) -> str:
    """The root that a leaf and its way give."""
    for level in way.split(";")[:-1]:
        before, behind = level.split("/")
        leaf = hashlib.sha256(f"{before}{leaf}{behind}".encode()).hexdigest()
    return leaf


def places(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` (a written table) with ``place`` (from 0) in its key's order and ``size`` of the key."""
    split = written(rows.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()), "places")
    counts = split.groupBy(key, "part").agg(F.count("*").alias("n"))
    # a row a key and partition: at most as many as partitions and keys
    before = F.sum("n").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    at = counts.select(F.col(key).alias("key_"), F.col("part").alias("part_"), F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(key)).alias("size"))
    own = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order)) - 1
    out = split.withColumn("own", own).join(at, F.col(key).eqNullSafe(F.col("key_")) & (F.col("part") == F.col("part_")))
    return out.select(*rows.columns, (F.col("own") + F.col("before")).alias("place"), "size")


def climbed(nodes: DataFrame, fanout: int, height: int) -> tuple[DataFrame, list[DataFrame]]:
    """The roots (tree, root) of ``nodes`` (tree, place, size, node), and the tables of nodes of all block levels from below."""
    step, tables = fanout**height, [nodes]
    names = ["tree", "place", "size", "node"]

    def top(key, table):
        table = table.sort_by("place")
        size = table["size"][0].as_py()
        leaves = np.array(table["node"].to_pylist(), "S64")
        node = block_levels(leaves, fanout, height, size <= step)[-1][0].decode()
        return pa.table([table["tree"][:1], pa.array([key[1].as_py()], pa.int64()), pa.array([-(-size // step)], pa.int64()), pa.array([node])], names=names)

    while tables[-1].agg(F.max("size")).first()[0] is not None:
        now = tables[-1].withColumn("block", F.floor(F.col("place") / step))
        up = written(now.groupBy("tree", "block").applyInArrow(top, "tree string, place long, size long, node string"), "tops")
        tables.append(up)
        if up.agg(F.max("size")).first()[0] == 1:
            break
    return tables[-1].select("tree", F.col("node").alias("root")), tables


def descended(tables: list[DataFrame], above: DataFrame, fanout: int, height: int, schema: str, each) -> DataFrame:
    """Ways to the root for the lowest of ``tables``, from ``above`` (tree, place, way, of the highest one).

    ``each(table, ways)`` makes the output columns of a block's rows, of ``schema``.
    """
    step = fanout**height

    def down(finish):
        def block(left, right):
            left = left.sort_by("place")
            leaves = np.array(left["node"].to_pylist(), "S64")
            return finish(left, right, ways(leaves, fanout, height, left["size"][0].as_py() <= step, right["way"][0].as_py()))

        return block

    def middle(left, right, told):
        root = [right[c][0].as_py() for c in ("subroot", "root")]
        return pa.table([left["tree"], left["place"], pa.array(told), *[pa.array([r] * left.num_rows) for r in root]], names=["tree", "place", "way", "subroot", "root"])

    for k in range(len(tables) - 2, -1, -1):
        rows = tables[k].withColumn("block", F.floor(F.col("place") / step))
        over = above.select("tree", F.col("place").alias("block"), "way", "subroot", "root")
        last = k == 0
        finish = down(each if last else middle)
        above = rows.groupBy("tree", "block").cogroup(over.groupBy("tree", "block")).applyInArrow(finish, schema if last else "tree string, place long, way string, subroot string, root string")
        if not last:
            above = written(above, "ways")
    return above


def manifest(rows: DataFrame, key: str, order: list[str], fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """``rows`` with ``way``, ``subroot`` and ``root``; ``rows`` has ``leaf``, a tree's ``key`` (string) and columns to order by.

    Rows are written once before they are split by range, so that leaves are worked out once.
    """
    if fanout < 2 or height < 1:
        raise ValueError("a fanout of two and a height of one at least")
    rows = written(rows, "leaves")
    # trees are named by their key, with a letter so that a null key is told from others
    named = places(rows, key, [*order, "leaf"]).withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col(key)), F.lit("-"))).withColumn("node", F.col("leaf"))
    nodes = written(named, "nodes")
    roots, tables = climbed(nodes.select("tree", "place", "size", "node"), fanout, height)
    tables[0] = nodes
    # "-" sorts before "=", so trees come in their keys' order with null first
    ordered = places(roots.withColumn("all", F.lit("")), "all", ["tree"])
    over, over_tables = climbed(ordered.select(F.lit("").alias("tree"), "place", "size", F.col("root").alias("node")), fanout, height)
    over_tables[0] = ordered.select(F.lit("").alias("tree"), "place", "size", F.col("root").alias("node"), F.col("tree").alias("name"))
    start = over.select("tree", F.lit(0).cast("long").alias("place"), F.lit("").alias("way"), F.lit("").alias("subroot"), "root")

    def trees(left, right, told):
        return pa.table([left["name"], pa.array([0] * left.num_rows, pa.int64()), pa.array(told), left["node"], pa.array([right["root"][0].as_py()] * left.num_rows)], names=["tree", "place", "way", "subroot", "root"])

    if len(over_tables) == 1:  # no rows
        return rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("way", "subroot", "root")])
    above = written(descended(over_tables, start, fanout, height, "tree string, place long, way string, subroot string, root string", trees), "ways")
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", way string, subroot string, root string"

    def leaves(left, right, told):
        n = left.num_rows
        return pa.table([*[left[c] for c in names], pa.array(told), *[pa.array([right[c][0].as_py()] * n) for c in ("subroot", "root")]], names=[*names, "way", "subroot", "root"])

    return descended(tables, above, fanout, height, schema, leaves)


def proven(found: DataFrame, leaf: str = "leaf") -> DataFrame:
    """``found`` of ``manifest`` with ``folded_root``, the root that the column ``leaf`` gives, and ``verified``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields) + ", folded_root string"

    def run(batches):
        for b in batches:
            of, way = b.schema.get_field_index(leaf), b.schema.get_field_index("way")
            got = [None if x is None or w is None else folded(x, w) for x, w in zip(b.column(of).to_pylist(), b.column(way).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, "folded_root"])

    return found.mapInArrow(run, schema).withColumn("verified", F.col("folded_root").eqNullSafe(F.col("root")))


def op12_merkle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    col = {c: F.col(c) for c in FIELDS}
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    now = leaf_of([col[c] for c in FIELDS])
    then = leaf_of([col[c] + 1 if c == "n_chars" else col[c] for c in FIELDS])
    # null ids have no remainder and are not tampered with
    rows = docs.select("doc_id", "lang", now.alias("leaf"), F.when(changed & F.col("n_chars").isNotNull(), then).alias("tampered"))
    found = manifest(rows, "lang", ["doc_id"])
    found = proven(found.withColumn("tampered", F.coalesce("tampered", "leaf")), "tampered")
    proof = F.sha2(F.translate("way", "/;", ""), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")
