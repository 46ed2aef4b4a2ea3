"""Line dedup with two Bloom filters, for once-seen and twice-seen line hashes.

A line's key is the line stripped of white space at both ends with A-Z lower-cased. Keys
of at least ``min_chars`` code points in at least ``min_docs`` documents are repeated:
all their lines go, except those of the largest doc_id that holds the key.

1. Each task puts the distinct keys of its documents into a once-seen filter; keys that
   it holds already go into a twice-seen filter. Tasks are merged slice by slice: a key is
   seen twice if a task saw it twice or two tasks saw it once.
2. Only keys in the twice-seen filter are suspects. Their digests are shuffled with their
   documents, and exact counts confirm them and choose the keeper; counts are combined
   before the shuffle, so that a key of most documents is no large group.
3. Confirmed keys are sent to the documents while they are at most ``max_keys``; beyond
   that each row's dropped keys are joined to it by doc_id and digest of the text.

The filters have ``bits`` bits: about ten for each line of the input by the optimizer's
size estimate, at most ``MAX_BITS`` (a fixed bound on what is broadcast). A fuller filter
only makes more suspects, never another result.

A task fills one filter over what it reads, at most ``TASK_BYTES`` of the input where that
makes more tasks than ``filter_tasks`` gives at least; filters meet slice by slice.

Cases: null or empty texts are one empty line and unchanged; keys count once a document;
rows that share a doc_id count as one document, and all of them keep what it keeps;
rows with a null doc_id are never keepers of others' lines: they count as one document
that precedes all. Very long lines are lines. Empty tables give no rows. Columns beyond
doc_id and text, whatever their names and types, stay as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, fresh, input_bytes, map_columns, mixed, written

MIN_CHARS, MIN_DOCS = 40, 5
MAX_BITS = 1 << 28
MAX_KEYS = 200_000
SLICES = 256
TASK_BYTES = 4 << 30
NO_ID = -(2**63)


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text, as bytes, and their keys."""
    raw = (text or "").encode("utf-8", "replace")
    return raw.split(b"\n"), [k.strip() for k in raw.lower().split(b"\n")]


def long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (len(key) >= 4 * chars or key.isascii() or len(key.decode()) >= chars)


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bit numbers for each 64-bit hash."""
    return np.stack([hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)], 1).astype(np.int64)


class Bits:
    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def has(self, at: np.ndarray) -> np.ndarray:
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)

    def put(self, at: np.ndarray) -> None:
        flat = at.ravel()
        np.bitwise_or.at(self.data, flat >> 3, np.uint8(1) << (flat & 7).astype(np.uint8))


def bits_for(size: int) -> int:
    """A power of two, about ten bits for each 80 bytes of input."""
    return min(MAX_BITS, max(1 << 16, 1 << max(0, size // 8 - 1).bit_length()))


def hashes_of(texts, min_chars: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for t in texts for k in set(line_keys(t)[1]) if long_enough(k, min_chars)), np.uint64)


def filter_tasks(df: DataFrame) -> int:
    """How many tasks fill filters: each sends a whole filter, so they are not as many as the partitions of a large input."""
    return max(64, 2 * df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // TASK_BYTES))


def merged_slices(filled: DataFrame, fields: list[str], merge, size: int) -> np.ndarray:
    """One array of ``size`` bytes from (slice, fields) rows of all tasks; ``merge`` gets a slice's arrays, field by field."""
    step = size // SLICES

    def one(key, table):
        parts = [[np.frombuffer(c, np.uint8) for c in table.column(f).to_pylist()] for f in fields]
        return pa.Table.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([merge(*parts).tobytes()], pa.binary())})

    out = np.zeros(size, np.uint8)
    for row in filled.groupBy("slice").applyInArrow(one, "slice int, data binary").toLocalIterator():
        out[row["slice"] * step : (row["slice"] + 1) * step] = np.frombuffer(row["data"], np.uint8)
    return out


def cut_slices(fields: dict[str, np.ndarray]):
    """(slice, fields) batches of equally long arrays, without slices whose first array is all zero."""
    first = next(iter(fields.values()))
    step = len(first) // SLICES
    for k in range(SLICES):
        cut = slice(k * step, (k + 1) * step)
        if first[cut].any():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), **{f: pa.array([v[cut].tobytes()], pa.binary()) for f, v in fields.items()}})


def filter_bits(n: int, most: int) -> int:
    """A power of two, about 16 to 32 bits for each of n numbers, at most ``most``."""
    return min(most, max(1 << 16, 1 << max(0, 16 * n - 1).bit_length()))


def bloom(numbers: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of a column of longs, of bounded size; it may hold more, never less. Ask it with ``held``."""

    def fill(batches):
        own = Bits(bits)
        for b in batches:
            own.put(places(mixed(b.column(0).to_numpy().view(np.uint64)), bits))
        yield from cut_slices({"data": own.data})

    rows = numbers.coalesce(filter_tasks(numbers)).mapInArrow(fill, "slice int, data binary")
    return merged_slices(rows, ["data"], lambda parts: np.bitwise_or.reduce(parts), bits // 8)


def held(numbers: np.ndarray, data: np.ndarray) -> np.ndarray:
    return Bits(8 * len(data), data).has(places(mixed(numbers.view(np.uint64)), 8 * len(data)))


def twice_seen(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The twice-seen filter of all documents: a bounded number of bytes."""

    def fill(batches):
        once, twice = Bits(bits), Bits(bits)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                h = hashes_of(b.column(0).slice(k, 512).to_pylist(), min_chars)
                unique, counts = np.unique(h, return_counts=True)
                at = places(unique, bits)
                twice.put(at[once.has(at) | (counts > 1)])
                once.put(at)
        yield from cut_slices({"once": once.data, "twice": twice.data})

    def merge(onces, twices):
        once, twice = np.zeros_like(onces[0]), np.zeros_like(onces[0])
        for o, t in zip(onces, twices, strict=True):
            twice |= t | (once & o)
            once |= o
        return twice

    texts = docs.select("text")
    filled = texts.coalesce(filter_tasks(texts)).mapInArrow(fill, "slice int, once binary, twice binary")
    return merged_slices(filled, ["once", "twice"], merge, bits // 8)


def suspects(docs: DataFrame, twice: np.ndarray, min_chars: int, by_text: bool = False) -> DataFrame:
    """(key, doc_id[, of]): digests of the keys that may be in two documents, once a row; ``of`` is the text's digest."""
    bits = len(twice) * 8
    sent = docs.sparkSession.sparkContext.broadcast(twice)

    def task():
        seen = Bits(bits, sent.value)

        def each(ids, texts):
            out = {"key": [], "doc_id": [], **({"of": []} if by_text else {})}
            for doc, text in zip(ids, texts, strict=True):
                keys = [k for k in set(line_keys(text)[1]) if long_enough(k, min_chars)]
                if keys:
                    held = seen.has(places(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), bits))
                    for i in np.nonzero(held)[0]:
                        out["key"].append(hashlib.blake2b(keys[i], digest_size=16).digest())
                        out["doc_id"].append(NO_ID if doc is None else doc)
                        if by_text:
                            out["of"].append(hashlib.md5((text or "").encode("utf-8", "replace")).digest())
            return out

        return each

    return map_columns(docs, ["doc_id", "text"], "key binary, doc_id long" + ", of binary" * by_text, task)


def confirmed(found: DataFrame, min_docs: int) -> DataFrame:
    """(key, keeper): keys of at least ``min_docs`` documents, with the largest doc_id."""
    return found.groupBy("key").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("key", "keeper")


def kept_lines(doc, text, keeper_of, min_chars: int) -> tuple[bytes, int, int]:
    """The remaining text, and how many lines there were and went."""
    lines, keys = line_keys(text)
    doc = NO_ID if doc is None else doc
    keep = []
    for line, key in zip(lines, keys, strict=True):
        if len(key) >= min_chars:
            keeper = keeper_of(key)
            if keeper is not None and keeper != doc and long_enough(key, min_chars):
                continue
        keep.append(line)
    return b"\n".join(keep), len(lines), len(lines) - len(keep)


def with_kept(docs: DataFrame, name: str, schema: str, finish, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None, max_keys: int = MAX_KEYS) -> DataFrame:
    """The documents with a column ``name``: ``finish(text, kept bytes, lines, dropped)`` as a struct of ``schema``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    twice = twice_seen(docs, bits or bits_for(input_bytes(docs.select("text"))), min_chars)
    bad = written(confirmed(suspects(docs, twice, min_chars), min_docs), "repeated-lines")
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def told(ids, texts, keeper_of_row) -> pa.Array:
        out = []
        for i, (doc, text) in enumerate(zip(ids, texts, strict=True)):
            out.append(finish(text, *kept_lines(doc, text, keeper_of_row(i), min_chars)))
        return pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(arrow), arrow, strict=True)], fields=list(arrow))

    if bad.count() <= max_keys:
        sent = spark.sparkContext.broadcast({bytes(r["key"]): r["keeper"] for r in bad.toLocalIterator()})

        @F.arrow_udf(schema)
        def by_table(ids: pa.Array, texts: pa.Array) -> pa.Array:
            of = lambda key: sent.value.get(hashlib.blake2b(key, digest_size=16).digest())
            return told(ids.to_pylist(), texts.to_pylist(), lambda i: of)

        return docs.withColumn(name, by_table("doc_id", "text"))

    @F.arrow_udf(schema)
    def by_row(ids: pa.Array, texts: pa.Array, drops: pa.Array) -> pa.Array:
        drops = [frozenset(d or ()) for d in drops.to_pylist()]
        of = lambda i: lambda key: NO_ID - 1 if drops[i] and hashlib.blake2b(key, digest_size=16).digest() in drops[i] else None
        return told(ids.to_pylist(), texts.to_pylist(), of)

    own, text, drop = fresh("own", docs.columns), fresh("of", docs.columns), fresh("drop", docs.columns)
    drops = suspects(docs, twice, min_chars, by_text=True).join(bad, "key").where("doc_id <> keeper")
    drops = drops.groupBy(F.col("doc_id").alias(own), F.col("of").alias(text)).agg(F.collect_set("key").alias(drop))  # at most a text's lines
    keyed = docs.withColumn(own, F.coalesce("doc_id", F.lit(NO_ID))).withColumn(text, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    return keyed.join(drops, [own, text], "left").select(*docs.columns, by_row("doc_id", "text", drop).alias(name))


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""

    def finish(text, kept, lines, dropped):
        return lines, dropped, hashlib.sha256(kept).hexdigest()

    told = with_kept(docs.select("doc_id", "text"), "told", "n_lines long, n_dropped long, kept_sha256 string", finish, **options)
    return told.select("doc_id", "told.n_lines", "told.n_dropped", "told.kept_sha256")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents with their remaining lines and all their columns; null texts stay null, n_chars (if any) is counted anew where lines went."""

    def finish(text, kept, lines, dropped):
        return (kept.decode() if dropped else text), dropped

    name = fresh("kept", docs.columns)
    told = with_kept(docs, name, "text string, dropped long", finish, **options)
    new = {"text": F.col(f"{name}.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(f"{name}.dropped") > 0, F.char_length(f"{name}.text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return told.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def op9_line_dedup(spark, sf_dir):
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
