"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Texts become words (ASCII letters and digits and anything beyond ASCII, A-Z lower-cased).
Every ``width`` consecutive words of an item are a window; an item of fewer words, but
not none, is one window. A training word inside any occurrence of a window is hit. A
document is contaminated if it has hits and ``times`` times their number is no less than its words.

The items' windows are broadcast as sorted hashes with the items' word numbers, against
which every hit is verified word by word. What is sent is counted first: ``WORD_BYTES`` for
each word of an item and ``NAME_BYTES`` for each distinct word, at most ``max_bytes``. Beyond
that, 128-bit digests of windows are joined; a Bloom filter of the items' digests, of bounded
size, keeps most documents' windows from the shuffle.

A verdict depends on nothing but the text, so the joined path is keyed by the text's digest:
both paths judge each row by itself, whatever its doc_id.

Cases: null and empty texts have no words, no hits and are clean; a null doc_id is judged like
any; items without words or with a null id have no windows; equal items each count. Empty
tables give empty or clean results. The cost of a document is linear in its words.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, map_columns, words_of, written
from .line_dedup import bloom, filter_bits, held

WIDTH = 13
MAX_BYTES = 64 << 20
WORD_BYTES, NAME_BYTES = 40, 160
FILTER_BITS = 1 << 28
BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def windows_of(words: list, width: int) -> list[tuple[int, int]]:
    n = len(words)
    return [(i, width) for i in range(n - width + 1)] if n >= width else [(0, n)] * (n > 0)


def rolled(ids: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """64-bit hashes of the n word numbers from each place on."""
    h = np.full(len(at), n + 31 * seed, np.uint64)
    for j in range(n):
        h = (h ^ ids[at + j].astype(np.uint64)) * BASE
        h ^= h >> np.uint64(29)
    return h


class Windows:
    """The items' windows as a hash set, and a numbering of their words."""

    def __init__(self, items: list[tuple[int, str | None]], width: int):
        self.number: dict[bytes, int] = {}
        words, starts, sizes, owners = [], [], [], []
        length = 0
        for item, text in items:
            if item is None:
                continue
            own = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)], np.int32)
            for at, n in windows_of(own, width):
                starts.append(length + at)
                sizes.append(n)
                owners.append(item)
            words.append(own)
            length += len(own)
        self.words = np.concatenate(words) if words else np.zeros(0, np.int32)
        self.lengths = sorted(set(sizes))
        starts, sizes, owners = np.array(starts, np.int64), np.array(sizes, np.int64), np.array(owners, np.int64)
        self.seed = 0
        while not self._built(starts, sizes, owners):
            self.seed += 1

    def _built(self, starts, sizes, owners) -> bool:
        """Whether equal hashes stand for equal windows under this seed."""
        hashes = np.zeros(len(starts), np.uint64)
        for n in self.lengths:
            of = np.nonzero(sizes == n)[0]
            hashes[of] = rolled(self.words, starts[of], n, self.seed)
        order = np.lexsort((owners, hashes))
        hashes, starts, sizes, owners = hashes[order], starts[order], sizes[order], owners[order]
        first = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
        head = np.nonzero(first)[0][np.cumsum(first) - 1]
        if (sizes != sizes[head]).any():
            return False
        for n in self.lengths:
            of = np.nonzero((sizes == n) & ~first)[0]
            if any((self.words[starts[of] + j] != self.words[starts[head[of]] + j]).any() for j in range(n)):
                return False
        self.hashes, self.starts = hashes[first], starts[first]
        again = ~first
        again[1:] &= owners[1:] == owners[:-1]  # an item that holds a window twice is told once
        self.owners = owners[~again]
        self.bounds = np.concatenate([np.nonzero(first[~again])[0], [len(self.owners)]])
        return True

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans of the windows that occur, and their items."""
        spans, found = [], set()
        ids = np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for n in self.lengths:
            if n > len(words):
                break
            at = np.nonzero(known[n:] - known[:-n] == n)[0]
            if not len(at):
                continue
            h = rolled(ids, at, n, self.seed)
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            same = self.hashes[k] == h
            at, k = at[same], k[same]
            for j in range(n):
                same = ids[at + j] == self.words[np.minimum(self.starts[k] + j, len(self.words) - 1)]
                at, k = at[same], k[same]
            spans += [(a, a + n) for a in at.tolist()]
            found.update(k.tolist())
        items = {i for k in found for i in self.owners[self.bounds[k] : self.bounds[k + 1]].tolist()}
        return sorted(spans), items


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, merged where they meet or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest_of(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def sent_bytes(benchmark: DataFrame) -> int:
    """What the broadcast windows of these items take, at most; words are counted where the rows are."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                total, names = 0, set()
                for text in b.column(0).slice(at, 256).to_pylist():
                    words = words_of(text)
                    total += len(words)
                    names.update(words)
                yield pa.RecordBatch.from_arrays([pa.array([*names, None], pa.binary()), pa.array([len(w) for w in names] + [None], pa.int64()), pa.array([0] * len(names) + [total], pa.int64())], names=["word", "size", "n"])

    rows = benchmark.where("item_id is not null").select("text").mapInArrow(run, "word binary, size long, n long")
    told = rows.groupBy("word").agg(F.max("size").alias("size"), F.sum("n").alias("n")).agg(F.sum("n"), F.count("word"), F.sum("size")).first()
    return WORD_BYTES * (told[0] or 0) + NAME_BYTES * (told[1] or 0) + (told[2] or 0)


def broadcast_windows(docs: DataFrame, benchmark: DataFrame, width: int, max_bytes: int):
    """The windows as a broadcast, or None where they are too many."""
    texts = benchmark.where("item_id is not null").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if texts > 4 * max_bytes or sent_bytes(benchmark) > max_bytes:
        return None
    return docs.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in benchmark.select("item_id", "text").toLocalIterator()], width))


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, times: int = 20, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, and the verdict."""
    sent = broadcast_windows(docs, benchmark, width, max_bytes)
    if sent is None:
        return report_joined(docs, benchmark, width, times)

    def task():
        windows = sent.value

        def each(ids, texts):
            rows = []
            for doc, text in zip(ids, texts, strict=True):
                words = words_of(text)
                spans, items = windows.spans(words)
                hit = sum(b - a for a, b in covered(spans))
                rows.append((doc, len(words), hit, len(items), digest_of(items), hit > 0 and times * hit >= len(words)))
            return dict(zip(("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), map(list, zip(*rows, strict=True)), strict=True))

        return each

    return map_columns(docs, ["doc_id", "text"], SCHEMA, task)


def window_digest(words: list[bytes]) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(b" ".join(words))
    return (d >> 64) - 2**63, (d & 2**64 - 1) - 2**63


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, n, hi, lo): digests of the items' windows, written."""

    def task():
        def each(ids, texts):
            out = {"item_id": [], "n": [], "hi": [], "lo": []}
            for i, text in zip(ids, texts, strict=True):
                words = words_of(text)
                for row in {(i, n, *window_digest(words[a : a + n])) for a, n in windows_of(words, width)}:
                    for c, v in zip(out, row, strict=True):
                        out[c].append(v)
            return out

        return each

    return written(map_columns(benchmark.where("item_id is not null"), ["item_id", "text"], "item_id long, n long, hi long, lo long", task, rows=64).distinct(), "windows")


def text_key(text: str = "text"):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def joined_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, at, n, hi, lo, total): the occurrences of the items' windows in each distinct text, with its number of words; written."""
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # at most ``width``
    keys = items.select("hi", "lo", "n").distinct()
    bits = filter_bits(items.count(), FILTER_BITS)
    sent = docs.sparkSession.sparkContext.broadcast(bloom(keys.select("lo"), bits))

    def task():
        seen = set()

        def each(ids, texts):
            out = {"key": [], "at": [], "n": [], "hi": [], "lo": [], "total": []}
            for key, text in zip(ids, texts, strict=True):
                if key in seen:  # copies that stand near each other are read once; the rest is told apart below
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(key)
                words = words_of(text)
                for n in lengths:
                    for base in range(0, len(words) - n + 1, 65536):
                        got = [window_digest(words[a : a + n]) for a in range(base, min(base + 65536, len(words) - n + 1))]
                        asked = held(np.array([lo for _, lo in got], np.int64), sent.value)
                        for i in np.nonzero(asked)[0].tolist():
                            for c, v in zip(out, (key, base + i, n, *got[i], len(words)), strict=True):
                                out[c].append(v)
            return out

        return each

    runs = map_columns(docs.select(text_key().alias("key"), "text"), ["key", "text"], "key binary, at long, n long, hi long, lo long, total long", task, rows=64)
    return written(runs.distinct().join(keys, ["hi", "lo", "n"], "left_semi"), "hits")


def hit_words(where: DataFrame) -> DataFrame:
    """(key, n_hit, total) of the distinct texts with hits."""
    words = where.select("key", "total", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("word")).distinct()
    return words.groupBy("key").agg(F.count("*").alias("n_hit"), F.first("total").alias("total"))


def report_joined(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, times: int = 20) -> DataFrame:
    """The same rows where the windows are too many to broadcast: digests are joined."""
    items = item_windows(benchmark, width)
    where = joined_hits(docs, items)
    found = where.select("key", "hi", "lo", "n").distinct().join(items, ["hi", "lo", "n"])
    found = found.select("key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("key").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item")).alias("items"))
    judged = hit_words(where).select("key", "n_hit").join(found, "key")

    def task():
        return lambda ids, keys, texts: {"doc_id": ids, "key": keys, "n_words": [len(words_of(t)) for t in texts]}

    counts = map_columns(docs.select("doc_id", text_key().alias("key"), "text"), ["doc_id", "key", "text"], "doc_id long, key binary, n_words long", task)
    out = counts.join(judged, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (times * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, times: int = 20, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    sent = broadcast_windows(docs, benchmark, width, max_bytes)
    if sent is None:
        key = fresh("key", docs.columns)
        bad = hit_words(joined_hits(docs, item_windows(benchmark, width))).where(times * F.col("n_hit") >= F.col("total"))
        return docs.withColumn(key, text_key()).join(bad.select(F.col("key").alias(key)), key, "left_anti").select(*docs.columns)

    @F.pandas_udf("boolean")
    def is_clean(texts):
        out = []
        for text in texts:
            words = words_of(text)
            hit = sum(b - a for a, b in covered(sent.value.spans(words)[0]))
            out.append(not (hit > 0 and times * hit >= len(words)))
        return pd.Series(out, dtype=bool)

    return docs.where(is_clean("text"))


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_bytes: int = MAX_BYTES) -> DataFrame:
    """All documents, with hit spans cut out of their texts (from a span's first word to the next kept word)."""
    def cut(text: str | None, spans_of) -> str | None:
        raw = (text or "").encode()
        found = list(WORD.finditer(raw.lower()))
        keep, at = [], 0
        for a, b in covered(spans_of([m[0] for m in found])):
            keep.append(raw[at : found[a].start()])
            at = found[b].start() if b < len(found) else len(raw)
        return text if not keep else b"".join([*keep, raw[at:]]).decode()

    sent = broadcast_windows(docs, benchmark, width, max_bytes)
    if sent is not None:

        @F.pandas_udf("string")
        def by_windows(texts: pd.Series) -> pd.Series:
            return pd.Series([cut(t, lambda ws: sent.value.spans(ws)[0]) for t in texts], dtype=object)

        return docs.withColumn("text", by_windows("text"))

    @F.pandas_udf("string")
    def by_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
        own = [sorted((int(s["at"]), int(s["at"]) + int(s["n"])) for s in (x if x is not None else ())) for x in spans]
        return pd.Series([cut(t, lambda ws, o=o: o) for t, o in zip(texts, own, strict=True)], dtype=object)

    key, spans = fresh("key", docs.columns), fresh("spans", docs.columns)
    hits = joined_hits(docs, item_windows(benchmark, width))
    of_text = hits.groupBy(F.col("key").alias(key)).agg(F.collect_set(F.struct("at", "n")).alias(spans))  # at most a text's words
    return docs.withColumn(key, text_key()).join(of_text, key, "left").withColumn("text", by_spans("text", spans)).select(*docs.columns)


def op3_decontaminate(spark, sf_dir):
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
