"""N-gram Jaccard join with rare-first prefixes, as connected groups of similar documents.

A document's set holds its distinct ``size``-word shingles (A-Z lower-cased, words split
at ASCII white space; fewer words: the whole sequence), as 64-bit hashes. Two documents
link if percent * union <= 100 * intersection.

1. One scan gives each document's set size, set digest and a 512-bit parity signature, and
   adds its shingles to counters, whose number grows with the input up to a bound. Equal sets
   become one node.
2. Sets are ordered rare-first by those counters, ties by hash: the same order everywhere,
   so a linked pair shares a shingle of both prefixes of n - ceil(t n) + 1. Prefix rows
   are shuffled by shingle once; rows alone in their shingle go.
3. First round: in each shingle's rows, sorted by set size, rows meet the first, middle
   and last of their size band and their neighbour. Second round: all pairs of a shingle
   whose documents are still in different components, in blocks of bounded size. Pairs
   inside a component need no test, so a group of thousands of near copies makes few.
4. Pairs pass the length, positional and suffix filters (the last: each element flips one
   bit of a signature, so differing bits bound the sets' difference from below), are made
   distinct, and are verified once on their whole sets.

Where the number of links is asked for, the sets of a component meet in blocks of bounded
size, each block pair a group of its own, and every pair of documents is tested there: a set
travels once for each block of its component, not once for each pair. Components of more than
``WHOLE`` documents test the pairs of a shingle instead.

No candidate is dropped: every linked pair is tested or already connected.

Cases: null and empty texts have no shingles and link with nothing; equal texts link if
they have words; rows that share a doc_id are one document; a null doc_id is a row with
its own count and a null component. Very long texts are read whole. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, mixed, written
from .components import components
from .line_dedup import SLICES, bloom, filter_bits, filter_tasks, held, merged_slices

SIZE, PERCENT = 5, 80
COUNTERS = 1 << 22, 1 << 25  # at least and at most
BLOCK = 512
LINK_BLOCK, LINK_BYTES, WHOLE = 512, 16 << 20, 8192
FILTER_BITS = 1 << 27
SIGNATURE = 8  # words of 64 bits
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


#: Bytes as random numbers, A-Z as a-z; white space parts words.
BYTES = np.random.default_rng(7).integers(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BYTES[65:91] = BYTES[97:123]
SOLID = np.ones(256, np.int8)
SOLID[[9, 10, 11, 12, 13, 32]] = 0
BASE = 0xD1342543DE82EF95


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse, modulo 2^64, to the powers below n."""
    out = []
    for base in (BASE, pow(BASE, -1, 2**64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return tuple(out)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, from one pass over the text's bytes: polynomials in BASE as differences of running sums."""
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    edge = np.diff(SOLID[b], prepend=np.int8(0), append=np.int8(0))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(16, len(b).bit_length()))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTES[b] * up[: len(b)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * ODD[0])


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The set as a sorted array of hashes."""
    h = word_hashes(text)
    if not len(h):
        return h
    run = min(size, len(h))  # fewer words: the whole sequence, which its length tells from a shingle
    n = len(h) - run + 1
    out = np.full(n, size - run, np.uint64)
    for i in range(run):
        out = mixed(out + h[i : i + n] * ODD[i % len(ODD)])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """Parities of 512 cells: each element flips one."""
    odd = np.bincount((s >> np.uint64(7)).astype(np.int64) & (64 * SIGNATURE - 1), minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def least_overlap(nx, ny, percent: int):
    """The least intersection of linked sets of these sizes."""
    return -(-percent * (nx + ny) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _cell(s: np.ndarray, counters: int) -> np.ndarray:
    return (s >> np.uint64(32)).astype(np.int64) & (counters - 1)


def counters_for(size: int) -> int:
    """A power of two, about one counter for each 128 bytes of input."""
    return min(COUNTERS[1], max(COUNTERS[0], 1 << max(0, size // 128 - 1).bit_length()))


def profiles(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, digest, s0..s7) of every row, and the counters of all documents as ranks of two bytes."""
    counters = counters_for(input_bytes(docs.select("text")))
    step = counters // SLICES
    sig = [f"s{i}" for i in range(SIGNATURE)]
    schema = "doc_id long, n long, digest binary, " + ", ".join(f"{c} long" for c in sig) + ", slice int, counts binary"

    def run(batches):
        counts, seen = np.zeros(counters, np.uint32), set()
        none = [None]
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = part.column(0).to_pylist()
                ns, digests, sigs = [], [], []
                for text in part.column(1).to_pylist():
                    s = shingles(text, size)
                    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if d not in seen:
                        if len(seen) >= 100_000:
                            seen.clear()
                        seen.add(d)
                        counts[_cell(s, counters)] += 1  # shingles of one set in one cell count once: only the order matters
                    ns.append(len(s))
                    digests.append(d)
                    sigs.append(signature(s))
                sigs = np.array(sigs)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(ns, pa.int64()), "digest": pa.array(digests, pa.binary()), **{c: pa.array(sigs[:, i]) for i, c in enumerate(sig)}, "slice": pa.nulls(len(ids), pa.int32()), "counts": pa.nulls(len(ids), pa.binary())})
        small = counts.astype(np.uint16) if counts.max() < 65536 else counts
        for k in range(SLICES):
            cut = small[k * step : (k + 1) * step]
            if cut.any():
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(none, pa.int64()), "n": pa.array(none, pa.int64()), "digest": pa.array(none, pa.binary()), **{c: pa.array(none, pa.int64()) for c in sig}, "slice": pa.array([k], pa.int32()), "counts": pa.array([cut.tobytes()], pa.binary())})

    def add(parts):
        total = np.zeros(step, np.float64)
        for c in parts:
            total += c.view(np.uint16 if len(c) == 2 * step else np.uint32)
        # Only the order matters: four times the square roots of the counts fit two bytes at any size.
        return np.minimum(np.sqrt(total) * 4, 65535).astype(np.uint16)

    rows = written(docs.select("doc_id", "text").coalesce(filter_tasks(docs.select("text"))).mapInArrow(run, schema), "profiles")
    counts = merged_slices(rows.where("slice is not null").select("slice", "counts"), ["counts"], add, 2 * counters).view(np.uint16)
    return rows.where("slice is null").drop("slice", "counts"), counts


def prefixes(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """(token, doc_id, n, pos): the rare-first prefix of each set, each set once a task."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        seen, cells = set(), sent.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows = b.slice(at, 256), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if doc is None:
                        continue
                    s = shingles(text, size)
                    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if not len(s) or d in seen:
                        continue
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(d)
                    p = prefix_length(len(s), percent)
                    first = s[np.argsort(cells[_cell(s, len(cells))], kind="stable")[:p]]
                    rows.append((first.view(np.int64), np.full(p, doc), np.full(p, len(s), np.int32), np.arange(p, dtype=np.int32)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["token", "doc_id", "n", "pos"])

    return docs.select("doc_id", "text").mapInArrow(run, "token long, doc_id long, n int, pos int")


def shared_rows(rows: DataFrame) -> DataFrame:
    """The rows that are not alone in their token; rows come sorted by token and leave in that order."""

    def run(batches):
        last, last_shared = None, False
        for b in batches:
            if not b.num_rows:
                continue
            t = b.column(0).to_numpy()
            same = np.concatenate([[last is not None and last.column(0)[0].as_py() == t[0]], t[1:] == t[:-1]])
            if last is not None and (same[0] or last_shared):
                yield last
            keep = same.copy()
            keep[:-1] |= same[1:]
            yield b.slice(0, b.num_rows - 1).filter(pa.array(keep[:-1]))
            last, last_shared = b.slice(b.num_rows - 1, 1), bool(keep[-1])
        if last is not None and last_shared:
            yield last

    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(run, "token long, doc_id long, n int, pos int")


def _near(nx, ny, px, py, percent: int):
    """Length and positional filters of pairs at a shared shingle."""
    small, large = np.minimum(nx, ny), np.maximum(nx, ny)
    return (100 * small >= percent * large) & (np.minimum(nx - px, ny - py) >= least_overlap(nx, ny, percent))


def first_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): rows meet the first, middle and last row of their size band, and their neighbour.

    Bands are ordered in one of four ways, by token, so that the rows of a large group of
    near copies, which share many tokens, meet several of each other.
    """
    band = max(np.log(100 / percent), 1e-3)
    level = F.floor(F.log("n") / band).cast("int")
    rows = rows.withColumn("level", level).withColumn("turn", F.xxhash64("doc_id", F.col("token").bitwiseAND(F.lit(3))))

    def pairs_of(t, doc, n, pos, level):
        start = np.concatenate([[True], (t[1:] != t[:-1]) | (level[1:] != level[:-1])])
        begin = np.nonzero(start)[0]
        run = np.cumsum(start) - 1
        end = np.concatenate([begin[1:], [len(t)]]) - 1
        at = np.arange(len(t))
        left = np.concatenate([begin[run], ((begin + end) // 2)[run], end[run], np.maximum(at - 1, 0)])
        right = np.tile(at, 4)
        ok = (t[left] == t[right]) & (doc[left] != doc[right])
        left, right = left[ok], right[ok]
        ok = _near(n[left].astype(np.int64), n[right].astype(np.int64), pos[left], pos[right], percent)
        a, b = doc[left[ok]], doc[right[ok]]
        return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)

    def run(batches):
        held = None
        for b in batches:
            b = pa.Table.from_batches([b])
            held = b if held is None else pa.concat_tables([held, b])
            if held.num_rows < 65536:
                continue
            cols = [held.column(i).to_numpy() for i in range(5)]
            # A token's rows meet within a batch of rows; what crosses its border meets through the second round.
            got = pairs_of(*cols)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])
            held = held.slice(held.num_rows - 1)
        if held is not None and held.num_rows:
            got = pairs_of(*[held.column(i).to_numpy() for i in range(5)])
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    rows = rows.select("token", "doc_id", "n", "pos", "level", "turn")
    return rows.repartition("token").sortWithinPartitions("token", "level", "turn", "doc_id").mapInArrow(run, "a long, b long")


def crossing_pairs(rows: DataFrame, percent: int, block: int = BLOCK, *, within: bool = False) -> DataFrame:
    """(a, b): all pairs of a token's rows in different components that pass the filters; with ``within``, in the same ones too.

    ``rows``: token, node, n, pos, component and the signature. Tokens of more than ``block``
    rows are dealt to chunks, and every pair of chunks is a group of its own.
    """
    sig = [f"s{i}" for i in range(SIGNATURE)]
    sizes = rows.groupBy("token").agg(F.count("*").alias("k"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    sizes = sizes if within else sizes.where("c0 <> c1")
    rows = rows.join(sizes.select("token", F.ceil(F.col("k") / block).cast("int").alias("chunks")), "token")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "n", "node", "pos", "component", "own", *sig)

    def pairs_of(t: pa.Table) -> np.ndarray:
        token, lo, hi, n, node, pos, comp, own = (t.column(i).to_numpy() for i in range(8))
        n = n.astype(np.int64)
        s = np.stack([t.column(8 + i).to_numpy() for i in range(SIGNATURE)], 1).view(np.uint64)
        begin = np.nonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))[0]
        end = np.repeat(np.concatenate([begin[1:], [len(token)]]), np.diff(np.concatenate([begin, [len(token)]])))
        out, i, d = [], np.arange(len(token)), 0
        while len(i):  # rows of a group stand in order of size: once a pair at distance d is too uneven, farther ones are too
            d += 1
            i = i[i + d < end[i]]
            i = i[100 * n[i] >= percent * n[i + d]]
            ok = ((node[i] != node[i + d]) if within else (comp[i] != comp[i + d])) & ((lo[i] == hi[i]) | (own[i] != own[i + d]))
            x = i[ok]
            x = x[_near(n[x], n[x + d], pos[x], pos[x + d], percent)]
            if len(x):
                x = x[np.bitwise_count(s[x] ^ s[x + d]).sum(1) <= n[x] + n[x + d] - 2 * least_overlap(n[x], n[x + d], percent)]
                out.append(np.stack([np.minimum(node[x], node[x + d]), np.maximum(node[x], node[x + d])], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def run(batches):
        held = None
        for b in batches:
            b = pa.Table.from_batches([b])
            held = b if held is None else pa.concat_tables([held, b])
            if held.num_rows < 65536:
                continue
            keys = np.stack([held.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            cut = np.nonzero((keys[1:] != keys[:-1]).any(1))[0]
            if len(cut):  # whole groups only; the last may go on in the next batch
                got = pairs_of(held.slice(0, int(cut[-1]) + 1))
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])
                held = held.slice(int(cut[-1]) + 1).combine_chunks()
        if held is not None and held.num_rows:
            got = pairs_of(held)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return rows.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, ids: DataFrame, size: int, name: str) -> DataFrame:
    """(id, elements): the sets of the documents with these ids (and of few others: ids go as a Bloom filter), written."""
    ids = written(ids, f"{name}-ids")
    bits = filter_bits(ids.count(), FILTER_BITS)
    sent = docs.sparkSession.sparkContext.broadcast(bloom(ids, bits))

    def sets(batches):
        for b in batches:
            ids = b.column(0)
            asked = held(ids.fill_null(0).to_numpy(), sent.value) & ids.is_valid().to_numpy(zero_copy_only=False)
            part = b.filter(pa.array(asked))
            for at in range(0, part.num_rows, 256):
                cut = part.slice(at, 256)
                got = [shingles(t, size).tobytes() for t in cut.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(got, pa.binary())], names=["id", "elements"])

    return written(docs.select("doc_id", "text").mapInArrow(sets, "id long, elements binary"), name)


def verified(pairs: DataFrame, docs: DataFrame, info: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that link: suffix filter on signatures, then whole sets of what is left."""
    sig = [f"s{i}" for i in range(SIGNATURE)]
    side = lambda x: info.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{x}{c}") for c in sig])
    differ = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in sig), F.lit(0))
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent) - 1e-9)
    left = pairs.join(side("a"), "a").join(side("b"), "b").where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (differ <= F.col("na") + F.col("nb") - 2 * need))
    left = written(left.select("a", "b").distinct(), "pairs")
    ends = left.select(F.col("a").alias("id")).distinct().unionByName(left.select(F.col("b").alias("id")).distinct())
    elements = sets_of(docs, ends, size, "sets")

    def test(batches):
        for b in batches:
            a, c = b.column(0).to_pylist(), b.column(1).to_pylist()
            x, y = b.column(2), b.column(3)
            ok = [i for i in range(b.num_rows) if linked(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in ok], pa.int64()), pa.array([c[i] for i in ok], pa.int64())], names=["a", "b"])

    whole = left.join(elements.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b").join(elements.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
    return written(whole.select("a", "b", "x", "y").mapInArrow(test, "a long, b long"), "verified")


def linked_in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """(node, others): how many documents each node links with, from (component, node, copies, elements) rows.

    Every pair of a component is tested on whole sets, in groups of two blocks: elements that
    one set of the group holds alone add nothing to an intersection, the others are columns
    of a matrix whose product with itself is all intersections.
    """
    sizes = rows.groupBy("component").agg(F.count("*").alias("k"), F.sum(F.octet_length("elements")).alias("bytes"))
    chunks = F.ceil(F.greatest(F.col("k") / LINK_BLOCK, F.col("bytes") / LINK_BYTES)).cast("int")
    rows = rows.join(sizes.select("component", chunks.alias("chunks")), "component")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "copies", "elements")

    def told(group: pa.Table) -> pa.RecordBatch:
        sets = [np.frombuffer(e.as_py(), np.uint64) for e in group.column("elements")]
        own, node, copies = (group.column(c).to_numpy() for c in ("own", "node", "copies"))
        n = np.array(list(map(len, sets)))
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(len(n)), n), (count > 1)[column]
        column = (np.cumsum(count > 1) - 1)[column][shared]
        order = np.argsort(column, kind="stable")
        row, column = row[shared][order], column[order]
        both = np.zeros((len(n), len(n)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            a, b = np.searchsorted(column, (at, at + 2048))
            x = np.zeros((len(n), 2048), np.float32)
            x[row[a:b], column[a:b] - at] = 1
            both += x @ x.T
        both = both.astype(np.int64)
        link = (both > 0) & (100 * both >= percent * (n[:, None] + n[None, :] - both))
        if group.column("lo")[0].as_py() != group.column("hi")[0].as_py():
            link &= own[:, None] != own[None, :]
        np.fill_diagonal(link, False)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(link @ copies)], names=["node", "others"])

    def run(batches):
        kept, key = [], None  # rows come sorted by group
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            start = 0
            for i, k in enumerate(keys):
                if k != key:
                    if i > start:
                        kept.append(b.slice(start, i - start))
                    if kept:
                        yield told(pa.Table.from_batches(kept))
                    kept, key, start = [], k, i
            if len(keys) > start:
                kept.append(b.slice(start))
        if kept:
            yield told(pa.Table.from_batches(kept))

    blocks = rows.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    return blocks.mapInArrow(run, "node long, others long").groupBy("node").agg(F.sum("others").alias("others"))


def link_counts(docs: DataFrame, final: DataFrame, shared: DataFrame, ids: DataFrame, info: DataFrame, size: int, percent: int, whole: int = WHOLE) -> DataFrame:
    """(node, n_links) of all nodes: links with other nodes' documents, and with the node's own other documents."""
    copies = written(ids.groupBy("node").agg(F.count("*").alias("copies")), "copies")
    sizes = final.groupBy("component").agg(F.count("*").alias("k"))
    placed = written(final.join(sizes, "component").where("k > 1").join(copies, "node"), "members")
    small, large = placed.where(F.col("k") <= whole), placed.where(F.col("k") > whole)
    sets = sets_of(docs, small.select(F.col("node").alias("id")), size, "members-sets").dropDuplicates(["id"])
    others = linked_in_blocks(small.join(sets, F.col("node") == F.col("id")).select("component", "node", "copies", "elements"), percent)
    if not large.isEmpty():
        signed = shared.join(large.select("node", "component"), "node").join(info.select(F.col("doc_id").alias("node"), *[f"s{i}" for i in range(SIGNATURE)]), "node")
        found = verified(crossing_pairs(signed, percent, within=True).distinct(), docs, info, size, percent)
        sides = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = others.unionByName(sides.join(large.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others")))
    return copies.join(others, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))


def groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, links: bool = False, whole: int = WHOLE) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links reach.

    With ``links`` also n_links, how many other documents the document links with, where ids are
    not shared. Copies count for their node's links and are no pairs of their own.
    """
    docs = docs.select("doc_id", "text")
    rows, counts = profiles(docs, size)
    info = rows.where("doc_id is not null and n > 0")
    nodes = written(info.groupBy("digest").agg(F.min("doc_id").alias("node")), "nodes")
    # Nothing above this join needs a digest's rows together, so those of a large group of copies can be split.
    ids = written(info.select("doc_id", "digest").join(nodes, "digest").select("doc_id", "node"), "named").distinct()

    shared = written(shared_rows(prefixes(docs, counts, size, percent)), "prefixes").join(ids, "doc_id")
    shared = written(shared.select("token", "node", "n", "pos").distinct(), "shared")
    several = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    same = ids.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    sig = [f"s{i}" for i in range(SIGNATURE)]
    pairs = first_pairs(shared.select("token", F.col("node").alias("doc_id"), "n", "pos"), percent).distinct()
    first = components(verified(pairs, docs, info, size, percent).unionByName(same))
    first = written(first, "first-components")
    # Signatures only go to tokens whose documents are in several components.
    placed = shared.join(first.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select("token", "node", "n", "pos", F.coalesce("component", "node").alias("component"))
    placed = written(placed, "placed")
    open_tokens = placed.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("token")
    signed = placed.join(open_tokens, "token").join(info.select(F.col("doc_id").alias("node"), *sig), "node")
    more = verified(crossing_pairs(signed, percent).distinct(), docs, info, size, percent)
    final = components(first.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    of_digest = nodes.join(final, "node", "left").select("digest", "node", F.coalesce("component", "node").alias("component_id"))
    if links:
        of_digest = of_digest.join(link_counts(docs, written(final, "components"), shared, ids, info, size, percent, whole), "node")
    counted = ["n_links"] if links else []
    out = rows.where("n > 0 and doc_id is not null").select("doc_id", "n", "digest").join(of_digest, "digest")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *[F.lit(0).cast("long").alias(c) for c in counted])
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", *counted).unionByName(alone)


def representatives(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns."""
    found = groups(docs, size, percent)
    extra = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(extra, "doc_id", "left_anti").select(*docs.columns)


def op10_jaccard(spark, sf_dir):
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, percent=85, links=True)
