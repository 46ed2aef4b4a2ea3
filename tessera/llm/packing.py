"""Hierarchical multi-length packing into windows of several context sizes.

Documents are tokenized with an end id each. Whole windows of the largest size are cut
off long documents; what is left goes to the smallest tier that holds it. Tiers are
packed from long to short: a window takes the largest waiting document of its tier, then
its gap is filled with the largest documents of this and shorter tiers that fit, and the
last gap by cutting one. Windows of all tiers are powers of two and full, so they need no
padding. When too little waits to fill a window, what is left is carried to the next
chunk; at a task's end it is cut at powers of two. Windows of a tier are dealt to step
groups of equal tokens, in snake order of their attention cost (the sum of squared piece
lengths), so that the steps of a tier cost alike.

Distribution: each task packs what it reads, in chunks of about ``chunk_tokens``; texts
are never shuffled, memory is bounded by a chunk and a document, and a lost task is
repeated with the same result because its documents come in the same order.

Cases: null and empty texts are one end id; a document longer than a window spans
several; equal documents and repeated ids are packed apart; no documents, no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import vocab
from .common import bounded_batches

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
CHUNK_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs documents that come one by one; ``take`` returns rows of SCHEMA."""

    def __init__(self, task: int = 0, tiers: tuple[int, ...] = TIERS, chunk_tokens: int = CHUNK_TOKENS, step_tokens: int = STEP_TOKENS):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError("tiers are rising powers of two")
        self.tiers, self.chunk, self.step = tiers, chunk_tokens, step_tokens
        self.docs: list[tuple[int | None, bytes]] = []
        #: By tier, (length, document, start) of waiting pieces in rising order of length.
        self.waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
        self.tokens, self.full = 0, []
        self.next_id, self.next_group = task << 40, task << 40

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, at, top = len(ids) // 4, 0, self.tiers[-1]
        d = len(self.docs)
        self.docs.append((doc_id, ids))
        self.tokens += n
        while n - at >= top:
            self.full.append((top, [(d, at, top)]))
            at += top
        self._wait(d, at, n - at)

    def _wait(self, d: int, start: int, n: int) -> None:
        if n:
            insort(self.waiting[next(t for t in self.tiers if n <= t)], (n, d, start))

    def _largest(self, room: int, tiers: tuple[int, ...]) -> tuple[int, int, int] | None:
        """Takes the largest waiting piece of at most ``room`` tokens."""
        for t in reversed(tiers):
            line = self.waiting[t]
            i = bisect_right(line, (room, 1 << 62, 0))
            if i:
                return line.pop(i - 1)
        return None

    def _pack(self) -> list[tuple[int, list[tuple[int, int, int]]]]:
        windows, self.full = self.full, []
        for level in range(len(self.tiers) - 1, -1, -1):
            size, usable = self.tiers[level], self.tiers[: level + 1]
            stock = sum(n for t in usable for n, _, _ in self.waiting[t])
            while self.waiting[size] and stock >= size:
                n, d, start = self.waiting[size].pop()
                pieces, room = [(d, start, n)], size - n
                while room and (got := self._largest(room, usable)):
                    pieces.append((got[1], got[2], got[0]))
                    room -= got[0]
                if room:  # only longer pieces wait: cut the shortest of them
                    n, d, start = next(self.waiting[t] for t in usable if self.waiting[t]).pop(0)
                    pieces.append((d, start, room))
                    self._wait(d, start + room, n - room)
                windows.append((size, pieces))
                stock -= size
        return windows

    def _rest(self) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """What can't fill a window of its tier, cut at falling powers of two."""
        line = [(d, start, n) for t in reversed(self.tiers) for n, d, start in reversed(self.waiting[t])]
        self.waiting = {t: [] for t in self.tiers}
        left, windows = sum(n for _, _, n in line), []
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            room, pieces = size, []
            while room:
                d, start, n = line[0]
                got = min(n, room)
                pieces.append((d, start, got))
                room -= got
                line[0] = (d, start + got, n - got)
                if got == n:
                    line.pop(0)
            windows.append((size, pieces))
            left -= size
        return windows

    def take(self, last: bool = False) -> list[tuple]:
        windows = self._pack() + (self._rest() if last else [])
        rows = []
        by_size: dict[int, list] = {}
        for w in windows:
            by_size.setdefault(w[0], []).append(w[1])
        for size in sorted(by_size, reverse=True):
            line = sorted(by_size[size], key=lambda ps: -sum(n * n for _, _, n in ps))
            groups = max(1, -(-len(line) * size // self.step))
            for i, pieces in enumerate(line):
                lap, place = divmod(i, groups)
                group = self.next_group + (place if lap % 2 == 0 else groups - 1 - place)
                offset = 0
                for d, start, n in pieces:
                    doc_id, ids = self.docs[d]
                    rows.append((doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, self.next_id, offset, size, group))
                    offset += n
                self.next_id += 1
            self.next_group += groups
        kept = sorted({d for line in self.waiting.values() for _, d, _ in line})
        new = {d: i for i, d in enumerate(kept)}
        self.docs = [self.docs[d] for d in kept]
        self.waiting = {t: sorted((n, new[d], s) for n, d, s in line) for t, line in self.waiting.items()}
        self.tokens = sum(n for line in self.waiting.values() for n, _, _ in line)
        return rows


def pack(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, chunk_tokens: int = CHUNK_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """A row for each piece of a document in a sequence; see SCHEMA."""
    path = path or vocab.default_path("word_bpe_49k.json")
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(docs.sparkSession)
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], SCHEMA).schema)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        packer, memo = Packer(TaskContext.get().partitionId(), tiers, chunk_tokens, step_tokens), vocab.id_bytes(path)

        def batch(rows):
            cols = list(zip(*rows, strict=True)) or [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for b in batches:
            for i in range(b.num_rows):
                packer.add(b.column(0)[i].as_py(), memo.encode(b.column(1)[i].as_py() or "") + end)
                if packer.tokens >= packer.chunk:
                    yield batch(packer.take())
        yield batch(packer.take(last=True))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op8_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
