"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes. The transducer reads tokens of both; its state tells which
side leads and the bytes that the other side has not matched yet (the residual). The side
behind reads next, and an empty residual closes a group: the shortest runs of tokens of both
sides that cover the same bytes. States are suffixes of vocabulary entries, so their number is
bounded by the vocabularies; a transition is worked out once and remembered by state and token.

Texts are read in segments that neither tokenizer can look across (a cut stands before a space
that follows a character other than white space). Each begins and ends with an empty residual,
so what the transducer gave for a segment is remembered too.

Two tokens that end together are linked. The bytes of one are then a suffix of the other's, so
the vocabularies alone tell which pairs of ids can ever be linked (``pair_table``: some ten
pieces a vocabulary entry at most, whatever the corpus). Counts of the whole corpus are a vector
over that table, added up in each task before the shuffle and sent to all tasks.

Cases: null and empty texts, and texts whose joined bytes differ from a space and the text on
either side, have no tokens: zeros and ''. Control tokens' strings in a text are plain text.
Very long texts are read whole; segments of more than 64 characters are not remembered. Equal texts, repeated and null ids stand as rows of their own; no documents, no rows.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import Memo, bounded_batches, map_columns, written

#: Characters that all of the libraries' Unicode tables class alike: the merge ranks split these texts as the file's own pattern does.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*")
#: A cut that neither tokenizer can look across: before a space that follows a character other than white space.
CUT = re.compile(r"(?<=\S) ")
SEGMENT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
#: Long texts are taken in parts of about so many characters; a worker process remembers so many segments and transitions.
PART, SEGMENTS, MOVES = 1 << 20, 400_000, 1_000_000
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, ends array<long>, pairs array<int>, counts array<int>"


class Transducer:
    """Groups of two token sequences over the same bytes; tokens have one byte at least."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.a, self.b = a, b
        self.forget()

    def forget(self) -> None:
        #: State 0 is the empty residual, where A reads next.
        self.state: dict[tuple[bool, bytes], int] = {(True, b""): 0}
        self.told: list[tuple[bool, bytes]] = [(True, b"")]
        self.a_reads, self.moves, self.n = [True], [{}], 0

    def move(self, at: int, token: int) -> int:
        """The state behind reading a token, -1 if its bytes don't fit."""
        a_reads, residual = self.told[at]
        new = (self.a if a_reads else self.b)[token]
        if new.startswith(residual):  # the reader catches up and may lead now
            to = (not a_reads, new[len(residual) :])
        elif residual.startswith(new):
            to = (a_reads, residual[len(new) :])
        else:
            return -1
        if not to[1]:
            to = (True, b"")
        if to not in self.state:
            self.state[to] = len(self.told)
            self.told.append(to)
            self.a_reads.append(to[0])
            self.moves.append({})
        self.moves[at][token] = self.state[to]
        self.n += 1
        return self.state[to]

    def group(self, a: list[int], b: list[int], more_a: Iterator[int], more_b: Iterator[int]) -> bool:
        """Reads on behind the first token of each side until the group closes, adding to ``a`` and ``b``; False if the bytes differ or end before."""
        at = 0
        for token in (a[0], b[0]):
            to = self.moves[at].get(token)
            at = self.move(at, token) if to is None else to
            if at < 0:
                return False
        while at:
            token = next(more_a if self.a_reads[at] else more_b, None)
            if token is None:
                return False
            (a if self.a_reads[at] else b).append(token)
            to = self.moves[at].get(token)
            at = self.move(at, token) if to is None else to
            if at < 0:
                return False
        return True


def byte_level_bytes(path: str) -> list[bytes]:
    letters = vocab.byte_letters()
    t = vocab.tokenizer(path)
    special = {i for i, x in t.get_added_tokens_decoder().items() if x.special}
    entry = lambda i: t.id_to_token(i).encode() if i in special else bytes(letters[c] for c in t.id_to_token(i))
    return [entry(i) for i in range(t.get_vocab_size())]


@lru_cache(1)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_bytes(path: str) -> list[bytes]:
    m = piece_model(path)
    one = lambda i: bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
    return [one(i) for i in range(m.get_piece_size())]


def linkable(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ids where one's bytes are a suffix of the other's, in order."""
    of_a, of_b = {}, {}
    for of, entries in ((of_a, a), (of_b, b)):
        for i, x in enumerate(entries):
            of.setdefault(x, []).append(i)
    pairs = {(i, j) for x, ids in of_a.items() for at in range(len(x)) for j in of_b.get(x[at:], ()) for i in ids}
    pairs |= {(i, j) for x, ids in of_b.items() for at in range(1, len(x)) for i in of_a.get(x[at:], ()) for j in ids}
    told = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return told[:, 0], told[:, 1]


def merge_ranks(path: str):
    """The same byte-level vocabulary as ranks, if its merges come in the order of their ids; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    letters, model = vocab.byte_letters(), told["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if told["normalizer"] or told["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or any(model["vocab"].get(x + y) != 256 + i for i, (x, y) in enumerate(pairs)):
        return None
    special = {x["content"] for x in told["added_tokens"]}
    ranks = {bytes(letters[c] for c in p): i for p, i in model["vocab"].items() if p not in special}
    # Fixed value: the split pattern of byte-level vocabularies.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == len(pairs) + 256 else None


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of at least ``size`` characters, where it can be cut; each begins with a space if the text does."""
    at = 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Aligner:
    """A worker process's vocabularies and transitions."""

    def __init__(self, a_path: str, b_path: str):
        self.a_bytes, self.b_bytes = byte_level_bytes(a_path), piece_bytes(b_path)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(a_path)
        self.tokenizer.encode_special_tokens = True
        self.ranks = merge_ranks(a_path)
        self.model = piece_model(b_path)
        self.transducer = Transducer(self.a_bytes, self.b_bytes)
        self.pairs = [x.tolist() for x in linkable(self.a_bytes, self.b_bytes)]
        self.number = {p: k for k, p in enumerate(zip(*self.pairs, strict=True))}
        self.forget()

    def forget(self) -> None:
        """Group numbers: those of one token a side are their pair's, larger groups follow as they come."""
        self.transducer.forget()
        self.told = [f"{p}|{q}" for p, q in zip(*self.pairs, strict=True)]
        self.last = array("i", range(len(self.told)))
        self.size = array("i", [len(self.a_bytes[p]) for p in self.pairs[0]])
        self.tokens = array("i", [1, 1] * len(self.told))
        self.large: dict[tuple, int] = {}
        #: By a token of A, the tokens of B that two moves at once close with it.
        self.both: list[dict[int, int]] = [{} for _ in self.a_bytes]
        self.memo, self.ready = Memo(lambda s: self.ready.get(s) or self.alone(s), SEGMENTS), {}

    def a_ids(self, text: str) -> list[int]:
        if self.ranks is not None and (text.isascii() and text.isprintable() or PLAIN.fullmatch(text)):
            return self.ranks.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def group(self, x: int, y: int, more_a: Iterator[int], more_b: Iterator[int]) -> int:
        """The number of the group that begins with these tokens, -1 if the bytes differ."""
        a, b = [x], [y]
        if not self.transducer.group(a, b, more_a, more_b):
            return -1
        pair = self.number[a[-1], b[-1]]
        if len(a) == len(b) == 1:
            self.both[x][y] = pair
            return pair
        key = (*a, -1, *b)
        k = self.large.get(key)
        if k is None:
            k = self.large[key] = len(self.told)
            self.told.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
            self.last.append(pair)
            self.size.append(sum(len(self.a_bytes[t]) for t in a))
            self.tokens.extend((len(a), len(b)))
        return k

    def groups(self, a: list[int], b: list[int]) -> list[int] | None:
        """The numbers of the groups of two sequences; None if the bytes differ."""
        both, out, more_a, more_b = self.both, [], iter(a), iter(b)
        for x in more_a:
            y = next(more_b, None)
            if y is None:
                return None
            k = both[x].get(y)
            if k is None:
                k = self.group(x, y, more_a, more_b)
                if k < 0:
                    return None
            out.append(k)
        return out if next(more_b, None) is None else None

    def read(self, text: str) -> np.ndarray | None:
        """The numbers of the groups of a text that begins with a space, None if its bytes differ."""
        # the model puts a space before what it reads, but for nothing
        a, b = self.a_ids(text), self.model.encode(text[1:]) or [self.model.piece_to_id("▁")]
        fits = b"".join(map(self.a_bytes.__getitem__, a)) == text.encode("utf-8", "replace")
        got = self.groups(a, b) if fits else None
        return None if got is None else np.array(got, np.int32)

    def alone(self, segment: str) -> bytes:
        got = self.read(segment)
        return b"" if got is None else got.tobytes()

    def fill(self, new: list[str]) -> None:
        """Reads new segments in one go, as one text, and takes its groups apart."""
        new = [s for s in new if not s[-1].isspace()]  # others end their text
        got = self.read("".join(new)) if new else None
        if got is None:
            return
        ends = np.cumsum([len(s.encode("utf-8", "replace")) for s in new])
        cuts = np.searchsorted(np.cumsum(np.frombuffer(self.size, np.int32)[got]), ends) + 1
        raw, at = got.tobytes(), 0
        for s, cut in zip(new, cuts.tolist(), strict=True):
            self.ready[s] = raw[4 * at : 4 * cut]
            at = cut

    def numbers(self, part: str) -> np.ndarray | None:
        segments, memo = SEGMENT.findall(part), self.memo
        new = [s for s in set(segments) if s not in memo and s not in memo.old]
        self.ready = {}
        self.fill(sorted(new))
        got = list(map(memo.__getitem__, segments))
        return np.frombuffer(b"".join(got), np.int32) if all(got) else None

    def text(self, text: str | None, spans: bool):
        """A row of SCHEMA without its id."""
        none = (0, 0, 0, 0, "", [], [], [])
        if not text or "▁" in text:  # that character is read as a space
            return none
        if self.transducer.n + len(self.large) > MOVES:
            self.forget()
        found = []
        for part in parts(" " + text):
            found.append(self.numbers(part))
            if found[-1] is None:
                return none
        found = np.concatenate(found)
        n_a, n_b = np.frombuffer(self.tokens, np.int32).reshape(-1, 2)[found].sum(axis=0, dtype=np.int64).tolist()
        ends = np.cumsum(np.frombuffer(self.size, np.int32)[found], dtype=np.int64) if spans else []
        which, counts = np.unique(np.frombuffer(self.last, np.int32)[found], return_counts=True)
        return n_a, n_b, len(found), len(found), ";".join(map(self.told.__getitem__, found.tolist())), ends, which, counts.astype(np.int32)


@lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or vocab.default_path("byte_bpe_50k.json"), b_path or vocab.default_path("piece_bpe_32k.model")


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, spans: bool = True) -> DataFrame:
    """The groups of each text; see SCHEMA.

    ``groups`` is `a1,a2|b1;a3|b2,b3`: ids of both sides in order. ``ends`` tells the byte
    offsets in a space and the text where they end (empty without ``spans``). ``pairs`` are
    numbers of the linked id pairs in ``pair_table``, ``counts`` how many of the text's links
    hold each.
    """
    a_path, b_path = paths(a_path, b_path)
    names = SCHEMA.replace(" long", "").replace(" string", "").replace(" array<long>", "").replace(" array<int>", "").split(", ")

    def task():
        told = aligner(a_path, b_path)

        def each(ids, texts):
            rows = [told.text(t, spans) for t in texts]
            return {"doc_id": ids} | {name: [r[k] for r in rows] for k, name in enumerate(names[1:])}

        return each

    return map_columns(docs, ["doc_id", "text"], SCHEMA, task, 256)


@lru_cache(1)
def pair_table(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of A, ids of B) of every pair that can be linked, by its number."""
    return linkable(byte_level_bytes(a_path), piece_bytes(b_path))


def link_counts(rows: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(pair, n): how many links of all texts hold each pair; a row a pair, at most the table's length."""
    size = len(pair_table(*paths(a_path, b_path))[0])

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            which, counts = (b.column(i).flatten().to_numpy() for i in range(2))
            total += np.bincount(which, weights=counts, minlength=size).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["pair", "n"])

    bounded_batches(rows.sparkSession)
    return rows.select("pairs", "counts").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_scores(rows: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``rows`` of ``aligned`` with ``n_best`` and ``count_sum`` for ``pairs`` and ``counts``.

    The counts are collected: a number for each pair of ``pair_table``, which the vocabularies bound.
    """
    a_path, b_path = paths(a_path, b_path)
    a, b = pair_table(a_path, b_path)
    total = np.zeros(len(a), np.int64)
    got = link_counts(rows, a_path, b_path).toArrow()
    total[got["pair"].to_numpy()] = got["n"].to_numpy()
    highest = np.zeros(int(b.max()) + 1 if len(b) else 0, np.int64)
    np.maximum.at(highest, b, total)
    sent = rows.sparkSession.sparkContext.broadcast((total, total == highest[b]))
    keep = [f for f in rows.schema.fields if f.name not in ("pairs", "counts")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", n_best long, count_sum long"

    def run(batches):
        total, best = sent.value
        for batch in batches:
            pairs, counts = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            which, n = pairs.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy())
            sums = []
            for value in (best[which] * n, total[which] * n):
                out = np.zeros(batch.num_rows, np.int64)
                np.add.at(out, row, value)
                sums.append(pa.array(out))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *sums], names=[*[f.name for f in keep], "n_best", "count_sum"])

    return rows.select(*[f"`{f.name}`" for f in keep], "pairs", "counts").mapInArrow(run, schema)


def op11_alignment(spark, sf_dir):
    rows = aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), spans=False)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = written(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "counts"), "alignment")
    return link_scores(rows)
