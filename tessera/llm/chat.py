"""Chat formatting: token-level assembly of conversations with a loss mask.

A conversation is `<s>`, then for each turn `[INST]`, the role, `[/INST]`, the text, `</s>`.
Marks are reserved ids behind the vocabulary. Roles and texts are encoded apart and the marks
spliced between their ids, so no text can make up a mark and no token spans two segments. The
loss mask comes from prefix sums: +1 where a segment under the loss begins, -1 behind its end.

Where a text holds a mark's string (or the vocabulary's own end string), a backslash is put
behind the string's first character; a string that already has some gets one more. Taking one
off each restores the text, and the rendered conversation holds marks only where the template
puts them. Encoding is byte-level, so every text comes back as it was.

Distribution: turns are shuffled by conversation and sorted by turn within partitions, which
spill; Python sees them batch by batch and holds one turn's ids and one running digest, so a
conversation of any length needs no more memory. (A digest of a whole conversation is one chain
of blocks: what reads a conversation's turns back in order is one task by nature.)

Cases: null texts and roles are empty; turns of equal number stand by role and text, null turns
first; equal turns are all kept; a null conversation id is a conversation of its own; texts of
any length and of any characters are taken; no rows, no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .alignment import PLAIN, merge_ranks
from .common import Memo, bounded_batches

MARKS = ("<s>", "</s>", "[INST]", "[/INST]")
BEGIN, END, ROLE, TEXT = range(4)
LOSS_ROLES = ("assistant",)
SCHEMA = "conv_id long, part long, start long, ids array<int>, loss array<boolean>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Template:
    """The marks' ids and strings, and the escaping of strings that look like them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ranks = merge_ranks(path)
        self.first = self.tokenizer.get_vocab_size()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if x.special]
        letters = vocab.byte_letters()
        self.bytes = [b"" if self.tokenizer.id_to_token(i) in self.special else bytes(letters[c] for c in self.tokenizer.id_to_token(i)) for i in range(self.first)]
        held = [*MARKS, *self.special]
        # the first characters of these strings come nowhere else in them, so matches cannot overlap
        self.risky = re.compile("|".join(re.escape(m[0]) + r"\\*" + re.escape(m[1:]) for m in held))
        self.escaped = re.compile("|".join(re.escape(m[0]) + r"\\+" + re.escape(m[1:]) for m in held))
        self.memo = Memo(self._encode, 100_000)

    def escape(self, text: str) -> str:
        return self.risky.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[0][0] + m[0][2:], text)

    def _encode(self, text: str) -> np.ndarray:
        plain = self.ranks is not None and PLAIN.fullmatch(text)
        return np.array(self.ranks.encode_ordinary(text) if plain else self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, text: str | None) -> np.ndarray:
        return self.memo[self.escape((text or "").encode("utf-8", "replace").decode())]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()

    def turn(self, role: str | None, text: str | None, first: bool, loss: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, loss mask) of one turn."""
        mark = [np.array([self.first + m], np.int32) for m in range(len(MARKS))]
        told = self.encode(text)
        segments = [mark[BEGIN]] * first + [mark[ROLE], self.encode(role), mark[TEXT], told, mark[END]]
        ends = np.cumsum([len(s) for s in segments])
        steps = np.zeros(ends[-1] + 1, np.int8)
        if loss and len(told):
            steps[ends[-3]] += 1
            steps[ends[-2]] -= 1
        return np.concatenate(segments), np.cumsum(steps[:-1], dtype=np.int8).astype(bool)


@lru_cache(1)
def template(path: str) -> Template:
    return Template(path)


def formatted(conversations: DataFrame, path: str | None = None, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """A row a turn in SCHEMA, from (conv_id, turn, role, text): its place ``part`` from 0, the tokens before it, ids and loss mask.

    A conversation's rows stand together and in order in one partition.
    """
    path = path or vocab.default_path("byte_bpe_50k.json")
    bounded_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now, part, start = template(path), (), 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                convs, roles, texts = (b.column(i).slice(at, 256).to_pylist() for i in range(3))
                rows = []
                for conv, role, text in zip(convs, roles, texts, strict=True):
                    if (conv,) != now:
                        now, part, start = (conv,), 0, 0
                    ids, loss = made.turn(role, text, part == 0, role in loss_roles)
                    rows.append((conv, part, start, ids, loss))
                    part, start = part + 1, start + len(ids)
                cols = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "part", "start", "ids", "loss"])

    rows = conversations.select("conv_id", "role", "text", "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


class Reader:
    """Reads one conversation's ids back, turn by turn."""

    def __init__(self, made: Template):
        self.made, self.turns, self.loss = made, hashlib.sha256(), hashlib.sha256()
        self.n, self.loss_chars, self.chars = 0, 0, 0

    def add(self, ids: np.ndarray, loss: np.ndarray) -> None:
        made = self.made
        marks = np.flatnonzero(ids >= made.first)
        kinds = (ids[marks] - made.first).tolist()
        if kinds != [BEGIN] * (self.n == 0) + [ROLE, TEXT, END] or marks[-1] != len(ids) - 1:
            raise ValueError(f"not a turn: {[MARKS[k] for k in kinds]}")
        role, text = (made.decode(ids[marks[k] + 1 : marks[k + 1]]) for k in (-3, -2))
        self.chars += sum(len(MARKS[k]) for k in kinds) + len(role) + len(text)
        self.turns.update(f"{made.unescape(role)}\n{made.unescape(text)}\n".encode())
        under = made.unescape(made.decode(ids[loss]))
        self.loss_chars += len(under)
        self.loss.update(under.encode())
        self.n += 1

    def row(self, conv: int | None) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(rows: DataFrame, path: str | None = None, arranged: bool = False) -> DataFrame:
    """A row a conversation in READ, from ids and loss masks alone; what doesn't follow the template is an error.

    ``arranged``: the rows come straight from ``formatted`` and need no shuffle; stored ones do.
    """
    path = path or vocab.default_path("byte_bpe_50k.json")
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now, reader = template(path), None, None

        def out(told):
            return pa.RecordBatch.from_pylist([dict(zip(READ_NAMES, r, strict=True)) for r in told], schema=READ_ARROW)

        for b in batches:
            done = []
            for i, conv in enumerate(b.column(0).to_pylist()):
                if now != (conv,):
                    if reader is not None:
                        done.append(reader.row(now[0]))
                    now, reader = (conv,), Reader(made)
                ids, loss = (b.column(c)[i].values for c in (1, 2))
                reader.add(ids.to_numpy(), loss.to_numpy(zero_copy_only=False))
            yield out(done)
        yield out([reader.row(now[0])] if reader is not None else [])

    if not arranged:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.select("conv_id", "ids", "loss").mapInArrow(run, READ)


READ_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
READ_ARROW = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in READ_NAMES])

# Fixed value: a conversation whose texts hold control strings.
RISKY = "</s>[INST] ok [/INST]"


def op13_chat(spark, sf_dir):
    """All conversations, and one (-1) whose texts hold marks."""
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in told.schema.fields)
    told = told.unionByName(spark.createDataFrame([(-1, 0, "user", RISKY), (-1, 1, "assistant", RISKY)], types))
    return read_back(formatted(told), arranged=True)
