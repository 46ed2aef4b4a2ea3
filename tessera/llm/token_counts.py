"""Token counts by a linear longest-match automaton.

Greedy word-piece takes the longest vocabulary piece at each place. The automaton is the
trie of the pieces with, at every node, a failure link and the number of pieces that are
taken off when no edge fits: reading a byte follows edges or failure links, each of which
uses up input, so a word costs time linear in its bytes and no piece is ever built.

The word's end is a symbol of its own (256), so that pieces that end words are longer
than their stems. A word that cannot be covered counts as one unknown token.

Cases: null and empty texts have no words and no tokens; very long words are read like
any other, and only words of up to 64 characters are remembered (at most ``vocab.MEMO``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame

from . import vocab
from .common import Memo, map_columns

END = 256


class LongestMatch:
    """Nodes are numbers, 0 the root; ``popped[v]`` pieces are taken when ``v`` fails over to ``fail[v]``."""

    def __init__(self, pieces: Iterable[tuple[bytes, bool]]):
        self.edges: list[dict[int, int]] = [{}]
        whole = [False]
        for piece, ends in pieces:
            v = 0
            for symbol in [*piece, *[END] * ends]:
                if symbol not in self.edges[v]:
                    self.edges[v][symbol] = len(self.edges)
                    self.edges.append({})
                    whole.append(False)
                v = self.edges[v][symbol]
            whole[v] = v != 0
        self.fail: list[int] = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for symbol, v in self.edges[u].items():
                todo.append(v)
                if whole[v]:  # the path itself is a piece: take it, go on from the root
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                w, taken = self.fail[u], self.popped[u]
                while w >= 0 and symbol not in self.edges[w]:
                    taken += self.popped[w]
                    w = self.fail[w]
                if w >= 0:
                    self.fail[v], self.popped[v] = self.edges[w][symbol], taken

    def count(self, word: bytes) -> int | None:
        """Pieces of a word, None if they can't cover it."""
        v, n = 0, 0
        for symbol in [*word, END]:
            while symbol not in self.edges[v]:
                if symbol == END and v == 0:
                    return n  # the word's end alone is no piece: what was taken covers the word
                if self.fail[v] < 0:
                    return None
                n += self.popped[v]
                v = self.fail[v]
            v = self.edges[v][symbol]
        while v:
            if self.fail[v] < 0:
                return None
            n += self.popped[v]
            v = self.fail[v]
        return n


@lru_cache(2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(vocab.pieces(path))


@lru_cache(1)
def counts_memo(path: str) -> Memo:
    """The worker process's memo of words' counts; -1 for words that the pieces can't cover."""

    def count(word: str) -> int:
        got = automaton(path).count(word.encode("utf-8", "replace"))
        return -1 if got is None else got

    return Memo(count, vocab.MEMO)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown): greedy longest-match counts of whole texts."""
    path = path or vocab.default_path("word_bpe_49k.json")

    def task():
        memo = counts_memo(path)

        def each(ids, texts):
            out = {"doc_id": ids, "n_words": [], "n_tokens": [], "n_unknown": []}
            for text in texts:
                words = vocab.words_of(text or "", path)
                counts = list(map(memo.__getitem__, words))
                bad = counts.count(-1)
                out["n_words"].append(len(words))
                out["n_tokens"].append(sum(counts) + 2 * bad)
                out["n_unknown"].append(bad)
            return out

        return each

    return map_columns(docs, ["doc_id", "text"], "doc_id long, n_words long, n_tokens long, n_unknown long", task)


def op6_token_counts(spark, sf_dir):
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
