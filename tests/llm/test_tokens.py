import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing as P
from tessera.llm import token_counts as C
from tessera.llm import vocab

from .conftest import ODD

pytest.importorskip("public_tokenizers")
PATH = vocab.default_path("word_bpe_49k.json")


def greedy(pieces, word):
    s, i, n = (*word, C.END), 0, 0
    while i < len(s) - 1:
        for j in range(len(s), i, -1):
            if s[i:j] in pieces:
                i, n = j, n + 1
                break
        else:
            return None
    if i == len(s) - 1 and s[i:] in pieces:
        n += 1
    return n


@settings(max_examples=150, deadline=None)
@given(st.sets(st.tuples(st.binary(min_size=1, max_size=4).map(lambda b: bytes(97 + x % 3 for x in b)), st.booleans()), max_size=12), st.lists(st.binary(max_size=12).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=8))
def test_longest_match_against_greedy(pieces, words):
    auto = C.LongestMatch(pieces)
    whole = {(*p, *[C.END] * e) for p, e in pieces}
    for w in words:
        assert auto.count(w) == greedy(whole, w)


def test_counts_of_whole_texts(docs_of, rows, prose):
    texts = [*ODD, prose(500), "It's 12½ naïve cafés! don't"]
    got = rows(C.token_counts(docs_of(texts, extra=True)))
    whole = {(*p, *[C.END] * e) for p, e in vocab.pieces(PATH)}
    for i, t in enumerate(texts):
        words = vocab.words_of(t or "", PATH)
        assert got[i].n_words == len(words) and got[i].n_unknown == 0
        if len(t or "") < 10_000:
            assert got[i].n_tokens == sum(greedy(whole, w.encode()) for w in words)
    assert C.token_counts(docs_of([])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_ids_are_the_librarys(text):
    want = vocab.tokenizer(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(vocab.id_bytes(PATH).encode(text), "<u4").tolist() == want


def check_pieces(rows, ids_of, sizes=P.TIERS):
    """Every id in one piece, sequences without gaps, full or a power of two."""
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r[5], []).append((r[6], r[2]))
        docs.setdefault(r[0], []).append((r[1], r[2]))
        ids = ids_of[r[0]]
        assert r[3] == zlib.crc32(ids[4 * r[1] : 4 * (r[1] + r[2])]) and r[4] == len(ids) // 4
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert 0 < at <= sizes[-1]
        padding += 0 if at & (at - 1) == 0 else sizes[-1] - at
    for d, ids in ids_of.items():
        at = 0
        for start, n in sorted(docs[d]):
            assert start == at
            at += n
        assert at == len(ids) // 4
    return padding


def test_packer_places_every_token_once():
    rng = random.Random(2)
    p = P.Packer(task=3, chunk_tokens=50_000)
    ids, rows = {}, []
    for d in range(600):
        ids[d] = rng.randbytes(4 * rng.choice((1, 2, 7, 100, 511, 512, 513, 900, 3000, 4096, 4097, 20_000)))
        p.add(d, ids[d])
        if p.tokens >= p.chunk:
            rows += p.take()
    rows += p.take(last=True)
    assert check_pieces(rows, ids) == 0
    assert {r[7] for r in rows} >= set(P.TIERS)
    load = {}
    for r in rows:
        load.setdefault((r[7], r[8]), set()).add(r[5])
    assert all(size * len(s) <= P.STEP_TOKENS for (size, _), s in load.items())


def test_tiers_must_be_powers_of_two():
    with pytest.raises(ValueError):
        P.Packer(tiers=(500, 1000))


def test_pack_odd_texts(docs_of, prose):
    texts = [*ODD, *[prose(300 + 40 * i, i) for i in range(40)]]
    got = P.pack(docs_of(texts, extra=True))
    t = vocab.tokenizer(PATH)
    ids = {i: b"".join(x.to_bytes(4, "little") for x in [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in enumerate(texts)}
    assert check_pieces([tuple(r) for r in got.collect()], ids) == 0
    assert P.pack(docs_of([])).count() == 0
    assert P.pack(docs_of([(1, "a"), (1, "a"), (None, "b")])).agg({"length": "sum"}).first()[0] == 6
