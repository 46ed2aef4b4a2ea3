import itertools
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import alignment as L

from .conftest import ODD

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def al():
    return L.aligner(*L.paths(None, None))


def plain(al, text):
    """Groups, links and ends by byte offsets, with whole texts given to the libraries."""
    if not text:
        return None
    a, b = al.tokenizer.encode(" " + text, add_special_tokens=False).ids, al.model.encode(text)
    joined = [b"".join(v[i] for i in ids) for v, ids in ((al.a_bytes, a), (al.b_bytes, b))]
    if joined != [(" " + text).encode()] * 2:
        return None
    ends_a, ends_b = (list(itertools.accumulate(len(v[i]) for i in ids)) for v, ids in ((al.a_bytes, a), (al.b_bytes, b)))
    both = sorted(set(ends_a) & set(ends_b))
    told, i, j = [], 0, 0
    for e in both:
        p, q = ends_a.index(e) + 1, ends_b.index(e) + 1
        told.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
        i, j = p, q
    links = [(a[ends_a.index(e)], b[ends_b.index(e)]) for e in both]
    return len(a), len(b), ";".join(told), both, links


TEXTS = st.one_of(st.lists(st.sampled_from([*" \n\t.,'sABté日\x1c\x85\xa0<>|", "  ", " the", "▁"]), max_size=30).map("".join), st.text(st.characters(codec="utf-8"), max_size=40))


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_texts_against_byte_offsets(text):
    agree(text)


@pytest.mark.parametrize("text", ["a ", " ", "  ", "a  ", "a \n", "a\n ", "a b ", "x \t y", "don't 1 23", "a\x1c b", "a\xa0 b", "日 本 ", "<s> </s>", "▁", "a ▁ b", "ß" * 70 + " b", "e\u0301 f", "\x00 a", "\ufeff a"])
def test_chosen_texts(text):
    agree(text)


def agree(text):
    al = L.aligner(*L.paths(None, None))
    got, want = al.text(text, True), plain(al, text)
    if want is None:
        assert got[:5] == (0, 0, 0, 0, "")
    else:
        assert got[:3] == (want[0], want[1], len(want[3])) and got[4] == want[2] and list(got[5]) == want[3]
        assert {(al.pairs[0][k], al.pairs[1][k]): n for k, n in zip(got[6].tolist(), got[7].tolist())} == Counter(want[4])


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n"), max_size=40), st.lists(st.integers(0, 40), max_size=6), st.lists(st.integers(0, 40), max_size=6))
def test_transducer_against_cuts(text, cuts_a, cuts_b):
    """Any two ways to cut the same bytes."""
    pieces = lambda cuts: [x for x in (text[i:j] for i, j in itertools.pairwise(sorted({0, len(text), *[c for c in cuts if c < len(text)]}))) if x]
    a, b = pieces(cuts_a), pieces(cuts_b)
    va, vb = sorted(set(a)), sorted(set(b))
    t = L.Transducer([x.encode() for x in va], [x.encode() for x in vb])
    more_a, more_b, ends = iter([va.index(x) for x in a]), iter([vb.index(x) for x in b]), []
    at = 0
    for x in more_a:
        p, q = [x], [next(more_b)]
        assert t.group(p, q, more_a, more_b)
        at += sum(len(va[i]) for i in p)
        ends.append(at)
    assert next(more_b, None) is None
    assert ends == sorted(set(itertools.accumulate(map(len, a))) & set(itertools.accumulate(map(len, b))))
    assert len(t.told) <= 1 + sum(map(len, va)) + sum(map(len, vb))


def test_bytes_that_differ_have_no_group():
    t = L.Transducer([b"ab"], [b"a", b"c"])
    assert not t.group([0], [1], iter([]), iter([]))
    assert not t.group([0], [0], iter([]), iter([]))
    assert not t.group([0], [0], iter([]), iter([1]))


def test_parts_cut_only_before_words(al, prose):
    text = " " + prose(3000) + "  \n x" * 50
    got = list(L.parts(text, 500))
    assert "".join(got) == text and len(got) > 5 and all(p.startswith(" ") and not q[-1].isspace() for q, p in itertools.pairwise(got))
    whole = al.text(text[1:], False)
    L.PART, was = 500, L.PART
    try:
        assert L.parts.__defaults__ == (was,)
        assert [x[:5] for x in [al.text(text[1:], False)]] == [whole[:5]]
    finally:
        L.PART = was


def test_forgetting_changes_nothing(al, prose):
    texts = [prose(50, i) for i in range(5)]
    before = [al.text(t, False)[:5] for t in texts]
    al.forget()
    assert [al.text(t, False)[:5] for t in texts] == before


def test_query_columns_on_odd_texts(spark, docs_of, rows, prose, al):
    rng = random.Random(3)
    texts = [*ODD, "a▁b", "<|endoftext|> <s> </s>", "naïve œuvre ß", *[prose(60, rng.randint(0, 4)) for _ in range(12)]]
    docs = docs_of(texts, extra=True).withColumnRenamed("key", "pairs").withColumnRenamed("node", "counts")
    got = rows(L.link_scores(L.aligned(docs)))
    want = {i: plain(al, t) for i, t in enumerate(texts) if len(t or "") < 20_000}
    long_ids = [i for i, t in enumerate(texts) if len(t or "") >= 20_000]
    links = [p for w in want.values() if w for p in w[4]]
    for i in long_ids:  # too long for the plain way: their links are taken from the operator, their counts tested by sums
        r = al.text(texts[i], False)
        assert got[i].n_a == len(al.tokenizer.encode(" " + texts[i], add_special_tokens=False).ids) and got[i].n_b == len(al.model.encode(texts[i]))
        links += [p for k, n in zip(r[6].tolist(), r[7].tolist()) for p in [(al.pairs[0][k], al.pairs[1][k])] * n]
    count = Counter(links)
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(highest.get(b, 0), n)
    for i, w in want.items():
        r = got[i]
        if w is None:
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) == (0, 0, 0, 0, "", 0, 0)
        else:
            assert (r.n_a, r.n_b, r.groups, list(r.ends)) == (w[0], w[1], w[2], w[3])
            assert r.n_links == len(w[4]) and r.count_sum == sum(count[p] for p in w[4])
            assert r.n_best == sum(count[p] == highest[p[1]] for p in w[4])
    assert L.link_scores(L.aligned(docs_of([]))).count() == 0
    same = L.link_scores(L.aligned(docs_of([(1, "ab"), (1, "ab"), (None, "ab")]))).collect()
    assert len(same) == 3 and len({tuple(r)[1:5] for r in same}) == 1
