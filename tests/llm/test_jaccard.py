import random

import numpy as np
import pytest

from tessera.llm import jaccard as J
from tessera.llm.components import components

from .conftest import ODD


def brute(docs, size=J.SIZE, percent=J.PERCENT):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = {}
    for doc, text in docs:
        w = low(text).encode().split()
        sets.setdefault(doc, []).append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    both = len(x & y)
                    if both and 100 * both >= percent * len(x | y):
                        ra, rb = find(a), find(b)
                        root[max(ra, rb)] = min(ra, rb)
    return {d: (sorted(map(len, s)), find(d)) for d, s in sets.items()}


def edited(text, n, rng):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "w%d" % rng.randrange(10**6)
    return " ".join(words)


def case(prose):
    rng = random.Random(11)
    texts = []
    for g in range(12):
        base = prose(rng.choice((5, 30, 120, 400)), g)
        texts += [base] * rng.randint(1, 3)
        for _ in range(rng.randint(0, 8)):
            texts.append(edited(base, rng.choice((0, 1, 2, 3, 5, 9)), rng))
    chain = prose(200, 99)
    for _ in range(12):  # each links to its neighbours only
        texts.append(chain)
        chain = edited(chain, 2, rng)
    common = prose(40, 77)
    texts += [common + " " + prose(rng.choice((3, 10, 200)), 500 + i) for i in range(25)]
    texts += ["A b c", "a B  c", "a b c d", "x", "X"]
    rng.shuffle(texts)
    return [(3 * i, t) for i, t in enumerate(texts)]


def same(got, want):
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r)
    assert found.keys() == want.keys()
    for d, (sizes, root) in want.items():
        assert sorted(r.n_shingles for r in found[d]) == sizes and {r.component_id for r in found[d]} == {root}, d


@pytest.mark.parametrize(("size", "percent"), [(5, 80), (4, 85), (1, 100)])
def test_groups_against_brute_force(docs_of, prose, size, percent):
    docs = case(prose) + [(1000 + i, t) for i, t in enumerate(ODD)]
    same(J.groups(docs_of(docs, extra=True).repartition(6), size, percent).collect(), brute(docs, size, percent))


def test_a_large_group_in_small_blocks(docs_of, prose, monkeypatch):
    rng = random.Random(12)
    base = prose(60, 3)
    docs = [(i, edited(base, rng.choice((0, 1, 1, 2, 2, 3, 6)), rng)) for i in range(150)]
    monkeypatch.setattr(J.crossing_pairs, "__defaults__", (16,))
    same(J.groups(docs_of(docs).repartition(4)).collect(), brute(docs))


@pytest.mark.parametrize(("whole", "block"), [(J.WHOLE, J.LINK_BLOCK), (J.WHOLE, 8), (0, 8)])
def test_every_link_is_counted(docs_of, prose, monkeypatch, whole, block):
    """Links inside a component that others tie already, and copies, against all pairs."""
    rng = random.Random(13)
    base = prose(60, 4)
    docs = [(i, edited(base, rng.choice((0, 1, 1, 2, 2, 3, 6)), rng)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(200, base), (201, base)]
    monkeypatch.setattr(J, "LINK_BLOCK", block)
    rows = {r.doc_id: r for r in J.groups(docs_of(docs), 4, 85, links=True, whole=whole).collect()}
    same(rows.values(), brute(docs, 4, 85))
    sets = {d: J.shingles(t, 4) for d, t in docs}
    want = {d: sum(e != d and len(sets[d]) > 0 and J.linked(sets[d], sets[e], 85) for e in sets) for d in sets}
    assert {d: r.n_links for d, r in rows.items()} == want and sum(want.values()) > 2 * len(docs)


def test_shared_and_null_ids(docs_of, prose):
    a, b = prose(50, 1), prose(50, 2)
    docs = [(1, a), (2, a), (2, b), (3, b), (4, prose(50, 3))]
    same(J.groups(docs_of(docs)).collect(), brute(docs))
    got = J.groups(docs_of([(None, a), (5, a)])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(None, 46, None), (5, 46, 5)}


def test_representatives(docs_of, prose):
    docs = case(prose)
    df = docs_of(docs)
    out = J.representatives(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({root for _, root in brute(docs).values()})
    assert J.representatives(docs_of([])).count() == 0 and J.groups(docs_of([])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_filters_never_drop_a_link(seed):
    rng = np.random.default_rng(seed)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = x[rng.random(len(x)) > rng.choice([0, 0.02, 0.1, 0.2])]
        y = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 10) + 1))).astype(np.uint64)]))
        if not len(y):
            continue
        if J.linked(x, y, 85):
            need = J.least_overlap(len(x), len(y), 85)
            differ = int(np.bitwise_count(J.signature(x).view(np.uint64) ^ J.signature(y).view(np.uint64)).sum())
            assert len(np.intersect1d(x, y)) >= need and differ <= len(x) + len(y) - 2 * need
            order = lambda s: s[np.argsort(J.mixed(s), kind="stable")]
            px, py = order(x)[: J.prefix_length(len(x), 85)], order(y)[: J.prefix_length(len(y), 85)]
            both = np.intersect1d(px, py)
            assert len(both)
            first = order(both)[0]
            i, j = np.array([np.nonzero(order(x) == first)[0][0]]), np.array([np.nonzero(order(y) == first)[0][0]])
            assert J._near(np.array([len(x)]), np.array([len(y)]), i, j, 85)[0]


def test_counters_grow_with_the_input_up_to_a_bound():
    assert J.counters_for(10**6) == 1 << 22 and J.counters_for(10**9) == 1 << 23 and J.counters_for(10**15) == 1 << 25


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 180)] + [(7, 7), (500, 501), (501, 500)]
    rng = random.Random(1)
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 180), 100), 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
