import random

import pytest

from tessera.operators import graph, intervals

ROWS = "id long, subject string, object string, predicate string, s long, e long"


def made(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    at = lambda c: f"timestamp_seconds({c} * 86400)"
    return df.selectExpr("id", "subject", "object", "predicate", f"{at('s')} as valid_from", f"{at('e')} as valid_to")


def loop(rows, key, other, open_ended, excludes):
    found = set()
    for a in rows:
        for b in rows:
            x, y = dict(zip("id subject object predicate s e".split(), a)), dict(zip("id subject object predicate s e".split(), b))
            if a[0] >= b[0] or any(x[k] is None or x[k] != y[k] for k in key) or None in (x["s"], y["s"], x[other], y[other]):
                continue
            ends = [v["e"] if v["e"] is not None else (10**9 if open_ended else None) for v in (x, y)]
            if None in ends or ends[0] < x["s"] or ends[1] < y["s"]:
                continue
            p, q = x[other], y[other]
            clash = p != q if excludes is None else p == q or (p, q) in excludes or (q, p) in excludes
            if clash and x["s"] < ends[1] and y["s"] < ends[0]:
                found.add((a[0], b[0]))
    return found


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize(("key", "other", "excludes"), [(["subject", "predicate"], "object", None), (["subject", "object"], "predicate", [("p", "q"), ("q", "r")])])
@pytest.mark.parametrize("open_ended", [True, False])
def test_pairs_and_counts_against_loops(spark, monkeypatch, seed, key, other, excludes, open_ended):
    monkeypatch.setattr(intervals, "BUCKET", 4)
    monkeypatch.setattr(intervals, "SMALL", (3, 0)[seed])
    rng = random.Random(seed)
    rows = []
    for i in range(90):
        s = rng.choice([None, *range(12)]) if i % 9 == 0 else rng.randint(0, 12)
        e = None if rng.random() < 0.2 else (s or 0) + rng.choice([-1, 0, 0, 1, 3, 8])
        rows.append((i, "hot" if rng.random() < 0.7 else rng.choice(["x", None]), rng.choice("ab"), rng.choice(["p", "q", "r", None]), s, e))
    df, want = made(spark, rows), loop(rows, key, other, open_ended, excludes)
    got = [tuple(r) for r in graph.overlapping_conflicts(df, key, other, open_ended, excludes).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5
    n = {}
    for a, b in want:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    assert {r.id: r.n for r in graph.conflicting(df, key, other, open_ended, excludes).collect()} == n


def test_a_subject_of_most_rows_makes_bounded_buckets(spark, monkeypatch):
    """Beliefs that follow each other: every bucket meets few rows, and each conflict is found once."""
    monkeypatch.setattr(intervals, "BUCKET", 16)
    monkeypatch.setattr(intervals, "SMALL", 60)
    rows = [(i, "hot", str(i % 3), "p", i, i + 2) for i in range(400)] + [(1000 + i, f"s{i}", "a", "p", 0, 5) for i in range(50)]
    got = {tuple(r) for r in graph.overlapping_conflicts(made(spark, rows), ["subject", "predicate"], "object").collect()}
    assert got == {(i, i + 1) for i in range(399)}
    assert graph.conflicting(made(spark, rows), ["subject", "predicate"], "object").count() == 400


def test_no_rows(spark):
    df = made(spark, [])
    assert graph.overlapping_conflicts(df, ["subject"], "object").count() == 0
    assert graph.conflicting(df, ["subject"], "object", excludes=[("p", "q")]).count() == 0


def test_weakest_is_one_row_a_group(spark):
    rows = [(1, "a", 1, 5), (2, "a", 1, 4), (3, "a", 2, 0), (4, "b", 1, 1), (5, "b", 1, 1), (6, "c", 0, 0), (7, None, 1, 1), (8, None, 0, 2)]
    got = graph.weakest(spark.createDataFrame(rows, "id long, g string, x int, y int"), ["g"], ["x", "y"])
    assert sorted((r.id, r.g) for r in got.collect()) == [(2, "a"), (8, None)]
