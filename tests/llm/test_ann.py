import math
import random

import numpy as np
import pytest

from tessera.llm import ann

V = "vec_id long, embedding array<float>"


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def test_finds_most_of_the_true_neighbours_with_exact_scores(spark):
    rng = random.Random(1)
    vs = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(1200)]
    df = spark.createDataFrame(list(enumerate(vs)), V)
    vs = {r.vec_id: r.embedding for r in df.collect()}
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    found = 0
    for q in range(0, 1200, 20):
        true = sorted(((-cosine(vs[q], v), i) for i, v in vs.items() if i != q))[:5]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1))
        assert all(r.score == pytest.approx(cosine(vs[q], vs[r.vec_id]), abs=1e-12) for r in own)
        found += len({i for _, i in true} & {r.vec_id for r in own})
    assert found >= 0.9 * 5 * 60


def test_unusable_vectors_take_no_part_and_ties_go_to_smaller_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (9, [2.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 1.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, V).withColumn("score", ann.F.lit("x"))
    got = ann.nearest(df, df.where("vec_id in (0, 1, 2, 3)"), k=5).orderBy("rank").collect()
    assert {r.query_id for r in got} == {0}
    assert [r.vec_id for r in got][:3] == [7, 7, 9] and all(r.vec_id in (7, 8, 9) for r in got)


def test_empty_tables_give_no_rows(spark):
    none = spark.createDataFrame([], V)
    assert ann.nearest(none, none).count() == 0
    some = spark.createDataFrame([(1, [1.0, 2.0])], V)
    assert ann.nearest(some, none).count() == 0 and ann.nearest(some, some).count() == 0


def test_shift_sets_come_by_cost_and_never_cross_both_borders():
    m = 5
    sets = ann.shift_sets(m, 60)
    assert len({tuple(s) for s in sets}) == 60 and not sets[0].any()
    assert not any(s[j] and s[2 * m - 1 - j] for s in sets for j in range(m))


def test_blocks_of_queries_agree_with_one_block(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)], V)
    a = sorted(map(tuple, ann.nearest(df, df).collect()))
    assert a == sorted(map(tuple, ann.nearest(df, df, hashing=ann.Hashing(block_bytes=64 * 8 * 8)).collect()))


def clustered(n, centers, dim, rng, spread=0.35):
    c = rng.standard_normal((centers, dim))
    c /= np.linalg.norm(c, axis=1)[:, None]
    x = c[rng.integers(0, centers, n)] + spread / np.sqrt(dim) * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize(("centers", "share"), [(200, 0.1), (1000, 0.1)])
def test_vectors_with_structure_are_found_among_few_candidates(centers, share):
    """Recall at 5 against brute force, and the share of rows that are candidates."""
    rng = np.random.default_rng(centers)
    x = clustered(20_000, centers, 64, rng)
    tables = ann.fitted(x[:16_384], len(x), 5, ann.Hashing())
    asks = np.arange(0, len(x), 100)
    hit = ann.visited(x, ann.in_tables(x, tables), x[asks], tables)
    score = x[asks] @ x.T
    score[np.arange(len(asks)), asks] = -2
    true = np.argpartition(-score, 5, axis=1)[:, :5]
    assert np.take_along_axis(hit, true, 1).mean() >= 0.9 and hit.mean() <= share


def test_vectors_without_structure_keep_their_recall():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((8_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tables = ann.fitted(x, len(x), 5, ann.Hashing())
    asks = np.arange(0, len(x), 50)
    hit = ann.visited(x, ann.in_tables(x, tables), x[asks], tables)
    score = x[asks] @ x.T
    score[np.arange(len(asks)), asks] = -2
    assert np.take_along_axis(hit, np.argpartition(-score, 5, axis=1)[:, :5], 1).mean() >= 0.9


def test_search_in_spark_is_the_search_of_all_rows(spark):
    rng = np.random.default_rng(6)
    x = clustered(3_000, 30, 16, rng)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    got = ann.nearest(df, df.where("vec_id % 50 = 0")).collect()
    found = 0
    for q in range(0, 3_000, 50):
        score = x @ x[q]
        score[q] = -2
        found += len(set(np.argsort(-score)[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert found >= 0.9 * 5 * 60


def test_the_length_is_that_of_usable_vectors(spark):
    """Empty, zero and broken vectors, though more of them have one length, don't decide it."""
    bad = [[], [], [], [0.0] * 3, [0.0] * 3, [float("nan"), 1.0, 1.0], [None, 1.0, 1.0], [float("inf"), 0.0, 0.0], None]
    good = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.5, 0.5]]
    df = spark.createDataFrame(list(enumerate(bad + good)), V)
    got = ann.nearest(df, df)
    first = {r.query_id: r.vec_id for r in got.where("rank = 1").collect()}
    assert set(first) == set(range(len(bad), len(bad) + 4)) and first[9] == 10 and first[10] == 9
