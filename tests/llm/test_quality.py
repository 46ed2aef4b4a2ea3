import zlib

import numpy as np

from tessera.llm import quality as Q

from .conftest import ODD

L = "doc_id long, quality int, toxic int"


def corpus(prose):
    good = [". ".join(prose(12, 50 * i + j).capitalize() for j in range(8)) + "." for i in range(120)]
    bad = [" | ".join(prose(60, 9000 + i).split()) if i % 2 else (prose(1, i) + " ") * 80 for i in range(40)]
    return good + bad


def test_ranks_held_out_documents(spark, docs_of, rows, prose):
    texts = corpus(prose)
    docs = docs_of(texts, extra=True)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(len(texts))], L)
    got = rows(Q.scores(docs, Q.fit(docs, labels)))
    held = [i for i in got if got[i].held_out]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2] and len(held) > 20
    assert sum(got[i].predicted == (i < 120) for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= Q.CUT) for r in got.values())


def test_labels_of_held_out_rows_change_nothing(spark, docs_of, rows, prose):
    texts = corpus(prose)
    docs = docs_of(texts)
    rows_ = [(i, int(i < 120), 0) for i in range(len(texts))]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in rows_]
    a, b = (rows(Q.scores(docs, Q.fit(docs, spark.createDataFrame(r, L)))) for r in (rows_, turned))
    assert {k: v.score for k, v in a.items()} == {k: v.score for k, v in b.items()}


def test_pair_fit_follows_the_preference_and_the_quantile():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.7).astype(int)
    x = rng.normal(size=(400, 3)) + y[:, None] * np.array([2.0, 0.0, -2.0])
    m = Q.fit_pairs(x, y)
    assert m.weight[0] > 0.5 and m.weight[2] < -0.5 and abs(m.weight[1]) < 0.5
    assert abs((m.score(x) < Q.CUT).mean() - (y == 0).mean()) < 0.01
    assert Q.fit_pairs(x, np.ones(400)) is None


def test_fit_scores_and_threshold_against_plain_python():
    """Gradient steps on all pairs' logistic loss in plain lists give the weights, the quantile and the scores."""
    import math

    rng = np.random.default_rng(3)
    x = rng.normal(size=(24, 2)) + np.array([[1.0, -0.5]] * 16 + [[0.0, 0.0]] * 8)
    y = np.array([1] * 16 + [0] * 8)
    m = Q.fit_pairs(x, y, pairs_per_row=400)
    mean = [sum(r[j] for r in x) / 24 for j in (0, 1)]
    scale = [math.sqrt(sum((r[j] - mean[j]) ** 2 for r in x) / 24) + 1e-6 for j in (0, 1)]
    z = [[(r[j] - mean[j]) / scale[j] for j in (0, 1)] for r in x]
    d = [[a[j] - b[j] for j in (0, 1)] for a in z[:16] for b in z[16:]]
    w = [0.0, 0.0]
    for _ in range(4000):
        g = [1e-3 * w[0], 1e-3 * w[1]]
        for p in d:
            lost = 1 / (1 + math.exp(p[0] * w[0] + p[1] * w[1]))
            g[0] -= lost * p[0] / len(d)
            g[1] -= lost * p[1] / len(d)
        w = [w[0] - 0.5 * g[0], w[1] - 0.5 * g[1]]
    assert all(abs(a - b) < 0.15 for a, b in zip(m.weight, w, strict=True))  # the operator draws 400 partners, the loop takes all
    s = sorted(r[0] * m.weight[0] + r[1] * m.weight[1] for r in z)
    assert abs(m.threshold - (s[7] + s[8]) / 2) < 1e-9
    for r, got in zip(z, m.score(x), strict=True):
        assert abs(got - 1 / (1 + math.exp(-(r[0] * m.weight[0] + r[1] * m.weight[1] - m.threshold + math.log(0.7 / 0.3))))) < 1e-9


def test_repeated_ids_take_one_row_of_the_sample(spark, docs_of, prose):
    texts = corpus(prose)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(len(texts))], L)
    docs = docs_of([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 50)
    a, b = Q.fit(docs_of(texts), labels), Q.fit(docs, labels)
    assert np.allclose(a.weight, b.weight) and a.threshold == b.threshold


def test_odd_texts_empty_tables_and_bad_labels(spark, docs_of, rows, prose):
    none = spark.createDataFrame([], L)
    got = rows(Q.scores(docs_of(ODD), Q.fit(docs_of(ODD), none)))
    assert len(got) == len(ODD) and all(r.score == Q.CUT and r.predicted == 1 for r in got.values())
    texts = corpus(prose)
    labels = [(i, int(i < 120), 0) for i in range(len(texts))] + [(0, 0, 0), (None, 1, 0), (5000, 1, 0), (1, None, None), (2, 1, 0)]
    docs = docs_of([*texts, *ODD])
    model = Q.fit(docs, spark.createDataFrame(labels, L))
    got = Q.scores(docs, model)
    assert got.count() == len(texts) + len(ODD) and got.where("score is null or isnan(score)").count() == 0
    kept = Q.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == got.where("predicted = 1").count()
    assert Q.scores(docs_of([]), model).count() == 0 and Q.accepted(docs_of([]), model).count() == 0


def test_all_labelled_rows_and_all_their_pairs_count(spark, docs_of, prose):
    """The weights are those of the loss of all pairs; a table's fit is that of its rows in memory, though it goes through tasks."""
    rng = np.random.default_rng(5)
    y = (rng.random(300) < 0.6).astype(int)
    x = rng.normal(size=(300, 3)) + y[:, None] * np.array([0.8, 0.0, -0.6])
    m = Q.fit_pairs(x, y)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -6, 6)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 3)
    grad = d.T @ (1 / (1 + np.exp(-d @ m.weight)) - 1) / len(d) + 1e-3 * m.weight
    assert np.abs(grad).max() < 1e-3
    texts = corpus(prose)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(len(texts))], L)
    mine = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2]
    a, b = Q.fit(docs_of(texts), labels), Q.fit_pairs(np.array([Q.features(texts[i]) for i in mine]), np.array([int(i < 120) for i in mine]))
    assert np.array_equal(a.weight, b.weight) and a.threshold == b.threshold


def test_passes_of_the_fit_take_few_tasks_whatever_the_shuffle_partitions(spark, docs_of, prose):
    texts = corpus(prose)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(len(texts))], L)
    sets = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in sets}
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    try:
        for k, v in sets.items():
            spark.conf.set(k, v)
        sc.setJobGroup("fit", "fit")
        Q.fit(docs_of(texts), labels)
        stages = {s for j in tracker.getJobIdsForGroup("fit") for s in tracker.getJobInfo(j).stageIds}
        tasks = [i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(t >= 61 for t in tasks) <= 4  # shuffles of the features, none of the passes over them
