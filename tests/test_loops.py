"""Operators without SQL, held against plain loops on seeded inputs, and groups that one task could not hold."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.porter import stem
from tessera.operators import bm25, graph, ordered, transcripts, uncertain, vector


@pytest.mark.parametrize("seed", range(3))
def test_failure_arcs_against_a_loop(spark, seed):
    rng = random.Random(seed)
    calls = [(s, i, rng.choice("tu"), rng.random() < 0.4, rng.choice("ABCDEF")) for s in ("s1", "s2", "s3") for i in sorted(rng.sample(range(200), 90))]
    want = set()
    for s in ("s1", "s2", "s3"):
        first, count, fixed, open_ = {}, {}, {}, []
        for _, i, tool, ok, sig in [c for c in calls if c[0] == s]:
            open_ = [o for o in open_ if i - o[0] <= 25]
            if not ok:
                if (tool, sig) in first or len(first) < 9:
                    first.setdefault((tool, sig), i)
                    count[tool, sig] = count.get((tool, sig), 0) + 1
                    open_.append((i, tool, sig))
                continue
            for o in sorted(open_, reverse=True):
                if o[1] == tool:
                    open_.remove(o)
                    fixed.setdefault((tool, o[2]), i)
                    break
        want |= {(s, *k, first[k], fixed.get(k), count[k]) for k in first}
    rng.shuffle(calls)
    df = spark.createDataFrame(calls, "session string, idx long, tool string, ok boolean, signature string").repartition(5)
    assert {tuple(r) for r in transcripts.failure_arcs(df, most=9).collect()} == want


@pytest.mark.parametrize("seed", range(2))
def test_values_told_again_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(5), i, float(rng.randrange(4)), rng.choice("pq"), rng.sample("abcdefgh", rng.randint(0, 3))) for i in range(300)]
    want = {}
    for g in range(5):
        kept, seen = [], 0
        for _, _, n, a, ws in sorted(r for r in rows if r[0] == g):
            seen += 1
            if not any(n == m and a == b and set(ws) & set(vs) for m, b, vs in kept):
                kept.append((n, a, ws))
        want[g] = (sum(k[0] for k in kept), len(kept), seen)
    df = spark.createDataFrame(rows, "g long, o long, n double, a string, w array<string>").repartition(3)
    assert {r.grp: (r.total, r.kept, r.seen) for r in uncertain.distinct_value_sums(df, "g", "o", "n", "a", "w").collect()} == want


def score(f, d, n, docs, average):
    idf = max(np.log((docs - n + 0.5) / (n + 0.5)), 1e-6)
    return idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / average))


def loop_search(texts, terms, count, size):
    f = {t: {i: c for i, x in texts.items() if (c := count(x or "", t))} for t in terms}
    d = {i: size(x or "") for i, x in texts.items()}
    average = sum(d.values()) / len(d)
    return {i: (round(-sum(score(f[t][i], d[i], len(f[t]), len(texts), average) for t in terms if i in f[t]), 6), sum(i in f[t] for t in terms)) for i in texts if any(i in f[t] for t in terms)}


def corpus(seed):
    rng = random.Random(seed)
    words = "running runs ran connect connected connection anana banana na the Übung running-shoes relational x1".split()
    return {i: None if i == 7 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for i in range(60)}


def test_stemmed_search_against_a_loop(spark):
    texts, asked = corpus(1), {0: {"run", "connect"}, 1: {"relat"}, 2: {"nothing", "run"}}
    stems = lambda x: [stem(w) for w in re.findall("[a-z0-9]+", x.lower())]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    q = spark.createDataFrame([(k, t) for k, ts in asked.items() for t in ts], "query_id long, term string")
    for every in (False, True):
        got = bm25.search(df, q, 1000, all_terms=every, mode=bm25.STEMS).collect()
        for k, ts in asked.items():
            want = loop_search(texts, ts, lambda x, t: stems(x).count(t), lambda x: len(stems(x)))
            own = {i: s for i, (s, n) in want.items() if not every or n == len(ts)}
            assert {r.id: r.score for r in got if r.query_id == k} == pytest.approx(own, abs=2e-6)


def test_substring_search_against_a_loop_and_sqlite(spark):
    import sqlite3

    texts, terms = corpus(2), {"ana", "run", "übu", "connection", "na", "RUN"}
    df = spark.createDataFrame([(i, t, (t or "")[::-1]) for i, t in texts.items()], "doc_id long, text string, back string")
    q = spark.createDataFrame([(0, t) for t in terms], "query_id long, term string")
    places = lambda x, t: len(re.findall(f"(?={re.escape(t)})", x.lower()))
    got = {r.id: r.score for r in bm25.search(df, q, 1000, mode=bm25.TRIGRAM).collect()}
    want = loop_search(texts, {"ana", "run", "übu", "connection"}, places, lambda x: max(0, len(x) - 2))
    assert got == pytest.approx({i: s for i, (s, _) in want.items()}, abs=2e-6)
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(text, back, tokenize = 'trigram')")
    db.executemany("insert into t(rowid, text, back) values (?, ?, ?)", [(i + 1, t or "", (t or "")[::-1]) for i, t in texts.items()])
    said = {i - 1: s for i, s in db.execute("select rowid, bm25(t) from t where t match '\"ana\" OR \"run\" OR \"connection\"'")}
    ask = spark.createDataFrame([(0, t) for t in ("ana", "run", "connection")], "query_id long, term string")
    both = bm25.search(df, ask, 1000, text=[F.col("text"), F.col("back")], mode=bm25.TRIGRAM)
    assert {r.id: r.score for r in both.collect()} == pytest.approx(said, abs=2e-6)


def test_blocks_of_terms_agree_with_one_block(spark, monkeypatch):
    df = spark.createDataFrame(list(corpus(3).items()), "doc_id long, text string")
    q = spark.createDataFrame([(k, t) for k, t in enumerate("running connected banana the x1".split())] + [(9, "the"), (9, "x1")], "query_id long, term string")
    one = sorted(map(tuple, bm25.search(df, q, 50).collect()))
    for name, bound in (("TERMS", 2), ("TERM_BYTES", 3), ("PAIRS", 1), ("TILE", 6)):
        with monkeypatch.context() as m:
            m.setattr(bm25, name, bound)
            assert sorted(map(tuple, bm25.search(df, q, 50).collect())) == one and one
    assert bm25.search(df, q.limit(0), 5).count() == 0


def test_filters_of_single_questions_stand_before_the_cut(spark, monkeypatch):
    rows = [(i, t, "abc"[i % 3] if i % 5 else None, str(i % 2), i % 4 > 0) for i, t in corpus(3).items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, place string, ok boolean")
    terms = ["running", "connected", "the", "x1"]
    q = spark.createDataFrame([(k, t) for k in range(6) for t in terms[k % 3 :]], "query_id long, term string")
    wants = {0: [["a"], None], 1: [["a", "c"], ["1"]], 2: [None, ["0"]], 3: [["z"], None], 4: [None, None]}
    w = spark.createDataFrame(list(wants.items()), "query_id long, wants array<array<string>>")
    every = {}
    for r in bm25.search(df, q, 10_000).collect():
        every.setdefault(r.query_id, []).append((r.score, r.id))
    of = {r[0]: r for r in rows}
    passes = lambda k, d: of[d][4] and all(v is None or of[d][2 + i] in v for i, v in enumerate(wants.get(k, [])))
    want = sorted((k, d, s, n) for k, found in every.items() for n, (s, d) in enumerate([x for x in sorted(found) if passes(k, x[1])][:4], 1))
    for tile in (bm25.TILE, 6):
        monkeypatch.setattr(bm25, "TILE", tile)
        got = bm25.search(df, q, 4, may=F.col("ok"), facets=[F.col("kind"), F.col("place")], wants=w)
        assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in got.collect()) == want and len(want) > 10


def test_only_takes_tables_away(spark):
    from pathlib import Path

    from tessera.operators import graph

    folder = Path(graph.shared_folder(spark).removeprefix("file:")) / "tessera"
    before = set(folder.glob("kept-*")) if folder.exists() else set()
    df = spark.createDataFrame([(i, f"w{i % 7} the") for i in range(50)], "doc_id long, text string")
    q = spark.createDataFrame([(0, "the"), (1, "w3")], "query_id long, term string")
    assert bm25.search(df, q, 3).count() == 6
    assert len(set(folder.glob("kept-*")) - before) == 1
    with pytest.raises(ZeroDivisionError):
        graph.only(lambda: graph.kept(df).limit(1 // 0))
    assert len(set(folder.glob("kept-*")) - before) == 1


def test_models_on_workers(spark):
    from tessera.operators import models

    def factory():
        def model(a, b):
            return [float(x) / float(y) for x, y in zip(a, b, strict=True)]

        return model

    df = spark.createDataFrame([(i, str(i), None if i == 5 else str(i % 4)) for i in range(20)], "id long, a string, b string")
    got = {int(r.a): r for r in models.applied(df, ["a", "b"], factory, "value", "double", rows=3, size=8).withColumnRenamed("value_error", "error").collect()}
    assert len(got) == 20
    for i, r in got.items():
        if i == 5 or i % 4 == 0:
            assert r.value is None and r.error.split(":")[0] in ("TypeError", "ZeroDivisionError")
        else:
            assert r.value == i / (i % 4) and r.error is None


def test_recall_takes_models(spark):
    """An embedder and a scorer put in: the head goes by the scorer, and the expansion's vector is the embedder's."""
    from tessera.operators import recall

    m = [(i, f"note {i} about topic{i % 4}", "EN", "p", f"s{i % 5}", "2024-01-01 00:00:00", 0.5) for i in range(40)]
    memories = spark.createDataFrame(m, "id long, content string, type string, project string, session string, created_at string, confidence double").withColumn("created_at", F.col("created_at").cast("timestamp"))
    vectors = spark.createDataFrame([(i, [1.0 if j == i % 4 else 0.1 for j in range(4)]) for i in range(40)], "id long, embedding array<double>")
    asks = spark.createDataFrame([(1, "topic1 notes", 1, [0.0, 1.0, 0.0, 0.0])], "query_id long, text string, vec_id long, embedding array<double>")
    usage = spark.createDataFrame([], "memory_id long, strength double, dormant boolean")
    phrases = spark.createDataFrame([], "phrase_id long, memory_id long, text string")

    def embed():
        return lambda texts: [[0.0, 0.0, 1.0, 0.0] for _ in texts]

    def score():
        return lambda questions, contents: [float(c.split()[1]) for c in contents]

    r = recall.Recall(asks, memories, vectors, usage, phrases, "2024-06-01 00:00:00", embed=embed, score=score)
    assert {x.id % 4 for x in r.by_expansion.where("similarity > 0.9").collect()} == {2}
    rows = sorted(r.reranked().collect(), key=lambda x: x["rank"])
    head = [x.id for x in rows[:20]]
    assert head == sorted(head, reverse=True) and len(rows) >= 20


def test_places_and_sums_in_a_group_of_most_rows(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else rng.choice("abc"), i, rng.randrange(50)) for i in range(3000)] + [(None, -1, 2), (None, -2, 3)]
    df = spark.createDataFrame(rows, "g string, id long, v long").repartition(6).withColumn("part", F.lit("own"))
    got = ordered.placed(df, ["g"], [F.desc("v"), F.col("id")], {"total": F.col("v")}).collect()
    assert len(got) == len(rows) and all(r.part == "own" for r in got)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        sums = np.cumsum([r[2] for r in own]).tolist()
        assert sorted((r.place, r.id, r.total, r.group_size) for r in got if r.g == g) == [(i + 1, r[1], sums[i], len(own)) for i, r in enumerate(own)]


def test_topk_tiles_blocks_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (700, 4)).astype(float)  # many equal similarities
    nan, inf = float("nan"), float("inf")
    odd = [(1000, [nan, 1.0, 1.0, 1.0]), (1001, [inf, 1.0, 1.0, 1.0]), (1002, None), (1003, [1.0, 1.0]), (1004, [None, 1.0, 1.0, 1.0]), (1005, [])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>").repartition(5)
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    sim = np.round(unit @ unit.T, 6) + 0.0
    want = set()
    for q in range(0, 700, 7):
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-sim[q, i], i))[:10]
        want |= {(q, i, sim[q, i], r) for r, i in enumerate(best, 1)}
    asks = df.where("vec_id % 7 = 0")
    assert {tuple(r) for r in vector.topk(asks, df, 10).select("query_id", "vec_id", "similarity", "rank").collect()} == want
    monkeypatch.setattr(vector, "ROWS", 64)
    monkeypatch.setattr(vector, "TILE", 64 * 8)
    small = vector.topk(asks, df, 10, block_bytes=40 * 32)
    assert {tuple(r) for r in small.select("query_id", "vec_id", "similarity", "rank").collect()} == want
    floor = vector.topk(asks, df, 10, floor=0.9)
    assert {tuple(r) for r in floor.select("query_id", "vec_id", "similarity", "rank").collect()} == {w for w in want if w[2] >= 0.9}


def test_best_trigger_against_a_loop(spark):
    rng = np.random.default_rng(6)
    x, t = rng.normal(size=(50, 3)), rng.normal(size=(9, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    triggers = spark.createDataFrame([(i % 4, i, v.tolist()) for i, v in enumerate(t)], "doctrine int, vec_id long, embedding array<double>")
    sim = np.round((x / np.linalg.norm(x, axis=1)[:, None]) @ (t / np.linalg.norm(t, axis=1)[:, None]).T, 6)
    want = {(q, d, s) for q in range(50) for d in range(4) if (s := max(sim[q, i] for i in range(9) if i % 4 == d)) >= 0.5}
    assert {tuple(r) for r in vector.best_trigger(df, triggers, 0.5).collect()} == want
    assert vector.best_trigger(df, triggers.limit(0), 0.5).count() == 0


def test_components_of_a_long_shuffled_path(spark):
    rng = random.Random(7)
    names = list(range(2000))
    rng.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(1999)] + [(5000, 5000), (7000, 6000), (None, 3)]
    rng.shuffle(links)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(2000), 0), 5000: 5000, 6000: 6000, 7000: 6000}


def test_ways_up_stop_at_rings_and_depths(spark):
    up = spark.createDataFrame([("a", "b", "B"), ("b", "c", "C"), ("c", "a", "A"), ("x", "y", "Y"), ("x", "w", "W"), ("y", "z", "Z")], "child string, parent string, name string")
    starts = spark.createDataFrame([("a",), ("x",), ("y",), ("z",)], "place string")
    got = {r.place: r.path for r in graph.containment_paths(up, starts).collect()}
    assert got == {"a": ["B", "C"], "x": ["W"], "y": ["Z"]}
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", f"N{i + 1}") for i in range(20)], "child string, parent string, name string")
    assert graph.containment_paths(chain, spark.createDataFrame([("n0",)], "place string")).first().depth == 8


def test_many_walks_are_single_walks(spark):
    e = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "d")]
    links = spark.createDataFrame(e + [(y, x) for x, y in e], "src string, dst string")
    seeds = spark.createDataFrame([(1, "a"), (2, "c"), (2, "d"), (3, "zz")], "query_id long, node string")
    got = {(r.query_id, r.node): r.mass for r in graph.pageranks(links, seeds, 5).collect()}
    for q, own in ((1, ["a"]), (2, ["c", "d"])):
        one = {r.node: r.mass for r in graph.pagerank(links, spark.createDataFrame([(n,) for n in own], "node string"), 5).collect()}
        assert {n: m for (k, n), m in got.items() if k == q} == pytest.approx(one)
