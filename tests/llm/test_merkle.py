import hashlib
import random

import pyspark.sql.functions as F
import pytest

from tessera.llm import merkle as M

DOCS = "doc_id long, lang string, text string, n_chars long, source string, place string, tree string, way2 string"


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def tree(nodes, fanout):
    """Levels, one list a level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, at, fanout):
    out = []
    for nodes in levels[:-1]:
        run = at // fanout * fanout
        out += [nodes[i] for i in range(run, min(run + fanout, len(nodes))) if i != at]
        at //= fanout
    return out


def brute(leaves, fanout):
    """(subroot, root, siblings) of each (key, order, leaf)."""
    keys = sorted({k for k, _, _ in leaves}, key=lambda k: (k is not None, (k or "").encode()))
    order = {k: sorted((x for x in leaves if x[0] == k), key=lambda x: (x[1] is not None, x[1], x[2])) for k in keys}
    trees = {k: tree([x[2] for x in order[k]], fanout) for k in keys}
    over = tree([trees[k][-1][0] for k in keys], fanout)
    return {(k, i): (x, trees[k][-1][0], over[-1][0], siblings(trees[k], i, fanout) + siblings(over, keys.index(k), fanout)) for k in keys for i, x in enumerate(order[k])}


@pytest.mark.parametrize(("fanout", "height", "sizes"), [(2, 1, [1, 2, 3, 7]), (2, 3, [8, 9, 64, 65, 1]), (3, 2, [1, 9, 10, 28, 82]), (5, 1, [26, 4]), (2, 10, [1]), (4, 2, [16, 17])])
def test_trees_against_lists(spark, fanout, height, sizes):
    rng = random.Random(fanout * height)
    langs = [None, "", "ä", "a", "=", "z"]
    rows = [(langs[k], rng.randint(0, n), H(str(rng.random()))) for k, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "lang string, o long, leaf string")
    got = M.proven(M.manifest(df, "lang", ["o"], fanout, height)).collect()
    want = sorted((k, o, leaf, sub, root, "".join(sib)) for (k, o, leaf), sub, root, sib in brute(rows, fanout).values()) if None not in [r[0] for r in rows] else None
    told = [(r.lang, r.o, r.leaf, r.subroot, r.root, r.way.replace("/", "").replace(";", "")) for r in got]
    if want is None:
        want = [(k, o, leaf, sub, root, "".join(sib)) for (k, o, leaf), sub, root, sib in brute(rows, fanout).values()]
        told, want = sorted(told, key=str), sorted(want, key=str)
    assert sorted(told, key=str) == sorted(want, key=str)
    assert all(r.verified and r.folded_root == r.root for r in got)


def test_a_changed_leaf_is_found(spark):
    rows = [("x", i, H(str(i))) for i in range(20)] + [("y", 0, H("y"))]
    found = M.manifest(spark.createDataFrame(rows, "lang string, o long, leaf string"), "lang", ["o"], 2, 2)
    bad = found.withColumn("other", F.when(F.col("o") == 3, F.sha2("leaf", 256)).otherwise(F.col("leaf")))
    got = M.proven(bad, "other").collect()
    assert [r.o for r in got if not r.verified] == [3] and all(r.folded_root != r.root for r in got if not r.verified)


def test_leaves_of_odd_values(spark):
    rows = [(1, "en", "ä\n", 2, "s"), (2, None, "", None, ""), (None, "", None, 0, "-"), (3, "en", "x" * 200_000, 200_000, "1:1")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, n_chars long, source string")
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    got = df.select("doc_id", M.leaf_of([F.col(c) for c in M.FIELDS]).alias("leaf")).collect()
    assert {r.doc_id: r.leaf for r in got} == {i: H(*map(one, (i, s, lang, n, t))) for i, lang, t, n, s in rows}


def test_ties_repeats_nulls_and_clashing_columns(spark, tmp_path):
    rows = [(i % 4 if i % 5 else None, "en" if i % 3 else None, f"t{i % 6}", i % 2, "s", "p", "t", "w") for i in range(40)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = M.op12_merkle(spark, str(tmp_path)).collect()
    assert len(got) == 40 and len({r.root for r in got}) == 1 and {r.verified for r in got} <= {True, False}
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    empty = M.op12_merkle(spark, str(tmp_path / "none"))
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and empty.count() == 0


def test_fanout_and_height_are_checked(spark):
    df = spark.createDataFrame([("a", 1, "x")], "lang string, o long, leaf string")
    for fanout, height in ((1, 3), (2, 0)):
        with pytest.raises(ValueError):
            M.manifest(df, "lang", ["o"], fanout, height)
