import pytest

import corpus_pipeline as C
from tessera.llm import decontaminate, jaccard, line_dedup, quality

from tessera.llm.common import shared_folder

from .conftest import ODD
from .test_jaccard import brute as near_brute
from .test_line_dedup import brute as line_brute

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark, prose, docs_of):
    path = str(tmp_path_factory.mktemp("corpus"))
    boiler = prose(14, 12345)
    texts = [". ".join(prose(12, 50 * i + j).capitalize() for j in range(8)) + "." + ("\n" + boiler if i % 4 == 0 else "") for i in range(80)]
    texts += texts[:5] + [" | ".join(prose(60, 9000 + i).split()) for i in range(30)]
    items = [prose(30, 777), prose(30, 778)]
    texts += [prose(40, 1).capitalize() + ". " + items[0].capitalize() + "."]
    docs_of(texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(not 85 <= i < 115), 0) for i in range(116)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect_in_order(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in C.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        kept[name] = (before, docs)
    assert [n for n, _ in C.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]

    after = {r.doc_id for r in kept["quality classifier"][1].collect()}
    assert len(after & set(range(85, 115))) <= 1 and len(after & set(range(85))) >= 82
    before, got = kept["line dedup"]
    want = line_brute(list(before.items()))
    assert sum(v[1] for v in want.values()) > 10
    assert {r.doc_id: len((r.text or "").split("\n")) for r in got.collect()} == {d: max(1, v[0] - v[1]) for d, v in want.items()}
    before, got = kept["n-gram Jaccard join"]
    assert {r.doc_id for r in got.collect()} == {root for _, root in near_brute(list(before.items())).values()}
    before, got = kept["benchmark decontamination"]
    assert 115 in before and {r.doc_id for r in got.collect()} == set(before) - {115}
    before, got = kept["packing"]
    assert {r.doc_id for r in got.collect()} == set(before)


def test_run_gives_the_last_stages_rows(spark, folder):
    got = C.run(spark, folder)
    assert "sequence_id" in got.columns and got.count() > 50


def test_run_takes_odd_rows_and_leaves_no_tables(spark, docs_of, prose, tmp_path):
    """Null and empty texts, null and shared ids, repeated rows and very long texts."""
    import os

    path = str(tmp_path)
    texts = [(i, prose(60, i)) for i in range(20)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(1, prose(60, 1))] * 3 + [(2, prose(60, 99)), (None, prose(60, 5)), (None, None)]
    docs_of(texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(None, None, None), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, prose(60, 3)), (None, "a"), (1, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    root = f"{shared_folder(spark)}/tessera".removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    got = {r.doc_id for r in C.run(spark, path).collect()}
    assert set(range(20)) - {3} <= got and 3 not in got and None in got  # no labels: nothing is rejected
    left = set(os.listdir(root)) - before
    assert len(left) == 1 and left.pop().startswith("stage3-")


def test_empty_documents(spark, docs_of, tmp_path):
    path = str(tmp_path)
    docs_of([]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert C.run(spark, path).count() == 0


def test_stages_use_the_operators():
    assert {m.__name__.rsplit(".", 1)[1] for m in (quality, line_dedup, jaccard, decontaminate)} <= set(C.__dict__)
