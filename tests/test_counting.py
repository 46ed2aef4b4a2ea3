import random
import re
from collections import Counter

from tessera.functions.porter import remembered
from tessera.operators import bm25, recall


def test_words_runs_and_stems_are_those_of_the_patterns():
    draw, stem = random.Random(3), remembered()
    token = recall.TOKEN.replace("A-Za-z", "a-z")
    for _ in range(3000):
        texts = ["".join(draw.choices("ab1%_. \n\x00\x1cé٠\ud800-", k=draw.randint(0, 14))) for _ in range(2)]
        for pattern, change, mode in (("[a-z0-9]+", str, bm25.WORDS), ("[a-z0-9]+", stem, bm25.STEMS), (token, str, bm25.by_runs(token, bm25.ALNUM + "%_."))):
            found = [change(w) for t in texts for w in re.findall(pattern, t)]
            asked = set(draw.sample(sorted(set(found)), len(set(found)) // 2)) | {"é", "zz"}
            size, counts = mode(asked)(texts)
            assert (size, dict(counts)) == (len(found), dict(Counter(filter(asked.__contains__, found)))), texts


def test_texts_come_in_batches_of_bounded_bytes(spark):
    key, rows = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 1 << 30)
        docs = spark.createDataFrame([(i, f"w{i} " + "long " * 40) for i in range(4)], "doc_id long, text string")
        asked = spark.createDataFrame([(1, "w1"), (1, "long")], "query_id long, term string")
        rows = bm25.search(docs, asked, 2).collect()
        assert int(spark.conf.get(key).removesuffix("b")) == 8 << 20
    finally:
        spark.conf.set(key, before)
    assert [r.id for r in sorted(rows, key=lambda r: r["rank"])][0] == 1 and len(rows) == 2
