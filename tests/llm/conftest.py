import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts (ids from 0) or (id, text) pairs, with columns that clash with results."""

    def make(texts, extra=False):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        if extra:
            for c in ("n_words", "score", "key", "component_id", "labels", "sequence_id", "slice", "node", "token"):
                df = df.withColumn(c, df.doc_id.cast("string"))
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded texts of invented words."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(2, 9))) for _ in range(3000)]

    def make(n, seed=0):
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def rows():
    return lambda df: {r["doc_id"]: r for r in df.collect()}


#: Texts that any operator must take.
ODD = [None, "", " \n\t ", "a", "ä" * 3, "\n" * 50, "x" * 200_000, "word " * 30_000, "\x00\x1f", "日本語 テキスト", "same text", "same text"]
