import hashlib
import random

from tessera.llm import line_dedup as L

from .conftest import ODD


def brute(docs, chars=40, least=5):
    white = "\x20\x09\x0a\x0b\x0c\x0d"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(white))
    held = {}
    for doc, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= chars:
                held.setdefault(k, set()).add(doc)
    out = {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(held.get(key(x), ())) < least or max(held[key(x)]) == doc]
        out[doc] = (len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    return out


def case(prose):
    rng = random.Random(8)
    common = [prose(9, 70 + i).ljust(41, "é")[: rng.choice((39, 40, 60))] for i in range(12)] + ["É" * 40, "é" * 39, "x" * 40]
    docs = []
    for i in range(60):
        lines = [prose(8, i)] + [rng.choice(common) for _ in range(rng.randint(0, 6))]
        lines = [rng.choice(("", " ", "\t\r", "\x0b")) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(("", "  ", "\x0c")) for x in lines]
        docs.append((i, "\n".join(lines)))
    return docs + [(100 + i, t) for i, t in enumerate(ODD)]


def test_report_against_brute_force(docs_of, rows, prose):
    docs = case(prose)
    want = brute(docs)
    df = docs_of(docs, extra=True).repartition(5)
    for options in ({}, {"max_keys": 0}, {"bits": 1 << 16, "max_keys": 0}):
        assert {k: tuple(r)[1:] for k, r in rows(L.report(df, **options)).items()} == want
    assert sum(v[1] for v in want.values()) > 20


def test_twice_filter_never_misses(docs_of, prose):
    import numpy as np
    import xxhash

    line = prose(12, 1)
    assert len(line) >= 40
    df = docs_of([line, prose(12, 2), line]).repartition(3)
    bits = 1 << 16
    seen = L.Bits(bits, L.twice_seen(df, bits, 40))
    assert seen.has(L.places(np.array([xxhash.xxh3_64_intdigest(line.encode())], np.uint64), bits)).all()
    assert not seen.has(L.places(np.array([xxhash.xxh3_64_intdigest(prose(12, 2).encode())], np.uint64), bits)).any()


def test_shared_ids_and_null_ids(docs_of, prose):
    line = prose(12, 3)
    got = L.report(docs_of([(None, line), (1, line), (1, line), (2, line), (3, line), (3, line)])).collect()
    assert all(r.n_dropped == 0 for r in got)  # four documents
    got = L.report(docs_of([(None, line), (1, line), (1, line), (2, line), (3, line), (4, line), (4, line)])).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 0), (4, 0)]


def test_shared_and_null_ids_beyond_the_broadcast(docs_of, prose):
    line = prose(12, 3)
    docs = docs_of([(None, line), (None, "own\n" + line), (1, line), (1, line), (2, line), (3, line), (4, line), (4, line)])
    a, b = (sorted(map(tuple, L.report(docs, max_keys=k).select(L.F.coalesce("doc_id", L.F.lit(0)), "n_lines", "n_dropped", "kept_sha256").collect())) for k in (10, 0))
    assert a == b and [r[2] for r in a] == [1, 1, 1, 1, 1, 1, 0, 0]


def test_deduplicated_needs_only_ids_and_texts_and_keeps_all_columns(spark, prose):
    line = prose(12, 4)
    df = spark.createDataFrame([(i, line + "\n\ud83d\ude00 ä".encode("utf-16", "surrogatepass").decode("utf-16"), {"a": i}, "x") for i in range(6)], "doc_id long, text string, own map<string,int>, kept string")
    for k in (10, 0):
        out = L.deduplicated(df, max_keys=k)
        assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
        got = {r.doc_id: r for r in out.collect()}
        assert all(got[i].own == {"a": i} and got[i].kept == "x" and got[i].text == "😀 ä" for i in range(5)) and got[5].text.startswith(line)
    assert L.deduplicated(df.select("doc_id", "text")).columns == ["doc_id", "text"]


def test_deduplicated_documents(docs_of, rows, prose):
    docs = case(prose)
    df = docs_of(docs)
    out = L.deduplicated(df)
    assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
    want, got = brute(docs), rows(out)
    for doc, text in docs:
        assert hashlib.sha256((got[doc].text or "").encode()).hexdigest() == want[doc][2]
        assert (got[doc].text is None) == (text is None)
    assert L.deduplicated(docs_of([])).count() == 0 and L.report(docs_of([])).count() == 0
