import hashlib
import random
import re

from tessera.llm import decontaminate as D

from .conftest import ODD

B = "item_id long, text string"


def brute(docs, items, width=13):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for doc, text in docs:
        w, hit, found = low(text), set(), set()
        for item, t in items:
            v = low(t)
            for i in range(max(1, len(v) - width + 1) if v else 0):
                g = v[i : i + width]
                for s in range(len(w) - len(g) + 1):
                    if w[s : s + len(g)] == g:
                        hit |= set(range(s, s + len(g)))
                        found.add(item)
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def case(prose):
    items = [(i, prose(30, 100 + i)) for i in range(6)] + [(10, "Short ITEM here"), (11, ""), (12, None), (13, "one"), (14, prose(30, 100))]
    texts = []
    rng = random.Random(9)
    for i in range(30):
        words = prose(rng.choice((5, 60, 400)), i).split()
        t = items[i % 6][1].split()
        a = rng.randint(0, 20)
        words[2:2] = t[a : a + rng.choice((5, 12, 13, 14, 30))]
        texts.append((" ".join(words) + " short, item: HERE! one" * (i % 3 == 0)).replace(" ", rng.choice((" ", ", ", "\n"))))
    return list(enumerate(texts + ODD)), items


def test_report_against_brute_force_broadcast_and_joined(spark, docs_of, rows, prose):
    docs, items = case(prose)
    want = brute([d for d in docs if len(d[1] or "") < 100_000], items)
    bench = spark.createDataFrame(items, B)
    for limit in (D.MAX_BYTES, 1):
        got = {k: tuple(r)[1:] for k, r in rows(D.report(docs_of(docs, extra=True), bench, max_bytes=limit)).items()}
        assert len(got) == len(docs) and {k: got[k] for k in want} == want


def test_clean_keeps_columns_and_clean_rows(spark, docs_of, prose):
    docs, items = case(prose)
    bench = spark.createDataFrame(items, B)
    df = docs_of(docs)
    bad = {r.doc_id for r in D.report(df, bench).where("contaminated").collect()}
    for limit in (D.MAX_BYTES, 1):
        out = D.clean(df, bench, max_bytes=limit)
        assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {i for i, _ in docs} - bad
    assert bad


def test_rows_are_judged_by_their_own_text_in_both_paths(spark, docs_of, prose):
    """Repeated ids, null ids and repeated texts."""
    item = prose(30, 1)
    hit = "before " + item + " after"
    docs = [(1, hit), (1, hit), (1, "clean text here"), (None, hit), (None, "clean text here"), (2, "other clean text"), (3, None), (3, item)]
    bench = spark.createDataFrame([(0, item), (1, prose(3, 2))], B)
    want = sorted((str(d), *brute([(0, t)], [(0, item), (1, prose(3, 2))])[0]) for d, t in docs)
    df = docs_of(docs, extra=True).repartition(3)
    for limit in (D.MAX_BYTES, 1):
        assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in D.report(df, bench, max_bytes=limit).collect()) == want
        left = D.clean(df, bench, max_bytes=limit)
        assert left.columns == df.columns
        assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted((str(d), str(t)) for d, t in docs if item not in (t or ""))
        cut = D.without_spans(df.withColumn("spans", df.doc_id), bench, max_bytes=limit)
        assert cut.columns == [*df.columns, "spans"]
        assert sorted((str(r.doc_id), str(r.text)) for r in cut.collect()) == sorted((str(d), str(None if t is None else t.replace(hit, "before after").replace(item, ""))) for d, t in docs)


def test_what_is_sent_is_bounded_by_what_is_built(spark, prose):
    import tracemalloc

    items = [(i, prose(200, i)) for i in range(300)]
    said = D.sent_bytes(spark.createDataFrame(items, B))
    tracemalloc.start()
    windows = D.Windows(items, D.WIDTH)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(windows.hashes) > 50_000 and held <= said


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    """A hash that is too short under the first seeds only."""
    whole = D.rolled
    monkeypatch.setattr(D, "rolled", lambda ids, at, n, seed: whole(ids, at, n, seed) & D.np.uint64(1) if seed < 2 else whole(ids, at, n, seed))
    w = D.Windows([(1, "a b c d e f"), (2, "c d e f g h")], 3)
    assert w.seed == 2 and w.spans(b"x c d e y".split()) == ([(1, 4)], {1, 2}) and w.spans(b"g h".split()) == ([], set())


def test_spans_are_cut(spark, docs_of, prose, rows):
    item = prose(20, 1)
    bench = spark.createDataFrame([(0, item)], B)
    got = rows(D.without_spans(docs_of([f"Before it. {item}! After it.", "nothing", None]), bench))
    assert got[0].text == "Before it. After it." and got[1].text == "nothing" and got[2].text is None
    joined = rows(D.without_spans(docs_of([f"Before it. {item}! After it.", "nothing", None]), bench, max_bytes=1))
    assert joined == got


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], B)
    assert not D.report(docs_of(["a b"]), none).first().contaminated
    assert D.report(docs_of([]), none).count() == 0 and D.clean(docs_of(["a"]), none).count() == 1
    assert D.report(docs_of(["a b"]), spark.createDataFrame([(None, "a b")], B)).first().n_hit == 0
