"""BM25 keyword search, with the statistics of the whole mirror.

score = sum over terms of -idf f 2.2 / (f + 1.2 (0.25 + 0.75 D / avgD)), idf = ln((N - n + 0.5) / (n + 0.5))
and at least 1e-6: negative, smaller is better. N, avgD and n never see filters.

One pass reads the texts: it tells each document's length and counts the asked terms only, one
row a document with the terms that it holds. The asked terms travel in blocks of at most
``TERMS`` and ``TERM_BYTES``; more take further passes. What a pass finds is a written table, from which document
counts and lengths are taken; then questions meet it in blocks of at most ``PAIRS`` (question,
term) pairs. Each partition adds up its documents' scores tile by tile and keeps its k best of
each question, so no (question, document) pair but those becomes a row.

``WORDS``: terms are words of ASCII letters and digits, D the number of words. ``STEMS``: the
same of their stems. ``TRIGRAM``: terms are substrings in any case, of three and more
characters (shorter ones match nothing), whose overlapping occurrences count; D adds
max(0, length - 2) of each text column.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.porter import remembered
from tessera.functions.text import tokens
from tessera.operators.graph import kept, only, sent
from tessera.operators.vector import Best
from tessera.session import bounded

TERMS, TERM_BYTES, PAIRS = 200_000, 16 << 20, 250_000
TILE = 1 << 19  # numbers added up at once
ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"
SCHEMA = "id long, d long, terms array<string>, fs array<long>, facets array<string>"


def postings(docs: DataFrame, id_col: str, text: Column, split=tokens) -> DataFrame:
    """(id, term, f, d) of every word: term counts with the document's length; one shuffle, pre-aggregated."""
    rows = docs.select(F.col(id_col).alias("id"), split(text).alias("ts"))
    return rows.select("id", F.size("ts").alias("d"), F.explode("ts").alias("term")).groupBy("id", "d", "term").agg(F.count("*").alias("f"))


def _cut(chars: str) -> bytes:
    """A table that turns all bytes but these characters' into spaces."""
    return bytes(i if chr(i) in chars and i < 128 else 32 for i in range(256))


def _by_words(asked: set[str], change: Callable[[str], str] | None = None):
    blank = _cut(ALNUM)
    wanted = None if change else frozenset(t.encode() for t in asked)

    def count(texts: list[str]) -> tuple[int, dict[str, int]]:
        found = [w for t in texts for w in t.encode("utf-8", "replace").translate(blank).split()]
        if change is None:
            return len(found), {w.decode(): n for w, n in Counter(filter(wanted.__contains__, found)).items()}
        out: dict[str, int] = {}
        for w, n in Counter(found).items():
            stem = change(w.decode())
            if stem in asked:
                out[stem] = out.get(stem, 0) + n
        return len(found), out

    return count


def _by_stems(asked: set[str]):
    return _by_words(asked, remembered())


def _by_substrings(asked: set[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for t in asked:
        if len(t) >= 3:
            automaton.add_word(t, t)
    if len(automaton):
        automaton.make_automaton()

    def count(texts: list[str]) -> tuple[int, dict[str, int]]:
        size = sum(max(0, len(t) - 2) for t in texts)
        return size, Counter(term for t in texts for _, term in automaton.iter(t)) if len(automaton) else {}

    return count


def by_runs(pattern: str, chars: str):
    """Terms are whole matches of a pattern in the lower-cased text; matches consist of ``chars`` (ASCII), and a match of letters and digits only is one of the pattern."""

    def mode(asked: set[str]):
        blank, word = _cut(chars), re.compile(pattern)

        def count(texts: list[str]) -> tuple[int, dict[str, int]]:
            size, out = 0, {}
            for run, n in Counter(r for t in texts for r in t.encode("utf-8", "replace").translate(blank).split()).items():
                run = run.decode()
                for w in (run,) if run.isalnum() else word.findall(run):
                    size += n
                    if w in asked:
                        out[w] = out.get(w, 0) + n
            return size, out

        return count

    return mode


WORDS, STEMS, TRIGRAM = _by_words, _by_stems, _by_substrings


def counted(docs: DataFrame, asked: DataFrame, id_col: str, texts: list[Column], mode=WORDS, facets: list[Column] | None = None) -> DataFrame | None:
    """(id, d, terms, fs, facets) of every document: the asked terms in it and how often they come. None if nothing is asked.

    ``facets`` are strings of the document that questions may ask for.
    """
    spark = bounded(docs.sparkSession)
    facet = F.array(*[f.cast("string") for f in facets or []]).cast("array<string>").alias("facets")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), facet, *[F.lower(t).alias(f"t{i}") for i, t in enumerate(texts)])

    def counter(asked_terms):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = mode(asked_terms.value)
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    ids, _, *cols = [b.column(i).slice(at, 1024).to_pylist() if i != 1 else None for i in range(b.num_columns)]
                    got = [count([p or "" for p in parts]) for parts in zip(*cols, strict=True)]
                    out = (ids, [d for d, _ in got], [list(f) for _, f in got], [list(f.values()) for _, f in got])
                    types = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
                    cols = [*[pa.array(c, t) for c, t in zip(out, types, strict=True)], b.column(1).slice(at, 1024)]
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "d", "terms", "fs", "facets"])

        return run

    parts, block, size = [], set(), 0

    def told():
        parts.append(kept(rows.mapInArrow(counter(sent(spark, frozenset(block))), SCHEMA)))
        block.clear()

    for r in asked.select("term").where("term is not null").distinct().toLocalIterator():
        block.add(r["term"])
        size += len(r["term"])
        if len(block) >= TERMS or size >= TERM_BYTES:
            told()
            size = 0
    if block:
        told()
    if not parts:
        return None
    if len(parts) == 1:
        return parts[0]
    out = parts[0].withColumn("at", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("at", F.lit(i)))
    found = out.groupBy("id", "d", "facets").agg(F.array_sort(F.collect_list(F.struct("at", "terms", "fs"))).alias("x"))
    return kept(found.select("id", "d", F.flatten(F.transform("x", lambda p: p["terms"])).alias("terms"), F.flatten(F.transform("x", lambda p: p["fs"])).alias("fs"), "facets"))


def frequencies(found: DataFrame) -> DataFrame:
    """(term, n): how many documents hold each asked term."""
    return found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def _weight(docs: int, n: int) -> float:
    return max(float(np.log((docs - n + 0.5) / (n + 0.5))), 1e-6)


def _asked(queries: DataFrame, mode) -> DataFrame:
    term = F.lower("term") if mode is TRIGRAM else F.col("term")
    return queries.select(F.col("query_id").cast("long").alias("query_id"), term.alias("term")).where("term is not null").distinct()


def _added(batch: pa.RecordBatch, number: dict[str, int], idf: np.ndarray, start: np.ndarray, of: np.ndarray, average: float):
    """(document numbers, questions, parts) of the postings of one batch of documents: one entry a question that asks a term.

    None where those are too many to hold and the batch has several documents.
    """
    sizes = pa.compute.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(batch.num_rows), sizes)
    coded = pa.compute.list_flatten(batch.column("terms")).dictionary_encode()  # no string a posting
    known = np.array([number.get(t, -1) for t in coded.dictionary.to_pylist()], np.int64)
    term = known[coded.indices.to_numpy()]
    f = pa.compute.list_flatten(batch.column("fs")).to_numpy().astype(np.float64)
    doc, term, f = doc[term >= 0], term[term >= 0], f[term >= 0]
    d = batch.column("d").to_numpy().astype(np.float64)[doc]
    part = idf[term] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / average))
    n = start[term + 1] - start[term]
    if n.sum() > TILE and batch.num_rows > 1:
        return None
    first = start[term] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
    asks = of[np.arange(n.sum()) + np.repeat(first, n)] if len(n) else np.zeros(0, np.int64)
    return np.repeat(doc, n), asks, np.repeat(part, n)


def _passing(batch: pa.RecordBatch, wanted: list[tuple[list, np.ndarray]], questions: int) -> np.ndarray | None:
    """[question, document]: whether the document's facets are among those that the question wants; None if no question wants any."""
    if not wanted:
        return None
    out, lists = np.ones((questions, batch.num_rows), bool), batch.column("facets")
    n = pa.compute.max(pa.compute.list_value_length(lists)).as_py() or 0
    facets = [pa.compute.list_element(lists, i).dictionary_encode() for i in range(n)]
    codes = [f.indices.fill_null(len(f.dictionary)).to_numpy() for f in facets]
    known = [f.dictionary.to_pylist() for f in facets]
    for values, which in wanted:
        ok = np.ones(batch.num_rows, bool)
        for v, code, names in zip(values, codes, known, strict=True):
            if v is not None:
                ok &= np.array([*[x in v for x in names], False])[code]
        out[which] &= ok
    return out


def _scored(found: DataFrame, asked: DataFrame, schema: str, collect, keep: DataFrame | None = None, wants: DataFrame | None = None, eligible: DataFrame | None = None) -> DataFrame | None:
    """Runs ``collect(ids, need, tiles)`` for blocks of questions; tiles are (ids, document numbers, questions, parts, passing)."""
    spark = bounded(found.sparkSession)
    about = found.agg(F.count("*").alias("n"), F.avg("d").alias("d")).first()
    weighted = asked.join(frequencies(found), "term").select("query_id", "term", "n")
    wants = weighted.select("query_id").limit(0).withColumn("wants", F.lit(None).cast("array<array<string>>")) if wants is None else wants
    weighted = weighted.join(wants, "query_id", "left").select("query_id", "term", "n", "wants").orderBy("query_id", "term")
    parts, rows = [], []

    def told():
        terms = sorted({r[1] for r in rows})
        number = {t: i for i, t in enumerate(terms)}
        ids = sorted({r[0] for r in rows})
        place = {q: i for i, q in enumerate(ids)}
        idf = np.zeros(len(terms))
        pairs = np.array([(number[t], place[q]) for q, t, _, _ in rows], np.int64)
        alike: dict = {}
        for q, t, n, w in rows:
            idf[number[t]] = _weight(about["n"], n)
            if w is not None:
                alike.setdefault(tuple(v if v is None else tuple(sorted(v)) for v in w), set()).add(place[q])
        wanted = [([v if v is None else frozenset(v) for v in k], np.array(sorted(qs))) for k, qs in alike.items()]
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        start = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
        need = np.bincount(pairs[:, 1], minlength=len(ids))
        block = sent(spark, (number, idf, start, pairs[:, 1], np.array(ids, np.int64), need, wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, idf, start, of, ids, need, wanted = block.value

            def tiles():
                step = max(1, TILE // max(len(ids), int(np.sqrt(len(of))), 1))
                for b in batches:
                    cuts = [b.slice(at, step) for at in range(0, b.num_rows, step)][::-1]
                    while cuts:
                        cut = cuts.pop()
                        got = _added(cut, number, idf, start, of, about["d"] or 1.0)
                        if got is None:  # terms that very many questions ask: fewer documents at once
                            half = cut.num_rows // 2
                            cuts += [cut.slice(half), cut.slice(0, half)]
                        else:
                            yield (cut.column("id").to_numpy(), *got, _passing(cut, wanted, len(ids)))

            yield from collect(ids, need, tiles())

        held = (found if eligible is None else eligible).where("size(terms) > 0")
        part = (held if keep is None else held.join(keep, "id", "left_semi")).select("id", "d", "terms", "fs", "facets").mapInArrow(run, schema)
        parts.append(part if last else kept(part))
        rows.clear()

    last = False
    for r in weighted.toLocalIterator():
        if len(rows) >= PAIRS and rows[-1][0] != r[0]:
            told()
        rows.append(tuple(r))
    last = not parts
    if rows:
        told()
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def search(
    docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text: Column | list[Column] | None = None, all_terms: bool = False, mode=WORDS, keep: DataFrame | None = None,
    may: Column | None = None, facets: list[Column] | None = None, wants: DataFrame | None = None,
) -> DataFrame:
    """(query_id, id, score, rank) for ``queries`` (query_id, term), distinct terms of each query.

    ``all_terms`` asks that every term occurs. Documents that are not in ``keep`` (id), or for
    which ``may`` is not true, are left out, though they count in the statistics. ``wants``
    (query_id, wants) narrows single queries: an array with one array of allowed values for
    each of the documents' ``facets``, null where any will do.
    """
    texts = [F.col("text")] if text is None else text if isinstance(text, list) else [text]
    facets = [*(facets or []), *([] if may is None else [F.when(may, "")])]
    return only(lambda: _searched(docs, queries, k, id_col, texts, all_terms, mode, keep, may is not None, facets, wants))


def _searched(docs, queries, k, id_col, texts, all_terms, mode, keep, by_may, facets, wants) -> DataFrame:
    asked = _asked(queries, mode)
    found = counted(docs, asked, id_col, texts, mode, facets)
    schema = "query_id long, id long, score double"
    w = Window.partitionBy("query_id").orderBy("score", "id")
    empty = docs.sparkSession.createDataFrame([], schema + ", rank int")
    if found is None:
        return empty
    if all_terms:  # a question with a word that no document holds has no answers
        asked_n = asked.groupBy("query_id").agg(F.count("*").alias("need"))
        known = asked.join(frequencies(found), "term", "left_semi").groupBy("query_id").agg(F.count("*").alias("known"))
        asked = asked.join(asked_n.join(known, "query_id").where("need = known"), "query_id", "left_semi")
    if wants is not None and by_may:
        wants = wants.select("query_id", F.concat("wants", F.array(F.lit(None).cast("array<string>"))).alias("wants"))

    def collect(ids, need, tiles):
        best = Best(len(ids), k, 6, None)
        for own, doc, q, part, passing in tiles:
            key = q * len(own) + doc
            total = np.bincount(key, weights=part, minlength=len(ids) * len(own)).reshape(len(ids), len(own))
            held = np.bincount(key, minlength=len(ids) * len(own)).reshape(len(ids), len(own))
            ok = held >= (need[:, None] if all_terms else 1)
            best.add(0, own, np.where(ok if passing is None else ok & passing, total, -9.0))
        best.settle()
        n, docs_, total = best.held
        yield pa.RecordBatch.from_arrays([pa.array(ids[n]), pa.array(docs_), pa.array(-total + 0.0)], names=["query_id", "id", "score"])

    held = found.where(F.element_at("facets", -1).isNotNull()) if by_may else found
    kept_ids = None if keep is None else keep.select(F.col("id").cast("long").alias("id")).distinct()
    out = _scored(found, asked, schema, collect, kept_ids, wants, held)
    if out is None:
        return empty
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
