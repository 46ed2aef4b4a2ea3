"""Operators on small inputs with answers worked out by hand."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, scoring, text
from tessera.operators import bm25, filters, fusion, graph, lifecycle, metrics, selection, transcripts, uncertain, vector


def ranked(spark, *ids):
    return spark.createDataFrame([("q", i, r) for r, i in enumerate(ids, 1)], "query_id string, id string, rank int")


def test_rrf_order_and_scores(spark):
    got = fusion.rrf([ranked(spark, "a", "b"), ranked(spark, "b", "c")], k=60).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "c"]
    assert got[0].rrf_score == pytest.approx(1 / 62 + 1 / 61, abs=1e-6)


def test_rrf_ties_keep_first_seen_order(spark):
    got = fusion.rrf([ranked(spark, "z"), ranked(spark, "a")]).orderBy("rank").collect()
    assert [r.id for r in got] == ["z", "a"]


def test_folds(spark):
    base = fusion.rrf([ranked(spark, "a", "b")])
    arm = ranked(spark, "b", "x", "y")
    add = {r.id: r.rrf_score for r in fusion.fold_arm(base, arm, add_only=True).collect()}
    assert add == pytest.approx({"a": 1 / 21, "b": 1 / 22, "x": 1 / 21, "y": 1 / 22}, abs=1e-6)
    there = spark.createDataFrame([("y",)], "id string")
    known = {r.id: r.rrf_score for r in fusion.fold_arm(base, arm, existing=there).collect()}
    assert known == pytest.approx({"a": 1 / 21, "b": 1 / 22 + 1 / 21, "y": 1 / 23}, abs=1e-6)


def test_gate_judges_the_first_row_only(spark):
    df = spark.createDataFrame([("p", 1, 0.2), ("p", 2, 0.9), ("q", 1, 0.5), ("q", 2, 0.1)], "query_id string, rank int, score double")
    assert {(r.query_id, r["rank"]) for r in filters.rejection_gate(df, 0.4).collect()} == {("q", 1), ("q", 2)}


def test_budget_is_a_prefix_and_keeps_the_first(spark):
    df = spark.createDataFrame([("q", 1, 900), ("q", 2, 4), ("p", 1, 40), ("p", 2, 400), ("p", 3, 0)], "query_id string, rank int, n int")
    got = {(r.query_id, r["rank"]) for r in filters.within_budget(df, 60, F.col("n")).collect()}
    assert got == {("q", 1), ("p", 1)}


def test_query_grammar(spark):
    asks = ["fix type:DECISION after:2024-01-02 path:src/x the bug", "type:X", "Type:gotcha,pattern see path:'a b' TAG:\"x y\"", "plain", "type:a type:b c", "mytype:x"]
    query, parts = filters.inline_filters(F.col("t"))
    got = spark.createDataFrame([(i, t) for i, t in enumerate(asks)], "i int, t string").select("i", query.alias("q"), parts.alias("p")).orderBy("i").collect()
    assert [(r.q, {p.key: p.value for p in r.p}) for r in got] == [
        ("fix the bug", {"type": "DECISION", "after": "2024-01-02", "path": "src/x"}),
        ("type:X", {"type": "X"}),
        ("see", {"type": "gotcha,pattern", "path": "a b", "tag": "x y"}),
        ("plain", {}),
        ("c", {"type": "b"}),
        ("my", {"type": "x"}),
    ]


def test_allowed_rows(spark):
    rows = [("see the Code", "2024-01-05 00:00:00", "EN", "p", ["Red"]), ("other", None, "DE", "q", [])]
    df = spark.createDataFrame(rows, "content string, at string, type string, project string, tags array<string>").withColumn("at", F.col("at").cast("timestamp"))

    def ok(text):
        parts = filters.inline_filters(F.lit(text))[1]
        keep = filters.allowed(parts, filters.SEARCH_KEYS + filters.RESULT_KEYS, df.content, df["at"], df.type, df.project, df.tags)
        return [r.project for r in df.where(keep).orderBy("project").collect()]

    assert ok("x") == ["p", "q"] and ok("type:en,fr x") == ["p"] and ok("type:'fr, en , x'") == ["p"] and ok("after:2024-01-06") == ["q"] and ok("symbol:code") == ["p"]
    assert ok("tag:red") == ["p"] and ok("project:q before:2020-01-01") == ["q"]


def test_bm25_equals_sqlite(spark):
    docs = ["the quick brown fox", "quick quick fox jumps over", "lazy dog sleeps", "brown dog and brown fox", "nothing here at all", "fox"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(content, tokenize = 'unicode61')")
    db.executemany("insert into t(rowid, content) values (?, ?)", list(enumerate(docs, 1)))
    want = dict(db.execute("select rowid, bm25(t) from t where t match '\"quick\" OR \"brown\"'").fetchall())
    df = spark.createDataFrame(list(enumerate(docs, 1)), "doc_id long, text string")
    asked = spark.createDataFrame([(0, "quick"), (0, "brown")], "query_id long, term string")
    got = {r.id: r.score for r in bm25.search(df, asked, 10).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_topk_blocks_zero_and_null_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = vector.topk(df, df, 2).where("query_id = 1").orderBy("rank").collect()
    assert [(r.vec_id, r.similarity) for r in got] == [(5, 1.0), (2, pytest.approx(0.993884))]
    assert df.select(vector.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).where("c = 0").count() == 1


def path(spark):
    e = [("a", "b"), ("b", "c"), ("c", "d")]
    return spark.createDataFrame(e + [(y, x) for x, y in e], "src string, dst string")


def test_pagerank_on_a_path(spark):
    seed = spark.createDataFrame([("a",)], "node string")
    m = {r.node: r.mass for r in graph.pagerank(path(spark), seed, 60).collect()}
    assert m["b"] > m["c"] > m["d"] > 0 and m["a"] > m["d"] and sum(m.values()) == pytest.approx(1, abs=1e-6)
    both = {r.node: r.mass for r in graph.pagerank(path(spark), spark.createDataFrame([("a",), ("d",)], "node string"), 60).collect()}
    assert both["a"] == pytest.approx(both["d"]) and both["b"] == pytest.approx(both["c"])
    assert graph.pagerank(path(spark), spark.createDataFrame([("zz",)], "node string"), 5).count() == 0


def test_neighbours_tell_the_first_hop(spark):
    e = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "d"), (4, "x", "y"), (5, "c", "a")], "id long, subject string, object string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert {(r.id, r.hop) for r in graph.neighbors(e, seed, 2).collect()} == {(1, 1), (5, 1), (2, 2), (3, 2)}
    assert {(r.id, r.hop) for r in graph.neighbors(e, seed, 1, "out").collect()} == {(1, 1)}


def test_components(spark):
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 50: 50, 51: 50}


def test_conflict_windows_differ_on_open_ends(spark):
    rows = [(1, "s", "p", "x", "2020-01-01", None), (2, "s", "p", "y", "2021-01-01", "2022-01-01"), (3, "s", "p", "z", "2023-01-01", None)]
    e = spark.createDataFrame(rows, "id long, subject string, predicate string, object string, f string, t string").selectExpr("*", "cast(f as timestamp) as valid_from", "cast(t as timestamp) as valid_to")
    pairs = lambda open_: {(r.a, r.b) for r in graph.overlapping_conflicts(e, ["subject", "predicate"], "object", open_).collect()}
    assert pairs(True) == {(1, 2), (1, 3)} and pairs(False) == set()


def test_metrics(spark):
    r = spark.createDataFrame([("c", i, k) for k, i in enumerate("abcd", 1)] + [("n", "a", 1)], "case_id string, id string, rank int")
    g = spark.createDataFrame([("c", "b"), ("c", "d"), ("c", "z")], "case_id string, id string")
    m = {x.case_id: x for x in metrics.case_metrics(r, g, 3).collect()}
    assert m["c"].recall == pytest.approx(1 / 3, abs=1e-6) and m["c"].precision == pytest.approx(1 / 3, abs=1e-6) and m["c"].mrr == 0.5 and m["c"].hit and m["c"].bridge == 0
    assert m["c"].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3) + 0.5), abs=1e-6)
    assert (m["n"].recall, m["n"].ndcg, m["n"].mrr) == (0, 0, 0)


def test_exclusive_percentile(spark):
    import statistics

    values = [float(v) for v in (3, 1, 4, 1, 5, 9, 2, 6)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)], "g string, v double")
    got = {r.g: round(r.percentile, 6) for r in selection.percentiles(df, ["g"], "v", {"percentile": 0.95}, exclusive=True).collect()}
    assert got["a"] == pytest.approx(statistics.quantiles(values, n=20)[18]) and got["b"] == 0


def test_individuation(spark):
    rows = [("g", "x", "Possible", 5.0, 1), ("g", "x", "In", None, 2), ("g", "x", "In", 7.0, 3), ("g", "y", "Possible", None, 4), ("g", "y", "Possible", 2.0, 5), ("g", "z", "Excluded", 99.0, 6)]
    df = spark.createDataFrame(rows, "grp string, label string, status string, value double, ord int")
    r = uncertain.count_and_sum(uncertain.individuals(df, ["grp"], "label", "status", "value", F.col("ord")), ["grp"]).first()
    assert (r.count_lower, r.count_upper, r.sum_lower, r.sum_upper) == (1, 2, 7.0, 9.0)


def test_votes(spark):
    rows = [("a", "in", 1), ("a", "out", 2), ("b", "in", 1), ("b", "contested", 2), ("c", "unsure", 1), ("c", "in", 2), ("d", "in", 5)]
    got = {r.u: r.tag for r in uncertain.vote_tag(spark.createDataFrame(rows, "u string, t string, o int"), ["u"], "t", "o").collect()}
    assert got == {"a": "contested", "b": "contested", "c": "unsure", "d": "in"}


def test_strength_orders_the_strong_before_the_weak(spark):
    rows = [("fresh", 0.0, 0, 0.0), ("used", 90.0, 40, 0.0), ("liked", 5.0, 1, 1.0), ("old", 120.0, 0, 0.0), ("disliked", 60.0, 1, -1.0)]
    df = spark.createDataFrame(rows, "id string, age double, n int, f double")
    s = {r.id: r.s for r in df.select("id", scoring.strength(F.col("age"), F.col("n").cast("double"), F.col("f"), 30, 0.5, 0.2).alias("s")).collect()}
    assert min(s["fresh"], s["used"], s["liked"]) > max(s["old"], s["disliked"]) - 1e-9 and s["fresh"] == 1


def test_feedback_is_clamped_at_every_step(spark):
    ev = spark.createDataFrame([("m", i, d) for i, d in enumerate([0.9, 0.9, -0.5, -2.0, 0.25])], "memory_id string, at int, x double")
    for size in (1, 2, 100):
        got = lifecycle.feedback_scores(ev, F.col("x"), ["at"], F.floor(F.col("at") / size)).first().feedback
        assert got == pytest.approx(-0.75)


def test_chain_stops_at_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 10)], "old long, new long")
    got = {r.start: (r.last, r.hops) for r in lifecycle.supersession_chain(links, 8).collect()}
    assert got[1] == (4, 3) and got[3] == (4, 1) and got[10][0] in (10, 11)


def test_long_chains_and_cycles_are_followed_to_their_end(spark):
    """A chain of some hundred links, a tail into a cycle of six, and a row that follows itself."""
    links = [(i, i + 1) for i in range(300)] + [(1000 + i, 1001 + i) for i in range(90)] + [(1090, 1085), (2000, 2000)]
    follow, want = dict(links), {}
    for start in follow:
        at, seen, hops = start, {start}, 0
        while at in follow:
            at, hops = follow[at], hops + 1
            if at in seen:
                break
            seen.add(at)
        want[start] = (at, hops)
    got = lifecycle.supersession_chain(spark.createDataFrame(links, "old long, new long")).collect()
    assert len(got) == len(links) and {r.start: (r.last, r.hops) for r in got} == want


def test_chain_query_on_a_hot_customer_gives_the_sql_rows(spark, tmp_path):
    import duckdb

    from tessera import catalog

    rows = spark.range(900).selectExpr("id as o_orderkey", "if(id % 3 = 0, 0, id % 50 + 1) as o_custkey", "timestamp_seconds(1700000000 + (id * 37 % 900) * 60) as o_orderdate")
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    duck = duckdb.connect()
    duck.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = catalog.QUERIES["g7_supersession_chain"](spark, str(tmp_path)).collect()
    want = duck.sql(catalog.SQL["g7_supersession_chain"]).fetchall()
    assert max(r.hops for r in got) == 299 and {(r.start, r.last, r.hops) for r in got} == set(want) and len(got) == len(want)


def test_failure_arcs_resolve_the_latest_first(spark):
    calls = [("s", 1, "t", False, "A"), ("s", 2, "t", False, "B"), ("s", 3, "t", True, ""), ("s", 4, "u", True, ""), ("s", 5, "t", True, ""), ("s", 6, "t", False, "A"), ("s", 7, "t", False, "A"), ("s", 40, "t", True, "")]
    df = spark.createDataFrame(calls, "session string, idx long, tool string, ok boolean, signature string")
    got = {(r.signature, r.failed_at, r.fixed_at, r.repeats) for r in transcripts.failure_arcs(df).collect()}
    assert got == {("B", 2, 3, 1), ("A", 1, 5, 3)}


def test_lines_and_grep(spark):
    df = spark.createDataFrame([(1, "ab\n\nxx 42 yy 43\n")], "id long, text string")
    lines = transcripts.line_starts(df, "id", F.col("text"))
    assert [(r.line_no, r.start) for r in lines.orderBy("line_no").collect()] == [(0, 0), (1, 3), (2, 4), (3, 16)]
    r = transcripts.grep(lines, "[0-9]+", 1).first()
    assert (r.line_no, r.start, r.match, r.from_line, r.to_line) == (2, 7, "42", 1, 3)


def test_text_functions(spark):
    df = spark.createDataFrame([(" \"The  Big   Report's\" ", "TypeError: x at /a/b/c.js:3:14 0xff 12345678901", " A\tB  ", "Meet Shirley Temple Black, and Ed.")], "a string, b string, c string, d string")
    r = df.select(text.entity_key(F.col("a")), text.normalized_error(F.col("b")), text.error_type(F.col("b")), text.error_signature(F.col("b")), text.normalized_query(F.col("c")), text.entity_spans(F.col("d")), text.stem_s(F.lit("likes"))).first()
    assert tuple(r) == ("big report", "TypeError: x at /PATH/c.js:LINE:COL 0xADDR NUM", "error", "error-TypeError", "a b", ["meet shirley", "ed"], "like")
    refs = spark.createDataFrame([("see (src/a/b.py:12), /etc/hosts. and x/ y",)], "t string").select(text.file_refs(F.col("t"))).first()[0]
    assert refs == ["/etc/hosts", "src/a/b.py:12"]


def test_plans_and_triage(spark):
    from tessera.operators import planning

    asked = {"how many cats": "count", "how many days between": "precise", "how many times, in total": "aggregation", "list all": "aggregation", "an overview": "broad", "what is x": "precise", "how often a week": "broad"}
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert {r.q: r["mode"] for r in df.select("q", *planning.plan_columns(F.col("q"))).collect()} == asked
    said = {"": "skip", " Thanks! ": "skip", "why not": "recall", "what is the time": "skip", "please translate this": "skip", "translate " + "x" * 400: "uncertain", "blue sky": "uncertain"}
    df = spark.createDataFrame([(q,) for q in said], "q string")
    assert {r.q: r.v for r in df.select("q", planning.triage(F.col("q")).alias("v")).collect()} == said


def test_told_dates(spark):
    told = ["on 2024-03-05 x", "March 5, 2024", "5 Mar 2024", "in March 2024", "seen yesterday", "2 weeks ago", "last month", "nothing", "2024-13-45"]
    df = spark.createDataFrame([(t,) for t in told], "t string")
    got = [str(r[0]) for r in df.select(dates.occurred_on(F.col("t"), F.lit("2024-04-10").cast("date"))).collect()]
    assert got == ["2024-03-05"] * 3 + ["2024-03-01", "2024-04-09", "2024-03-27", "2024-03-11", "None", "None"]


def test_triples_by_type(spark):
    from tessera.operators.triples import triples

    rows = [
        (1, "WORKING_SOLUTION", "Use jq to parse logs", None), (2, "GOTCHA", "watch out for tabs", None), (3, "GOTCHA", "cache breaks builds", None), (4, "DECISION", "we chose A over B", None),
        (5, "FAILURE", "npm fails", None), (6, "PREFERENCE", "prefers dark mode", None), (7, "TOOL_RULE", "", '{"tool": "sed", "pattern": "-i", "error_source": "bsd", "correction": "gsed"}'), (8, "NOTE", "use x to y", None), (9, "TOOL_RULE", "", "not json"),
    ]
    got = {(r.id, r.subject, r.predicate, r.object) for r in triples(spark.createDataFrame(rows, "id int, type string, content string, context string"), "id", "type", "content", "context").collect()}
    assert got == {
        (1, "jq", "solves", "parse logs"), (2, "tabs", "has_pitfall", "warning"), (3, "cache", "has_pitfall", "builds"), (4, "project", "chose", "A (B)"), (5, "npm", "fails_for", "unknown reason"),
        (6, "user", "prefers", "dark mode"), (7, "sed -i", "fails_for", "bsd"), (7, "sed -i", "has_fix", "gsed"),
    }


def test_retold_values_count_once(spark):
    rows = [(1, 1, 5.0, "usd", ["red", "car"]), (1, 2, 5.0, "usd", ["car", "old"]), (1, 3, 5.0, "usd", ["boat"]), (1, 4, 5.0, "day", ["car"]), (1, 5, 5.0, "usd", ["old"]), (2, 1, 3.0, "usd", []), (2, 2, 3.0, "usd", [])]
    df = spark.createDataFrame(rows, "g long, o int, n double, a string, w array<string>").repartition(3)
    got = {r.grp: (r.total, r.kept, r.seen) for r in uncertain.distinct_value_sums(df, "g", "o", "n", "a", "w").collect()}
    assert got == {1: (20.0, 4, 5), 2: (6.0, 2, 2)}


def test_triage_and_intents_read_patterns_as_their_sql_does(spark, tmp_path):
    """Accented letters bound words, vertical tabs are no space, edges lose all kinds of spaces, and the end is the very end."""
    import duckdb

    from tessera import catalog

    said = ["échange", "défix", "fix́", "teſt", "ſummarize this", "summariſe", " ok ", "ok\x0b", "ok ", "ok\u0085", " ", "What's\x0bthe time", "　thanks!　", "oK", "\x0b", "Ok\n", None, "préformat", "éhow many", "in totaſ", "over the laſt year", "which été\u0085s did i", "which cats\r did i", "which cats\n did i", "nowé"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(said)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as from '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("fp12_recall_triage", "r21_query_intent"):
        assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.execute(catalog.SQL[name]).fetchall())


def test_shared_counts_takes_more_tasks_for_more_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS", 30)
    held = {g: [(7 * g + 3 * i) % 20 for i in range(1 + g % 12)] for g in range(40)}
    rows = sorted({(g, x) for g, xs in held.items() for x in xs})
    want, sets = {}, {g: sorted(set(xs)) for g, xs in held.items()}
    for xs in sets.values():
        for i, a in enumerate(xs):
            for b in xs[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    out = graph.shared_counts(spark.createDataFrame(rows, "g long, x long"), "g", "x", 3)
    assert {(r.a, r.b): r.n for r in out.collect()} == {k: n for k, n in want.items() if n >= 3}
    assert out.rdd.getNumPartitions() == sum(len(x) * (len(x) - 1) // 2 for x in sets.values()) // 30 + 1
    assert graph.shared_counts(spark.createDataFrame([], "g long, x long"), "g", "x").count() == 0


def test_focus_terms_of_own_and_shared_ids(spark, tmp_path):
    """As the SQL says, for ids of one text, of several and null ones; words of an id's only text are cut before anything is shuffled."""
    import duckdb

    from tessera import catalog

    docs = [(1, "Delta delta alpha_1 Beta-2 " + " ".join(f"word{i:02d}x" for i in range(20))), (2, "Gamma longerword the zzz"), (2, "x1 x1y  gamma GAMMA other_name more"), (3, None), (None, "Null ident"), (None, "aaa bbb longer_one"), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.QUERIES["r9_focus_terms"](spark, str(tmp_path))
    rows = {(r.id, r.term, r.salience) for r in got.collect() if r.id == 1}
    assert rows == {r[:3] for r in con.execute(catalog.SQL["r9_focus_terms"]).fetchall() if r[0] == 1} and len(rows) == 12
    several = lambda found: sorted((str(r[0]), r[1].lower()) for r in found if r[0] != 1)  # noqa: E731  places of several texts tie
    assert several(got.collect()) == several(con.execute(catalog.SQL["r9_focus_terms"]).fetchall())
    assert "slice(" in got._jdf.queryExecution().optimizedPlan().toString()
