"""Readers of benchmark files on small ones, compaction, and the redirection of commands."""

import json

from pyspark.sql import functions as F

from tessera.operators import redirect as D
from tessera.operators import vector
from tessera.sources import benchmarks as B
from tessera.sources import tables


def write(path, rows, lines=False):
    path.write_text("\n".join(map(json.dumps, rows)) if lines else json.dumps(rows))
    return str(path)


def rows_of(df, *cols):
    return {tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*cols).collect()}


CASE = ("dataset", "id", "query", "relevant_ids", "intent", "answer")


def test_locomo(spark, tmp_path):
    talk = {"speaker_a": "Ann", "session_1": [{"dia_id": "D1:1", "speaker": "Ann", "text": " hi "}, {"dia_id": "D1:2", "speaker": "Bo", "text": ""}], "session_1_date_time": "1 May 2023", "session_2": [{"dia_id": "D2:1", "speaker": "", "text": "bye"}]}
    qa = [{"question": "q0", "answer": 5, "evidence": ["D1:1", "D9:9"], "category": 1}, {"question": "q1", "evidence": ["D9:9"], "category": 2}, {"question": "q2", "answer": "n", "evidence": ["D2:1", "D1:1"], "category": 5}, {"question": "q3", "answer": "x", "evidence": ["D2:1"], "category": 9}]
    path = write(tmp_path / "l.json", [{"sample_id": "s", "conversation": talk, "qa": qa}])
    corpus, cases = B.locomo(spark, path)
    assert rows_of(corpus, "dataset", "id", "content", "session") == {("s", "D1:1", "[1 May 2023] Ann: hi", "session_1"), ("s", "D2:1", "bye", "session_2")}
    want = {("s", "s_q0", "q0", ("D1:1",), "multi-hop", "5"), ("s", "s_q2", "q2", ("D2:1", "D1:1"), "adversarial", "n"), ("s", "s_q3", "q3", ("D2:1",), "9", "x")}
    assert rows_of(cases, *CASE) == want
    assert rows_of(B.locomo(spark, path, include_adversarial=False)[1], *CASE) == {w for w in want if w[4] != "adversarial"}


def test_longmemeval(spark, tmp_path):
    q = {"question": "?", "question_type": "t", "answer": "a", "haystack_session_ids": ["a", "b"], "haystack_dates": ["d1"], "haystack_sessions": [[{"role": "user", "content": "x", "has_answer": True}, {"role": "assistant", "content": " "}], [{"role": "user", "content": "y"}, {"role": "", "content": "z", "has_answer": True}]]}
    path = write(tmp_path / "m.json", [{**q, "question_id": "q1"}, {**q, "question_id": "q2_abs"}, {**q, "question_id": "q3", "haystack_sessions": [[{"role": "user", "content": "w"}], []]}])
    corpus, cases = B.longmemeval(spark, path)
    assert rows_of(corpus.where("dataset = 'q1'"), "id", "content", "session") == {("a#0", "[d1] user: x", "a"), ("b#0", "user: y", "b"), ("b#1", "z", "b")}
    assert rows_of(cases, *CASE) == {("q1", "q1", "?", ("a#0", "b#1"), "t", "a")}
    assert {r.id for r in B.longmemeval(spark, path, include_abstention=True)[1].collect()} == {"q1", "q2_abs"}


def test_hotpotqa(spark, tmp_path):
    one = {"_id": "1", "question": "?", "type": "bridge", "answer": "a", "context": [["T", ["s1 ", "", " s2"]], ["T", ["other"]], ["U", []]], "supporting_facts": [["U", 0], ["T", 1], ["T", 0], ["X", 0]]}
    two = {"_id": "2", "question": "!", "type": "comparison", "answer": "b", "context": [["U", ["later"]], ["V", ["v"]]], "supporting_facts": [["V", 0]]}
    path = write(tmp_path / "h.json", [one, two, {"_id": "3", "question": "", "context": [["W", ["w"]]], "supporting_facts": [["Z", 0]]}])
    corpus, cases = B.hotpotqa(spark, path)
    assert rows_of(corpus, "dataset", "id", "content") == {("1", "T", "T. s1 s2"), ("1", "U", "U"), ("2", "U", "U. later"), ("2", "V", "V. v"), ("3", "W", "W. w")}
    assert rows_of(cases, *CASE) == {("1", "1", "?", ("U", "T"), "bridge", "a"), ("2", "2", "!", ("V",), "comparison", "b")}
    corpus, cases = B.hotpotqa(spark, path, pooled=True)
    assert rows_of(corpus, "id", "content") == {("T", "T. s1 s2"), ("U", "U"), ("V", "V. v")} and {r.dataset for r in cases.collect()} == {"hotpotqa-pooled"}


def test_halumem(spark, tmp_path):
    s0 = {"memory_points": [{"memory_content": "m0"}, {"memory_content": "m1"}], "questions": [{"question": "q", "answer": "a", "evidence": [{"memory_content": "m1"}], "question_type": "Basic"}, {"question": "r", "answer": "no", "evidence": [], "question_type": "Basic"}]}
    path = write(tmp_path / "u.jsonl", [{"uuid": "u", "sessions": [s0, {"memory_points": [{"memory_content": "m1"}], "questions": []}]}], lines=True)
    corpus, cases = B.halumem(spark, path)
    assert rows_of(corpus, "id", "content") == {("s0_0", "m0"), ("s0_1", "m1"), ("s1_0", "m1")}
    assert rows_of(cases, *CASE) == {("u", "u_0_0", "q", ("s0_1", "s1_0"), "Basic", "a"), ("u", "u_0_1", "r", (), B.BOUNDARY, "no")}


def test_subtlememory(spark, tmp_path):
    h = write(tmp_path / "h.json", [{"session_id": "a", "timestamp": "t", "history": [{"role": "user", "content": "x"}, {"role": "user", "content": ""}, {"role": "bot", "content": "y"}]}, {"session_id": "b", "timestamp": "", "history": [{"role": "", "content": "z"}]}])
    b = write(tmp_path / "b.json", [{"instance_id": "i", "session_ids": ["b", "a", "none"], "relation_type": "r", "qas": [{"query": "q", "gold": "g"}, {"query": " ", "gold": ""}]}, {"instance_id": "j", "session_ids": ["none"], "relation_type": "r", "qas": [{"query": "q", "gold": "g"}]}])
    corpus, cases = B.subtlememory(spark, h, b, "p")
    assert rows_of(corpus, "id", "content", "session") == {("a_0", "[t] user: x", "a"), ("a_2", "[t] bot: y", "a"), ("b_0", "z", "b")}
    assert rows_of(cases, *CASE) == {("p", "p_i_0", "q", ("b_0", "a_0", "a_2"), "r", "g")}


def test_compaction_keeps_the_rows(spark, tmp_path):
    spark.range(1000).repartition(20).write.parquet(f"{tmp_path}/small")
    assert tables.compacted(spark, f"{tmp_path}/small", f"{tmp_path}/large") == 1
    got = spark.read.parquet(f"{tmp_path}/large")
    assert got.count() == 1000 and len(got.inputFiles()) == 1


def test_reembedding_guards_the_dimension(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.embedding, r.former) for r in vector.reembedded(df, vector.unit(F.col("embedding")), 2).collect()}
    assert got == {1: ([0.6, 0.8], [3.0, 4.0]), 2: ([0.0, 0.0], [0.0, 0.0]), 3: ([1.0], [1.0])}


def test_programs_of_commands():
    want = {
        "grep -r x src": ["grep"], "cat a | grep x && ls": ["cat", "grep", "ls"], 'echo "grep | sed"': ["echo"], "A=1 B='x y' pip list": ["pip"], "sudo -n": ["-n"],
        'bash -c "npm test; ls"': ["npm", "ls"], "bash run.sh": ["bash"], "/usr/bin/npm ci": ["npm"], "sh -lc 'cd x; bash -c \"npm i\"'": ["cd", "npm"],
        "uv run --with x --python 3 -- pytest -q": ["pytest"], "uv run": ["uv"], "uv pip list": ["uv"], "env A=1 time grep z": ["grep"], "pip install 'a": ["pip"], "": [], "(ls; pwd)\nid": ["ls", "pwd", "id"],
    }
    assert {c: D.programs(c) for c in want} == want


def test_decisions(spark):
    patterns = [D.Pattern("("), D.Pattern(r"(\w+) --force", "$1 --safe"), D.Pattern("^rm ", "", None), D.Pattern("^mv ", "cp ", "deny")]
    asks = {"git push --force": ("rewrite", "2", "git push --safe"), "rm x": ("deny", "3", None), "mv a b": ("deny", "4", None), "grep x": ("rewrite", "grep", "rg x"), "grep x; ls": ("deny", "grep", None), "grep 'a b'": ("rewrite", "grep", "rg 'a b'"), "grep $(ls)": ("deny", "grep", None), "ls": (None, None, None)}
    df = spark.createDataFrame([(c,) for c in asks] + [(None,)], "c string").select("c", D.decisions(F.col("c"), patterns, {"grep": "rg"}).alias("d"))
    got = {r.c: (tuple(r.d) if r.d else (None, None, None)) for r in df.collect()}
    assert got == {**asks, None: (None, None, None)}
    df = spark.createDataFrame([("grep x",)], "c string").select(D.decisions(F.col("c"), [], {"grep": "rg"}, "deny").alias("d"))
    assert tuple(df.first().d) == ("deny", "grep", None)
