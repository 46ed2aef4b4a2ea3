import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import transcripts
from tessera.sources.transcripts import append_results, read_jsonl, read_markdown, read_results_log, replace_transcripts
from tessera.sources.versions import Versioned
from tessera.streaming import pipelines as P

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), u, t, v, "{}") for i, m, u, t, v in rows], P.EVENTS)


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_tumbling_equals_batch(spark, tmp_path):
    rows = [(i, i * 17 % 600, i % 3, "view" if i % 2 else "error", float(i)) for i in range(60)]
    events(spark, rows).write.parquet(str(tmp_path / "e"))
    got = drained(P.tumbling(P.read_events(spark, str(tmp_path / "e"))), "tumbling", "complete")
    batch = spark.read.parquet(str(tmp_path / "e")).groupBy(F.window("ts", "1 hour").start.alias("window_start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_repeats_within_the_watermark_go(spark, tmp_path):
    events(spark, [(1, 0, 1, "view", 1.0), (1, 5, 1, "view", 1.0), (2, 6, 1, "view", 1.0)]).write.parquet(str(tmp_path / "e"))
    assert drained(P.deduplicated(P.read_events(spark, str(tmp_path / "e"))), "dedup").count() == 2


def test_sessions(spark, tmp_path):
    events(spark, [(1, 0, 1, "view", 1.0), (2, 100, 1, "view", 1.0), (3, 2000, 1, "view", 1.0)]).write.parquet(str(tmp_path / "e"))
    got = drained(P.sessions(P.read_events(spark, str(tmp_path / "e"))), "sess", "complete")
    assert sorted(r.n for r in got.collect()) == [1, 2]


def test_projection_is_idempotent_and_rebuilds(spark, tmp_path):
    events(spark, [(i, i, 1, "view", 1.0) for i in range(10)]).write.parquet(str(tmp_path / "e"))

    def apply(batch, number):
        batch.groupBy("user_id").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(str(tmp_path / f"out/batch={number}"))

    for checkpoint in ("c1", "c1", "c2"):
        P.project(P.read_events(spark, str(tmp_path / "e")), apply, str(tmp_path / checkpoint)).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 10


def test_transcripts_are_read_tolerantly(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.jsonl").write_text('{"type":"user","message":{"role":"user","content":"hello"}}\nnot json\n{"type":"tool"}\n{"role":"assistant","content":"hi"}\n{"role":"user","content":"  "}\n')
    got = read_jsonl(spark, str(tmp_path / "j")).orderBy("message_index").collect()
    assert [(r.message_index, r.role, r.text) for r in got] == [(0, "user", "hello"), (1, "assistant", "hi")]
    assert read_jsonl(spark, str(tmp_path / "j"), max_bytes=10).count() == 0
    (tmp_path / "m.md").write_text("intro\n## User\nhello\nthere\n## Assistant\nhi\n## Notes\nx\n")
    assert [(r.role, r.text) for r in read_markdown(spark, str(tmp_path / "m.md")).orderBy("message_index").collect()] == [("user", "hello\nthere"), ("assistant", "hi")]


def test_sinks_replace_and_append(spark, tmp_path):
    one = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "transcript_path string, message_index int, text string")
    replace_transcripts(one, str(tmp_path / "t"))
    replace_transcripts(spark.createDataFrame([("a", 0, "new")], one.schema), str(tmp_path / "t"))
    assert {(r.transcript_path, r.text) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", "new"), ("b", "z")}
    append_results(spark.createDataFrame([(1, 0.5)], "run int, score double"), str(tmp_path / "log"))
    (tmp_path / "log" / "part-x.json").write_text('{"run": 2, "score": 0.7}\n{broken\n')
    assert read_results_log(spark, str(tmp_path / "log"), "run int, score double").count() == 2


@pytest.fixture
def rocks(spark):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


CALLS = "session string, ts timestamp, event_id long, tool string, ok boolean, signature string"


def in_batches(spark, folder, batches, schema):
    """Files that come one a micro-batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        newest = max(folder.glob("part-*"), key=lambda f: f.stat().st_mtime_ns)
        newest.rename(folder / f"part-{k:05d}.parquet")
        os.utime(folder / f"part-{k:05d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "part-*.parquet").parquet(str(folder))


@pytest.mark.parametrize("final", [True, False])
def test_streamed_arcs_equal_batch(spark, tmp_path, rocks, final):
    """Rows shuffled within the allowed lateness and split over micro-batches give what the batch fold gives."""
    rng = random.Random(3)
    rows = [(s, T0 + dt.timedelta(minutes=i), i, f"t{rng.randrange(2)}", rng.random() < 0.5, f"e{rng.randrange(3)}") for s in ("a", "b") for i in range(60)] + [("a", T0 + dt.timedelta(minutes=60), 60, "t9", False, "e9")]
    late = sorted(rows, key=lambda r: (r[1] + dt.timedelta(minutes=rng.randint(0, 50)), r[0]))
    assert late != sorted(rows, key=lambda r: (r[1], r[0]))
    batches = [late[k : k + 17] for k in range(0, len(late), 17)]
    # what comes last moves the watermark behind all others; the second of them lets the sessions leave
    batches += [[("end", T0 + dt.timedelta(days=3), 0, "t", True, "e")], [("end", T0 + dt.timedelta(days=9), 1, "t", True, "e")]]
    source = in_batches(spark, tmp_path / "c", batches, CALLS)
    got = drained(P.failure_arcs(source, final=final, idle_ms=3_600_000), f"arcs_{final}")
    got = [tuple(r) for r in got.collect()]
    batch = transcripts.failure_arcs(spark.createDataFrame(rows, CALLS).withColumn("idx", F.col("event_id") + 1))
    want = [tuple(r) for r in batch.collect()]
    if final:
        assert sorted(got, key=str) == sorted(want, key=str) and any(r[4] is None for r in want)
    else:  # told when resolved, with the repeats so far
        assert sorted(r[:5] for r in got) == sorted(r[:5] for r in want if r[4] is not None) and got


def test_too_late_rows_are_left_out_and_idle_sessions_begin_anew(spark, tmp_path, rocks):
    at = lambda h: T0 + dt.timedelta(hours=h)
    fail, fix = (lambda s, h, i: (s, at(h), i, "t", False, "e")), (lambda s, h, i: (s, at(h), i, "t", True, "e"))
    batches = [[fail("a", 0, 1), fail("b", 0, 1)], [fix("b", 5, 2)], [fail("x", 30, 0)], [fail("x", 31, 1)], [fix("a", 1, 2), fix("b", 40, 3), fix("a", 40, 3)], [fail("x", 90, 2)], [fail("x", 120, 3)]]
    got = drained(P.failure_arcs(in_batches(spark, tmp_path / "c", batches, CALLS), final=True, idle_ms=10 * 3_600_000), "idle")
    told = sorted((r.session, r.failed_at, r.fixed_at) for r in got.collect() if r.session != "x")
    assert told == [("a", 1, None), ("b", 1, 2)]  # a's fix came after the watermark, and at hour 40 its failure was gone


def test_streamed_signals_equal_a_loop(spark, tmp_path, rocks):
    rng = random.Random(5)
    schema = "session string, ts timestamp, event_id long, memory long, terms array<string>, injected boolean"
    rows = [(s, T0 + dt.timedelta(minutes=i), i, i % 3, rng.sample("abcdef", rng.randint(0, 4)), rng.random() < 0.7) for s in ("p", "q") for i in range(40) if rng.random() < 0.9]
    want = {}
    for s, _, i, m, terms, injected in rows:
        if injected:
            n = want.setdefault((s, m), [0, 0])
            n[0] += 1
            then = next((r for r in rows if r[0] == s and r[2] == i + 1), None)
            n[1] += bool(then and terms and len({*terms} & {*then[4]}) >= min(2, len(terms)))
    late = rows[:]
    rng.shuffle(late)
    batches = [late[:30], late[30:], [("end", T0 + dt.timedelta(days=5), 0, 0, [], False)], [("end", T0 + dt.timedelta(days=9), 1, 0, [], False)]]
    got = drained(P.usage_signals(in_batches(spark, tmp_path / "c", batches, schema), late="2 hours", idle_ms=3_600_000), "signals")
    assert {(r.session, r.memory): [r.injects, r.uses] for r in got.collect()} == want
    assert {r.signal for r in got.collect()} <= {"good", "bad", "none"}


def test_late_rows_change_exactly_their_groups(spark, tmp_path):
    schema = "session string, turn long, failed boolean"
    events, store = tmp_path / "events", Versioned(str(tmp_path / "out"), ("session",), "session string, watermark long, n long", buckets=8)

    def fold(rows):
        stop = rows.where("failed").groupBy("session").agg(F.min("turn").alias("stop"))
        return rows.join(stop, "session", "left").groupBy("session").agg(F.max(F.when(F.col("stop").isNull() | (F.col("turn") < F.col("stop")), F.col("turn"))).alias("watermark"), F.count("*").alias("n"))

    def now():
        source = spark.readStream.schema(schema).parquet(str(events))
        P.project(source, P.touched(["session"], lambda s: s.read.schema(schema).parquet(str(events)), fold, store), str(tmp_path / "c")).awaitTermination(120)
        return {r.session: (r.watermark, r.n) for r in store.read(spark).collect()}

    first = [(s, t, False) for s in "abcdefgh" for t in range(5)]
    spark.createDataFrame(first, schema).write.parquet(str(events))
    assert now() == {s: (4, 5) for s in "abcdefgh"}
    before = store.version(spark)["folders"]
    # a turn that failed, before what was already folded, and one that comes twice
    spark.createDataFrame([("c", 2, True)], schema).write.mode("append").parquet(str(events))
    assert now() == {s: (4, 5) for s in "abdefgh"} | {"c": (1, 6)}
    after = store.version(spark)["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert now()["c"] == (1, 6) and store.version(spark)["folders"] == after
