import datetime as dt
import random
from pathlib import Path

import pytest

from tessera.sources.versions import AUDIT, BELIEFS, Versioned, believe

T0 = dt.datetime(2024, 1, 1)
CHANGES = "seq long, op string, id long, subject string, predicate string, object string, at timestamp"


def loop(beliefs, changes, name):
    """Change by change over a dict."""
    log = []
    for seq, op, i, s, p, o, at in sorted(changes):
        for b in beliefs.values():
            hit = b[0] == s and (b[1] == p if op == "supersede" else op == "invalidate" and b[5] == i)
            if hit and b[4] is None:
                b[4] = at
                log.append((name, seq, "close", b[5], at))
        if op != "invalidate":
            beliefs[i] = [s, p, o, at, None, i]
            log.append((name, seq, "insert", i, at))
    return log


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path.removeprefix("file://")).glob("data/*/bucket_=*/part-*")}


def test_beliefs_against_a_loop(spark, tmp_path):
    rng, beliefs, log = random.Random(2), {}, []
    table = Versioned(str(tmp_path / "kg"), ("subject",), BELIEFS, buckets=8)
    n = 0
    for batch in range(3):
        changes = []
        for seq in range(25):
            op = rng.choice(["add", "supersede", "invalidate"])
            i = rng.randint(1, n) if op == "invalidate" and n else (n := n + 1)
            op = "add" if op == "invalidate" and i == n and i not in beliefs and not any(c[2] == i for c in changes) else op
            s = next((b[0] for b in beliefs.values() if b[5] == i), None) or next((c[3] for c in changes if c[2] == i), None) if op == "invalidate" else rng.choice(["a", "b", None, "hot", "hot"])
            if op == "invalidate" and s is None:
                continue
            changes.append((seq, op, i, s, rng.choice("pq"), f"o{seq}", T0 + dt.timedelta(days=batch * 100 + seq)))
        log += loop(beliefs, [c for c in changes if c[3] is not None or c[1] != "supersede" or True], f"b{batch}")
        assert believe(spark, table, spark.createDataFrame(changes, CHANGES), f"b{batch}")
        got = {tuple(r) for r in table.read(spark).collect()}
        assert got == {(i, s, p, o, a, z) for s, p, o, a, z, i in beliefs.values()}
        # again: nothing changes
        before = files(table.path)
        assert not believe(spark, table, spark.createDataFrame(changes, CHANGES), f"b{batch}")
        assert files(table.path) == before
    assert {tuple(r) for r in table.log(spark, AUDIT).collect()} == set(log)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_untouched_files_stay_and_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch, scheme):
    table = Versioned(scheme + str(tmp_path / "t"), ("k",), "k long, v string", buckets=16)
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(200)], "k long, v string")
    table.replace(spark, rows, rows.select("k"), "first")
    before, keys = files(table.path), spark.createDataFrame([(7,)], "k long")
    assert table.replace(spark, spark.createDataFrame([(7, "new")], "k long, v string"), keys, "second")
    live = {f for f in files(table.path) if any(f"/{d}/" in f for d in table.version(spark)["folders"].values())}
    gone = set(before) - live
    assert gone and len({Path(f).parent for f in gone}) == 1  # one bucket was written anew
    assert all(files(table.path)[f] == t for f, t in before.items())
    assert {r.k: r.v for r in table.read(spark).collect()} == {i: f"v{i}" for i in range(200)} | {7: "new"}

    def crash(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Versioned, "_commit", crash)
        with pytest.raises(OSError):
            table.replace(spark, spark.createDataFrame([], "k long, v string"), keys, "third")
    assert table.read(spark).where("k = 7").first().v == "new" and table.version(spark)["number"] == 2
    assert table.replace(spark, spark.createDataFrame([], "k long, v string"), keys, "third")
    assert table.read(spark).where("k = 7").count() == 0 and table.read(spark).count() == 199
    assert table.vacuum(spark) >= 2 and table.read(spark).count() == 199
    assert table.vacuum(spark) == 0


def test_no_table_yet(spark, tmp_path):
    table = Versioned(str(tmp_path / "none"), ("k",), "k long")
    assert table.read(spark).count() == 0 and table.log(spark, AUDIT).count() == 0
