import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.sources import lines as L


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: b.replace(b"\n", b"")), max_size=12), st.binary(max_size=4).map(lambda b: b.replace(b"\n", b"")), st.integers(1, 9))
def test_parts_give_whole_lines_once(tmp_path_factory, told, rest, step):
    f = tmp_path_factory.mktemp("f") / "x"
    f.write_bytes(b"".join(t + b"\n" for t in told) + rest)
    stop = L.last_end(str(f), f.stat().st_size)
    assert stop == sum(len(t) + 1 for t in told)
    r = L.GrowingReader({"path": str(f.parent), "bytes_per_task": str(step)})
    got = [row for p in r.partitions({}, r.latestOffset()) for row in r.read(p)]
    want, at = [], 0
    for t in told:
        want.append((str(f), at, t.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(t) + 1
    assert got == want


def test_growing_shrinking_and_replaced_files(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "c"
    folder.mkdir()
    seen = set()

    def run():
        """What one run adds."""
        q = L.growing_lines(spark, str(folder), "*.jsonl", 8).writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).option("path", str(out)).trigger(once=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        now = [(r.path.split("/")[-1], r.start, r.value) for r in spark.read.parquet(str(out)).collect()]
        new = sorted(now)
        for s in sorted(seen_rows):
            new.remove(s)
        seen_rows.extend(new)
        return new

    seen_rows = []
    a, b = folder / "a.jsonl", folder / "b.jsonl"
    a.write_bytes("one\ntwö\r\nthr".encode())
    (folder / "skipped.txt").write_text("no\n")
    assert run() == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "twö")]
    with a.open("ab") as f:
        f.write(b"ee\nfour")
    b.write_bytes(b"first\n\n")
    assert run() == [("a.jsonl", 10, "three"), ("b.jsonl", 0, "first"), ("b.jsonl", 6, "")]
    a.write_bytes(b"new\n")  # shorter
    b.write_bytes(b"Other, and longer than before\n")  # another beginning
    assert run() == [("a.jsonl", 0, "new"), ("b.jsonl", 0, "Other, and longer than before")]
    b.unlink()
    with a.open("ab") as f:
        f.write(b"last\n")
    assert run() == [("a.jsonl", 4, "last")]


def test_a_batch_that_is_replayed_reads_the_same_bytes(tmp_path):
    f = tmp_path / "x"
    f.write_text("a\nb\n")
    r = L.GrowingReader({"path": str(tmp_path)})
    one = r.latestOffset()
    f.write_text("a\nb\nc\n")
    two = r.latestOffset()
    again = L.GrowingReader({"path": f"file://{tmp_path}"})
    assert [v for p in again.partitions({}, one) for _, _, v in again.read(p)] == ["a", "b"]
    assert [v for p in again.partitions(one, two) for _, _, v in again.read(p)] == ["c"]
    assert list(again.read(again.partitions(two, two)[0])) == []
