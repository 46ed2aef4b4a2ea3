"""A streaming source of growing line files: ``spark.readStream.format("growing_lines").load(folder)``.

Rows are (path, start, value): whole lines, with the byte where each begins in its file. The
offset of a batch tells for each file how many bytes are read, up to the last line's end, and
a fingerprint of the file's beginning; it stands in the checkpoint, so a replayed batch reads
the same bytes, and a stopped query goes on where it was. Rows come at least once.

A file that has become shorter than what was read of it, or whose beginning is another, is read
again from its start. A line without its end waits. Bytes that are no UTF-8 are replaced. Files
are listed by ``glob`` in the folder, which the driver and the workers must both reach; a
partition reads at most ``bytes_per_task`` of one file, but always whole lines, so one task holds
one line and a buffer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

HEAD, BUFFER = 256, 1 << 20


@dataclass
class Part(InputPartition):
    path: str
    start: int
    stop: int


def fingerprint(path: str, size: int) -> int:
    """Of the file's first bytes, as many as it is asked for and HEAD at most."""
    with open(path, "rb") as f:
        return zlib.crc32(f.read(min(size, HEAD)))


def last_end(path: str, size: int) -> int:
    """Where the last whole line of the first ``size`` bytes ends."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            begin = max(0, at - BUFFER)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return 0


def lines(path: str, start: int, stop: int) -> Iterator[tuple[str, int, str]]:
    """The lines that begin from ``start`` on and before ``stop``; ``start`` may stand inside a line, which is passed over."""
    with open(path, "rb") as f:
        at = start
        f.seek(max(0, start - 1))
        if start and f.read(1) != b"\n":
            at += len(f.readline())
        while at < stop:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            yield path, at, line[:-1].removesuffix(b"\r").decode("utf-8", "replace")
            at += len(line)


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path string, start bigint, value string"

    def streamReader(self, schema: StructType) -> GrowingReader:
        return GrowingReader(self.options)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")
        self.pattern = options.get("glob", "*")
        self.step = int(options.get("bytes_per_task", 64 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pathlib import Path

        out = {}
        for f in sorted(Path(self.folder).glob(self.pattern)):
            if f.is_file():
                size = last_end(str(f), f.stat().st_size)
                out[str(f)] = [size, fingerprint(str(f), size)]
        return out

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for path, (stop, _) in end.items():
            done, mark = start.get(path, (0, 0))
            try:
                same = done <= stop and (done == 0 or fingerprint(path, done) == mark)
            except FileNotFoundError:  # it went since: there is nothing to read
                continue
            at = done if same else 0
            while at < stop:
                out.append(Part(path, at, min(stop, at + self.step)))
                at += self.step
        return out or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple[str, int, str]]:
        if partition.path:
            yield from lines(partition.path, partition.start, partition.stop)


def growing_lines(spark, folder: str, glob: str = "*", bytes_per_task: int = 64 << 20):
    """The source as a streaming DataFrame."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("glob", glob).option("bytes_per_task", bytes_per_task).load(folder)
