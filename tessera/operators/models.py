"""Models on the workers: embedders, scorers, judges and extractors as callables over batches.

A model is given as a factory without arguments. A worker process calls it once and keeps what
it returns; that is called with a list for each input column and returns a list of values.
Batches are bounded by rows and by bytes of text. If a batch fails, its rows are asked one by
one, so that an error stands with the row that made it and the others have their values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS, BYTES = 256, 1 << 20
_loaded: dict[str, Callable] = {}


def loaded(key: str, factory: Callable[[], Callable]) -> Callable:
    """The worker process's model; one at a time for a key, the oldest gives way beyond four."""
    if key not in _loaded:
        while len(_loaded) >= 4:
            _loaded.pop(next(iter(_loaded)))
        _loaded[key] = factory()
    return _loaded[key]


def asked(model: Callable, columns: list[list]) -> list[tuple]:
    """(value, error) for each row."""
    n = len(columns[0])
    try:
        got = list(model(*columns))
        if len(got) != n:
            raise ValueError(f"{len(got)} values for {n} rows")
        return [(v, None) for v in got]
    except Exception as e:  # told with the row
        if n == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        return [asked(model, [[c[i]] for c in columns])[0] for i in range(n)]


def bounded(batch: pa.RecordBatch, inputs: list[int], rows: int, size: int) -> Iterator[tuple[int, list[list]]]:
    """(rows, input columns) of parts of a batch."""
    cols, at, held = [batch.column(i).to_pylist() for i in inputs], 0, 0
    for i in range(batch.num_rows):
        own = sum(len(c[i]) for c in cols if isinstance(c[i], (str, bytes, list)))
        if i > at and (i - at >= rows or held + own > size):
            yield i - at, [c[at:i] for c in cols]
            at, held = i, 0
        held += own
    if batch.num_rows > at:
        yield batch.num_rows - at, [c[at:] for c in cols]


def applied(df: DataFrame, inputs: list[str], factory: Callable[[], Callable], name: str, kind: str, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """``df`` with the model's value, of SQL type ``kind``, as ``name``, and what went wrong as ``{name}_error``."""
    from pyspark.sql.pandas.types import to_arrow_type

    key = uuid.uuid4().hex
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name}` {kind}, `{name}_error` string"
    arrow = to_arrow_type(df.sparkSession.createDataFrame([], f"x {kind}").schema["x"].dataType)
    at, names = [df.columns.index(c) for c in inputs], [*df.columns, name, f"{name}_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(key, factory)
        for b in batches:
            done = 0
            for n, columns in bounded(b, at, rows, size):
                got = asked(model, columns)
                values = [pa.array([v for v, _ in got], arrow), pa.array([e for _, e in got], pa.string())]
                yield pa.RecordBatch.from_arrays([*b.slice(done, n).columns, *values], names=names)
                done += n

    return df.mapInArrow(run, schema)
