"""Calls of an outside service from tasks: in batches, tried again, and with failures as rows.

A service is any callable over a list of values. It may fail, and it may answer out of order, so each answer names the
place of its value. A batch that keeps failing is halved until the values that fail stand alone; they become rows with
an error, and the task goes on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

#: (place in the list, fields) of each value.
Answers = Iterable[tuple[int, tuple]]


def back_off(attempt: int) -> float:
    """Seconds to wait after a failed attempt: two more each time, six at most."""
    return min(2.0 * attempt, 6.0)


def attempt(call: Callable[[list], Answers], values: list, attempts: int, wait: Callable[[int], float]) -> list[tuple[tuple | None, str | None]]:
    """(fields, None) or (None, kind of error) for each value, in their order."""
    error = ""
    for n in range(1, attempts + 1):
        try:
            own = dict(call(values))
            if sorted(own) != list(range(len(values))):
                raise ValueError(f"{len(values)} values, answers for {len(own)}")
            return [(own[i], None) for i in range(len(values))]
        except Exception as e:  # whatever the service raises; only its kind is kept, as messages may hold secrets
            error = type(e).__name__
            if n < attempts:
                time.sleep(wait(n))
    if len(values) == 1:
        return [(None, error)]
    half = len(values) // 2
    return attempt(call, values[:half], attempts, wait) + attempt(call, values[half:], attempts, wait)


def called(df: DataFrame, column: str, call: Callable[[list], Answers], fields: str, batch: int = 64, attempts: int = 3, wait: Callable[[int], float] = back_off) -> DataFrame:
    """df with the fields that call gives for each value of column, and `error`, which is null where it gave them.

    Each row goes out once. Nulls are values like any other, an empty frame makes no call. Calls are made where the rows lie,
    `batch` values at a time; a task that is run again makes its calls again.
    """
    spark = df.sparkSession
    new = spark.createDataFrame([], fields).schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*df.schema.fields, *new]) + ", error string"
    types, names = [to_arrow_type(f.dataType) for f in new], [*df.columns, *(f.name for f in new), "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                own = whole.slice(at, batch)
                got = attempt(call, own.column(column).to_pylist(), attempts, wait)
                arrays = [pa.array([x[i] if x is not None else None for x, _ in got], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*own.columns, *arrays, pa.array([e for _, e in got], pa.string())], names=names)

    return df.mapInArrow(run, schema)


def embedded(df: DataFrame, column: str, call: Callable[[Sequence[str]], Iterable[tuple[int, Sequence[float]]]], name: str = "embedding", **how) -> DataFrame:
    """df with vectors of a service that answers (place, vector), null ones for what it keeps failing on."""

    def fields(values: list) -> Answers:
        return [(i, ([float(x) for x in vector],)) for i, vector in call([v or "" for v in values])]

    return called(df, column, fields, f"{name} array<double>", **how)
