"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: Bytes that a frame may hold at most to be broadcast; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20

#: Keys that hold over one in so many rows are joined by themselves; there are fewer of them than that.
HOT_KEYS = 1000

#: Rows that a task holds as Python objects at a time.
SLICE_ROWS = 256

#: Entries of a per-worker cache, after which it starts anew.
CACHE_ENTRIES = 400_000

#: Bits of a row's number that count inside a file.
ROW_BITS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_shared_dir(spark: SparkSession) -> None:
    """Set a checkpoint folder only where the session has none; on a cluster that must be set by the session."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the shared folder so that it outlives executors."""
    use_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _nodes(plan) -> list[str]:
    """Classes of a plan's nodes, the plan's own first."""
    children = plan.children()
    return [plan.getClass().getSimpleName(), *(n for i in range(children.size()) for n in _nodes(children.apply(i)))]


def _plan(df: DataFrame) -> tuple[list[str], bool]:
    """Classes of the nodes of df's plan, and whether each scan gives the same rows: no rand(), no UDF that isn't deterministic."""
    plan = df._jdf.queryExecution().analyzed()
    return _nodes(plan), plan.deterministic()


def stable(df: DataFrame) -> DataFrame:
    """df if its rows and their names are the same in each scan, else df checkpointed.

    Columns and rows chosen by deterministic expressions from a Parquet table have file and place there; a checkpointed
    frame has fixed partitions. What a shuffle brings has neither: its partitions may be dealt anew when an executor is
    lost. What hangs on rand() or the like changes from scan to scan.
    """
    nodes, same = _plan(df)
    plain = same and set(nodes[:-1]) <= {"Project", "Filter", "SubqueryAlias"}
    return df if plain and (nodes[-1] == "LogicalRDD" or nodes[-1] == "LogicalRelation" and _places(df) is not None) else cut(df)


def _places(df: DataFrame, path: str = "__path", at: str = "__at") -> DataFrame | None:
    """df with its rows' places in Parquet files, or None if it has none."""
    try:
        return df.select("*", F.regexp_replace("_metadata.file_path", ":/+", ":/").alias(path), F.col("_metadata.row_index").alias(at))
    except AnalysisException:
        return None


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A frame that is stable() with a number for each row, the same in every scan however the scan is split.

    For Parquet it is the file's number in the order of paths and the row's in its file; a checkpointed frame has
    partitions that don't change.
    """
    if "LogicalRelation" not in _plan(df)[0]:
        return df.withColumn(name, F.monotonically_increasing_id())
    path, at, base = fresh(df, "__path"), fresh(df, "__at"), fresh(df, "__base")
    # A local file's path has one or three slashes after its scheme, as it is listed or read.
    rows, files = _places(df, path, at), sorted({re.sub(":/+", ":/", f) for f in df.inputFiles()})
    if len(files) < 2:
        return rows.withColumn(name, F.coalesce(at, F.lit(-1))).drop(path, at)
    order = df.sparkSession.createDataFrame([(f, i << ROW_BITS) for i, f in enumerate(files)], f"{path} string, {base} long")
    rows = rows.join(small(order), path, "left")
    start = F.coalesce(base, F.raise_error(F.concat(F.lit("a file that was not listed: "), path)).cast("long"))
    # Never null, and known as such: a test for nulls before one of two joins would keep them from sharing a shuffle.
    return rows.withColumn(name, F.coalesce(start + F.col(at), F.lit(-1))).drop(path, at, base)


def with_rid(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(rid, id, text, more) of a stable frame: rid tells repeated rows apart."""
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *more)
    return numbered(own, "rid").select("rid", *own.columns)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def release() -> None:
    """Give memory that this worker no longer uses back to the system; a worker that waits for its next task keeps it else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with release() at the end of each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def per_text(df: DataFrame, fn: Callable[[str | None], tuple], columns: str, drop_text: bool = True, tidy: bool = False) -> DataFrame:
    """fn's tuple for each text as new columns, one Arrow batch at a time; a null text is given as None.

    The other columns of df pass through; text itself only if drop_text is false. tidy: release() after each task.
    """
    keep = [f for f in df.schema.fields if not (drop_text and f.name == "text")]
    fresh = df.sparkSession.createDataFrame([], columns).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*keep, *fresh.fields])
    names = [f.name for f in keep]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fresh.fields]
    heads = [f.name for f in fresh.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [fn(x) for x in batch.column("text").to_pylist()]
            arrays = [batch.column(n) for n in names]
            arrays += [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(arrays, names=names + heads)

    return df.mapInArrow(releasing(run) if tidy else run, schema)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its values take `most` bytes at most, else df as it is; df should be cheap to scan."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType, ArrayType))]
    fixed = 8 * (1 + len(df.columns))  # a row's head and a word for each column
    length = lambda c: F.size(c) * 8 if isinstance(df.schema[c].dataType, ArrayType) else F.octet_length(c)
    row = sum((F.coalesce(length(c), F.lit(0)) for c in wide), F.lit(fixed))
    held = df.limit(most // fixed + 1).agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(df) if held <= most else df


def join_hot(rows: DataFrame, classes: DataFrame, on: str, n: str, total: int) -> DataFrame:
    """rows joined to classes (one row for each value of `on`, n of rows with it out of total); n goes.

    Values that hold over one in HOT_KEYS rows are fewer than that, so they are broadcast; the rest are shuffled, and no
    task gets more of one value than that share.
    """
    hot = F.col(n) * HOT_KEYS > total
    few, many = F.broadcast(classes.filter(hot).drop(n)), classes.filter(~hot).drop(n)
    rest = rows.join(F.broadcast(classes.filter(hot).select(on)), on, "left_anti")
    return rows.join(few, on).unionByName(rest.join(many, on))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, a stable frame, without the rows that gone (rid of with_rid over the same docs) names; columns stay as they are."""
    rid = fresh(docs, "__rid")
    rows = numbered(docs, rid)
    return rows.join(small(cut(gone.select(F.col("rid").alias(rid)))), rid, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def crc_mod(c: Column, n: int) -> Column:
    return F.crc32(F.encode(c.cast("string"), "UTF-8")) % n
