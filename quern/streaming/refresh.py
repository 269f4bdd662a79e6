"""Incremental operators as streams: an index, crawl state, and conversation tails.

State and tails are stateful processors: what a key holds is kept in the state store and changed where rows arrive, so a
batch writes what it changes and not the whole state. A stream and a batch over the same rows end in the same state,
wherever the stream was stopped and started again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quern.operators.index import Index

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the store that keeps state on disk; set where the session still has another one."""
    if not spark.conf.get(_PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def index_stream(chunks: DataFrame, index: Index, checkpoint: str):
    """Chunks that arrive go through the incremental refresh; the query, once per available data."""
    return chunks.writeStream.foreachBatch(lambda batch, _: index.refresh(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Latest(StatefulProcessor):
    """A key's row with the highest `order`, in a value state; a row goes out where that changes."""

    def __init__(self, schema: StructType, order: str, ttl_ms: int | None):
        self.schema, self.order, self.ttl_ms = schema, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("latest", self.schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rank = lambda r: (r[self.order] is not None, r[self.order])
        best = max(rows, key=rank)
        old = self.held.get() if self.held.exists() else None
        if old is None or rank(best) > rank(Row(**dict(zip(self.schema.names, old)))):
            self.held.update(tuple(best[c] for c in self.schema.names))
            yield Row(**{c: best[c] for c in self.schema.names})

    def close(self) -> None:
        pass


def changes_of(events: DataFrame, key: str = "url", order: str = "ts", ttl_ms: int | None = None) -> DataFrame:
    """The stream of rows that become their key's latest by `order`; of equal ones the first to come, and null is before all.

    ttl_ms: a key that had no change for so long is forgotten, and its next row is a change.
    """
    use_state_store(events.sparkSession)
    processor = Latest(events.schema, order, ttl_ms)
    return events.groupBy(key).transformWithState(processor, events.schema, "Append", "ProcessingTime" if ttl_ms else "None")


def state_stream(events: DataFrame, path: str, checkpoint: str, key: str = "url", order: str = "ts", ttl_ms: int | None = None):
    """The changes of each key's latest row, appended under path; read_state gives the state that they come to.

    The query ends with the data that is there; with a time to live it goes on until it is stopped, as clocks do.
    """
    changes = changes_of(events, key, order, ttl_ms)
    when = {"processingTime": "1 second"} if ttl_ms else {"availableNow": True}
    return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**when).start()


def read_state(spark: SparkSession, path: str, schema: StructType | str, key: str = "url", order: str = "ts") -> DataFrame:
    """The latest of each key's changes under path."""
    rows = spark.read.schema(schema).parquet(path)
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*").select(*rows.columns)


class Tail(StatefulProcessor):
    """A conversation's last `keep` turns, in a list state; each turn goes out with how many are held and the question before."""

    def __init__(self, key: str, keep: int, ttl_ms: int | None):
        self.key, self.keep, self.ttl_ms = key, keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("turn", LongType()), StructField("question", StringType())])
        self.held = handle.getListState("tail", schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        for r in sorted(rows, key=lambda r: (r.turn is not None, r.turn)):
            previous = held[-1][1] if held else None
            held = [*held, (r.turn, r.question)][-self.keep :]
            yield Row(**{self.key: key[0], "turn": r.turn, "question": r.question, "answer": r.answer, "kept": len(held), "previous": previous})
        self.held.put(held)

    def close(self) -> None:
        pass


def conversation_stream(turns: DataFrame, keep: int = 4, ttl_ms: int | None = None) -> DataFrame:
    """(conv_id, turn, question, answer, kept, previous): each turn as it arrives, how many its conversation then holds, and the question before.

    turns: (conv_id, turn, question, answer), those of a batch in order of turn. ttl_ms: a conversation that is silent for so
    long starts anew.
    """
    use_state_store(turns.sparkSession)
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, turn long, question string, answer string, kept int, previous string"
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "question", "answer")
    return rows.groupBy("conv_id").transformWithState(Tail("conv_id", keep, ttl_ms), schema, "Append", "ProcessingTime" if ttl_ms else "None")
