"""Chunking as a table function, for SQL text.

    chunk_table.register(spark)
    chunk_table.block_rows(docs, "page_key").createOrReplaceTempView("blocks")
    SELECT * FROM chunk_blocks(TABLE(blocks) PARTITION BY page_key ORDER BY pos)

Blocks come from wherever SQL makes them; a task holds one document at a time, and gives out its pieces when it has ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import ChunkConfig
from quern.functions.text import blank, content_hash, default
from quern.functions.tokens import Ends
from quern.operators.chunking import chunk_groups, grouped

#: What stands in each row of a document and goes into each of its chunks.
OWN = ("page_key", "url", "page_title", "content_hash", "access")
_PIECE = (("chunk_no", pa.int32()), ("heading", pa.string()), ("section", pa.string()), ("text", pa.string()), ("seed", pa.string()), ("tokens", pa.int32()))
PIECES = pa.schema([(c, pa.string()) for c in OWN] + list(_PIECE))
SCHEMA = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'string'}" for f in PIECES)


def block_rows(docs: DataFrame, key: str = "page_key") -> DataFrame:
    """A row for each block of docs (key, url, title, cleaned_text, blocks, optional content_hash and access).

    A document without blocks is one row with a null pos and its cleaned text. Keys name documents: rows of one key are one
    document, and a null key is a key.
    """
    have = lambda c: F.col(c) if c in docs.columns else F.lit("")
    rows = docs.select(
        F.col(key).cast("string").alias("page_key"), blank("url").alias("url"), blank("title").alias("page_title"),
        default(have("content_hash"), content_hash("cleaned_text")).alias("content_hash"), default(have("access"), "authenticated").alias("access"),
        blank("cleaned_text").alias("whole"), F.posexplode_outer("blocks").alias("pos", "b"),
    )
    text = F.when(F.col("pos").isNull(), F.col("whole")).otherwise(F.col("b.text"))
    return rows.select(*OWN, "pos", F.col("b.kind").alias("kind"), text.alias("text"), F.col("b.heading").alias("heading"), F.col("b.section").alias("section"))


def table_function(config: ChunkConfig = ChunkConfig(), ends: Ends | None = None):
    """The function over rows of block_rows' columns, in any order of columns and with others beside them; see chunk_documents for sizes.

    An empty table, and a document without text, give no rows. Null texts of blocks are left out.
    """

    class ChunkBlocks:
        def __init__(self) -> None:
            self.own: dict | None = None
            self.blocks: list[dict] = []
            self.text = ""

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            for row in rows.to_pylist():
                self.own = self.own or {c: row[c] for c in OWN}
                if row["pos"] is None:
                    self.text = row["text"] or ""
                else:
                    self.blocks.append({c: row[c] or "" for c in ("kind", "text", "heading", "section")})
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            if self.own is None:
                return
            groups = grouped(self.blocks, self.text, self.own["page_title"])
            pieces = chunk_groups(groups, config, ends) if ends else chunk_groups(groups, config)
            if pieces:
                yield pa.Table.from_pylist([{**self.own, **p} for p in pieces], PIECES)

    return F.arrow_udtf(ChunkBlocks, returnType=SCHEMA)


def register(spark: SparkSession, config: ChunkConfig = ChunkConfig(), ends: Ends | None = None, name: str = "chunk_blocks") -> None:
    """The table function under a name in this session."""
    spark.udtf.register(name, table_function(config, ends))
