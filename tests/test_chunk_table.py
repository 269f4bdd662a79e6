"""Chunking as a table function gives the rows of the DataFrame one."""

import random

from quern.config import ChunkConfig
from quern.functions.tokens import Characters
from quern.operators import chunk_table, chunking, html


def documents(spark, n=60):
    r = random.Random(5)
    word = lambda: r.choice(["alpha", "beta", "line\nbreak", "para\n\ngraph", "é" * 9, "", "x" * 90])
    rows = []
    for i in range(n):
        blocks = [
            {"kind": k, "text": ("## " if k == "heading" else "") + " ".join(word() for _ in range(r.randrange(12))), "heading": r.choice(["", "H"]), "section": r.choice(["", "S"])}
            for k in r.choices(["heading", "paragraph", "list"], k=r.randrange(9))
        ]
        rows.append((f"k{i}", f"https://h/{i % 7}", r.choice([None, "", "Title"]), r.choice([None, "", "whole text " * r.randrange(60)]), r.choice([blocks, blocks, None])))
    rows.append((None, None, None, "a text without key", None))
    return spark.createDataFrame(rows, f"page_key string, url string, title string, cleaned_text string, blocks {html.BLOCKS}")


def test_equal_to_chunk_documents(spark):
    docs = documents(spark)
    for config, ends in ((ChunkConfig(), None), (ChunkConfig(size=20, overlap=5), None), (ChunkConfig(size=30, overlap=0), Characters(3))):
        want = chunking.chunk_documents(docs, config, ends=ends)
        chunk_table.register(spark, config, ends, "cut_small")
        blocks = chunk_table.block_rows(docs)
        # Columns in another order, one more of a name that the result has, and rows in any order.
        blocks = blocks.selectExpr("section", "pos", "page_key", "7 AS chunk_no", "* EXCEPT (section, pos, page_key)").orderBy("text")
        got = spark.sql("SELECT * FROM cut_small(TABLE(SELECT * FROM {blocks}) PARTITION BY page_key ORDER BY pos)", blocks=blocks)
        got = chunking.with_ids(got).select(*want.columns)
        tidy = lambda df: sorted(map(repr, df.collect()))
        assert tidy(got) == tidy(want) and got.count() > 50


def test_no_rows(spark):
    chunk_table.register(spark)
    for docs in (documents(spark).limit(0), documents(spark).limit(1).selectExpr("page_key", "url", "title", "'' AS cleaned_text", f"CAST(NULL AS {html.BLOCKS}) AS blocks")):
        blocks = chunk_table.block_rows(docs)
        assert spark.sql("SELECT * FROM chunk_blocks(TABLE(SELECT * FROM {blocks}) PARTITION BY page_key ORDER BY pos)", blocks=blocks).count() == 0
