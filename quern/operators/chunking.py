"""Chunking of texts and of pages' content blocks. A token is about four code points, unless a tokenizer is given."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import ChunkConfig
from quern.functions import tokens as of_tokens
from quern.functions.text import blank, chunk_id, content_hash, default, document_id
from quern.functions.tokens import Characters, Ends
from quern.operators.frames import in_slices

CHARS = 4


def fixed_windows(text: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """Pieces of `size` tokens, each beginning `overlap` tokens before the last one's end, until one reaches the end."""
    whole, step = CHARS * config.size, CHARS * (config.size - config.overlap)
    n = F.length(text)
    last = F.when(n <= whole, 0).otherwise(F.ceil((n - whole) / step)).cast("int")
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(whole))))


def windows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: ChunkConfig = ChunkConfig(), ends: Ends | None = None) -> DataFrame:
    """(id, piece, text): windows of each text, by the tokens that `ends` finds, or by code points in built-in functions."""
    if ends is None:
        return docs.select(F.col(id_col), F.posexplode(fixed_windows(blank(text_col), config)).alias("piece", "text"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, n, piece) for i, t in enumerate(batch.column(1).to_pylist()) for n, piece in enumerate(of_tokens.windows(t, config.size, config.overlap, ends))]
        own = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
        return pa.RecordBatch.from_arrays([own, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=[id_col, "piece", "text"])

    rows = docs.select(F.col(id_col), blank(text_col).alias("text"))
    return rows.mapInArrow(in_slices(cut), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, piece int, text string")


def section_groups(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, group_no, heading, section, text) of blocks (doc, pos, kind, text, heading, section).

    Each heading begins a group with what follows it; blocks before the first are a group without a name. Texts are joined
    by blank lines; groups without text are left out.
    """
    order = Window.partitionBy(doc).orderBy("pos")
    rows = blocks.withColumn("group_no", F.sum((F.col("kind") == "heading").cast("int")).over(order))
    each = F.struct("pos", "kind", "text", blank("heading").alias("heading"), blank("section").alias("section"))
    rows = rows.groupBy(doc, "group_no").agg(F.array_sort(F.collect_list(each)).alias("b"))
    first = F.element_at("b", 1)
    named = first["kind"] == "heading"
    heading = F.when(named, default(first["heading"], F.trim(F.ltrim(first["text"], F.lit("# "))))).otherwise("")
    rows = rows.withColumn("heading", heading).withColumn("section", F.when(named, default(first["section"], F.col("heading"))).otherwise(""))
    text = F.array_join(F.filter(F.transform("b", lambda b: blank(b["text"])), lambda t: t != ""), "\n\n")
    return rows.select(doc, "group_no", "heading", "section", F.trim(text).alias("text")).filter("text <> ''")


_CHARACTERS = Characters(CHARS)


def tokens(text: str, ends: Ends = _CHARACTERS) -> int:
    return (len(text) + CHARS - 1) // CHARS if ends is _CHARACTERS else len(ends(text))


def windows(text: str, config: ChunkConfig, ends: Ends = _CHARACTERS) -> list[str]:
    return of_tokens.windows(text, config.size, config.overlap, ends)


def split(text: str, config: ChunkConfig, ends: Ends = _CHARACTERS) -> list[str]:
    """Pieces of at most `size` tokens, packed from paragraphs, or from lines if there is one paragraph.

    A piece that follows a full one begins with the end of that; units that are too large by themselves are cut to windows.
    """
    if tokens(text, ends) <= config.size:
        return [text]
    for mark in ("\n\n", "\n"):
        units = [u for x in text.split(mark) if (u := x.strip())]
        if len(units) > 1:
            break
    else:
        return windows(text, config, ends)
    out: list[str] = []
    held = ""
    for unit in units:
        if tokens(unit, ends) > config.size:
            out += [held] if held else []
            out += windows(unit, config, ends)
            held = ""
        elif tokens(joined := f"{held}\n\n{unit}".strip(), ends) <= config.size:
            held = joined
        else:
            # A unit alone is never too large here, so there is something held.
            out.append(held)
            tail = of_tokens.suffix(held, config.overlap, ends) if ends is not _CHARACTERS else held[-CHARS * config.overlap :] if config.overlap > 0 else ""
            held = f"{tail}\n\n{unit}".strip()
            if tokens(held, ends) > config.size:
                out += windows(held, config, ends)
                held = ""
    return out + ([held] if held else [])


def chunk_groups(groups: list[tuple[str, str, str]], config: ChunkConfig, ends: Ends = _CHARACTERS) -> list[dict]:
    """Chunks of (heading, section, text) groups; a tiny piece is laid to the chunk before it while that keeps in bounds."""
    out: list[dict] = []
    for heading, section, text in groups:
        for piece in split(text, config, ends):
            if out and tokens(piece, ends) < config.least:
                merged = f"{out[-1]['text']}\n\n{piece}".strip()
                if tokens(merged, ends) <= config.size + config.overlap:
                    out[-1]["text"] = merged
                    continue
            out.append({"chunk_no": len(out), "heading": heading, "section": section, "text": piece, "seed": piece[:200]})
    for chunk in out:
        chunk["tokens"] = tokens(chunk["text"], ends)
    return out


def grouped(blocks: Iterable[dict], text: str, title: str) -> list[tuple[str, str, str]]:
    """(heading, section, text) groups of a document's blocks; of its text, under its title, if it has none."""
    groups: list[tuple[str, str, list[str]]] = []
    for b in blocks:
        if b["kind"] == "heading":
            heading = b["heading"] or b["text"].lstrip("# ").strip()
            groups.append((heading, b["section"] or heading, [b["text"]]))
        elif groups:
            groups[-1][2].append(b["text"])
        else:
            groups.append(("", "", [b["text"]]))
    if not groups and text:
        groups = [(title or "", "", [text])]
    return [(h, s, x) for h, s, xs in groups if (x := "\n\n".join(filter(None, xs)).strip())]


_CHUNK = "chunk_no int, heading string, section string, text string, seed string, tokens int"


def chunk_documents(docs: DataFrame, config: ChunkConfig = ChunkConfig(), source_type: str = "web_page", source_label: str = "Knowledge Base", crawled_at: str = "", ends: Ends | None = None) -> DataFrame:
    """Chunks of docs (url, title, cleaned_text, blocks, optional content_hash and access), one row each.

    A document without blocks is one group of its cleaned text. Columns: chunk_id, document_id, page_title, url, section,
    heading, crawl_timestamp, scraped_date, source_type, source, access, content_hash, token_count, chunk_no, text, and page_key
    if docs has it. Sizes are in tokens of `ends`, or of four code points each.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    have = lambda c: F.col(c) if c in docs.columns else F.lit("")
    key = ["page_key"] if "page_key" in docs.columns else []
    rows = docs.select(
        *key, blank("url").alias("url"), blank("title").alias("page_title"), default(have("content_hash"), content_hash("cleaned_text")).alias("content_hash"),
        default(have("access"), "authenticated").alias("access"), "blocks", blank("cleaned_text").alias("whole"),
    )
    kept = rows.columns[:-2]
    of_key = f"page_key {docs.schema['page_key'].dataType.simpleString()}, " if key else ""
    columns = f"{of_key}url string, page_title string, content_hash string, access string, {_CHUNK}"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], columns).schema)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in batch.to_pylist():
            whole = grouped(row["blocks"] or (), row["whole"], row["page_title"])
            own = {c: row[c] for c in kept}
            out += [{**own, **c} for c in (chunk_groups(whole, config, ends) if ends else chunk_groups(whole, config))]
        return pa.RecordBatch.from_pylist(out, schema)

    return with_ids(rows.mapInArrow(in_slices(cut), columns), source_type, source_label, crawled_at)


def with_ids(cut: DataFrame, source_type: str = "web_page", source_label: str = "Knowledge Base", crawled_at: str = "") -> DataFrame:
    """The columns of chunk_documents from cut pieces (url, page_title, content_hash, access, chunk_no, heading, section, text, seed, tokens)."""
    heading = default("heading", F.col("page_title"))
    return cut.select(
        chunk_id(F.col("url"), heading, F.col("chunk_no"), F.col("seed")).alias("chunk_id"),
        document_id(F.col("url"), F.col("page_title")).alias("document_id"),
        "page_title", "url", default("section", heading).alias("section"), heading.alias("heading"),
        F.lit(crawled_at).alias("crawl_timestamp"), F.lit(crawled_at).alias("scraped_date"), F.lit(source_type).alias("source_type"), F.lit(source_label).alias("source"),
        "access", "content_hash", F.col("tokens").alias("token_count"), "chunk_no", "text", *(["page_key"] if "page_key" in cut.columns else []),
    )


def to_documents(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, url, page_title, cleaned_text, content_hash, access, sections, chunk_count, chunks); empty ones are left out.

    Pages and chunks meet by page_key where both have it, so that two pages of one URL and title stay apart.
    """
    key = ["page_key"] if {"page_key"} <= {*docs.columns} & {*chunks.columns} else ["url", "page_title"]
    names = F.array_sort(F.array_distinct(F.filter(F.transform("blocks", lambda b: b["section"]), lambda s: s != "")))
    page = [blank("url").alias("url"), blank("title").alias("page_title")]
    own = docs.select(*(key if len(key) == 1 else []), *page, "cleaned_text", names.alias("sections")).filter(F.trim("cleaned_text") != "")
    packed = chunks.groupBy(*key).agg(
        F.first("document_id").alias("document_id"), F.first("content_hash").alias("content_hash"), F.first("access").alias("access"), F.count(F.lit(1)).alias("chunk_count"),
        F.array_sort(F.collect_list(F.struct("chunk_no", "chunk_id", "section", "heading", "token_count", "text"))).alias("chunks"),
    )
    return own.join(packed, key)
