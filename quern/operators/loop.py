"""Filling gaps: discover pages for a question, ingest them, retrieve again; and refreshing an index from pages."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.config import ChunkConfig, CrawlConfig, RetrievalConfig, SiteConfig
from quern.operators import chunking, crawl, html
from quern.operators.frames import checkpointed, small
from quern.operators.index import Index

log = logging.getLogger(__name__)


def fill_gaps(
    question: str,
    found: list[dict],
    retrieve: Callable[[str], list[dict]],
    discover: Callable[[str, int], list[str]] | None,
    ingest: Callable[[list[str]], int] | None,
    seen: set[str],
    config: RetrievalConfig = RetrievalConfig(),
) -> list[dict]:
    """found, or what retrieval brings after ingesting discovered pages; seen is the caller's and outlives a question.

    Ends when a chunk is relevant enough, when nothing new is discovered, when ingestion fails or brings nothing, or
    after max_iterations.
    """
    enough = lambda chunks: any(c["relevance"] >= config.min_relevance for c in chunks)
    if enough(found) or discover is None:
        return found
    for _ in range(config.max_iterations):
        new = [u for u in discover(question, config.discover_limit) if u not in seen]
        if not new:
            break
        seen.update(new)
        try:
            n = ingest(new) if ingest else 0
        except Exception:
            log.exception("ingestion failed")
            break
        found = retrieve(question)
        if enough(found) or not n:
            break
    return found


def unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of found whose url is not in seen (url); seen goes to all tasks while it is small."""
    return found.join(small(checkpointed(seen.select("url").distinct())), "url", "left_anti")


def fill_gaps_together(
    questions: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    discover: Callable[[DataFrame, int], DataFrame],
    ingest: Callable[[DataFrame], DataFrame],
    seen: DataFrame,
    config: RetrievalConfig = RetrievalConfig(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, found, seen) of the loop for many questions (query_id, question) that go through its steps together.

    retrieve(questions) gives (query_id, chunk_id, relevance, ...), discover(questions, limit) gives (query_id, rank, url) and
    ingest(pages (url)) the pages (url) that it took in. Each step takes all questions whose chunks are not relevant enough:
    URLs that none had seen before the step are seen from then on, the first query_time_pages of each question are
    ingested, each page once for all that ask for it, and the questions that had any are asked again. A question
    ends as in fill_gaps: with a chunk that is relevant enough, without new URLs, without an ingested page, or after
    max_iterations. A failed ingestion is raised, as answers of the steps before would look like those of a whole loop.
    answers: (query_id, steps, ingested, best, enough), best being null without a chunk; seen: (url) of all steps and
    before. Driver and tasks hold no question's rows but by step.
    """
    config_pages = max(1, config.query_time_pages)
    best_of = lambda rows: rows.groupBy("query_id").agg(F.max("relevance").alias("best"))
    found = checkpointed(retrieve(questions))
    zero = F.lit(0)
    state = questions.select("query_id", "question").join(best_of(found), "query_id", "left").select("query_id", "question", zero.alias("steps"), zero.cast("long").alias("ingested"), "best", F.lit(True).alias("open"))
    enough = F.coalesce(F.col("best") >= config.min_relevance, F.lit(False))
    seen = seen.select("url").distinct()
    for _ in range(config.max_iterations):
        state = checkpointed(state.withColumn("open", F.col("open") & ~enough))
        todo = state.filter("open").select("query_id", "question")
        if todo.isEmpty():
            break
        wanted = checkpointed(unseen(discover(todo, config.discover_limit).select("query_id", "rank", "url"), seen))
        if wanted.isEmpty():
            break
        seen = seen.unionByName(wanted.select("url")).distinct()
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        picked = wanted.withColumn("nth", nth).filter(F.col("nth") <= config_pages)
        taken = checkpointed(ingest(picked.select("url").distinct()).select("url").distinct())
        counts = picked.join(taken, "url", "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("new"))
        again = checkpointed(todo.join(wanted.select("query_id").distinct(), "query_id", "left_semi"))
        better = checkpointed(retrieve(again))
        found = checkpointed(found.join(again.select("query_id"), "query_id", "left_anti").unionByName(better))
        asked = again.select("query_id", F.lit(True).alias("asked")).join(best_of(better).withColumnRenamed("best", "now"), "query_id", "left").join(counts, "query_id", "left")
        asked = asked.select("query_id", "asked", "now", F.coalesce("new", F.lit(0)).alias("new"))
        state = state.join(asked, "query_id", "left").select(
            "query_id", "question", (F.col("steps") + F.coalesce(F.col("asked").cast("int"), zero)).alias("steps"), (F.col("ingested") + F.coalesce("new", zero)).alias("ingested"),
            F.when(F.col("asked"), F.col("now")).otherwise(F.col("best")).alias("best"), (F.col("open") & F.coalesce(F.col("new") > 0, F.lit(False))).alias("open"),
        )
    return checkpointed(state.select("query_id", "steps", "ingested", "best", enough.alias("enough"))), found, seen


def process(pages: DataFrame, site: SiteConfig = SiteConfig(), config: ChunkConfig = ChunkConfig(), crawled_at: str = "") -> DataFrame:
    """Chunks of pages (page_id, url, html)."""
    done = html.extract_pages(pages, site.allowed_hosts)
    return chunking.chunk_documents(done, config, source_label=site.source_label, crawled_at=crawled_at).withColumn("pos", F.monotonically_increasing_id())


def targeted_ingest(urls: list[str], pages: DataFrame, index: Index, site: SiteConfig = SiteConfig(), config: RetrievalConfig = RetrievalConfig(), has_session: bool = True) -> int:
    """Pages processed and indexed of those asked for, the first few only; 0 without URLs, without a session or on failure."""
    if not urls or not has_session:
        return 0
    wanted = urls[: min(len(urls), max(1, config.query_time_pages))]
    try:
        got = pages.filter(F.col("url").isin(*wanted))
        n = got.count()
        if n:
            index.refresh(process(got, site))
        return n
    except Exception:
        log.exception("targeted ingestion failed")
        return 0


def refresh(pages: DataFrame, state: DataFrame, index: Index, mode: str = "incremental", site: SiteConfig = SiteConfig(), now: str = "") -> tuple[DataFrame, dict]:
    """(new state, totals): fetched pages against the state, processing of what is new or changed, and the index."""
    CrawlConfig(mode=mode)
    done = html.extract_pages(pages, site.allowed_hosts).join(pages.select(F.col("page_id").alias("page_key"), "html"), "page_key")
    fetched = done.select("page_key", "url", F.col("url").alias("final_url"), F.lit(200).alias("status_code"), "title", "html", "content_hash")
    rows = crawl.checkpointed(crawl.outcomes(fetched, state, site.allowed_hosts, mode))
    kept = pages.join(rows.filter(F.col("outcome").isin("new", "updated")).select(F.col("page_key").alias("page_id")), "page_id", "left_semi")
    figures = index.refresh(process(kept, site), mode)
    after = crawl.upsert_state(state, rows.select("url", "title", "content_hash", "status", F.lit(now).alias("last_scraped"), F.lit("").alias("error")), now)
    return after, rows.transform(crawl.outcome_counts).first().asDict() | {"documents_indexed": figures["upserted"], "chunks_created": figures["loaded"], "mode": mode}
