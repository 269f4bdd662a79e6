"""Queries by name, over whole tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import ChunkConfig, CrawlConfig, RetrievalConfig, SiteConfig, hybrid_stopwords, run_name, utc_now
from quern.functions import embedding, text, tokens, urls
from quern.operators import answer, cells, chunk_table, chunking, conversation, crawl, frames, health, html, index, loop, retrieval
from quern.plans.oracles import ORACLES  # noqa: F401
from quern.sources import files, pages as page_sources, robots, runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Hosts that the fixture's pages are looked at from.
HOSTS = ("example.com", "example.org", "www.example.com")
HUB = ("hub.example.com",)
LABEL = "Knowledge Base"


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, with a vector where there is one; access is a stand-in made from the toxicity labels."""
    docs, vectors, labels = frames.spread(t(spark, sf_dir, "documents")), t(spark, sf_dir, "embeddings"), t(spark, sf_dir, "labels")
    rows = docs.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").join(labels.select("doc_id", "toxic"), "doc_id", "left")
    access = F.when(F.col("toxic") == 1, "restricted").otherwise("authenticated")
    return rows.select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("source").alias("title"), F.concat(F.lit("https://hub.example.com/"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("section"), access.alias("access"), F.col("doc_id").alias("pos"), "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first user turn of each conversation, with the vector of the same number where there is one."""
    first = t(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    return first.join(t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("vector")), "conv_id", "left").withColumnRenamed("conv_id", "query_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks: the first is a heading, every tenth after it too."""
    rows = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kind = F.when(F.col("pos") % 10 == 0, "heading").otherwise("paragraph")
    return rows.select("doc_id", "pos", kind.alias("kind"), "text", F.lit("").alias("heading"), F.lit("").alias("section"))


def _hybrid(spark, sf_dir) -> DataFrame:
    return retrieval.hybrid_search(questions(spark, sf_dir), corpus(spark, sf_dir))


@query
def hybrid_search(spark, sf_dir):
    found = _hybrid(spark, sf_dir)
    return found.select("query_id", "rank", "chunk_id", "title", "relevance")


@query
def vector_topk(spark, sf_dir):
    return retrieval.vector_topk(questions(spark, sf_dir), corpus(spark, sf_dir), RetrievalConfig().candidates)


@query
def vector_topk_batch(spark, sf_dir):
    vectors = t(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.vector_topk(asked, vectors.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding"), 5)


@query
def vector_recall(spark, sf_dir):
    """How much of the exact search the one by cells finds: every twentieth vector asked of all, at least nine of ten neighbours met.

    The fixture's vectors are random and form no clusters, so a question has to look into 12 of 16 cells for that.
    """
    rows = t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "vec_id")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    centres = cells.fit_centres(rows, 16)
    found = cells.vector_topk_cells(asked, cells.index_cells(rows, centres, _folder(spark, "cells")), centres, 10, 12)
    figures = cells.recall(found, retrieval.vector_topk(asked, rows, 10))
    return figures.select("n_queries", "n_exact", (F.col("n_met") >= 0.9 * F.col("n_exact")).alias("enough"))


@query
def debug_search(spark, sf_dir):
    own = corpus(spark, sf_dir)
    vector = own.filter("embedding IS NOT NULL").orderBy("pos").select("embedding").first()
    return retrieval.debug_search(own, list(vector[0]) if vector else [0.0] * 64)


@query
def keyword_search(spark, sf_dir):
    return retrieval.keyword_topk(questions(spark, sf_dir), corpus(spark, sf_dir), RetrievalConfig().candidates)


def _two_lists(spark, sf_dir):
    near = retrieval.vector_topk(questions(spark, sf_dir), corpus(spark, sf_dir), 12).select("query_id", F.lit(0).alias("list_no"), "chunk_id", "rank", text.relevance("distance").alias("relevance"))
    words = retrieval.keyword_topk(questions(spark, sf_dir), corpus(spark, sf_dir), 12).select("query_id", F.lit(1).alias("list_no"), "chunk_id", "rank", "relevance")
    return near.unionByName(words)


@query
def rrf_scores(spark, sf_dir):
    return retrieval.rrf_scores(_two_lists(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query
def rrf_fuse(spark, sf_dir):
    return retrieval.rrf_fuse(_two_lists(spark, sf_dir)).select("query_id", "position", "chunk_id", F.round("score", 9).alias("score"), F.round("relevance", 6).alias("relevance"))


@query
def authorized_filter(spark, sf_dir):
    return corpus(spark, sf_dir).filter(text.authorized("access")).select("chunk_id", "access")


@query
def context_sufficient(spark, sf_dir):
    asked = questions(spark, sf_dir)
    return retrieval.context_sufficient(_hybrid(spark, sf_dir), asked)


@query
def context_blocks(spark, sf_dir):
    found = _hybrid(spark, sf_dir)
    kept = answer.context_budget(answer.context_blocks(found))
    return kept.select("query_id", "rank", F.length("block").alias("block_chars"), "chars", F.sha2(F.regexp_replace("block", "relevance=[0-9.]+", ""), 256).alias("block_sha256"))


@query
def source_list(spark, sf_dir):
    return answer.source_list(_hybrid(spark, sf_dir))


@query
def build_prompt(spark, sf_dir):
    asked = questions(spark, sf_dir)
    rows = answer.prompts(asked, _hybrid(spark, sf_dir))
    return rows.select("query_id", F.length("prompt").alias("chars"), F.sha2(F.regexp_replace("prompt", "relevance=[0-9.]+", ""), 256).alias("prompt_sha256"))


@query
def expand_query(spark, sf_dir):
    return conversation.expanded(conversation.pair_turns(t(spark, sf_dir, "conversations"))).select("conv_id", "turn", "query")


@query
def conversation_tail(spark, sf_dir):
    return conversation.tail(conversation.pair_turns(t(spark, sf_dir, "conversations"))).select("conv_id", "turn", "back", "question", "answer")


@query
def history_text(spark, sf_dir):
    return conversation.history_text(conversation.pair_turns(t(spark, sf_dir, "conversations")))


@query
def content_hash(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.content_hash("text").alias("content_hash"))


@query
def text_normalize_hash(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.length(text.normalize_for_hash("text")).alias("chars"), F.md5(text.normalize_for_hash("text")).alias("normal_md5"))


@query
def content_changed(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    old = docs.select("doc_id", text.content_hash("text").alias("old_hash"))
    new = docs.select("doc_id", text.content_hash(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.concat(F.lit("  "), "text"))).alias("new_hash"))
    return old.join(new, "doc_id").select("doc_id", crawl.is_unchanged(F.col("old_hash"), F.col("new_hash")).alias("unchanged"))


@query
def query_terms(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.query_terms("text"), " ").alias("terms"))


@query
def query_terms_score(spark, sf_dir):
    """How many of a question's terms its answer holds."""
    pairs = conversation.pair_turns(t(spark, sf_dir, "conversations"))
    return pairs.select("conv_id", "turn", text.term_hits("answer", text.query_terms("question")).alias("score"))


@query
def keywords_top8(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.keywords("text", hybrid_stopwords(LABEL)), " ").alias("keywords"))


@query
def token_count(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.count_tokens("text").alias("tokens"))


@query
def truncate_tokens(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.truncate_to_tokens("text", 100)).alias("cut_md5"))


@query
def overlap_suffix(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.overlap_suffix("text", 150)).alias("suffix_md5"))


@query
def slug_document_id(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", text.slugify("url").alias("slug"), text.document_id(F.col("url"), F.lit("")).alias("document_id"))


@query
def chunk_id(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.chunk_id(F.col("source"), F.col("lang"), F.col("doc_id"), F.col("text")).alias("chunk_id"))


@query
def whitespace_normalize(spark, sf_dir):
    padded = F.concat(F.lit(" \t"), F.replace("text", F.lit("\n"), F.lit("  \n\n\n\n ")))
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_whitespace(padded)).alias("normal_md5"))


@query
def footer_flag(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("text", F.when(F.col("pos") % 5 == 0, F.concat(F.lit("© "), "text")).otherwise(F.col("text")))
    return rows.groupBy("doc_id").agg(F.count_if(text.is_footer_boilerplate("text")).alias("n_footer"))


@query
def markdown_links(spark, sf_dir):
    marked = F.concat(F.lit("[a b](https://hub.example.com/"), F.col("doc_id").cast("string"), F.lit(") "), F.col("text"), F.lit(" [z](http://x.example/)"))
    rows = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.markdown_links(marked)).alias("pos", "link"))
    return rows.select("doc_id", "pos", F.col("link.text").alias("label"), F.col("link.url").alias("url"))


@query
def redact_secrets(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact("text")).alias("redacted_md5"), F.contains(text.redact("text"), F.lit("=***")).alias("had_secret"))


@query
def safe_error(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.safe_error(F.lit("ValueError"), F.col("text"))).alias("error_md5"))


@query
def url_normalize(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", urls.normalize_url("url").alias("url"))


@query
def url_classify(spark, sf_dir):
    rows = t(spark, sf_dir, "pages")
    return rows.select("page_id", urls.host("url").alias("host"), urls.is_internal("url", HOSTS).alias("internal"), urls.is_allowed("url", HOSTS).alias("allowed"), urls.is_probably_html("url").alias("page"), urls.is_document("url").alias("document"))


@query
def url_log_path(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", urls.log_path("url").alias("path"))


@query
def url_page_slug(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", urls.page_slug("url").alias("slug"))


@query
def login_signal(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", urls.looks_like_login("url", HOSTS).alias("login"))


@query
def signin_title(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", urls.looks_like_sign_in_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("sign_in"))


@query
def access_denied(spark, sf_dir):
    status = F.when(F.col("page_id") % 50 == 0, 403).otherwise(200)
    return t(spark, sf_dir, "pages").select("page_id", urls.looks_like_denied(status, F.col("url"), F.lit(""), F.col("html")).alias("denied"))


def _extracted(spark, sf_dir):
    return html.extract_pages(t(spark, sf_dir, "pages"), HOSTS)


@query
def html_title(spark, sf_dir):
    return _extracted(spark, sf_dir).select(F.col("page_key").alias("page_id"), "title")


@query
def html_headings(spark, sf_dir):
    rows = _extracted(spark, sf_dir).select(F.col("page_key").alias("page_id"), F.posexplode("headings").alias("pos", "h"))
    return rows.select("page_id", "pos", F.col("h.level").alias("level"), F.col("h.text").alias("text"))


@query
def html_links(spark, sf_dir):
    rows = _extracted(spark, sf_dir).select(F.col("page_key").alias("page_id"), F.posexplode("links").alias("pos", "l"))
    return rows.select("page_id", "pos", F.col("l.url").alias("url"), F.col("l.text").alias("text"), F.col("l.internal").alias("internal"))


@query
def html_nav(spark, sf_dir):
    rows = _extracted(spark, sf_dir).select(F.col("page_key").alias("page_id"), F.posexplode("navigation").alias("pos", "n"))
    return rows.select("page_id", "pos", F.col("n.label").alias("label"), F.size("n.items").alias("n_items"))


@query
def html_visible_text(spark, sf_dir):
    return _extracted(spark, sf_dir).select(F.col("page_key").alias("page_id"), "visible_text", "content_hash")


@query
def html_clean(spark, sf_dir):
    return _extracted(spark, sf_dir).select(F.col("page_key").alias("page_id"), "cleaned_text", F.size("preserved_links").alias("n_links"))


@query
def html_blocks(spark, sf_dir):
    rows = _extracted(spark, sf_dir).select(F.col("page_key").alias("page_id"), F.posexplode("blocks").alias("pos", "b"))
    return rows.select("page_id", "pos", "b.kind", "b.text", "b.heading", "b.section", "b.level")


@query
def block_dedupe(spark, sf_dir):
    return html.dedupe_blocks(lines(spark, sf_dir)).select("doc_id", "pos", "kind", F.md5("text").alias("text_md5"))


@query
def line_dedupe(spark, sf_dir):
    return html.dedupe_lines(t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query
def chunk_fixed_windows(spark, sf_dir):
    rows = chunking.windows_of(t(spark, sf_dir, "documents"))
    return rows.select("doc_id", "piece", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query
def chunk_token_windows(spark, sf_dir):
    """Windows of exactly so many tokens of an injected tokenizer, here words with the white space before them."""
    rows = chunking.windows_of(t(spark, sf_dir, "documents"), config=ChunkConfig(200, 30, 1), ends=tokens.Pattern())
    return rows.select("doc_id", "piece", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query
def section_groups(spark, sf_dir):
    return chunking.section_groups(lines(spark, sf_dir)).select("doc_id", F.col("group_no").cast("long").alias("group_no"), F.md5("heading").alias("heading_md5"), F.md5("text").alias("text_md5"))


def _documents_as_pages(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    none = F.lit(None).cast(html.BLOCKS)
    return docs.select(F.concat(F.lit("https://hub.example.com/"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("title"), F.col("text").alias("cleaned_text"), none.alias("blocks"))


@query
def chunk_documents(spark, sf_dir):
    own = chunking.chunk_documents(_documents_as_pages(spark, sf_dir))
    pages = chunking.chunk_documents(_extracted(spark, sf_dir))
    return own.unionByName(pages.drop("page_key")).select("chunk_id", "document_id", "url", "section", "heading", "token_count", "chunk_no", "content_hash", "text")


@query
def chunk_documents_sql(spark, sf_dir):
    """The chunks of chunk_documents, cut by a table function in SQL text."""
    own = _documents_as_pages(spark, sf_dir).withColumn("page_key", F.concat(F.lit("document "), "url"))
    pages = _extracted(spark, sf_dir).withColumn("page_key", F.concat(F.lit("page "), F.col("page_key").cast("string")))
    chunk_table.register(spark)
    blocks = chunk_table.block_rows(own).unionByName(chunk_table.block_rows(pages))
    cut = spark.sql("SELECT * FROM chunk_blocks(TABLE(SELECT * FROM {blocks}) PARTITION BY page_key ORDER BY pos)", blocks=blocks)
    return chunking.with_ids(cut).select("chunk_id", "document_id", "url", "section", "heading", "token_count", "chunk_no", "content_hash", "text")


@query
def sections_rollup(spark, sf_dir):
    docs = _extracted(spark, sf_dir)
    return chunking.to_documents(docs, chunking.chunk_documents(docs)).select("document_id", "url", F.array_join("sections", "|").alias("sections"), "chunk_count")


def _records(spark, sf_dir, edited: bool = False) -> DataFrame:
    """Documents as chunk records, each source a URL; edited: another text and hash for every seventh."""
    docs = t(spark, sf_dir, "documents")
    body = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")) if edited else F.col("text")
    url = F.concat(F.lit("https://hub.example.com/"), (F.col("doc_id") / 5).cast("long").cast("string"))
    return docs.select(F.col("doc_id").cast("string").alias("chunk_id"), body.alias("text"), url.alias("url"), text.content_hash(body).alias("content_hash"), F.col("doc_id").alias("pos"))


@query
def normalize_records(spark, sf_dir):
    own = _records(spark, sf_dir)
    again = own.filter("pos % 3 = 0").select("chunk_id", F.lit("another").alias("text"), "url", "content_hash", (F.col("pos") + 1_000_000_000).alias("pos"))
    blanks = own.filter("pos % 11 = 0").select(F.lit("  ").alias("chunk_id"), "text", "url", "content_hash", (F.col("pos") + 2_000_000_000).alias("pos"))
    return index.normalize_records(own.unionByName(again).unionByName(blanks)).select("id", F.md5("text").alias("text_md5"), "pos")


@query
def index_full(spark, sf_dir):
    return index.full(_records(spark, sf_dir))[0].select("id", "url", "content_hash")


def _refresh(spark, sf_dir):
    before = index.normalize_records(_records(spark, sf_dir)).filter("pos % 2 = 0")
    return index.incremental(before, _records(spark, sf_dir, edited=True))


@query
def index_incremental(spark, sf_dir):
    return _refresh(spark, sf_dir)[0].select("id", "url", "content_hash")


@query
def index_stale(spark, sf_dir):
    before = index.normalize_records(_records(spark, sf_dir)).filter("pos % 2 = 0")
    return index.stale(before, index.normalize_records(_records(spark, sf_dir, edited=True))).select("id", "url")


@query
def index_stats(spark, sf_dir):
    return _refresh(spark, sf_dir)[1]


@query
def index_hashes_by_url(spark, sf_dir):
    return index.hashes_by_url(index.normalize_records(_records(spark, sf_dir))).select("url", F.size("hashes").alias("n"), F.md5(F.array_join("hashes", "")).alias("hashes_md5"))


@query
def hash_embedding(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select("doc_id", embedding.hash_embedding("text").alias("v"))
    return rows.select("doc_id", F.posexplode("v").alias("slot", "x")).select("doc_id", "slot", F.round("x", 6).alias("value"))


def _pages(spark, sf_dir) -> DataFrame:
    """Pages, three of four of them moved to one site."""
    moved = F.regexp_replace("url", r"\Ahttps?://[^/?#]*", "https://hub.example.com")
    return t(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 4 != 0, moved).otherwise(F.col("url")).alias("url"), "html")


def _links(spark, sf_dir) -> DataFrame:
    """Each page's URL and variants of it as links in page order, at depths 0 to 9."""
    variants = F.array(F.col("url"), F.regexp_replace("url", r"\Ahttps:", "http:"), F.concat(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("/a.pdf")), F.concat(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("/b.PNG")), F.lit("mailto:x"), F.col("url"))
    rows = _pages(spark, sf_dir).select("page_id", F.posexplode(variants).alias("k", "raw"))
    return rows.select((F.col("page_id") * 10 + F.col("k")).alias("pos"), urls.normalize_url("raw").alias("url"), (F.col("page_id") % 10).cast("int").alias("depth"))


@query
def crawl_decisions(spark, sf_dir):
    return crawl.decisions(_links(spark, sf_dir), HUB, CrawlConfig(max_pages=60)).select("pos", "url", "depth", "decision")


@query
def crawl_stats(spark, sf_dir):
    return crawl.stats(crawl.decisions(_links(spark, sf_dir), HUB, CrawlConfig(max_pages=60)))


def _state(spark, sf_dir, unknown: bool = False) -> DataFrame:
    """What was known of the pages, half of it out of date; a URL's last page counts. unknown: not of every third page."""
    pages = _pages(spark, sf_dir)
    rows = (pages.filter("page_id % 3 <> 0") if unknown else pages).groupBy("url").agg(F.max("page_id").alias("pos"), F.max_by("html", "page_id").alias("html"))
    old = F.when(F.col("pos") % 2 == 0, text.content_hash("html")).otherwise(F.lit("0"))
    status = F.when(F.col("pos") % 5 == 0, "FAILED").when(F.col("pos") % 5 == 1, "PENDING").otherwise("PROCESSED")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return rows.select("pos", "url", title.alias("title"), old.alias("content_hash"), F.lit("").alias("last_scraped"), F.lit("").alias("last_updated"), status.alias("status"), F.lit("").alias("error"), F.array(F.concat("url", F.lit("/a.pdf"))).alias("document_links"))


@query
def crawl_outcomes(spark, sf_dir):
    status = F.when(F.col("page_id") % 17 == 0, 404).when(F.col("page_id") % 19 == 0, 403).otherwise(200)
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    fetched = _pages(spark, sf_dir).select("page_id", "url", F.col("url").alias("final_url"), status.alias("status_code"), title.alias("title"), "html", text.content_hash("html").alias("content_hash"))
    return crawl.outcomes(fetched, _state(spark, sf_dir, unknown=True), HUB).select("page_id", "url", "outcome", "status")


def _seed(spark, sf_dir) -> DataFrame:
    """All pages' URLs, in page order."""
    return _pages(spark, sf_dir).select(F.col("page_id").alias("pos"), urls.normalize_url("url").alias("url")).filter("url IS NOT NULL")


#: A budget and a depth beyond the fixture's pages.
WIDE = CrawlConfig(max_pages=10_000_000)


@query
def bfs_frontier(spark, sf_dir):
    """The link graph of the whole page table, breadth first from all pages."""
    pages = _pages(spark, sf_dir).select("page_id", F.coalesce(urls.normalize_url("url"), F.col("url")).alias("url"), "html")
    pages = pages.groupBy("url").agg(F.min_by(F.struct("page_id", "html"), "page_id").alias("p")).select("p.page_id", "url", "p.html")
    found = html.extract_pages(pages, HUB).select(F.col("url").alias("src"), F.col("page_key").alias("page_id"), F.posexplode("links").alias("k", "l"))
    edges = found.select("src", (F.col("page_id") * 100_000 + F.col("k")).alias("pos"), F.col("l.url").alias("dst"))
    return crawl.bfs(_seed(spark, sf_dir), edges, HUB, WIDE)


@query
def crawl_run(spark, sf_dir):
    """A whole crawl over the page table as a source: what each visited URL came to."""
    fetched, _, _ = crawl.crawl(_pages(spark, sf_dir), _seed(spark, sf_dir), _state(spark, sf_dir, unknown=True), HUB, WIDE)
    return fetched.select("url", "depth", "status_code", "outcome", "status")


def _answers(spark, sf_dir) -> DataFrame:
    """Pages as a site that fails now and then gives them: some are missing, some forbidden, and of some the first fetch meets an expired session."""
    pages = _pages(spark, sf_dir)
    status = F.when(F.col("page_id") % 5 == 0, 404).when(F.col("page_id") % 7 == 0, 403).otherwise(200).alias("status_code")
    good = pages.select((F.col("page_id") * 2 + 1).alias("page_id"), "url", "html", urls.normalize_url("url").alias("final_url"), status)
    expired = pages.filter("page_id % 3 = 0").select((F.col("page_id") * 2).alias("page_id"), "url", F.lit("").alias("html"), F.lit("https://hub.example.com/login").alias("final_url"), F.lit(200).alias("status_code"))
    return good.unionByName(expired)


#: A budget that a crawl of the fixture's pages runs into, again and again as fetches fail.
TIGHT = CrawlConfig(max_pages=40)


def _tight(spark, sf_dir):
    seed = _seed(spark, sf_dir).filter("pos % 4 = 1")
    return crawl.crawl(_answers(spark, sf_dir), seed, _state(spark, sf_dir, unknown=True), HUB, TIGHT)


@query
def crawl_budget(spark, sf_dir):
    """A crawl within a budget over a site that fails: places that failures free go to later links, in the sequential crawl's order."""
    return _tight(spark, sf_dir)[0].select("order_no", "url", "depth", "status_code", "outcome", "renewals")


@query
def crawl_budget_links(spark, sf_dir):
    """What becomes of each link of such a crawl, counted by page and decision."""
    decided = _tight(spark, sf_dir)[1]
    return decided.groupBy("order_no", "decision").agg(F.count(F.lit(1)).alias("n"))


@query
def requeue_expired(spark, sf_dir):
    """Every tenth page's session had expired; these come first again."""
    own = _pages(spark, sf_dir).select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("url"))
    outcome = F.when(F.col("page_id") % 10 == 0, "session_expired").otherwise("new").alias("outcome")
    return crawl.requeue(own.select("url", F.col("page_id").alias("order_no")), own.select("url", outcome)).select("url", "order_no")


def _asked(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question")).withColumnRenamed("conv_id", "query_id")


@query
def catalog_rank(spark, sf_dir):
    return crawl.rank_catalog(_state(spark, sf_dir), _asked(spark, sf_dir), HUB)


@query
def url_rank(spark, sf_dir):
    asked = _asked(spark, sf_dir).withColumn("question", F.concat("question", F.lit(" example com")))
    return crawl.rank_urls(_pages(spark, sf_dir).select("url"), asked, HUB)


@query
def catalog_fallback(spark, sf_dir):
    return crawl.search_catalog(_state(spark, sf_dir), _asked(spark, sf_dir), HUB, start_url="https://hub.example.com/")


@query
def state_upsert(spark, sf_dir):
    own = t(spark, sf_dir, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("error"))
    changes = own.select("url", "error", F.lit("FAILED").alias("status"), F.lit(None).cast("string").alias("title"))
    start = spark.range(10).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("kept").alias("title"), F.lit("h").alias("content_hash"), F.lit("").alias("last_scraped"), F.lit("").alias("last_updated"), F.lit("PROCESSED").alias("status"), F.lit("").alias("error"), F.array(F.lit("d")).alias("document_links"))
    return crawl.upsert_state(start, changes, "2000-01-01T00:00:00Z").select("url", "title", "content_hash", "status", "error", "last_updated", F.array_join("document_links", ",").alias("document_links"))


@query
def retry_urls(spark, sf_dir):
    return crawl.retry_urls(_state(spark, sf_dir))


@query
def status_counts(spark, sf_dir):
    return crawl.status_counts(_state(spark, sf_dir))


def _folder(spark, name: str) -> str:
    return f"{frames.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf_dir: str, name: str) -> DataFrame:
    # As a pattern, so that a table may be one file or a folder.
    return spark.readStream.schema(t(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.[p]arquet")


@query
def index_stream(spark, sf_dir):
    from quern.streaming import refresh

    own = index.Index(spark, _folder(spark, "index"), "id string, text string, url string, content_hash string, pos long")
    source = _stream(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://hub.example.com/"), (F.col("doc_id") / 5).cast("long").cast("string"))
    chunks = source.select(F.col("doc_id").cast("string").alias("chunk_id"), "text", url.alias("url"), text.content_hash("text").alias("content_hash"), F.col("doc_id").alias("pos"))
    refresh.index_stream(chunks, own, _folder(spark, "stream")).awaitTermination()
    return own.read().select("id", "url", "content_hash")


@query
def conversation_stream(spark, sf_dir):
    from quern.streaming import refresh

    out, at = _folder(spark, "turns"), _folder(spark, "stream")
    source = _stream(spark, sf_dir, "conversations")
    turns = source.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.lit("").alias("answer"))
    rows = refresh.conversation_stream(turns).withColumn("query", conversation.expand(F.col("question"), F.col("previous"))).drop("previous")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("conv_id long, turn long, question string, kept int, query string").parquet(out)


@query
def state_stream(spark, sf_dir):
    """The latest event of each user, from the changes that a stream of events makes to its state."""
    from quern.streaming import refresh

    out, at = _folder(spark, "state"), _folder(spark, "stream")
    # One number that orders events: microseconds, then the place of an id among ids.
    order = F.concat(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0")).alias("at")
    source = _stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), order, "event_id", "event_type")
    refresh.state_stream(source, out, at, order="at").awaitTermination()
    return refresh.read_state(spark, out, source.schema, order="at").select("url", "event_id", "event_type")


# Files, stores and reports: written to the shared folder and read back.


def _hub_pages(spark, sf_dir) -> DataFrame:
    """Pages as crawled ones, of which the URL's first counts."""
    rows = _pages(spark, sf_dir).groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return rows.select("url", F.col("url").alias("final_url"), F.lit(200).alias("status_code"), title.alias("page_title"), "html", text.content_hash("html").alias("content_hash"))


@query
def page_files(spark, sf_dir):
    """Page files of the newest crawl under a root: written, found by time and read."""
    root = _folder(spark, "crawls")
    files.write_pages(_hub_pages(spark, sf_dir).limit(0), f"{root}/crawl_20990101_000000")
    files.write_pages(_hub_pages(spark, sf_dir), f"{root}/{run_name('crawl')}")
    got, _ = files.read_pages(spark, files.page_folder(spark, root))
    return got.select("url", "final_url", "status_code", "page_title", "content_hash", F.md5("html").alias("html_md5"))


@query
def page_runs(spark, sf_dir):
    """Pages through the data source: two runs are written, and the newest one is read, failures told apart."""
    runs.register(spark)
    root, rows = _folder(spark, "crawls"), _hub_pages(spark, sf_dir)
    for name, part in (("crawl_2099", rows.limit(0)), (run_name("crawl"), frames.spread(rows))):
        part.write.format("quern_pages").mode("append").option("run", name).save(root)
    got = spark.read.format("quern_pages").load(root).filter("failure IS NULL")
    return got.select("url", "final_url", "status_code", "page_title", "content_hash", F.md5("html").alias("html_md5"))


@query
def page_run_stream(spark, sf_dir):
    """Runs of pages as a stream, into runs of another root: those of even and of odd lengths come one after the other."""
    runs.register(spark)
    root, out, at = (_folder(spark, n) for n in ("crawls", "copies", "stream"))
    rows = _hub_pages(spark, sf_dir)
    for odd in (0, 1):
        rows.filter(F.length("html") % 2 == odd).write.format("quern_pages").mode("append").option("run", f"crawl_{odd}").save(root)
        new = spark.readStream.format("quern_pages").load(root).filter("failure IS NULL").select("url", "html")
        sink = new.writeStream.format("quern_pages").option("stream", "copy").option("path", out).option("checkpointLocation", at)
        sink.trigger(once=True).start().awaitTermination()
    name = lambda odd: spark.read.format("quern_pages").option("run", f"crawl_copy_{odd:010d}").load(out).withColumn("batch", F.lit(odd))
    return name(0).unionByName(name(1)).select("url", "batch", F.md5("html").alias("html_md5"))


@query
def page_file_failures(spark, sf_dir):
    """Files that aren't pages are listed by name, whatever else is there."""
    folder = _folder(spark, "pages")
    body = F.when(F.col("page_id") % 3 == 0, F.lit("no page")).otherwise(F.to_json(F.struct("url", "html")))
    runs.write_files(t(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".txt")).alias("name"), body.alias("value")), folder)
    raw = spark.read.text(folder, wholetext=True).select("value", F.regexp_replace("_metadata.file_name", r"\.txt\z", "").alias("page"))
    bad = raw.filter(~files.is_object("value"))
    return bad.select("page", F.lit("not a JSON page").alias("error"))


def _chunk_rows(spark, sf_dir) -> DataFrame:
    docs = t(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://hub.example.com/"), (F.col("doc_id") / 5).cast("long").cast("string"))
    return docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "text", url.alias("url"), F.col("source").alias("page_title"), F.col("lang").alias("section"), text.content_hash("text").alias("content_hash"), url.alias("document_id"))


@query
def chunk_files(spark, sf_dir):
    """Chunks of the newest process run: JSON lines, invalid ones left out."""
    root, rows = _folder(spark, "processed"), _chunk_rows(spark, sf_dir)
    run = f"{root}/{run_name('process')}"
    files.write_run(rows.select("document_id").distinct(), rows, {"chunks": 1}, run)
    spark.createDataFrame([("no chunk",), ("[1]",)], "value string").write.mode("append").text(f"{run}/chunks.jsonl")
    return files.read_chunks(spark, files.process_run(spark, root)).select("chunk_id", "url", "page_title", "section", "document_id", F.md5("text").alias("text_md5"))


@query
def chunk_runs(spark, sf_dir):
    """Chunks through the data source: a process run of lines, of which those that are no objects become failures."""
    runs.register(spark)
    root, rows = _folder(spark, "processed"), _chunk_rows(spark, sf_dir)
    run = f"{root}/{run_name('process')}"
    files.write_run(rows.select("document_id").distinct(), rows, {"chunks": 1}, run)
    spark.createDataFrame([("no chunk",), ("[1]",)], "value string").write.mode("append").text(f"{run}/chunks.jsonl")
    got = spark.read.format("quern_chunks").load(root)
    return got.select("chunk_id", "url", "page_title", "section", "document_id", F.md5("text").alias("text_md5"), "failure")


@query
def nested_chunk_files(spark, sf_dir):
    """Chunks nested in document files, where there is no file of chunks."""
    run = _folder(spark, "process")
    inner = F.collect_list(F.struct("chunk_id", "url", F.lit("").alias("document_id"), "text")).alias("chunks")
    _chunk_rows(spark, sf_dir).groupBy("document_id").agg(inner).write.json(f"{run}/documents")
    return files.read_chunks(spark, run).select("chunk_id", "url", "document_id", F.md5("text").alias("text_md5"))


@query
def state_round_trip(spark, sf_dir):
    """State as records by URL, written and read; blank URLs go and a missing status is pending."""
    path = _folder(spark, "state")
    rows = _state(spark, sf_dir).drop("pos")
    odd = rows.limit(1).select(*(F.lit("").alias(c) if c in ("url", "status") else F.col(c) for c in rows.columns))
    bare = rows.withColumn("status", F.when(F.col("status") == "PENDING", "").otherwise(F.col("status")))
    files.write_state(bare.unionByName(odd), path, utc_now())
    return files.read_state(spark, path).select("url", "title", "content_hash", "status", F.array_join("document_links", ",").alias("document_links"))


def _stored(spark, sf_dir) -> index.Index:
    own = index.Index(spark, _folder(spark, "index"), "id string, text string, url string, content_hash string, pos long")
    own.refresh(_records(spark, sf_dir), "full")
    return own


@query
def index_get_by_ids(spark, sf_dir):
    """Records of asked ids, once each; unknown and repeated ids are asked for too."""
    own = _stored(spark, sf_dir)
    asked = t(spark, sf_dir, "embeddings").select((F.col("vec_id") * 2).cast("string").alias("id"))
    return index.get_by_ids(own.read(), asked.unionByName(asked)).select("id", "url", F.md5("text").alias("text_md5"))


@query
def index_get_by_metadata(spark, sf_dir):
    return index.get_by_metadata(_stored(spark, sf_dir).read(), url="https://hub.example.com/7").select("id", "url")


@query
def index_rewrites(spark, sf_dir):
    """Counts and live snapshots of an index over a full load, a refresh, a clear and another load."""
    own = _stored(spark, sf_dir)
    out = []

    def note(step: str) -> None:
        stats = health.statistics(own)
        out.append((len(out), step, stats["count"], stats["live"], stats["embedding_model"], ",".join(stats["sample_ids"])))

    note("full")
    own.refresh(_records(spark, sf_dir, edited=True))
    note("incremental")
    own.vacuum(1)
    own.clear()
    note("clear")
    own.refresh(_records(spark, sf_dir).filter("pos % 2 = 0"), "full")
    note("half")
    return spark.createDataFrame(out, "step_no int, step string, records long, live long, model string, peek string")


@query
def index_peek(spark, sf_dir):
    return _stored(spark, sf_dir).peek().select("id", "url")


@query
def health_report(spark, sf_dir):
    """Diagnoses of a filled, an unconfigured and an empty index, by their first point of failure."""
    own = _stored(spark, sf_dir)
    none = index.Index(spark, _folder(spark, "index"), own.schema)

    def broken(_):
        raise ValueError("api_key=secret")

    probe = lambda texts: [embedding.hash_vector(x).tolist() for x in texts]
    cases = {"filled": (own, probe, True), "no model": (own, probe, False), "no embedder": (own, None, True), "broken embedder": (own, broken, True), "empty": (none, probe, True)}
    rows = [(n, d["status"], d["failure_point"], d["error"], d["document_count"], d["dimensions"]) for n, d in ((n, health.diagnose(*c)) for n, c in cases.items())]
    return spark.createDataFrame(rows, "name string, status string, failure_point string, error string, documents long, dimensions int")


@query
def crawl_report(spark, sf_dir):
    """failed, skipped and counted URLs of a crawl as they are written, as (part, name, n)."""
    run = _folder(spark, "crawl")
    decided = crawl.decisions(_links(spark, sf_dir), HUB, CrawlConfig(max_pages=60))
    status = F.when(F.col("page_id") % 17 == 0, 404).when(F.col("page_id") % 19 == 0, 403).otherwise(200)
    fetched = _pages(spark, sf_dir).select("url", F.lit("https://hub.example.com/").alias("final_url"), status.alias("status_code"), F.lit("").alias("title"), F.lit("").alias("html"), F.lit("x").alias("content_hash"))
    parts = health.crawl_report(crawl.outcomes(fetched, _state(spark, sf_dir), HUB).select("url", "outcome", "status_code"), decided)
    files.write_report(parts, {"mode": "incremental"}, run)
    failed = spark.read.schema("error_type string").json(f"{run}/failed").groupBy(F.lit("failed").alias("part"), F.col("error_type").alias("name")).count()
    skipped = spark.read.schema("reason string").json(f"{run}/skipped").groupBy(F.lit("skipped").alias("part"), F.col("reason").alias("name")).count()
    return failed.unionByName(skipped).withColumnRenamed("count", "n")


@query
def process_report(spark, sf_dir):
    docs = _extracted(spark, sf_dir)
    documents = chunking.to_documents(docs, chunking.chunk_documents(docs))
    return health.process_report(t(spark, sf_dir, "pages").count(), 3, documents).select("input", "processed", "failed", "skipped")


@query
def page_source(spark, sf_dir):
    """Pages fetched from a table by URL; what it lacks is a 404."""
    source = page_sources.TableSource(_hub_pages(spark, sf_dir))
    asked = _hub_pages(spark, sf_dir).select("url")
    got = source.fetch(asked.unionByName(asked.select(F.concat("url", F.lit("/missing")).alias("url"))))
    return got.select("url", "final_url", "status_code", F.md5("html").alias("html_md5"))


class _Flaky:
    """A service that fails now and then: by its URL's digest a page comes at once, at the third attempt, or never."""

    def __init__(self):
        self.tries: dict[str, int] = {}

    def __call__(self, url: str) -> tuple[str, int, str]:
        self.tries[url] = self.tries.get(url, 0) + 1
        digit = hashlib.md5(url.encode()).hexdigest()[0]
        if digit == "0" or digit in "123" and self.tries[url] % 3:
            raise TimeoutError(url)
        return url, 200, f"<title>{url}</title>"


@query
def page_fetch_retries(spark, sf_dir):
    """All pages' URLs fetched from a service that fails now and then: each once, as a page or as a failure."""
    rows = t(spark, sf_dir, "pages").select("url").distinct()
    got = page_sources.FetchSource(_Flaky(), wait=lambda n: 0.0).fetch(rows)
    return got.select("url", "status_code", F.md5("html").alias("html_md5"), "error")


@query
def robots_allow(spark, sf_dir):
    """Rules of each host of the pages, of which a third have none, and what they allow."""
    rows = t(spark, sf_dir, "pages").select("page_id", "url")
    name = urls.host("url")
    hosts = rows.select(name.alias("host")).filter("host <> ''").distinct()
    strict = F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /en/1\nDisallow: /en/ # all else\nDisallow:\n")
    lax = F.lit("User-Agent: *\nDisallow: /fr\nAllow: /\n")
    bodies = hosts.select("host", F.when(F.length("host") % 3 == 0, strict).when(F.length("host") % 3 == 1, lax).alias("body"))
    return robots.allowed(rows, robots.rules_of(bodies, "crawler/1.0")).select("page_id", "allowed")


@query
def to_chunks(spark, sf_dir):
    """Records as chunks, with defaults for what is missing."""
    docs = t(spark, sf_dir, "documents")
    gone = lambda c, k: F.when(F.col("doc_id") % k == 0, F.lit("")).otherwise(F.col(c)).alias(c)
    rows = docs.select(F.col("doc_id").alias("chunk_id"), "text", gone("source", 2).alias("page_title"), gone("lang", 3).alias("title"), gone("lang", 4).alias("section"), F.col("source").alias("heading"))
    return retrieval.to_chunks(rows, LABEL).select("chunk_id", "title", "section", "url", F.md5("text").alias("text_md5"))


@query
def html_fallback(spark, sf_dir):
    """Documents as records that kept no HTML."""

    heads = [{"level": "h2", "text": "Part"}, {"level": "h9", "text": ""}]
    own = [{"url": "https://hub.example.com/x", "text": "more", "internal": True}, {"url": "https://o.example/", "text": "out", "internal": False}]

    def cleaned(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, titles, bodies = batch.columns
        texts = [html.clean_without_html(n, heads, b, own)["cleaned_text"] for n, b in zip(titles.to_pylist(), bodies.to_pylist())]
        return pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], names=["doc_id", "cleaned"])

    one_line = F.regexp_replace("text", r"\s+", " ")
    rows = t(spark, sf_dir, "documents").select("doc_id", "source", one_line.alias("text"))
    return rows.mapInArrow(frames.in_slices(cleaned), "doc_id long, cleaned string").select("doc_id", F.md5("cleaned").alias("cleaned_md5"))


@query
def placeholder_check(spark, sf_dir):
    value = F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).when(F.col("doc_id") % 3 == 1, F.lit("x-replace_with_key")).otherwise(F.col("source"))
    return t(spark, sf_dir, "documents").select("doc_id", text.configured(value).alias("configured"))


@query
def request_validation(spark, sf_dir):
    """What becomes of every turn's text as a request, with its conversation's id and its turn as the number of results."""
    rows = t(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", answer.verdict(F.col("text"), F.repeat(F.col("conv_id").cast("string"), F.lit(40)), F.col("turn")).alias("verdict"))


@query
def settings(spark, sf_dir):
    """What a site's configuration comes to if each page is a start URL: hosts, and the embedding model's name by provider."""
    rows = t(spark, sf_dir, "pages")
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" A.Example,, "), F.upper(urls.host("url")), F.lit(" ,"))).otherwise(F.lit(" , "))
    provider = F.when(F.col("page_id") % 2 == 0, "azure").otherwise("openai")
    deployment = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("d"), F.col("page_id").cast("string"))).otherwise("")
    return rows.select("page_id", F.array_join(urls.allowed_hosts(raw, "url"), ",").alias("hosts"), embedding.model_name(provider, F.lit("m"), deployment).alias("model"))


@query
def seeds(spark, sf_dir):
    """The start URL, a given list and what a state has to try again, in this order."""
    own = crawl.seeds(spark, ["https://hub.example.com/b", "HTTPS://HUB.example.com/a#x", "mailto:x"], "https://hub.example.com/", _state(spark, sf_dir))
    return own.select("url", F.when(F.col("pos") < 1 << 40, F.col("pos")).alias("place"))


@query
def unseen_urls(spark, sf_dir):
    """Discovered pages that were not seen before."""
    found = _pages(spark, sf_dir).select(urls.normalize_url("url").alias("url")).distinct()
    seen = _pages(spark, sf_dir).filter("page_id % 2 = 0").select(urls.normalize_url("url").alias("url"))
    return loop.unseen(found, seen)


@query
def processed_urls(spark, sf_dir):
    return crawl.processed_urls(_state(spark, sf_dir))


@query
def targeted_ingest(spark, sf_dir):
    """The first few of the asked pages are processed and indexed."""
    own = index.Index(spark, _folder(spark, "index"), "id string, text string, url string, content_hash string, pos long")
    wanted = [r.url for r in t(spark, sf_dir, "pages").orderBy("page_id").select("url").limit(7).collect()]
    n = loop.targeted_ingest(wanted, t(spark, sf_dir, "pages"), own)
    blocked = loop.targeted_ingest(wanted, t(spark, sf_dir, "pages"), own, has_session=False)
    return own.read().groupBy("url").agg(F.count(F.lit(1)).alias("chunks")).select("url", "chunks", F.lit(n).alias("ingested"), F.lit(blocked).alias("without_session"))


@query
def refresh_run(spark, sf_dir):
    """An incremental refresh of state and index from the page table: the state's new statuses."""
    own = index.Index(spark, _folder(spark, "index"), "id string, text string, url string, content_hash string, pos long")
    site = SiteConfig(allowed_hosts=HUB)
    # A URL's first page counts, whatever order the table is read in.
    first = _pages(spark, sf_dir).groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("p")).select("p.page_id", "url", "p.html")
    after, _ = loop.refresh(first, _state(spark, sf_dir, unknown=True).drop("pos"), own, site=site, now="2000-01-01T00:00:00Z")
    return after.select("url", "status")


@query
def insufficient_answers(spark, sf_dir):
    """First questions of all conversations, answered from what retrieval finds or refused."""
    rows = answer.answers(questions(spark, sf_dir), _hybrid(spark, sf_dir))
    return rows.select("query_id", "refused", F.md5("answer").alias("answer_md5"), "n_sources")


@query
def knowledge_loop(spark, sf_dir):
    """First questions of all conversations, asked of an empty index: pages are found in the catalog, ingested once for all, and searched."""
    pages = _pages(spark, sf_dir).groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("p")).select("p.page_id", "url", "p.html")
    state = _state(spark, sf_dir)
    own = index.Index(spark, _folder(spark, "index"), "id string, text string, page_title string, url string, section string, heading string, content_hash string, access string, pos long")

    def retrieve(asked: DataFrame) -> DataFrame:
        chunks = own.read().select(F.col("id").alias("chunk_id"), "text", F.col("page_title").alias("title"), "pos")
        return retrieval.keyword_topk(asked, chunks, RetrievalConfig().top_k)

    def ingest(wanted: DataFrame) -> DataFrame:
        got = frames.checkpointed(pages.join(frames.small(frames.checkpointed(wanted)), "url", "left_semi"))
        chunks = loop.process(got, SiteConfig(allowed_hosts=HUB))
        own.refresh(chunks.withColumn("pos", F.col("page_key") * 1_000_000 + F.col("chunk_no")))
        return got.select("url")

    discover = lambda asked, n: crawl.search_catalog(state, asked, HUB, n)
    answers, _, _ = loop.fill_gaps_together(_asked(spark, sf_dir), retrieve, discover, ingest, spark.createDataFrame([], "url string"))
    return answers
