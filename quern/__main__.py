"""python -m quern crawl PAGES RUN [--state STATE] | process PAGES RUN | index full|incremental|clear|stats INDEX [RUN] | refresh PAGES ROOT INDEX

refresh is crawl, process and index in one: runs of the same time under ROOT, the state in ROOT/state. A step that fails ends
it; the next refresh goes on from the state before the crawl, which is written last.

Exit codes: 0 done, 1 failed, 2 bad arguments, 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable
from dataclasses import replace

SCHEMA = "id string, text string, page_title string, url string, section string, heading string, content_hash string, access string, token_count int, document_id string, pos long"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quern")
    commands = parser.add_subparsers(dest="command", required=True)
    crawl = commands.add_parser("crawl", help="a breadth-first crawl over a page table, to page files, a report and a state")
    crawl.add_argument("pages")
    crawl.add_argument("run")
    crawl.add_argument("--state", help="where the state of pages is read and written anew; default: RUN/state")
    refresh = commands.add_parser("refresh", help="a crawl whose pages are processed and go into an index")
    refresh.add_argument("pages")
    refresh.add_argument("root")
    refresh.add_argument("index")
    for command in (crawl, refresh):
        command.add_argument("--mode", choices=("full", "incremental"), default="incremental")
        command.add_argument("--max-pages", type=int, default=None)
        command.add_argument("--seed", action="append", default=[], help="a URL besides the start URL")
    process = commands.add_parser("process", help="page files or a page table to documents and chunks")
    process.add_argument("pages")
    process.add_argument("run")
    index = commands.add_parser("index", help="refresh, clear or look at an index")
    index.add_argument("mode", choices=("full", "incremental", "clear", "stats"))
    index.add_argument("index")
    index.add_argument("run", nargs="?")
    for command in (crawl, process, refresh):
        command.add_argument("--env", help="a file of NAME=value lines; QUERN_<FIELD> there or in the environment sets a field of the configuration")
    args = parser.parse_args(argv)
    if args.command == "index" and args.mode in ("full", "incremental") and not args.run:
        parser.error("this mode needs a run")
    try:
        return _run(args)
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"{type(e).__name__}: {e}".splitlines()[0], file=sys.stderr)
        return 1


def _configured(cls, args: argparse.Namespace):
    from quern.config import from_environment, read_env

    text = open(args.env, encoding="utf-8").read() if args.env else ""
    return from_environment(cls, "QUERN", read_env(text) | dict(os.environ))


def _run(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from quern.operators import health
    from quern.operators.index import Index

    spark = SparkSession.builder.getOrCreate()
    if args.command == "crawl":
        report, save = _crawl(args, spark, args.run, args.state or f"{args.run}/state")
        save()
    elif args.command == "process":
        report = _process(args, spark, args.pages, args.run)
    elif args.command == "refresh":
        report = _refresh(args, spark)
    else:
        own = Index(spark, args.index, SCHEMA)
        if args.mode == "clear":
            own.clear()
        report = _index(spark, own, args.run, args.mode) if args.mode in ("full", "incremental") else health.statistics(own)
    print(json.dumps(report))
    return 0


def _index(spark, own, run: str, mode: str) -> dict:
    from pyspark.sql import functions as F

    from quern.sources import files

    return own.refresh(files.read_chunks(spark, run).withColumn("pos", F.monotonically_increasing_id()), mode)


def _process(args: argparse.Namespace, spark, source: str, run: str) -> dict:
    from pyspark.sql import functions as F

    from quern.config import SiteConfig
    from quern.operators import chunking, health, html
    from quern.sources import files

    table = source.endswith(".parquet")
    pages, bad = (spark.read.parquet(source), None) if table else files.read_pages(spark, source)
    if not table:
        pages = pages.withColumn("page_id", F.monotonically_increasing_id())
    site = _configured(SiteConfig, args)
    docs = html.extract_pages(pages, site.allowed_hosts)
    chunks = chunking.chunk_documents(docs, source_label=site.source_label)
    documents = chunking.to_documents(docs, chunks)
    report = health.process_report(pages.count(), bad.count() if bad is not None else 0, documents).first().asDict()
    files.write_run(documents, chunks, report, run)
    return report


def _refresh(args: argparse.Namespace, spark) -> dict:
    from datetime import datetime, timezone

    from quern.config import run_name
    from quern.operators.index import Index

    at = datetime.now(timezone.utc)
    crawled, processed = (f"{args.root}/{run_name(step, at)}" for step in ("crawl", "process"))
    report, save = _crawl(args, spark, crawled, f"{args.root}/state")
    out = {"crawl": report, "process": _process(args, spark, f"{crawled}/pages", processed)}
    # Only a full crawl has all pages; else what is new or changed goes into the index.
    out["index"] = _index(spark, Index(spark, args.index, SCHEMA), processed, args.mode)
    save()
    return out


def _crawl(args: argparse.Namespace, spark, run: str, state: str) -> tuple[dict, Callable[[], None]]:
    """A crawl's report, its files being written under run, and what writes the state that it leads to."""
    from pyspark.sql import functions as F

    from quern.config import CrawlConfig, SiteConfig, utc_now
    from quern.operators import crawl, health
    from quern.sources import files

    site, now = _configured(SiteConfig, args), utc_now()
    config = replace(_configured(CrawlConfig, args), mode=args.mode)
    config = config if args.max_pages is None else replace(config, max_pages=args.max_pages)
    before = files.read_state(spark, state)
    seed = crawl.seeds(spark, args.seed, site.start_url, before, args.mode)
    fetched, decided, _ = crawl.crawl(spark.read.parquet(args.pages), seed, before, site.allowed_hosts, config)
    kept = fetched.filter(F.col("outcome").isin("new", "updated"))
    kept = kept.select("url", "final_url", "status_code", F.col("title").alias("page_title"), "headings", "visible_text", "content_hash", F.lit(now).alias("scraped_at"), F.lit(now).alias("crawl_timestamp"), "links", "html", "depth")
    files.write_pages(kept, run)
    counts = crawl.outcome_counts(fetched).first().asDict() | crawl.stats(decided).first().asDict() | {"mode": args.mode, "generated_at": now}
    files.write_report(health.crawl_report(fetched, decided), counts, run)
    changes = fetched.select("url", "title", "content_hash", "status", F.lit(now).alias("last_scraped"))
    after = crawl.checkpointed(crawl.upsert_state(before, changes, now))  # it may be written where it was read
    return counts, lambda: files.write_state(after, state, now)


if __name__ == "__main__":
    sys.exit(main())
