"""Diagnostics of an index and its providers, without secrets, and crawl reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.index import Index


def list_indexes(index: Index) -> list[str]:
    """Folders beside the index that hold a manifest."""
    fs, path = index._path()
    root = path.getParent()
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(p.getName() for p in found if any(f.getPath().getName().startswith("manifest-") for f in fs.listStatus(p)))


def diagnose(index: Index, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None, model_configured: bool) -> dict:
    """Status and the first point of failure: index, embedding, embedding_config, empty_index, llm_config.

    Errors are given by kind alone, so that no message carries a secret.
    """
    out: dict = {"document_count": 0, "dimensions": None, "error": None, "failure_point": None, "llm_configured": model_configured}

    def fails(point: str, error: Exception | None = None) -> None:
        if out["failure_point"] is None:
            out["failure_point"], out["error"] = point, type(error).__name__ if error else None

    try:
        out["document_count"] = index.count()
    except Exception as e:
        fails("index", e)
    if embed is None:
        fails("embedding_config")
    else:
        try:
            out["dimensions"] = len(embed(["probe"])[0])
        except Exception as e:
            fails("embedding", e)
    if not out["document_count"]:
        fails("empty_index")
    if not model_configured:
        fails("llm_config")
    return out | {"status": "healthy" if out["failure_point"] is None else "unhealthy"}


def statistics(index: Index) -> dict:
    manifest = index.manifest()
    sample = index.peek().collect()  # five rows at most
    return {"count": index.count(), "embedding_model": manifest["embedding_model"], "live": manifest["live"], "sample_ids": [r["id"] for r in sample]}


def crawl_report(outcomes: DataFrame, decided: DataFrame) -> dict[str, DataFrame]:
    """failed, skipped and stats frames of a crawl, by outcome and by decision."""
    failed = outcomes.filter(F.col("outcome").isin("access_denied", "http_error"))
    kind = F.when(F.col("outcome") == "access_denied", "ACCESS_DENIED").otherwise("http_error")
    skipped = decided.filter(~F.col("decision").isin("queued", "duplicate", "external", "invalid")).select("url", F.col("decision").alias("reason"))
    unchanged = outcomes.filter("outcome = 'unchanged'").select("url", F.lit("unchanged_content").alias("reason"))
    counts = decided.groupBy(F.col("decision").alias("name")).count().unionByName(outcomes.groupBy(F.col("outcome").alias("name")).count())
    return {"failed": failed.select("url", kind.alias("error_type"), "status_code"), "skipped": skipped.unionByName(unchanged), "stats": counts}


def process_report(pages: int, failures: int, documents: DataFrame) -> DataFrame:
    """One row: input, processed, failed and skipped pages, and chunks."""
    sums = documents.agg(F.count(F.lit(1)).alias("processed"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))
    return sums.select(F.lit(pages).alias("input"), "processed", F.lit(failures).alias("failed"), (F.lit(pages) - F.col("processed")).alias("skipped"), "chunks")
