"""Where pages come from: an interface, and the one over a table."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.calls import back_off, called


class PageSource(Protocol):
    def fetch(self, urls: DataFrame) -> DataFrame:
        """(url, final_url, status_code, html) of (url)."""


class TableSource:
    """Pages of a table (url, html); others are not found."""

    def __init__(self, pages: DataFrame):
        self.pages = pages.select("url", "html")

    def fetch(self, urls: DataFrame) -> DataFrame:
        rows = urls.select("url").join(self.pages, "url", "left")
        return rows.select("url", F.col("url").alias("final_url"), F.when(F.col("html").isNull(), 404).otherwise(200).alias("status_code"), "html")


class FetchSource:
    """Pages of an injected fetch: url -> (final_url, status_code, html). What keeps failing is a row with an error and no status."""

    def __init__(self, fetch: Callable[[str], tuple[str, int, str]], attempts: int = 3, wait: Callable[[int], float] = back_off):
        self.one, self.attempts, self.wait = fetch, attempts, wait

    def fetch(self, urls: DataFrame) -> DataFrame:
        """(url, final_url, status_code, html, error) of (url); each URL is asked for by itself, and again after a failure."""
        one = self.one
        return called(urls.select("url"), "url", lambda us: [(i, one(u)) for i, u in enumerate(us)], "final_url string, status_code int, html string", 1, self.attempts, self.wait)
