"""From raw documents to token ids: quality rules, exact dedup, near-dedup, mixing, encoding.

Each stage reads the five columns of documents and gives them back, but for the last; extra columns are left out, whatever
their names. Null texts are empty ones, a null id or source is a value like any other, texts of any length are read
whole, repeated rows are told apart, and an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from quern.llm.common import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of policy 1 keep; null and empty texts have too few words. Repeated rows are judged alike."""
    return quality_rules.passing(docs.select(*COLUMNS), quality_rules.POLICIES[1])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id; of repeated rows the first in file order. Null and empty texts are equal."""
    return exact_dedup.without_exact_duplicates(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles, the one with the smallest id, the first in file order if that occurs twice."""
    return simhash.without_near_duplicates(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that the mix takes twice stands there twice. A null source is the last one."""
    return mixing.mixed(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document of the mix with its token ids and the text that they decode to; null and empty texts have no ids."""
    return bpe.encoded(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("source_mixing", mix),
    ("bpe_encoding", encode),
]

#: SimHash links and BPE ids are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
