"""Thin queries over the operators: one for each, with production parameters and over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, chat_format, exact_dedup, lexical_search, lm_scoring, mixing, quality_model, quality_rules, simhash, suffix_dedup, token_counts, url_filter, vector_codes
from quern.llm.common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = F.lit("</s>[INST] ok [/INST]").alias("text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, probe)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_digests(chat_format.expand(chat_format.format_conversations(rows), with_text=True))


def chat_digests(examples: DataFrame) -> DataFrame:
    """A row for each conversation of examples with texts: what is read back from the text, and what stands under the loss mask."""
    own = F.when(F.col("example").isNotNull(), F.struct("example", F.col("loss_start").alias("start"), F.col("loss_end").alias("end")))
    whole = examples.groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("spans"), F.max("text").alias("text"))
    said = F.array_join(F.transform(chat_format.under_mask(F.col("text"), F.col("spans")), chat_format.unescape), "")
    out = whole.select("conv_id", "text", F.size("spans").alias("n_examples"), said.alias("said"), chat_format.read_back(F.col("text")).alias("turns"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(flat, "UTF-8"), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2(F.encode("said", "UTF-8"), 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
        F.col("n_examples").cast("long").alias("n_examples"),
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, max_bits=2)
    return rows.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    rows = quality_model.score(docs, model)
    return rows.select(F.col("id").alias("doc_id"), quality_model.in_fold(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = quality_rules.rejects(quality_rules.BASE)
    return book.select(F.col("id").alias("doc_id"), *measures, failed.alias("base_failed"), (~failed & ~quality_rules.rejects(quality_rules.POLICIES[1])).alias("kept"), "failed")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy does by itself, from the ledger's bits."""
    return quality_rules.ablation(quality_rules.ledger(table(spark, sf_dir, "documents")), quality_rules.POLICIES[1])


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm_scoring.lm_scores(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"), length=200, keep_first=False, with_text=False)
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


#: The stated rules: what a URL is held against, and what becomes of it.
URL_RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))
    return rows.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)
    return rows.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)


_ALL = (
    op1_chat_formatting, op2_source_mixing, op3_simhash_near_dedup, op4_bpe_round_trip, op5_quality_model, op6_token_counts,
    op7_quality_rules, quality_ablation, op8_lm_scoring, op9_suffix_dedup, op10_exact_dedup,
    op11_url_filter, op12_lexical_search, op13_vector_codes,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
