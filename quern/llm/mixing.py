"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents stand in a shuffled queue. A document's virtual finish time is the source's words up to and
including it divided by the source's target; passes over the source follow each other in the queue. Over all
sources, documents are taken by finish time while the running total stays within the budget.

Rows are sorted by range over all tasks, first each source's queue by its shuffle key and then all entries by finish
time. A running total is a part's own running total upon the totals of the parts before it, which are a small table,
so no source and no queue goes into one task. The mix is cut off where its running total passes the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, fresh, numbered, small, stable, with_rid

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
#: Rows that a part of the global order is meant to hold, and parts at most.
ROWS_PER_PART = 5_000
PARTS = 4_096


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes (source_key, source_size) with target and budget: `share` of all words split by weight, at most cap * source_size each.

    Weights go round the sources in the order of source_key. Sources are filled to a common level times their weight.
    Ordered by cap / weight, those before the first that the level doesn't fill get their cap, the rest their share.
    The table has a row for each source and is small beside the documents.
    """
    order = Window.orderBy("source_key")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(cap))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), "source_key")
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("before", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("left", F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    level = (F.col("budget") - F.col("before")) / F.col("left")
    first = F.min(F.when(level * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "source_key", level.alias("level"))))
    rows = rows.withColumn("level", first.over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return rows.select("source_key", "source_size", target.alias("target"), "budget")


def _sorted(rows: DataFrame, parts: int, *by: str) -> DataFrame:
    """rows in global order: `part` numbers the ranges, which are written to the shared folder."""
    return cut(rows.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()))


def _starts(rows: DataFrame, *groups: str) -> DataFrame:
    """(groups, part, start): words of a group before a part; a row for each part and group."""
    words = rows.groupBy(*groups, "part").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy(*(groups or (F.lit(0),))).orderBy("part"))
    return words.select(*groups, "part", "words", (upto - F.col("words")).alias("start"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """rid, id, size, source_size, target, times, taken: one row per row of docs; taken = times * size.

    A source is gone through ceil(cap) times at most. Null texts have no words; null sources are one source, the last.
    The shuffle key is md5(id + seed), a null id being an empty one; equal ids go by size, and repeated rows stand in
    file order. Texts are read once and only their word counts move. An empty table gives no rows. Other columns are
    not read.
    """
    source = F.coalesce(F.concat(F.lit("a"), F.col(source_col).cast("string")), F.lit("z")).alias("source_key")
    base = with_rid(stable(docs), id_col, text_col, source)
    key = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f"/{seed}")))
    base = cut(base.select("rid", "id", "source_key", n_words(F.col("text")).alias("size"), key.alias("key")))
    parts = min(PARTS, max(8, base.count() // rows_per_part))
    rows = _sorted(base, parts, "source_key", "key", "id", "size", "rid")
    starts = cut(_starts(rows, "source_key"))
    goals = targets(starts.groupBy("source_key").agg(F.sum("words").alias("source_size")), weights, share, cap)
    goals = cut(starts.select("source_key", "part", "start").join(goals, "source_key"))
    inside = Window.partitionBy("source_key", "part").orderBy("key", "id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    queue = rows.withColumn("upto", F.sum("size").over(inside)).join(small(goals), ["source_key", "part"]).drop("part")

    passes = F.sequence(F.lit(0), F.lit(int(-(-cap // 1)) - 1))
    at = (F.col("start") + F.col("upto") + F.col("p") * F.col("source_size")) / F.col("target")
    entry = queue.withColumn("p", F.explode(passes)).withColumn("finish", F.when(F.col("target") > 0, at).otherwise(F.lit(0.0)))
    order = ("finish", "source_key", "p", "key", "id", "size", "rid")
    entry = _sorted(entry.select(*order, "source_size", "target", "budget"), parts, *order)
    # Parts before the one in which the budget ends are taken whole; that one's own running total says how far it goes.
    sums = cut(_starts(entry))
    budget = entry.agg(F.first("budget").alias("budget"))
    ends = sums.crossJoin(F.broadcast(budget)).filter(F.col("start") + F.col("words") > F.col("budget"))
    last = cut(ends.agg(F.min_by(F.struct("part", "start", "budget"), "part").alias("l")).select("l.*")).first()
    if last.part is None:
        fits = F.lit(True)
    else:
        running = last.start + F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        inner = entry.filter(F.col("part") == last.part).withColumn("running", running).filter(F.col("running") <= last.budget)
        bound = inner.agg(F.max(F.struct(*order)).alias("bound"))
        entry = entry.join(F.broadcast(bound), F.lit(True), "left")
        fits = (F.col("part") < last.part) | ((F.col("part") == last.part) & F.coalesce(F.struct(*order) <= F.col("bound"), F.lit(False)))
    out = entry.groupBy("rid", "id", "size", "source_size", "target").agg(F.sum(fits.cast("long")).alias("times"))
    return out.withColumn("taken", F.col("times") * F.col("size"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: rows it takes twice stand there twice, and all columns are as they were, whatever their names.

    Rows without words are taken where their place in the queue is; repeated rows are told apart; an empty table stays empty.
    """
    docs = stable(docs)
    rid, times = fresh(docs, "__rid"), fresh(docs, "__times")
    plan = mix(docs, **how).filter("times > 0").select(F.col("rid").alias(rid), F.sequence(F.lit(1), F.col("times").cast("int")).alias(times))
    rows = numbered(docs, rid).join(small(cut(plan)), rid)
    return rows.withColumn(times, F.explode(times)).select(*(f"`{c}`" for c in docs.columns))
