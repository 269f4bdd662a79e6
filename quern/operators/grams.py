"""Substring search by an inverted index of grams.

A text gives its distinct grams, runs of three characters that a term may hold; a term can only stand in texts that hold
all of its grams. Lists of where a gram occurs are sorted and kept in Parquet folders by bucket of grams, in stripes of
about STRIPE_TEXTS texts in order of their place. A search reads the buckets of the asked grams alone, intersects
their lists stripe by stripe from the first, and looks at the texts of what is left to see which hold the term. It
stops reading for a term as soon as enough texts are found, so a common term takes the first stripes only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.frames import TERMS, checkpointed, in_blocks, small, union

#: Characters that terms are made of, as the pattern of terms has them.
ALPHABET = b"abcdefghijklmnopqrstuvwxyz0123456789-"
SIZE = 3
BUCKETS = 16
STRIPE_TEXTS = 1024
#: Entries that a task gathers before it writes lists, and stripes that a search begins with.
GATHERED = 1 << 21
#: Candidates of a stripe that a term's first look takes for each text that is wanted, and how many times more the next one takes.
TAKEN, TIMES = 16, 16
FIRST_STRIPES = 2

_BASE = len(ALPHABET) + 1
_CODES = np.zeros(256, np.int64)
_CODES[list(ALPHABET)] = np.arange(1, _BASE)
_LISTS = "bucket int, stripe int, gram int, n int, places binary"


def grams(text: str | None) -> np.ndarray:
    """Distinct grams of a text as sorted numbers; those with a character beyond the alphabet are none."""
    codes = _CODES[np.frombuffer((text or "").encode(), np.uint8)]
    if len(codes) < SIZE:
        return np.empty(0, np.int64)
    parts = [codes[i : len(codes) - SIZE + 1 + i] for i in range(SIZE)]
    whole = np.logical_and.reduce([p > 0 for p in parts])
    return np.unique(reduce(lambda a, b: a * _BASE + b, parts)[whole])


def indexable(term: str) -> bool:
    return len(term) >= SIZE and all(c in ALPHABET for c in term.encode())


def _packed(places: np.ndarray) -> bytes:
    """Sorted places as their first and the steps to the next."""
    return np.diff(places, prepend=0).astype("<i8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<i8"))


class GramIndex:
    """Lists of texts (key, pos, body) under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, texts: DataFrame | None = None):
        """texts: the frame that the index was built from, if it is at hand; candidates are looked at there."""
        self.spark, self.path, self.texts = spark, path.rstrip("/"), texts

    def read(self) -> DataFrame:
        return self.spark.read.schema(_LISTS).parquet(f"{self.path}/lists")

    @classmethod
    def build(cls, texts: DataFrame, path: str, buckets: int = BUCKETS, stripe_texts: int = STRIPE_TEXTS) -> GramIndex:
        """The index of texts (pos long, body string); a null pos stands before all others, a null body holds nothing.

        Stripes are cut at quantiles of pos, so their number follows the table's rows and not the range of places; texts
        with one place share a stripe. Other columns are not read.
        """
        own = texts.select(_place("pos"), F.col("body").cast("string").alias("body"))
        n = own.count()
        stripes = max(1, -(-n // stripe_texts))
        cuts = own.select("pos").approxQuantile("pos", [i / stripes for i in range(1, stripes)], 0.1 / stripes) if stripes > 1 else []
        bounds = np.unique(np.array(cuts, np.float64)).astype(np.int64)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: list[np.ndarray] = []
            places: list[np.ndarray] = []
            held = 0

            def lists() -> pa.RecordBatch:
                gram, place = np.concatenate(found), np.concatenate(places)
                stripe = np.searchsorted(bounds, place, side="right")
                order = np.lexsort((place, gram, stripe))
                gram, place, stripe = gram[order], place[order], stripe[order]
                new = np.flatnonzero(np.diff(gram, prepend=-1) | np.diff(stripe, prepend=-1))
                ends = [*new[1:].tolist(), len(gram)]
                own = [np.unique(place[a:b]) for a, b in zip(new.tolist(), ends)]
                columns = [pa.array(gram[new] % buckets, pa.int32()), pa.array(stripe[new], pa.int32()), pa.array(gram[new], pa.int32())]
                return pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in own], pa.int32()), pa.array([_packed(x) for x in own])], names=["bucket", "stripe", "gram", "n", "places"])

            for batch in batches:
                for pos, body in zip(batch.column("pos").to_pylist(), batch.column("body")):
                    some = grams(body.as_py())
                    found.append(some)
                    places.append(np.full(len(some), pos))
                    held += len(some)
                    if held >= GATHERED:
                        yield lists()
                        found, places, held = [], [], 0
            if held:
                yield lists()

        lists = own.mapInArrow(gather, _LISTS).repartition("bucket", "stripe").sortWithinPartitions("bucket", "stripe", "gram")
        lists.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lists")
        stats = texts.sparkSession.createDataFrame([(int(len(bounds) + 1), buckets)], "stripes int, buckets int")
        stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        return cls(texts.sparkSession, path, texts)

    def asked(self, terms: list[str], first: int, last: int, buckets: int) -> DataFrame:
        """Lists of the grams of terms in stripes first to last; other buckets' folders are not opened."""
        wanted = sorted({int(g) for t in terms for g in grams(t)})
        rows = self.read().filter(F.col("bucket").isin(sorted({g % buckets for g in wanted})) & F.col("stripe").between(first, last))
        only = self.spark.createDataFrame([(g,) for g in wanted], "gram int")  # there are len(ALPHABET) ** 3 grams at most
        return rows.join(F.broadcast(only), "gram", "left_semi")

    def first_holders(self, terms: DataFrame, texts: DataFrame, k: int) -> DataFrame:
        """(term, key, pos, nth): the first k of texts (key, pos, body) by (pos, key) that hold each term as a substring.

        texts are those of the index. terms: distinct (term), of SIZE characters of the alphabet at least; they are taken in
        blocks. Rows are as frames.first_holders has them.
        """
        stats = self.spark.read.schema("stripes int, buckets int").parquet(f"{self.path}/stats").first()
        own = texts.select(F.col("key").cast("string").alias("key"), _place("pos"), F.col("body").cast("string").alias("body"))
        parts = [p for block in in_blocks(terms, "term", TERMS) for p in self._rounds([r.term for r in block.collect()], own, k, stats.stripes, stats.buckets)]
        if not parts:
            return self.spark.createDataFrame([], "term string, key string, pos long, nth int")
        nth = F.row_number().over(Window.partitionBy("term").orderBy("pos", "key"))
        pos = F.when(F.col("pos") == _NONE, F.lit(None)).otherwise(F.col("pos"))
        return union(parts).withColumn("nth", nth).filter(F.col("nth") <= k).withColumn("pos", pos)

    def _rounds(self, terms: list[str], texts: DataFrame, k: int, stripes: int, buckets: int) -> list[DataFrame]:
        """What is found round by round. A round takes a range of stripes and, of each, a term's next candidates.

        Candidates up to a term's horizon, the last one taken of a stripe that has more, were all looked at; so texts up to
        there are the term's first ones. A term that still lacks texts goes on behind its horizon, with more candidates at a
        time, or else with the next range of stripes.
        """
        if odd := [t for t in terms if not indexable(t)]:
            raise ValueError(f"terms have {SIZE} or more characters of the index's alphabet: {odd[0]!r}")
        out, missing = [], dict.fromkeys(terms, k)
        first, last = 0, FIRST_STRIPES - 1
        while missing and first < stripes:
            here, missing, take = {t: (n, _NONE - 1) for t, n in missing.items()}, {}, TAKEN * k
            while here:
                rows, found, horizon = self._look(here, texts, self.asked([*here], first, last, buckets), take)
                out.append(rows)
                left = {t: n - found.get(t, 0) for t, (n, _) in here.items() if found.get(t, 0) < n}
                missing |= {t: n for t, n in left.items() if t not in horizon}
                here = {t: (n, horizon[t]) for t, n in left.items() if t in horizon}
                take *= TIMES
            first, last = last + 1, 8 * (last + 1) - 1
        return out

    def _look(self, here: dict[str, tuple[int, int]], texts: DataFrame, lists: DataFrame, take: int) -> tuple[DataFrame, dict[str, int], dict[str, int]]:
        """(rows up to each term's horizon that hold it, how many those are, horizons) for terms (missing, behind)."""
        met = lists.groupBy("stripe").applyInArrow(_intersect({t: behind for t, (_, behind) in here.items()}, take), "pos long, terms array<string>, ends array<string>")
        met = checkpointed(met)
        # A text meets all terms that it may hold at once.
        held = F.filter("terms", lambda t: F.contains(F.col("body"), t))
        hits = texts.join(small(met.select("pos", "terms")), "pos").select("key", "pos", F.explode(held).alias("term")).select("term", "key", "pos")
        ends = met.filter(F.size("ends") > 0).select("pos", F.explode("ends").alias("term")).groupBy("term").agg(F.min("pos").alias("horizon"))
        ends = {r.term: r.horizon for r in ends.collect()}
        if ends:
            horizon = self.spark.createDataFrame([*ends.items()], "term string, horizon long")
            hits = hits.join(F.broadcast(horizon), "term", "left").filter("horizon IS NULL OR pos <= horizon").drop("horizon")
        hits = checkpointed(hits)
        return hits, {r.term: r.n for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}, ends


#: Where texts without a place stand.
_NONE = -(1 << 62)
_EMPTY = np.empty(0, np.int64)


def _place(c: str):
    return F.coalesce(F.col(c).cast("long"), F.lit(_NONE)).alias("pos")


def _intersect(after: dict[str, int], take: int):
    """For a stripe's lists (gram, places): each place with the terms that have it among their next `take`, and those for which others follow it.

    A term's places are those behind after[term] that hold all its grams.
    """
    asked = {term: [int(g) for g in grams(term)] for term in after}

    def run(lists: pa.Table) -> pa.Table:
        held: dict[int, np.ndarray] = {}
        for gram, data in zip(lists.column("gram").to_pylist(), lists.column("places")):
            own = _unpacked(data.as_py())
            held[gram] = np.union1d(held[gram], own) if gram in held else own
        terms: dict[int, list[str]] = defaultdict(list)
        ends: dict[int, list[str]] = defaultdict(list)
        for term, behind in after.items():
            own = sorted((held.get(g, _EMPTY) for g in asked[term]), key=len)
            if not len(own[0]):
                continue
            left = own[0][np.searchsorted(own[0], behind, side="right") :]
            for other in own[1:]:
                at = np.minimum(np.searchsorted(other, left), len(other) - 1)
                left = left[other[at] == left]
            some = left[:take].tolist()
            for place in some:
                terms[place].append(term)
            if len(left) > take:
                ends[some[-1]].append(term)
        places = sorted(terms)
        kinds = pa.list_(pa.string())
        return pa.table({"pos": pa.array(places, pa.int64()), "terms": pa.array([terms[p] for p in places], kinds), "ends": pa.array([ends.get(p, []) for p in places], kinds)})

    return run
