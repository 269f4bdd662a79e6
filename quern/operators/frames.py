"""What several operators do with whole frames: cut lineage, broadcast what is small, meet terms with texts."""

from __future__ import annotations

import hashlib
import heapq
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Bytes that a frame may hold at most to be broadcast.
BROADCAST_BYTES = 32 << 20
#: Questions, and distinct terms, that go to all tasks at a time.
QUESTIONS = 20_000
TERMS = 100_000
#: Characters that terms of questions are made of, and runs of them that a task remembers.
WORD = re.compile("[a-z0-9-]+")
KEPT_RUNS = 1 << 18
#: Times that words met in vain make up for another automaton, a word of it.
REBUILD = 3
#: Texts that are matched at a time.
TEXTS = 1024
#: Texts from which on terms are first looked for in the earliest ones, and the share of these.
HEAD_LEAST, HEAD = 20_000, 1 / 16
#: Rows of a batch that are worked on at a time where results are large.
SLICE = 64
#: Groups of a corpus's parts that a core goes through.
GROUPS_PER_CORE = 3
#: Rows of a range of a global order, and ranges at most.
RANGE_ROWS, RANGES = 50_000, 4_096


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of the machine's own only where Spark is on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quern-")
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the session's shared folder; a folder is set only where there is none."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, cheap to scan, marked for broadcast if its values take `most` bytes at most; else df as it is."""
    width = lambda f: F.lit(8) if isinstance(f.dataType, NumericType) else F.coalesce(F.length(F.col(f.name).cast("string")), F.lit(0))
    row = sum((width(f) for f in df.schema.fields), F.lit(16))
    held = df.limit(most // 24 + 1).agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(df) if held <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df, read from files, dealt over the session's cores if it has fewer files; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def in_groups(df: DataFrame) -> DataFrame:
    """df with neighbouring parts laid together, a few for each of the session's cores, without a shuffle.

    What a task keeps of all it has seen, like the k best, is then kept once for a group of parts and not for each part.
    """
    return df.coalesce(GROUPS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key over as many groups, each in order of key; for rows of few bytes, which would be laid together else."""
    return df.repartition(GROUPS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, key).sortWithinPartitions(key)


def in_slices(f: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = SLICE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, a few rows at a time, so that a task holds the results of these alone and not of a whole batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield f(batch.slice(at, rows))

    return run


def in_blocks(df: DataFrame, key: str, rows: int) -> Iterator[DataFrame]:
    """df in parts of about `rows` rows by hash of key, for what must go to all tasks."""
    n = -(-df.count() // rows)
    for i in range(n):
        yield df if n == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def running(df: DataFrame, order: list[str], value: str, name: str, how: Callable = F.sum, before: bool = False) -> DataFrame:
    """df with `name`: the sum or minimum (how) of value over all rows up to each one, or before it, by order, which has no ties.

    Rows are sorted by range over all tasks; what stands before a task's range comes from a table of the ranges.
    """
    parts = min(RANGES, -(-df.count() // RANGE_ROWS)) or 1
    rows = checkpointed(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    whole = rows.groupBy("__part").agg(how(value).alias("__whole"))
    earlier = how("__whole").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    inside = how(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    rows = rows.withColumn("__inside", inside).join(F.broadcast(whole.select("__part", earlier.alias("__earlier"))), "__part")
    total = F.coalesce("__inside", F.lit(0)) + F.coalesce("__earlier", F.lit(0)) if how is F.sum else F.least("__inside", "__earlier")
    return rows.withColumn(name, total).drop("__part", "__inside", "__earlier")


def automaton(terms: list[str], numbers: Iterable | None = None) -> ahocorasick.Automaton:
    """Meets all places of the terms in a text at once; a term is known by its place in the list, or by its number or other name."""
    out = ahocorasick.Automaton()
    for i, t in zip(range(len(terms)) if numbers is None else numbers, terms):
        out.add_word(t, i)
    out.make_automaton()
    return out


def _met(words: list[str]) -> Callable[[str], np.ndarray]:
    """For a text, the numbers of the words that are substrings of it; some may come more than once.

    Words of WORD's characters alone stand inside the text's longest runs of these. There are few different runs, so
    each is looked at once and kept, KEPT_RUNS at most.
    """
    machine = automaton(words)
    inside = lambda text: np.array([i for i in {i for _, i in machine.iter(text)}], np.int64)
    if not all(WORD.fullmatch(w) for w in words):
        return inside
    known: dict[str, np.ndarray] = {}
    none = np.empty(0, np.int64)

    def met(text: str) -> np.ndarray:
        found = [none]
        for run in set(WORD.findall(text)):
            own = known.get(run)
            if own is None:
                if len(known) >= KEPT_RUNS:
                    known.clear()
                own = known[run] = inside(run)
            if len(own):
                found.append(own)
        return np.concatenate(found)

    return met


def _firsts(words: list[str], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (key, pos, body) by (pos, key): the first k of them that hold each word.

    A word that has its k places needs to be met no more. Once such words have been met REBUILD times as often as there
    are words, the automaton is made anew of the others, so most texts are gone through for rare words alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, str]]] = [[] for _ in words]
        left = range(len(words))  # words without their k places when the automaton was made
        machine, idle = automaton(words), 0
        for batch in batches:
            if not left:
                continue  # all have their places; the rest is passed over
            for key, pos, body in zip(*(batch.column(c).to_pylist() for c in ("key", "pos", "body"))):
                for i in {i for _, i in machine.iter(body)}:
                    if len(best[i]) < k:
                        best[i].append((pos, key))
                    else:
                        idle += 1
                if idle >= REBUILD * len(left):
                    left, idle = [i for i in left if len(best[i]) < k], 0
                    if not left:
                        break
                    machine = automaton([words[i] for i in left], left)
        flat = [(words[i], key, pos) for i, own in enumerate(best) for pos, key in own]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat)], names=["term", "key", "pos"])

    return run


def first_holders(terms: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(term, key, pos, nth): the first k of texts (key string, pos long, body) by (pos, key) that hold each term as a substring.

    terms: distinct (term), no empty ones. Each text is gone through once for a block of terms, in order inside a task; each
    task keeps k places a term, and only those are shuffled. The earliest of many texts come first, as common terms have
    all their places there; the others are gone through for the rest of the terms alone.
    """
    schema = "term string, key string, pos long"

    def scan(terms: DataFrame, texts: DataFrame) -> DataFrame:
        source = in_groups(texts.select("key", "pos", "body")).sortWithinPartitions("pos", "key")
        parts = [source.mapInArrow(_firsts([r.term for r in block.collect()], k), schema) for block in in_blocks(terms, "term", TERMS)]
        return union(parts) if parts else terms.sparkSession.createDataFrame([], schema)

    terms = checkpointed(terms)
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("pos", HEAD, 1000).alias("head")).first()
    if size.n < HEAD_LEAST or size.head is None:
        found = scan(terms, texts)
    else:
        found = checkpointed(scan(terms, texts.filter((F.col("pos") < size.head) | F.col("pos").isNull())))
        full = found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        found = found.unionByName(scan(checkpointed(terms.join(full, "term", "left_anti")), texts.filter(F.col("pos") >= size.head)))
    nth = F.row_number().over(Window.partitionBy("term").orderBy("pos", "key"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= k)


def best_holders(questions: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score, rank): the k texts (key, body) that hold most of each question's terms; ties by key.

    questions: (query_id long, terms array), distinct terms. Texts without any are left out. A task takes its texts in order of
    key. Of those that hold the same terms only the first k can be among the best, so the others are passed over; the rest
    are counted a block at a time, by the rows of a question's own terms. Each task keeps k texts a question, and only
    those are shuffled.
    """

    def scorer(ids: list[int], lists: list[list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        words = sorted({t for own in lists for t in own})
        number = {t: i for i, t in enumerate(words)}
        asks = [np.array([number[t] for t in own], np.int64) for own in lists]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = _met(words)
            best: list[list[tuple[int, str]]] = [[] for _ in ids]
            worst = [0] * len(ids)  # each question's k-th score so far; a later text must hold more
            like: dict[bytes, int] = {}  # how many texts hold just these terms

            def close(rows: list[tuple[str, np.ndarray]]) -> None:
                held = np.zeros((len(words), len(rows)), np.uint8)
                for r, (_, own) in enumerate(rows):
                    held[own, r] = 1
                for q, own in enumerate(asks):
                    scores = np.add.reduce(held[own], axis=0, dtype=np.uint8 if len(own) < 256 else np.int32)
                    if scores.max() <= worst[q]:
                        continue
                    some = np.flatnonzero(scores > worst[q])
                    some = some[np.argsort(-scores[some].astype(np.int64), kind="stable")[:k]]
                    best[q] = heapq.nsmallest(k, best[q] + [(-int(scores[r]), rows[r][0]) for r in some])
                    if len(best[q]) == k:
                        worst[q] = -best[q][-1][0]

            rows: list[tuple[str, np.ndarray]] = []
            for batch in batches:
                for key, body in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist()):
                    own = np.unique(met(body))
                    kind = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    like[kind] = like.get(kind, 0) + 1
                    if len(own) and like[kind] <= k:
                        rows.append((key, own))
                    if len(rows) >= TEXTS:
                        close(rows)
                        rows = []
            if rows:
                close(rows)
            flat = [(q, key, -minus) for q, own in zip(ids, best) for minus, key in own]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat]), pa.array([x[2] for x in flat], pa.int32())], names=["query_id", "key", "score"])

        return run

    schema = "query_id long, key string, score int"
    parts = []
    # Dealt by key over all cores, as texts like these are few bytes and would be laid together.
    source = checkpointed(texts.select("key", "body").repartition(texts.sparkSession.sparkContext.defaultParallelism, "key").sortWithinPartitions("key"))
    for block in in_blocks(checkpointed(questions.select("query_id", "terms").filter(F.size("terms") > 0)), "query_id", QUESTIONS):
        rows = block.collect()
        parts.append(source.mapInArrow(scorer([r.query_id for r in rows], [r.terms for r in rows]), schema))
    if not parts:
        return questions.sparkSession.createDataFrame([], schema + ", rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return union(parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
