"""Approximate vector search: rows are dealt to cells round centres, and a question looks into the nearest few cells.

Centres come from k-means on a bounded sample; every row is indexed. Stored by cell, a search reads only the cells that
some question of its block asks for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.frames import QUESTIONS, in_blocks, union
from quern.operators.retrieval import DIGITS

#: Rows that centres are fitted on at most.
SAMPLE = 50_000


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def fit_centres(corpus: DataFrame, cells: int, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centres (cells x dimensions) of corpus (chunk_id, embedding), fitted on `sample` rows by hash of chunk_id."""
    some = corpus.filter("embedding IS NOT NULL").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    rows = some.select(array_to_vector(F.transform("embedding", lambda v: F.when(size > 0, v.cast("double") / size).otherwise(0.0))).alias("features"))
    return _unit(np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(rows).clusterCenters()))


def index_cells(corpus: DataFrame, centres: np.ndarray, path: str) -> DataFrame:
    """corpus with each row's cell, written under path by cell; rows without a vector are in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _unit(np.array(batch.column("embedding").to_pylist(), np.float64)) @ centres.T
                yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("embedding"), pa.array(near.argmax(axis=1), pa.int32())], names=["chunk_id", "embedding", "cell"])

    rows = corpus.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL")
    rows = rows.mapInArrow(run, "chunk_id string, embedding array<double>, cell int")
    # A large cell goes to several files.
    rows.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(4))).write.mode("overwrite").partitionBy("cell").parquet(path)
    return read_cells(rows.sparkSession, path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chunk_id string, embedding array<double>, cell int").parquet(path)


def vector_topk_cells(queries: DataFrame, indexed: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """(query_id, chunk_id, distance, rank) as vector_topk gives it, from the `probes` nearest cells of each question."""
    parts = []
    for block in in_blocks(queries.select("query_id", "vector").filter("vector IS NOT NULL"), "query_id", QUESTIONS):
        asked = block.toArrow().to_pydict()
        matrix = _unit(np.array(asked["vector"], np.float64))
        near = np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :probes]
        wanted = {c: np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near).tolist()}
        rows = indexed.filter(F.col("cell").isin([*wanted]))
        parts.append(rows.mapInArrow(_in_cells(asked["query_id"], matrix, wanted, k), "query_id long, chunk_id string, distance double"))
    best = union(parts) if parts else queries.sparkSession.createDataFrame([], "query_id long, chunk_id string, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _in_cells(ids: list[int], matrix: np.ndarray, wanted: dict[int, np.ndarray], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, str]]] = {}
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for c in np.unique(cells).tolist():
                own = batch.filter(pa.array(cells == c))
                names, questions = own.column("chunk_id").to_pylist(), wanted[c]
                far = np.round(1.0 - matrix[questions] @ _unit(np.array(own.column("embedding").to_pylist(), np.float64)).T, DIGITS) + 0.0
                for q, row in zip(questions.tolist(), far):
                    near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else range(len(row))
                    heaps[q] = heapq.nsmallest(k, heaps.get(q, []) + [(float(row[i]), names[i]) for i in near])
        flat = [(ids[q], name, d) for q, heap in heaps.items() for d, name in heap]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat]), pa.array([x[2] for x in flat], pa.float64())], names=["query_id", "chunk_id", "distance"])

    return run


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_queries, n_exact, n_met): how many of the exact neighbours were found."""
    met = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("met")), ["query_id", "chunk_id"], "left")
    return met.agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_exact"), F.count("met").alias("n_met"))
