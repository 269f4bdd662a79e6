"""Vector codes by product quantisation, with float32 products that are never trusted beyond their error.

A vector is cut into equal parts, and each part is named by the nearest entry of its codebook. Squared distances to all
entries come from one float32 matrix product; each has an interval that holds the exact value whatever the order
of the sums. Every entry whose interval reaches below the least upper end is worked out again in 64-bit integers,
and of equally near ones the first is taken. So the codes are those of integer arithmetic throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, join_hot, small

#: Vectors whose distances to all entries a task holds at a time.
ROWS = 1024
SCALE = 1024

#: Half the distance from 1 to the next float32, and to the next float64.
_U32, _U64 = 2.0**-24, 2.0**-53


def nearest(x: np.ndarray, book: np.ndarray, norms: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest row of book, squared distance) of each row of x; both are int64, and so are the results.

    Rounding x and book to float32 and adding d products in any order leaves the product of two vectors within
    (d + 3) u / (1 - (d + 3) u) of |x| |c|, u being half a unit; the sum with |c|^2 is done in float64, whose own error
    is added. Of equally near entries the first counts.
    """
    norms = (book * book).sum(axis=1) if norms is None else norms
    n, d = x.shape
    dots = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    gamma = (d + 3) * _U32 / (1 - (d + 3) * _U32)
    # Norms are rounded as well, by far less than the 1 % that is added.
    lengths = 1.01 * np.sqrt((x * x).sum(axis=1).astype(np.float64))[:, None] * np.sqrt(norms.astype(np.float64))[None, :]
    middle = norms.astype(np.float64)[None, :] - 2.0 * dots
    width = 2.0 * gamma * lengths + 4.0 * _U64 * (norms.astype(np.float64)[None, :] + 2.0 * np.abs(dots))
    width *= 1.01
    rows, entries = np.nonzero(middle - width <= (middle + width).min(axis=1)[:, None])
    exact = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 1 << 16):
        some = slice(at, at + (1 << 16))
        exact[some] = ((x[rows[some]] - book[entries[some]]) ** 2).sum(axis=1)
    starts = np.searchsorted(rows, np.arange(n))
    best = np.minimum.reduceat(exact, starts) if n else exact
    first = np.flatnonzero(exact == best[rows])
    return entries[first[np.searchsorted(rows[first], np.arange(n))]], best


def whole(vectors: pa.Array) -> np.ndarray:
    """Rows of floor(SCALE * component) in int64; all vectors have one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.floor(flat * SCALE).reshape(len(vectors), -1)
    if rows.size and np.abs(rows).max() > (largest := math.isqrt((1 << 61) // rows.shape[1])):
        raise ValueError(f"squared distances of components beyond {largest // SCALE} don't fit 64 bits: scale the vectors")
    return rows.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            own = batch.slice(at, ROWS)
            yield own, whole(own.column("vector"))


def usable(vector: Column) -> Column:
    """Whether a vector is kept: it isn't null or empty and holds no null and no non-finite component."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def fit(vectors: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """books (part, entry, place) after `rounds` rounds over vectors (vector): the mean, rounded down, of what each entry is nearest to.

    Each task adds up its vectors by part and entry; the sums meet by part and entry, and only means reach the driver.
    """
    parts, entries, width = books.shape
    for _ in range(rounds):
        norms = (books * books).sum(axis=2)

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books, norms: np.ndarray = norms) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts * entries, width), np.int64)
            count = np.zeros(parts * entries, np.int64)
            for _, rows in _blocks(batches):
                for p in range(parts):
                    own = rows[:, p * width : (p + 1) * width]
                    near, _ = nearest(own, books[p], norms[p])
                    np.add.at(total, near + p * entries, own)
                    count += np.bincount(near + p * entries, minlength=len(count))
            used = np.flatnonzero(count)
            arrays = [pa.array(used.astype(np.int32)), pa.array(count[used]), *(pa.array(total[used, i]) for i in range(width))]
            yield pa.RecordBatch.from_arrays(arrays, names=["entry", "n", *(f"s{i}" for i in range(width))])

        columns = [f"s{i}" for i in range(width)]
        schema = "entry int, n long, " + ", ".join(f"{c} long" for c in columns)
        met = vectors.select("vector").mapInArrow(sums, schema).groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns))
        books = books.copy()
        for r in met.collect():  # parts * entries rows at most
            books[r.entry // entries, r.entry % entries] = [r[c] // r.n for c in columns]
    return books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (vec_id, label_key, vector) as (vec_id, label_key, code, error): two hex digits a part, and the squared distance over all parts."""
    parts, _, width = books.shape
    norms = (books * books).sum(axis=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, vectors in _blocks(batches):
            code, error = np.empty((len(vectors), parts), np.uint8), np.zeros(len(vectors), np.int64)
            for p in range(parts):
                near, far = nearest(vectors[:, p * width : (p + 1) * width], books[p], norms[p])
                code[:, p] = near
                error += far
            arrays = [batch.column("vec_id"), batch.column("label_key"), pa.array([c.tobytes().hex() for c in code]), pa.array(error)]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label_key", "code", "error"])

    return rows.mapInArrow(run, "vec_id long, label_key string, code string, error long")


def compress(
    table: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): one row per row of table whose vector is usable.

    Codebooks start as the parts of the `entries` rows with the smallest ids; a null id is larger than any other, and rows of
    one id go by their vectors. With fewer rows a codebook is shorter. Each round gives every part to its nearest entry and
    replaces entries by means rounded down; unused ones stay. Rows without a vector, with an empty one, or with null or
    non-finite components have no row. Null labels are one label. Repeated rows are rows of their own, an empty table gives
    no rows, other columns are not read. Vectors of unlike lengths, a length that `parts` doesn't divide, over 256 entries
    and components whose squared distances don't fit 64 bits (131,072 and more at 64 components) are errors.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    label = F.coalesce(F.concat(F.lit("v"), F.col(label_col).cast("string")), F.lit("-"))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label_key"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(usable(F.col("vector")))
    lengths = rows.agg(F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b")).first()
    if lengths.a is None:
        none = F.lit(None)
        return rows.select("vec_id", none.cast("string").alias("code"), none.cast("long").alias("error"), none.cast("long").alias("label_error"), none.cast("string").alias("codebooks_sha256"))
    if lengths.a != lengths.b or lengths.a % parts:
        raise ValueError(f"vectors of {lengths.a} to {lengths.b} components can't be cut into {parts} equal parts")
    width = lengths.a // parts
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").toArrow()
    start = np.concatenate([whole(c) for c in first.column("vector").chunks])
    books = fit(rows, np.ascontiguousarray(start.reshape(len(start), parts, width).transpose(1, 0, 2)), rounds)
    coded = cut(encode(rows, books))
    labels = cut(coded.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    sums = labels.drop("n")
    few = small(sums)
    # If there are too many labels to be broadcast, those that hold many rows go by themselves.
    out = join_hot(coded, labels, "label_key", "n", coded.count()) if few is sums else coded.join(few, "label_key")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
