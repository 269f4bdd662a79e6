"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is a polynomial in its normalised bytes. Fingerprints of parts combine by length-shifted
arithmetic, F(ab) = F(a) * B**len(b) + F(b), so a huge text is hashed part by part in any grouping. Texts with
equal fingerprint and length are then compared part by part while they stream past in sorted order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, join_hot, per_text, small, stable, with_rid, without

PART_BYTES = 1 << 16
#: Two primes below 2**31 and a base for each: a sum of PART_BYTES products of a byte and a power fits 64 bits.
PRIMES = ((2147483647, 911382323), (2147483629, 972663749))

_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _powers:
        for p, base in PRIMES:
            own = np.empty(PART_BYTES, np.uint64)
            x = 1
            for i in range(PART_BYTES - 1, -1, -1):
                own[i] = x
                x = x * base % p
            _powers.append(own)
    return _powers


def part_fingerprint(part: bytes) -> tuple[int, int, int]:
    """(F1, F2, length) of at most PART_BYTES bytes."""
    n = len(part)
    values = np.frombuffer(part, np.uint8).astype(np.uint64)
    values += np.uint64(1)
    return *(int(np.dot(values, own[PART_BYTES - n :])) % p for own, (p, _) in zip(_tables(), PRIMES)), n


def combine(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint of two texts laid end to end; associative, and (0, 0, 0) is neutral."""
    return *((x * pow(base, b[2], p) + y) % p for x, y, (p, base) in zip(a, b, PRIMES)), a[2] + b[2]


def fingerprint(data: bytes) -> tuple[int, int, int]:
    out = (0, 0, 0)
    for at in range(0, len(data), PART_BYTES):
        part = part_fingerprint(data[at : at + PART_BYTES])
        out = combine(out, part) if at else part
    return out


def same(a: bytes, b: bytes) -> bool:
    """Compare part by part and stop at the first part that differs."""
    if len(a) != len(b):
        return False
    x, y = memoryview(a), memoryview(b)
    return all(x[i : i + PART_BYTES] == y[i : i + PART_BYTES] for i in range(0, len(a), PART_BYTES))


def _digest(text: str | None) -> tuple[int, int, str]:
    data = (text or "").encode().lower()
    a, b, n = fingerprint(data)
    return a << 31 | b, n, hashlib.sha256(data).hexdigest()


def _part(text: str) -> tuple[bytes]:
    return (np.array(fingerprint(text.encode().lower()), "<i8").tobytes(),)


def _joined(parts: list[bytes]) -> tuple[int, int]:
    a, b, n = reduce(combine, (tuple(np.frombuffer(p, "<i8").tolist()) for p in parts))
    return a << 31 | b, n


def _huge(rows: DataFrame, part_chars: int) -> DataFrame:
    """rid, id, fp, n, text_sha256 of rows whose texts are cut into parts that many tasks hash at once."""
    text = F.coalesce("text", F.lit(""))
    sha = F.sha2(F.translate(text, ascii_uppercase, ascii_lowercase).cast("binary"), 256)
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / part_chars).cast("int"))
    parts = rows.select("rid", "text", F.explode(starts).alias("part"))
    parts = parts.select("rid", "part", F.substring("text", F.col("part") * part_chars + 1, F.lit(part_chars)).alias("text"))
    prints = per_text(parts.repartition("rid", "part"), _part, "f binary").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("part", "f"))).alias("fs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_joined([x["f"] for x in fs]) for fs in batch.column("fs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), *(pa.array([x[k] for x in own], pa.int64()) for k in range(2))], names=["rid", "fp", "n"])

    prints = prints.mapInArrow(run, "rid long, fp long, n long")
    return rows.select("rid", "id", sha.alias("text_sha256")).join(prints, "rid").select("rid", "id", "fp", "n", "text_sha256")


def _first_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, rep) of rows sorted by (fp, n, salt, rid): rep is the first of the salt with the same text.

    Texts stream past; one of each class of a salt is held.
    """
    group, held = None, []
    for batch in batches:
        reps: list[int] = []
        keys = zip(*(batch.column(c).to_pylist() for c in ("fp", "n", "salt")))
        for key, rid, text in zip(keys, batch.column("rid").to_pylist(), batch.column("text")):
            data = (text.as_py() or "").encode().lower()
            if key != group:
                group, held = key, []
            rep = next((r for r, known in held if same(known, data)), None)
            if rep is None:
                held.append((rid, data))
            reps.append(rid if rep is None else rep)
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(reps, pa.int64())], names=["rid", "rep"])


def _classes(rows: DataFrame, marks: DataFrame, rows_per_salt: int) -> DataFrame:
    """(rid, rep) of rows whose fingerprint others have: rep is one row of their class of equal texts.

    A group of over rows_per_salt rows is compared in salts of about so many; the first of each class in each salt
    goes to the next round, in which there are fewer, until one salt holds all that are left.
    """
    groups = cut(marks.groupBy("fp", "n").count().filter("count > 1"))
    todo = marks.select("rid", "fp", "n").join(small(groups), ["fp", "n"])
    out, before = None, None
    while True:
        salts = F.ceil(F.col("count") / rows_per_salt)
        named = todo.select("rid", "fp", "n", F.pmod(F.xxhash64("rid"), salts).alias("salt"), (salts > 1).alias("more"))
        texts = rows.select("rid", "text").join(small(named), "rid").repartition("fp", "n", "salt").sortWithinPartitions("fp", "n", "salt", "rid")
        found = texts.select("rid", "fp", "n", "salt", "text").mapInArrow(_first_equal, "rid long, rep long")
        found = cut(found.join(named, "rid").select("rid", "rep", "fp", "n", "more"))
        step = found.select("rid", "rep")
        out = step if out is None else cut(out.withColumnRenamed("rep", "via").join(step.withColumnRenamed("rid", "via"), "via", "left").select("rid", F.coalesce("rep", "via").alias("rep")))
        left = found.filter("more AND rid = rep").select("rid", "fp", "n")
        sizes = left.groupBy("fp", "n").count()
        waiting = left.count()
        if not waiting:
            return out
        # Unlike texts of one fingerprint don't become fewer by rounds; then they meet all at once.
        rows_per_salt = rows_per_salt if before is None or waiting < before else waiting
        before, todo = waiting, left.join(small(cut(sizes)), ["fp", "n"])


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_salt: int = 2000, huge_chars: int = 1 << 25, part_chars: int = 1 << 22
) -> DataFrame:
    """One row per row of docs: rid, id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id of a group stays.
    A null id is smaller than any other; of rows that share the largest id the first in file order stays. Texts of
    over huge_chars are hashed in parts by many tasks. An empty table gives an empty result; other columns are not read.
    """
    rows = with_rid(stable(docs), id_col, text_col)
    huge = F.coalesce(F.length("text"), F.lit(0)) > huge_chars
    marks = per_text(rows.filter(~huge), _digest, "fp long, n long, text_sha256 string").unionByName(_huge(rows.filter(huge), part_chars))
    marks = cut(marks)
    members = cut(marks.select("rid", "id").join(_classes(rows, marks, rows_per_salt), "rid"))
    best = F.max(F.struct("id", (-F.col("rid")).alias("first")))
    classes = cut(members.groupBy("rep").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"), F.count(F.lit(1)).alias("n")))
    classes = classes.select("rep", F.col("best.id").alias("keep_id"), (-F.col("best.first")).alias("keep_rid"), "group_size", "n")
    info = join_hot(members.select("rid", "rep"), classes, "rep", "n", members.count())
    info = info.select("rid", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"))
    alone = F.col("group_size").isNull()
    return marks.join(info, "rid", "left").select(
        "rid", "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
        "text_sha256",
    )


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were, whatever their names.

    Null and empty texts are one group; ties and repeated rows go as in exact_duplicates; an empty table stays empty.
    """
    docs = stable(docs)
    return without(docs, exact_duplicates(docs, id_col, text_col, **how).filter("not kept"))
