"""Quality rules kept in a bitmask ledger.

Every rule is evaluated once for each text. The ledger stores a failure bit for each rule beside the measurements,
so that policies (named sets of rules) and ablations are later bit operations and never read a text again.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import per_text, with_rid

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
_SPACE = b" \t\n\r\x0b\x0c"
#: 1 for white space, 0 for letters, usual punctuation and all beyond ASCII, 2 for other bytes; a word with a 2 is odd.
_KIND = np.array([1 if x in _SPACE else 0 if x > 127 or chr(x).isalpha() or x in b".,;:?'\"()-" else 2 for x in range(256)], np.uint8)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaim", "n_odd_words")

#: Rule name to the condition under which a text fails; the position is the bit. Rules are only ever appended.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "repeated_lines": "n_dup_lines >= 2 AND 100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "exclamations": "100 * n_exclaim > 50 * n_words",
    "odd_words": "n_words >= 20 AND 100 * n_odd_words > 40 * n_words",
}


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy(0, ("few_words", "repeated_words"))
POLICIES = {0: BASE, 1: Policy(1, tuple(RULES))}


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of a whole text; null has none of anything."""
    if not text:
        return (0,) * len(MEASURES)
    data = text.encode()
    words = data.split()
    n = len(words)
    blanks = len(data) - len(data.translate(None, _SPACE))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(distinct := set(windows)) < len(windows):
            del distinct
            counts, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + WINDOW - max(i, end)
                    end = i + WINDOW
    kinds = _KIND[np.frombuffer(data, np.uint8)]
    odd = np.flatnonzero(kinds == 2)
    n_odd = len(np.unique(np.searchsorted(np.flatnonzero(kinds == 1), odd))) if len(odd) else 0
    return n, len(text) - blanks, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), data.count(b"!"), n_odd


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        bits = bits + F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, the measurements and failed (bit i: rule i failed), one row per row of docs.

    Null and empty texts have measurements of zero; repeated rows each get a row; other columns are not read.
    """
    schema = ", ".join(f"{m} long" for m in MEASURES)
    return per_text(with_rid(docs, id_col, text_col), measure, schema).withColumn("failed", failure_bits())


def rejects(policy: Policy) -> Column:
    """True where the ledger's failures meet the policy."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) != 0


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: rows it fails, rows that no other rule of the policy fails, rows kept without it.

    Rows are first counted by their failure bits, of which there are as many as sets of rules at most. An empty ledger gives no rows.
    """
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("hit")
    counts = book.select(hit).groupBy("hit").count()
    rules = [(r, 1 << list(RULES).index(r)) for r in policy.rules]
    which = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for r, b in rules)))
    each = counts.select("hit", "count", which.alias("r")).select("hit", "count", "r.*")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0))
    return each.groupBy("rule").agg(
        n(F.col("hit").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        n(F.col("hit") == F.col("bit")).alias("n_only"),
        n(F.col("hit").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )


def passing(docs: DataFrame, policy: Policy = POLICIES[1], text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, all columns as they were, whatever their names, in one pass without a shuffle.

    Null and empty texts have measurements of zero; repeated rows are judged alike; an empty table stays empty.
    """
    own = [f"__q_{i}" for i in range(len(docs.columns))]
    held = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = ", ".join(f"{m} long" for m in MEASURES)
    book = per_text(held, measure, schema).withColumn("failed", failure_bits())
    return book.filter(~rejects(policy)).select(*(F.col(o).alias(c) for c, o in zip(docs.columns, own)))
