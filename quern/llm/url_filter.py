"""URL filters by a cascade of Bloom filters, in DataFrame functions only.

Rules are keys: a host and a path in one string, like `example.org/es/`. A URL's candidate keys are those ends of its
host and beginnings of its path that have the shape of some rule, so a rule fits a URL exactly if it is one of them.
A cascade tells listed keys from all other keys of the corpus: its first level encodes the listed keys, the next one
the other keys that pass the first, the next one the listed keys that pass the second, and so on until nothing passes
wrongly. For every key of the corpus the first level that it doesn't pass gives the exact answer, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut, fresh, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Listed keys of one cascade. At 40 hashes its first level has 58 bits a key, 8 MB.
BLOCK_KEYS = 1 << 20
MAX_HASHES = 40
ALLOW, BLOCK = "allow", "block"

Test = Callable[[Column], Column]


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Level:
    """A Bloom filter: `hashes` bits a key in `words` of 64 bits."""

    seed: int
    hashes: int
    words: tuple[int, ...]

    def bits_of(self, key: Column) -> Column:
        return _bits_of(key, self.seed, self.hashes, 64 * len(self.words))

    def passes(self, key: Column) -> Column:
        # Folded to one literal array before the query runs.
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        return F.forall(self.bits_of(key), lambda at: F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1)


def _bits_of(key: Column, seed: int, hashes: int, bits: int) -> Column:
    """Positions of a key's bits by double hashing; 56 bits of each hash, so that no sum passes 64."""
    a, b = (F.shiftrightunsigned(F.xxhash64(F.lit(2 * seed + i), key), 8) for i in range(2))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + i * (b + 1), F.lit(bits).cast("long")))


def _level(keys: DataFrame, n: int, seed: int, wrong: float) -> Level:
    """The filter of n keys (key) that lets a share `wrong` of others pass; its words come to the driver.

    Its size is bounded by n and MAX_HASHES: BLOCK_KEYS keys take 8 MB.
    """
    hashes = min(MAX_HASHES, max(1, round(-math.log2(wrong))))
    words = max(1, math.ceil(n * hashes / math.log(2) / 64))
    at = F.explode(_bits_of(F.col("key"), seed, hashes, 64 * words)).alias("at")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
    full = keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    held = [0] * words
    for row in full.toLocalIterator():
        held[row.word] = row.bits
    return Level(seed, hashes, tuple(held))


def build_cascade(listed: DataFrame, others: Callable[[Test], DataFrame], n_others: int) -> list[Level]:
    """Levels that tell listed (key, distinct, BLOCK_KEYS at most) from the keys of others.

    others(test) gives (key), distinct, of the unlisted keys that pass a test; n_others is how many there are, or a bound of that.
    It sets the first level's size, so that about half as many keys pass as are listed. No listed keys give no levels.
    """
    own = cut(listed)
    levels, n = [], own.count()
    wrong = min(0.5, 0.5 * n / max(1, n_others)) if n else 0.5
    rivals = None
    while n:
        levels.append(_level(own, n, len(levels), wrong))
        passing = cut(others(levels[-1].passes) if rivals is None else rivals.filter(levels[-1].passes(F.col("key"))))
        rivals, own = own, passing
        n, wrong = own.count(), 0.5
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the corpus is listed: the first level that it doesn't pass says so."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def _shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """(labels of the host, characters of the path) of rules, longest keys of a URL first; a few for each length that paths have."""
    host = F.substring_index("rule", "/", 1)
    labels = F.size(F.split(host, r"\."))
    found = rules.select(labels.alias("labels"), (F.length("rule") - F.length(host)).alias("path")).distinct()
    return sorted(((r.labels, r.path) for r in found.toLocalIterator()), reverse=True)


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of a URL that have one of the shapes, longest first, of equally long ones that with the longer host."""
    if not shapes:
        return F.array().cast("array<string>")
    pairs = F.array(*(F.struct(F.lit(n).alias("labels"), F.lit(m).alias("path")) for n, m in shapes))
    labels = F.when(host == "", 0).otherwise(F.size(F.split(host, r"\.")))
    own = F.filter(pairs, lambda s: (s["labels"] <= labels) & (s["path"] <= F.length(path)))
    tail = lambda s: F.array_join(F.slice(F.split(host, r"\."), labels - s["labels"] + 1, s["labels"]), ".")
    keys = F.transform(own, lambda s: F.concat(tail(s), F.substring(path, F.lit(1), s["path"])))
    return F.array_sort(keys, lambda a, b: F.length(b) - F.length(a)) if len(shapes) > 1 else keys


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = ALLOW, id_col: str = "page_id", url_col: str = "url", block_keys: int = BLOCK_KEYS) -> DataFrame:
    """(id, host, path, rule, verdict): one row per row of pages; rules has (rule, verdict).

    A rule is a host and a path, `net/` or `example.org/en/1`; it fits its host and all subdomains if the path starts with its
    own. Of those that fit, the longest string counts, of equally long ones that with the longer host. A rule that is
    listed twice blocks if one of its rows says so; null rules, and rules without a host, fit nothing. Without a fitting
    rule, `rule` is null and the verdict is `default`, as the URL is on no list. A null URL, or one without `://`, has an empty
    host and path, and no rule fits. Repeated rows stay, an empty table gives no rows, other columns are not read.

    Lists of over block_keys rules are gone through in blocks, each with a cascade of its own; the corpus is read again for each.
    """
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = rules.select(F.col("rule").cast("string").alias("rule"), (F.col("verdict") == BLOCK).alias("blocks"))
    known = cut(known.filter(F.substring_index("rule", "/", 1) != "").groupBy("rule").agg(F.max(F.coalesce("blocks", F.lit(False))).alias("blocks")))
    blocks = max(1, -(-known.count() // block_keys))
    out = rows.withColumn("rule", F.lit(None).cast("string")).withColumn("blocks", F.lit(None).cast("boolean"))
    for i in range(blocks):
        of_block = F.pmod(F.xxhash64(F.lit("block"), F.col("rule")), F.lit(blocks)) == i
        out = _apply(out, rows, known.filter(of_block))
        out = cut(out) if i + 1 < blocks else out
    verdict = F.when(F.col("blocks"), BLOCK).when(~F.col("blocks"), ALLOW).otherwise(F.lit(default))
    return out.select("id", "host", "path", "rule", verdict.alias("verdict"))


def _apply(out: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame:
    """out with rule and blocks of the block of rules `known` where that is longer than what out has."""
    shapes = _shapes(known)
    if not shapes:
        return out
    keys = candidates(F.col("host"), F.col("path"), shapes)
    listed = known.select(F.col("rule").alias("key"))

    def unlisted(test: Test) -> DataFrame:
        # Only what passes leaves its task, each key once.
        found = rows.select(F.explode(F.filter(keys, test)).alias("key")).distinct()
        return found.join(small(listed), "key", "left_anti")

    levels = build_cascade(listed, unlisted, rows.count() * len(shapes))
    blocking = known.filter("blocks").select(F.col("rule").alias("key"))
    allowing = cut(known.filter("NOT blocks").select(F.col("rule").alias("key")))
    actions = build_cascade(blocking, lambda test: allowing.filter(test(F.col("key"))), allowing.count())
    best = F.get(F.filter(keys, lambda key: member(levels, key)), F.lit(0))
    found, newer = fresh(out, "__found"), fresh(out, "__newer")
    longer = lambda c: F.struct(F.coalesce(F.length(c), F.lit(-1)), F.length(F.substring_index(c, "/", 1)))
    rows = out.withColumn(found, best).withColumn(newer, F.col(found).isNotNull() & (longer(F.col(found)) > longer(F.col("rule"))))
    return rows.select(
        "id", "host", "path",
        F.when(F.col(newer), F.col(found)).otherwise(F.col("rule")).alias("rule"),
        F.when(F.col(newer), member(actions, F.col(found))).otherwise(F.col("blocks")).alias("blocks"),
    )


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(rule, verdict) of a stated list."""
    return spark.createDataFrame(list(rules), "rule string, verdict string")
