"""Ranked lexical search by the three-phase uniform threshold over term-partitioned postings.

Each text is gone through once and gives postings: for a term and a range of RANGE rows, which rows hold it, how often,
and how long they are. Postings are ordered by term, and a list's ranges are dealt like rows, so a common term is many
segments and not one task. A search then takes three phases:

1. the heads of the lists: each list's k best values; the k-th best sum of an item's heads is a lower bound of its answer;
2. each list's values of at least that bound over the number of lists: a document without any such value can't reach the
   bound. Sums of what was fetched raise the bound, and documents that even the most that unseen lists could add
   leaves below it are out;
3. exact scores of those left, looked up in all lists of their item.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, numbered, slices, small, stable, with_rid

#: Rows of a file that share a segment, and postings that a task gathers before it packs them.
RANGE_BITS = 12
GATHERED = 1 << 20
#: Bytes of a text that are cut to terms at a time.
TEXT_BYTES = 1 << 20
#: Items that one search answers, and terms that an index is narrowed to at most; an index of more holds all terms.
ITEMS = 2_000
TERMS = 1_000_000
#: Parts that the lists are dealt to at most, and postings of a part.
PARTS, PART_POSTINGS = 8_192, 200_000
#: Lists or segments that a task gives out at a time.
SEGMENTS = 256

#: Letters of ASCII in lower case, digits and all bytes of other characters stay; the rest parts terms.
_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: What a text's task writes of a posting, and what a list holds of it: a weight of 1 makes it worth `q` of a score.
_COUNTS = np.dtype([("at", "<u2"), ("tf", "<u4"), ("n", "<u4")])
_LIST = np.dtype([("at", "<u2"), ("q", "<u4")])
_SEGMENTS = "term string, range long, n_docs long, n_terms long, packed binary"


def term_counts(text: str | None) -> Counter[bytes]:
    """Terms of a text with how often they occur; a text is cut where terms part, so that a long one is never held as a list."""
    data = (text or "").encode().translate(_BYTES)
    counts: Counter[bytes] = Counter()
    start = 0
    while start < len(data):
        end = data.find(b" ", start + TEXT_BYTES)
        end = len(data) if end < 0 else end
        counts.update(data[start:end].split())
        start = end
    return counts


def _packer(asked: frozenset[bytes] | None):
    """Segments of rows (rid, text) in the order they come; a segment without a term counts documents and terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, n_docs, n_terms = None, 0, 0
        names: dict[bytes, int] = {}
        term, at, tf, size = array("I"), array("H"), array("I"), array("I")

        def packed() -> pa.RecordBatch:
            own = np.frombuffer(term, np.uint32)
            order = np.argsort(own, kind="stable")
            rows = np.empty(len(own), _COUNTS)
            for name, values in (("at", at), ("tf", tf), ("n", size)):
                rows[name] = np.frombuffer(values, values.typecode)[order]
            ends = np.searchsorted(own[order], np.arange(len(names)), side="right").tolist()
            starts = [0, *ends[:-1]]
            return _batch(
                [*(t.decode() for t in names), None],
                [here] * (len(names) + 1),
                [*(b - a for a, b in zip(starts, ends)), n_docs],
                [*(0 for _ in ends), n_terms],
                [*(rows[a:b].tobytes() for a, b in zip(starts, ends)), b""],
            )

        for batch in slices(batches):
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text")):
                if rid >> RANGE_BITS != here or len(term) >= GATHERED:
                    if here is not None:
                        yield packed()
                    here, n_docs, n_terms, names = rid >> RANGE_BITS, 0, 0, {}
                    term, at, tf, size = array("I"), array("H"), array("I"), array("I")
                counts = term_counts(text.as_py())
                total = sum(counts.values())
                n_docs += total > 0
                n_terms += total
                for t in counts if asked is None else counts.keys() & asked:
                    term.append(names.setdefault(t, len(names)))
                    at.append(rid & ((1 << RANGE_BITS) - 1))
                    tf.append(counts[t])
                    size.append(total)
        if here is not None:
            yield packed()

    return run


def _batch(*columns: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["term", "range", "n_docs", "n_terms", "packed"])


class Postings:
    """An index of a frame: segments by term, document frequencies, and the numbers N and L of documents and terms."""

    def __init__(self, docs: DataFrame, asked: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text"):
        """asked: the terms that are indexed; None is all. Texts are read once; what they give is kept in the shared folder."""
        self.docs, self.id_col = stable(docs), id_col
        rows = with_rid(self.docs, id_col, text_col).select("rid", "text")
        found = cut(rows.mapInArrow(_packer(asked), _SEGMENTS))
        sums = found.filter("term IS NULL").agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
        self.n, self.l = sums.n or 0, sums.l or 0
        lists = found.filter("term IS NOT NULL")
        self.df = cut(lists.groupBy("term").agg(F.sum("n_docs").alias("df")))
        held = self.df.agg(F.sum("df")).first()[0] or 0
        self.parts = min(PARTS, max(1, held // PART_POSTINGS))
        worth = lists.select("term", "range", "packed").mapInArrow(_worth(self.n, self.l), _SEGMENT)
        # Two tasks may each have a segment of one term and range; they hold different rows.
        self.lists = cut(worth.repartitionByRange(self.parts, "term", "range").sortWithinPartitions("term", "range"))

    def weights(self, terms: DataFrame) -> DataFrame:
        """terms (term, ...) that occur, with their weight."""
        idf = F.log((F.lit(2 * self.n + 2).cast("double")) / (2 * F.col("df") + 1).cast("double"))
        return terms.join(small(self.df), "term").withColumn("weight", F.floor(1000.0 * idf).cast("long"))


_SEGMENT = "term string, range long, packed binary"


def _worth(n: int, total: int):
    """Segments with each posting's share of a score, which hangs on the numbers of documents and terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for packed in batch.column("packed").to_pylist():
                rows = np.frombuffer(packed, _COUNTS)
                tf, size = rows["tf"].astype(np.int64), rows["n"].astype(np.int64)
                own = np.empty(len(rows), _LIST)
                own["at"], own["q"] = rows["at"], (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * size * n) // total))
                out.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("range"), pa.array(out, pa.binary())], names=["term", "range", "packed"])

    return run


def _segments(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """(term, range, places in the range, shares of a score, more) of segments, one by one."""
    for batch in slices(batches):
        columns = [batch.column(c).to_pylist() for c in ("term", "range", "packed", *more)]
        for term, part, packed, *rest in zip(*columns):
            rows = np.frombuffer(packed, _LIST)
            yield term, part, rows["at"], rows["q"].astype(np.int64), *rest


def search(index: Postings, items: DataFrame, k: int = 50, block: int = ITEMS) -> DataFrame:
    """(item, rid, score): exact scores above 0 of documents among which each item's k best are, and all that tie with them.

    items: (item long, term string), distinct rows; they are answered in blocks of items. More than k may be given,
    namely all whose score reaches the bound that the thresholds found.
    """
    n = items.agg(F.count_distinct("item")).first()[0]
    out = None
    for i in range(max(1, -(-n // block))):
        own = items if n <= block else items.filter(F.pmod(F.xxhash64("item"), F.lit(-(-n // block))) == i)
        found = _search(index, own, k)
        out = found if out is None else out.unionByName(found)
    return out


def _nth_best(sums: DataFrame, k: int) -> dict[int, int]:
    """The k-th highest s of each item that has so many rows; a task passes on k rows of an item at most."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("s")))
    best = sums.select("item", "s", rank.alias("r")).filter(F.col("r") <= k)
    found = best.groupBy("item").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    return {r.item: r.s for r in found.collect()}


def _search(index: Postings, items: DataFrame, k: int) -> DataFrame:
    weighted = cut(index.weights(items).filter("weight > 0"))
    # The terms of a block of items, which every task needs: ITEMS items of some words each.
    lists: dict[str, list[int]] = defaultdict(list)
    weight: dict[str, int] = {}
    for r in weighted.toLocalIterator():
        lists[r.term].append(r.item)
        weight[r.term] = r.weight
    terms_of_item: dict[int, list[str]] = defaultdict(list)
    for t, own in lists.items():
        for i in own:
            terms_of_item[i].append(t)
    if not lists:
        return items.sparkSession.createDataFrame([], "item long, rid long, score long")
    terms = small(weighted.select("term").distinct())
    asked = index.lists.join(terms, "term", "left_semi")

    # 1. Heads. Segments come by term, so a task keeps one list's best at a time.
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, best, done = None, (np.empty(0, np.int64), np.empty(0, np.int64)), []
        for term, part, at, q in _segments(batches):
            if term != name:
                done.append((name, *best))
                name, best = term, (np.empty(0, np.int64), np.empty(0, np.int64))
                if len(done) >= SEGMENTS:
                    yield _heads(done)
                    done = []
            some = np.argsort(-q, kind="stable")[:k]
            rid, v = np.concatenate([best[0], at[some].astype(np.int64) + (part << RANGE_BITS)]), np.concatenate([best[1], weight[term] * q[some]])
            some = np.argsort(-v, kind="stable")[:k]
            best = rid[some], v[some]
        yield _heads([*done, (name, *best)])

    top = asked.mapInArrow(heads, "term string, rid long, v long")
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("v"), "rid"))).filter(F.col("r") <= k)
    per_item = small(cut(weighted.select("item", "term")))
    bound = _nth_best(top.join(per_item, "term").groupBy("item", "rid").agg(F.sum("v").alias("s")), k)

    # 2. The uniform threshold: a document that reaches the bound has a value of bound / m or more in one of m lists.
    least = {i: max(1, -(-bound.get(i, 0) // len(own))) for i, own in terms_of_item.items()}
    at_least = {t: min(least[i] for i in own) for t, own in lists.items()}

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for term, part, at, q in _segments(batches):
            some = weight[term] * q >= at_least[term]
            if some.any():
                own = np.empty(int(some.sum()), _LIST)
                own["at"], own["q"] = at[some], q[some]
                out.append((term, part, own.tobytes()))
            if len(out) >= SEGMENTS:
                yield _list_batch(out)
                out = []
        if out:
            yield _list_batch(out)

    # What was fetched meets by range, each posting once and not once for each item that asks for it.
    fetched = cut(asked.mapInArrow(above, _SEGMENT).repartition(index.parts, "range").sortWithinPartitions("range", "term"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(item, range, sum of what was fetched by place, number of lists by place)."""
        for part, held in _ranges(batches):
            for item, own in terms_of_item.items():
                s, seen = np.zeros(1 << RANGE_BITS, np.int64), np.zeros(1 << RANGE_BITS, np.int64)
                for at, q, w in ((*x, weight[t]) for t in own for x in held.get(t, ())):
                    v = w * q
                    some = v >= least[item]
                    s[at[some]] += v[some]
                    seen[at[some]] += 1
                yield item, part, s, seen

    def best_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, _, s, _ in sums(batches):
            best = -np.partition(-s, min(k, len(s) - 1))[:k]
            best = best[best >= max(1, bound.get(item, 0))]
            if len(best):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), item, np.int64)), pa.array(best)], names=["item", "s"])

    raised = _nth_best(fetched.mapInArrow(best_sums, "item long, s long"), k)
    bound = {i: max(bound.get(i, 0), raised.get(i, 0), 1) for i in terms_of_item}

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, part, s, seen in sums(batches):
            own = np.flatnonzero((seen > 0) & (s + (len(terms_of_item[item]) - seen) * (least[item] - 1) >= bound[item]))
            if len(own):
                yield pa.RecordBatch.from_pylist([{"item": item, "range": part, "places": own.astype("<u2").tobytes()}])

    # 3. Exact scores: what is left of a range meets that range of each of its item's lists.
    asks = fetched.mapInArrow(left, "item long, range long, places binary").join(per_item, "item")
    asks = asks.groupBy("term", "range").agg(F.collect_list(F.struct("item", "places")).alias("asks"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for term, part, at, q, own in _segments(batches, "asks"):
            v = np.zeros(1 << RANGE_BITS, np.int64)
            v[at] = weight[term] * q
            for ask in own:
                want = np.frombuffer(ask["places"], "<u2")
                hit = want[v[want] > 0].astype(np.int64)
                if len(hit):
                    yield _found(ask["item"], hit + (part << RANGE_BITS), v[hit])

    exact = index.lists.join(asks, ["term", "range"]).mapInArrow(look_up, "item long, rid long, v long")
    scores = exact.groupBy("item", "rid").agg(F.sum("v").alias("score"))
    reached = F.broadcast(items.sparkSession.createDataFrame([*bound.items()], "item long, bound long"))
    return scores.join(reached, "item").filter(F.col("score") >= F.col("bound")).drop("bound")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list[tuple[np.ndarray, np.ndarray]]]]]:
    """Segments of one range at a time, by term; they come in order of range."""
    here, held = None, defaultdict(list)
    for term, part, at, q in _segments(batches):
        if part != here:
            if here is not None:
                yield here, held
            here, held = part, defaultdict(list)
        held[term].append((at, q))
    if here is not None:
        yield here, held


def _list_batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["term", "range", "packed"])


def _heads(done: list[tuple[str | None, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    done = [x for x in done if x[0] is not None]
    names = [t for t, rid, _ in done for _ in range(len(rid))]
    rid, v = (np.concatenate([np.empty(0, np.int64), *(x[i] for x in done)]) for i in (1, 2))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rid), pa.array(v)], names=["term", "rid", "v"])


def _found(item: int, rid: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rid), item, np.int64)), pa.array(rid), pa.array(v)], names=["item", "rid", "v"])


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, as term_counts has them."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1))


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_terms: int = TERMS
) -> DataFrame:
    """(item_id, rank, id, score): the k documents with the highest scores above 0 for each row of items.

    Ranks are unique, from 1; equal scores go by id, a null id first, and repeated rows of one id in file order. Each of
    them is a document of its own. A null text has no terms, and a document without terms is never found. An item
    without terms has no rows; repeated rows of items are answered each by itself. Empty tables give no rows; other columns
    are not read. Weights and lengths count all documents. Scores are whole numbers of 64 bits.
    """
    asked = stable(items).select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("item_text"))
    asked = cut(numbered(asked, "item").select("item", "item_id", F.explode(terms_of(F.col("item_text"))).alias("term")))
    pairs = asked.select("item", "term")
    names = pairs.select("term").distinct()
    narrow = frozenset(r.term.encode() for r in names.toLocalIterator()) if names.count() <= max_terms else None
    index = Postings(docs, narrow, id_col, text_col)
    best = cut(search(index, pairs, k))
    ids = numbered(index.docs.select(F.col(id_col).cast("long").alias("id")), "rid")
    rows = ids.join(small(best), "rid").join(small(asked.select("item", "item_id").distinct()), "item")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id", "rid")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "id", "score")
