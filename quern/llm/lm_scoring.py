"""Language-model scoring with an Elias-Fano n-gram trie that is dealt over shards.

Texts are cut into words and an end mark. A block is some million tokens of whole texts; it is tokenised once, kept
in the shared folder, and asks shards about its distinct (context, successor) pairs. A shard gets the pairs of its
contexts from all blocks, sums their training counts, builds a trie with quantised smoothed probabilities, looks
every asked pair up in it and answers in one byte each. No machine holds the model, and what moves is the
corpus's distinct pairs by block. A context with very many successors is spread over several shards.

Model: P(w | v) = max(c(v w) - D, 0) / c(v) + D * n(v) / c(v) * (c(w) + 1) / (N + V + 1), with n(v) the number of
distinct successors of v, and the last factor alone where c(v) is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, stable, with_rid
from quern.llm.elias_fano import Trie, scratch

DISCOUNT = 0.75
BLOCK_TOKENS = 3_000_000
#: Tokens of the corpus for each shard.
SHARD_TOKENS = 4_000_000
#: Successors of one context, summed over blocks, that one shard is meant to hold.
HOT_SUCCESSORS = 1_000_000
#: Contexts that are spread over shards at most; all tasks know which they are.
HOT_CONTEXTS = 100_000
SUCCESSOR = np.uint64(64 - Trie.SUCCESSOR)

START, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" ", b"\n"))  # neither can be a word


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1  # 0 is the end mark
        return n


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def _six(a: np.ndarray) -> bytes:
    """Six bytes for each value below 2 ** 48."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


_BLOCK = "block long, n_tokens long, rids binary, ids binary, has_id binary, train binary, lengths binary, tokens binary, words binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, partition = 0, TaskContext.get().partitionId()
    docs: list[tuple] = []
    tokens: list[np.ndarray] = []
    vocabulary, total = _Vocabulary(), 0

    def row() -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
        flat = np.concatenate(tokens)
        # Frequent words get small numbers, which pack well.
        counts = np.bincount(flat, minlength=len(hashes) + 1)
        order = np.argsort(-counts[1:], kind="stable")
        renumber = np.zeros(len(hashes) + 1, np.uint32)
        renumber[order + 1] = np.arange(1, len(hashes) + 1)
        column = lambda k, t: np.array([d[k] for d in docs], t).tobytes()
        values = (partition << 32 | at, total, column(0, "<i8"), column(1, "<i8"), column(2, "u1"), column(3, "u1"), column(4, "<i8"), _pack(renumber[flat]), hashes[order].tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=[c.split()[0] for c in _BLOCK.split(", ")])

    for batch in batches:
        for rid, i, train, text in zip(*(batch.column(c).to_pylist() for c in ("rid", "id", "train", "text"))):
            words = (text or "").encode().lower().split()
            n = len(words) + 1
            own = np.zeros(n, np.uint32)
            own[:-1] = np.fromiter(map(vocabulary.__getitem__, words), np.uint32, n - 1)
            docs.append((rid, i or 0, i is not None, train, n))
            tokens.append(own)
            total += n
            if total >= BLOCK_TOKENS:
                yield row()
                at, total = at + 1, 0
                docs, tokens, vocabulary = [], [], _Vocabulary()
    if docs:
        yield row()


class _Block:
    """A block's tokens and its distinct pairs, always in the same order."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.rids = np.frombuffer(row["rids"], "<i8")
        self.has_id = np.frombuffer(row["has_id"], "u1")
        self.train = np.frombuffer(row["train"], "u1")
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.tokens = _unpack(row["tokens"], "<u4")
        self.starts = np.cumsum(self.lengths) - self.lengths
        words = np.frombuffer(row["words"], "<u8")
        #: Hash of each number; the number after the last word is the start mark, which is a context only.
        self.hashes = np.concatenate(([END], words, [START])).astype(np.uint64)
        context = np.empty(len(self.tokens), np.uint64)
        context[1:] = self.tokens[:-1]
        context[self.starts] = len(self.hashes) - 1
        pairs = context << np.uint64(32) | self.tokens
        self.pairs, self.pair_of = np.unique(pairs, return_inverse=True)
        self.context = (self.pairs >> np.uint64(32)).astype(np.int64)
        self.next = (self.pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        learnt = np.repeat(self.train, self.lengths)
        self.counts = np.bincount(self.pair_of, weights=learnt, minlength=len(self.pairs)).astype(np.int64)

    def plan(self, shards: int, hot: dict[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(shard, pairs, contexts, of): of[k] is the place in contexts of pair k's; both sorted by hash.

        Shards of which the block has nothing to ask are left out, so a block has no more rows than pairs, and a few for
        spread contexts: each of their parts is asked for its totals, with or without pairs.
        """
        home = (self.hashes % np.uint64(shards)).astype(np.int64)
        parts = np.ones(len(self.hashes), np.int64)
        if hot:
            names = np.array(sorted(hot), np.uint64)
            at = np.minimum(np.searchsorted(names, self.hashes), len(names) - 1)
            parts = np.where(names[at] == self.hashes, np.array([hot[h] for h in names.tolist()])[at], 1)
        follower = self.hashes[self.next]
        shard = (home[self.context] + (follower >> np.uint64(7)).astype(np.int64) % parts[self.context]) % shards
        by = np.lexsort((follower >> SUCCESSOR, self.hashes[self.context], shard))
        used = np.unique(self.context)
        spread = used[parts[used] > 1]
        extra = np.repeat(spread, parts[spread])
        nth = np.arange(len(extra)) - np.repeat(np.cumsum(parts[spread]) - parts[spread], parts[spread])
        extra_shard = (home[extra] + nth) % shards
        for s in np.unique(np.concatenate((shard, extra_shard))):
            first, end = np.searchsorted(shard[by], (s, s + 1))
            pairs = by[first:end]
            own = np.unique(np.concatenate((self.context[pairs], extra[extra_shard == s])))
            own = own[np.argsort(self.hashes[own])]
            yield int(s), pairs, own, np.searchsorted(self.hashes[own], self.hashes[self.context[pairs]])


def _rows(table: pa.Table) -> list[dict]:
    return table.to_pylist()


def _hot(least: int):
    """Contexts of a block with that many successors in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                counts = np.bincount(block.context, minlength=len(block.hashes))
                many = np.flatnonzero(counts >= least)
                yield pa.RecordBatch.from_arrays([pa.array(block.hashes[many].view(np.int64)), pa.array(counts[many])], names=["context", "n"])

    return run


_ASK = "shard int, block long, contexts binary, sizes binary, successors binary, counts binary"


def _asks(shards: int, hot: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                for s, pairs, own, of in block.plan(shards, hot):
                    sizes = np.bincount(of, minlength=len(own)).astype("<u4")
                    successors = block.hashes[block.next[pairs]] >> SUCCESSOR
                    values = (s, row["block"], block.hashes[own].tobytes(), _pack(sizes), _six(successors), _pack(block.counts[pairs].astype("<u4")))
                    yield pa.RecordBatch.from_arrays([pa.array([values[0]], pa.int32()), *(pa.array([v]) for v in values[1:])], names=[c.split()[0] for c in _ASK.split(", ")])

    return run


_ANSWER = "shard int, block long, totals binary, kinds binary, codes binary, learnt long, known long, spread array<long>"


def _shard(table: pa.Table, hot: frozenset[int]) -> pa.Table:
    """Build one shard's trie from all blocks' counts and look up all that they ask.

    learnt: tokens that it has seen; known: words seen, without those of spread contexts, which it lists.
    """
    asks = sorted(_rows(table), key=lambda r: r["block"])
    lists = [np.frombuffer(r["contexts"], "<u8") for r in asks]
    contexts = np.unique(np.concatenate(lists))
    keys, counts = [], []
    for r, own in zip(asks, lists):
        of = np.repeat(np.searchsorted(contexts, own), _unpack(r["sizes"], "<u4")).astype(np.uint64)
        keys.append(of << np.uint64(Trie.SUCCESSOR) | _from_six(r["successors"]))
        counts.append(_unpack(r["counts"], "<u4"))
    flat, weights = np.concatenate(keys), np.concatenate(counts)
    seen = weights > 0
    known, back = np.unique(flat[seen], return_inverse=True)
    sums = np.bincount(back, weights=weights[seen], minlength=len(known))
    context_of = (known >> np.uint64(Trie.SUCCESSOR)).astype(np.int64)
    totals = np.bincount(context_of, weights=sums, minlength=len(contexts)).astype(np.int64)
    kinds = np.bincount(context_of, minlength=len(contexts))
    shared = np.isin(contexts, np.array([*hot], np.uint64)) & (totals > 0)
    spread = contexts[shared].view(np.int64).tolist()
    words = int(((totals > 0) & ~shared & (contexts != START)).sum())
    del flat, weights, back
    with scratch() as folder:
        trie = Trie(contexts, known, (sums - DISCOUNT) / totals[context_of] if len(known) else sums, folder)
        out = []
        for r, own, key in zip(asks, lists, keys):
            at = trie.context(own)
            codes = trie.lookup(at, _unpack(r["sizes"], "<u4"), key & np.uint64((1 << Trie.SUCCESSOR) - 1))
            out.append((r["shard"], r["block"], _pack(totals[at].astype("<u8")), _pack(kinds[at].astype("<u8")), _pack(codes), int(totals.sum()), words, spread))
        del trie
    arrays = [pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out]) for k in range(1, 7)), pa.array([x[7] for x in out], pa.list_(pa.int64()))]
    return pa.Table.from_arrays(arrays, names=[c.split()[0] for c in _ANSWER.split(", ")])


_SCORE = "rid long, id long, n_tokens long, n_known long, base_score double, score double"


def _score(shards: int, hot: dict[int, int], train_tokens: int, distinct: int, ends: int):
    total = train_tokens + distinct + 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(_rows(left)[0])
        answers = {r["shard"]: r for r in _rows(right)}
        n = len(block.hashes)
        codes = np.zeros(len(block.pairs), np.uint8)
        part_total = np.zeros(len(block.pairs))
        totals, kinds = np.zeros(n), np.zeros(n)
        for s, pairs, own, of in block.plan(shards, hot):
            answer = answers[s]
            got = _unpack(answer["totals"], "<u8")
            totals[own] += got
            kinds[own] += _unpack(answer["kinds"], "<u8")
            codes[pairs] = _unpack(answer["codes"], "u1")
            part_total[pairs] = got[of]
        # A word is followed by something each time, so its total as a context is its count.
        counts = totals.copy()
        counts[0] = ends
        unigram = (counts + 1) / total
        of_context = totals[block.context]
        seen = np.maximum(of_context, 1)
        p = Trie.probability(codes) * part_total / seen
        rest = np.where(of_context > 0, DISCOUNT * kinds[block.context] / seen, 1.0)
        logs = np.log10(p + rest * unigram[block.next])
        base = np.log10(unigram)
        sums = lambda x: np.add.reduceat(x, block.starts)
        arrays = [
            pa.array(block.rids), pa.array(block.ids, mask=block.has_id == 0), pa.array(block.lengths), pa.array(sums((counts > 0).astype(np.int64)[block.tokens])),
            pa.array(sums(base[block.tokens])), pa.array(sums(logs[block.pair_of])),
        ]
        return pa.Table.from_arrays(arrays, names=[c.split()[0] for c in _SCORE.split(", ")])

    return run


def lm_scores(docs: DataFrame, fold: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    Learns from rows whose crc32(id as text) mod fold is not held_out; a null id is held out. A-Z are lower-cased.
    Null and empty texts are an end mark alone. Repeated rows count as often as they stand there. With nothing to learn
    from, all tokens are equally likely. An empty table gives no rows; other columns are not read. Words are told
    apart by 64 bits of hash, successors of a context by 42.
    """
    spark = docs.sparkSession
    out_of_fold = F.coalesce(F.crc32(F.encode(F.col("id").cast("string"), "UTF-8")) % fold == held_out, F.lit(True))
    rows = with_rid(stable(docs), id_col, text_col).withColumn("train", (~out_of_fold).cast("int"))
    blocks = cut(rows.mapInArrow(_blocks, _BLOCK))
    size = blocks.agg(F.coalesce(F.sum(F.length("words")), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    # The number of contexts that one trie holds bounds the shards from below.
    shards = int(max(4, size[2] // SHARD_TOKENS, size[0] // 8 // 2_000_000))
    # A context with over `limit` successors has half of them in blocks with limit / (2 * blocks) or more; each of these rows
    # stands for limit / 2 of all tokens, so that there are HOT_CONTEXTS at most.
    limit = max(HOT_SUCCESSORS, 2 * size[2] // HOT_CONTEXTS)
    seen = blocks.mapInArrow(_hot(max(1, limit // (2 * max(1, size[1])))), "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))
    hot = {r["context"] % (1 << 64): min(shards, -(-r["n"] * 2 // limit)) for r in seen.filter(F.col("n") * 2 > limit).collect()}
    asks = blocks.mapInArrow(_asks(shards, hot), _ASK)
    spread = frozenset(hot)
    answers = cut(asks.repartition(shards, "shard").groupBy("shard").applyInArrow(lambda t: _shard(t, spread), _ANSWER))
    # Figures of the whole corpus. Each shard says the same to all blocks; a spread context is one word.
    each = answers.groupBy("shard").agg(F.first("learnt").alias("learnt"), F.first("known").alias("known"), F.first("spread").alias("spread"))
    learnt, known, ends = (
        each.agg(F.coalesce(F.sum("learnt"), F.lit(0)).alias("a"), F.coalesce(F.sum("known"), F.lit(0)).alias("b"))
        .crossJoin(rows.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("c")))
        .first()
    )
    start = START.view(np.int64).item()
    known += each.select(F.explode("spread").alias("w")).filter(F.col("w") != start).distinct().count() + (ends > 0)
    keys = blocks.groupBy("block").cogroup(answers.drop("learnt", "known", "spread").groupBy("block"))
    scores = keys.applyInArrow(_score(shards, hot, learnt, known, ends), _SCORE)
    crc = F.crc32(F.encode(F.col("id").cast("string"), "UTF-8")) % fold
    return scores.select("rid", "id", F.coalesce(crc == held_out, F.lit(True)).alias("held_out"), "n_tokens", "n_known", F.lit(learnt).cast("long").alias("train_tokens"), "base_score", "score")
