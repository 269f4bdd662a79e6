"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into segments that stand in a ring. If two fingerprints differ in at most t of 64 bits, then some
segment begins a chain in which the first l segments together differ in at most l * t / m bits, for every l. While l * t / m
is below 1 the chain's segments are equal, which gives candidates by an equality join on all of them; the budgets of the
longer chains prune these before the full check. With m = 3 t + 1 three segments are equal, 27 of 64 bits for t = 2.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, join_hot, per_text, releasing, small, stable, with_rid, without

#: Shingles that are hashed and counted at a time.
BLOCK = 1 << 14


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all word shingles of a whole text, repeats included, in blocks.

    A-Z are lower-cased. A text of fewer words than a shingle has one, its whole sequence; one without words has none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return
    width = min(width, len(words))
    total = len(words) - width + 1
    for at in range(0, total, BLOCK):
        n = min(BLOCK, total - at)
        part = zip(*(words[at + k : at + k + n] for k in range(width)))
        yield np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, part)), np.uint64, n)


def fingerprint(text: str | None, width: int) -> int:
    """64 bits, as a signed integer: a bit is 1 if set in over half of the hashes."""
    sums, total = np.zeros(64, np.int64), 0
    for block in shingle_hashes(text, width):
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.uint32)
        total += len(block)
    return int(np.packbits(2 * sums > total, bitorder="little").view(np.int64)[0])


def segments(m: int) -> list[tuple[int, int]]:
    """(first bit, bits) of m segments of 64 bits, as even as can be."""
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(ring: list[tuple[int, int]], first: int, n: int) -> int:
    """Bits of the n segments of the ring from `first` on, as a signed integer."""
    own = (ring[(first + k) % len(ring)] for k in range(n))
    return _signed(sum(((1 << size) - 1) << at for at, size in own))


def pigeonring(a: Column, b: Column, first: Column, max_bits: int, m: int) -> Column:
    """True if the chain that begins at segment `first` keeps to its budget at every length up to the whole ring."""
    ring = segments(m)

    def chain(i: int) -> Column:
        tests = (F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(_mask(ring, i, n)))) <= n * max_bits // m for n in range(1, m + 1))
        return reduce(lambda x, y: x & y, tests)

    out = F.lit(False)
    for i in reversed(range(m)):
        out = F.when(first == i, chain(i)).otherwise(out)
    return out


def links(prints: DataFrame, max_bits: int = 2, crowd: int = 64) -> DataFrame:
    """(a, b) edges between fingerprints of prints (fp, distinct) such that components are those of all links.

    Fingerprints that agree in the segments with which a chain must begin meet in a bucket. In buckets of up to `crowd`,
    pairs go through the pigeonring filter. In fuller ones, which 27 equal bits make rare before ten thousand million
    fingerprints, pairs would be too many. With max_bits 2, each fingerprint there is tied to itself and
    the 64 points one bit away: fingerprints share such a point exactly if they differ in 2 bits at most, so stars
    round the points give the same components with 65 rows each. Other max_bits have pairs in all buckets.
    """
    m = 3 * max_bits + 1
    ring = segments(m)
    equal = -(-m // max_bits) - 1 if max_bits else m
    spread = F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(_mask(ring, i, equal))).alias("val")) for i in range(m))))
    rows = prints.select("fp", spread.alias("s")).select("fp", "s.seg", "s.val")
    sizes = rows.groupBy("seg", "val").count().filter("count > 1")
    rows = cut(rows.join(small(cut(sizes)), ["seg", "val"]))
    ball = max_bits == 2
    few = rows.filter(F.col("count") <= crowd) if ball else rows
    x, y = few.select("seg", "val", F.col("fp").alias("a")), few.select("seg", "val", F.col("fp").alias("b"))
    near = x.join(y, ["seg", "val"]).filter((F.col("a") < F.col("b")) & pigeonring(F.col("a"), F.col("b"), F.col("seg"), max_bits, m)).select("a", "b").distinct()
    if not ball:
        return near
    crowded = rows.filter(F.col("count") > crowd).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << k)) for k in range(64)))
    points = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    centres = points.groupBy("point").agg(F.min("fp").alias("a"))
    stars = points.join(centres, "point").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return near.unionByName(stars)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b), root being the component's smallest node.

    Large-star and small-star steps in turn, each written to the shared folder, until no edge changes. Large-star ties
    every larger neighbour of a node to the least of its neighbourhood, small-star every smaller one.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least_ = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least_, "u")
        own = least_.select("u", F.col("m").alias("v"))
        rest = tied.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(own.unionByName(rest).filter("u <> v").distinct())
        figures = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if figures == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = figures


def near_duplicates(docs: DataFrame, width: int = 5, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text", crowd: int = 64) -> DataFrame:
    """rid, id, fp, component_id (smallest id of all documents reachable by links), one row per row of docs.

    Documents link where their fingerprints differ in max_bits at most; equal ones always do. Null, empty and wordless
    texts have fingerprint 0 and link like any other. A null id is passed over as component_id unless there is
    no other. Repeated rows each get a row; an empty table gives none; other columns are not read.
    """
    rows = with_rid(stable(docs), id_col, text_col)
    marks = cut(per_text(rows, lambda t: (fingerprint(t, width),), "fp long"))
    prints = cut(marks.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(prints.select("fp"), max_bits, crowd))
    prints = cut(prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", "root"))
    linked = prints.filter("root IS NOT NULL")
    classes = cut(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints")))
    linked = join_hot(linked.select("fp", "n", "root"), classes, "root", "prints", linked.count())
    alone = prints.filter("root IS NULL").select("fp", "n", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    named = cut(linked.select("fp", "n", "root", "component_id").unionByName(alone))
    return join_hot(marks, named, "fp", "n", marks.count()).select("rid", "id", "fp", "root", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Long fingerprints, for a similarity rather than a few bits.

#: Words of 64 bits in a long fingerprint, and its bytes, which stand in a ring.
WORDS = 4
RING = 8 * WORDS
#: Rows of a bucket beyond which its parts are compared two and two, each two in a task of their own.
BUCKET_ROWS = 20_000
#: Parts of a bucket at most, and pairs of parts.
PARTS = 2048
CELLS = PARTS * PARTS
#: Rows whose buckets are compared at a time.
COMPARED = 50_000


def max_distance(similarity: float, bits: int = 64 * WORDS) -> int:
    """Bits in which shingle sets of that Jaccard similarity differ on average, and a standard deviation more.

    Sets of one size with similarity s have cosine 2 s / (1 + s); a bit differs with probability angle / pi.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + math.sqrt(bits * p * (1 - p)))


def long_fingerprint(text: str | None, width: int) -> bytes:
    """WORDS * 64 bits: word k from the hashes of all shingles after k rounds of mixing."""
    return _majorities(shingle_hashes(text, width))


def _majorities(blocks: Iterable[np.ndarray]) -> bytes:
    sums, total = np.zeros((WORDS, 64), np.int64), 0
    for block in blocks:
        for k in range(WORDS):
            h = block + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            if k:
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(31)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums[k] += bits.sum(axis=0, dtype=np.uint32)
        total += len(block)
    return np.packbits(2 * sums > total, bitorder="little").tobytes()


def _near(x: np.ndarray, y: np.ndarray, first: np.ndarray, most: int) -> np.ndarray:
    """Rows in which x and y (RING bytes each) pass the chains from byte `first` on and differ in `most` bits at most.

    The first two bytes agree already. A chain of l bytes may differ in l * most / RING bits, rounded up.
    """
    ok = np.zeros(len(x), bool)
    bits = np.bitwise_count(x ^ y)
    near = np.flatnonzero(bits.sum(axis=1, dtype=np.int32) <= 2 * most)  # a coarse look spares most of the turning
    turn = (first[near][:, None] + np.arange(RING)) % RING
    chain = np.cumsum(np.take_along_axis(bits[near], turn, axis=1), axis=1, dtype=np.int32)
    budget = -(-np.arange(1, RING + 1) * most // RING) + 4
    budget[-1] = most
    ok[near] = (chain <= budget).all(axis=1)
    return ok


def _tree(x: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all links between rows of x, found breadth first against what is not reached yet."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(x))
    while len(left):
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            reached = []
            for i in wave:
                far = np.bitwise_count(x[left] ^ x[i]).sum(axis=1, dtype=np.int32)
                hit = far <= most
                if hit.any():
                    out += [(int(i), int(j)) for j in left[hit]]
                    reached.append(left[hit])
                    left = left[~hit]
                    if not len(left):
                        break
            wave = np.concatenate(reached) if reached else left[:0]
    return out


def _pairs(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0], pa.int64()), pa.array(rows[:, 1], pa.int64())], names=["a", "b"])


def _edges(most: int, crowd: int):
    """Rows sorted by bucket to edges (a, b) of fingerprint numbers: a spanning forest of a task's links."""

    def solve(keys: np.ndarray, firsts: np.ndarray, ids: np.ndarray, x: np.ndarray) -> set[tuple[int, int]]:
        found: set[tuple[int, int]] = set()
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        sizes = np.diff(edges)
        for b in np.flatnonzero(sizes > crowd):
            part = slice(edges[b], edges[b + 1])
            found.update((int(ids[part][i]), int(ids[part][j])) for i, j in _tree(x[part], most))
        small = np.repeat(sizes, sizes)
        for lag in range(1, min(crowd, int(sizes.max(initial=0)))):
            at = np.flatnonzero((keys[lag:] == keys[:-lag]) & (small[lag:] <= crowd))
            if not len(at):
                break
            hit = at[_near(x[at], x[at + lag], firsts[at], most)]
            found.update(zip(ids[hit].tolist(), ids[hit + lag].tolist()))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0
        above: dict[int, int] = {}
        tree: list[tuple[int, int]] = []

        def root(x: int) -> int:
            top = x
            while (up := above.setdefault(top, top)) != top:
                top = up
            while above[x] != top:
                above[x], x = top, above[x]
            return top

        def flush(last: bool) -> None:
            nonlocal held, rows
            keys, firsts, ids, x = (np.concatenate([h[k] for h in held]) for k in range(4))
            # A bucket that may go on is kept for the next block.
            end = len(keys) if last else int(np.flatnonzero(keys != keys[-1]).max(initial=-1)) + 1
            for a, b in sorted(solve(keys[:end], firsts[:end], ids[:end], x[:end])) if end else ():
                u, v = root(a), root(b)
                if u != v:
                    above[max(u, v)] = min(u, v)
                    tree.append((a, b))
            held, rows = ([(keys[end:], firsts[end:], ids[end:], x[end:])], len(keys) - end) if end < len(keys) else ([], 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, RING)
            key = batch.column("bucket").to_numpy() * CELLS + batch.column("salt").to_numpy()
            held.append((key, batch.column("first").to_numpy().astype(np.int64), batch.column("node").to_numpy(), x))
            rows += batch.num_rows
            if rows >= COMPARED:
                flush(False)
        if held:
            flush(True)
        for at in range(0, len(tree), COMPARED):
            yield _pairs(np.array(tree[at : at + COMPARED]))

    return run


def _cells(rows: DataFrame, by: str, most: int) -> DataFrame:
    """rows with a salt, such that all pairs of rows with one value of `by` share a salt.

    Values of over `most` rows have parts of about that many; a row stands once for every other part.
    """
    full = rows.groupBy(by).count().filter(F.col("count") > most)
    full = small(full.select(by, F.least(F.lit(PARTS), F.ceil(F.col("count") / most)).cast("int").alias("parts")))
    rows = rows.join(full, by, "left").withColumn("part", F.pmod(F.xxhash64("node", by), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != F.col("part"))
    cells = F.transform(others, lambda k: F.least("part", k) * PARTS + F.greatest("part", k))
    return rows.withColumn("salt", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(cells))).drop("part", "parts")


def similar_links(prints: DataFrame, most: int, crowd: int = 16) -> DataFrame:
    """(a, b) links between nodes of prints (node long, fp binary), distinct fingerprints.

    Every pair of neighbouring bytes of the ring, from each of its places, names a bucket. Buckets of up to `crowd`
    look at their pairs by chains and the full check, fuller ones find a spanning forest of their links. Each task merges
    what it finds and gives an edge for each fingerprint at most, so that what comes out grows with the rows. Very full ones
    are cut into parts, and every two parts meet in a task, so that no pair of a bucket is passed over.
    """
    ring = F.concat("fp", F.substring("fp", 1, 1))
    value = lambda i: F.conv(F.hex(F.substring(ring, i + 1, 2)), 16, 10).cast("long")
    spread = F.explode(F.array(*(F.struct(F.lit(i).alias("first"), (value(i) * RING + i).alias("bucket")) for i in range(RING))))
    rows = prints.select("node", "fp", spread.alias("s")).select("node", "fp", "s.first", "s.bucket")
    rows = _cells(rows, "bucket", BUCKET_ROWS).select("bucket", "salt", "first", "node", "fp")
    rows = rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "node")
    return rows.mapInArrow(releasing(_edges(most, crowd)), "a long, b long").distinct()


# Shingle sets, held against each other exactly.

#: Documents whose shingles are counted to find the common ones, and how many of these are told apart.
COUNTED = 20_000
COMMON = 200_000
#: Bytes of parities that go with each shingle of a prefix.
SIG = 64
#: Rows of a shingle's bucket beyond which its parts are compared two and two.
HOLDERS = 20_000


def shingle_set(blocks: Iterable[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *blocks]))


def common_shingles(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts), by hash, of shingles that several of some thousand documents hold.

    They only say in which order a document's shingles are tried; any order finds the same pairs.
    """
    step = max(1, rows.count() // COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(shingle_hashes(text, width)).view(np.int64))], names=["h"])

    some = rows.filter(F.pmod(F.xxhash64("rid"), F.lit(step)) == 0).select("text").mapInArrow(run, "h long")
    got = some.groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    hashes, counts = got.column("h").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _folded(parities: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(parities.reshape(-1, size), axis=0)


def _sketch(width: int, share: Fraction, common: tuple[np.ndarray, np.ndarray]):
    """text to (node, fp, size, sig, parities, prefix): its shingle set's number, long fingerprint, size and so on.

    Bit k of the parities, two or more a shingle, is that of the number of shingles whose low bits are k: sets differ in
    as many shingles as bits at least. sig has them folded to SIG bytes. Of sets that overlap in share of the
    larger one, the first size - ceil(share * size) + 1 shingles of each in a common order, rare ones first, meet in one.
    """

    def run(text: str | None) -> tuple:
        blocks = list(shingle_hashes(text, width))
        own = shingle_set(blocks)
        bits = max(8 * SIG, 1 << (2 * len(own)).bit_length())
        odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        parities = np.packbits(odd.astype(np.uint8), bitorder="little")
        sig = _folded(parities, SIG)
        times = np.zeros(len(own), np.int64)
        if len(common[0]):
            at = np.minimum(np.searchsorted(common[0], own), len(common[0]) - 1)
            times = np.where(common[0][at] == own, common[1][at], 0)
        prefix = own[np.lexsort((own, times))][: len(own) - math.ceil(share * len(own)) + 1]
        node = xxhash.xxh64_intdigest(own.tobytes(), 7)
        return _signed(node), _majorities(blocks), len(own), sig.tobytes(), parities.tobytes(), prefix.tobytes()

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root, prefix) to (token, node, root, at), at being a shingle's place in the prefix."""
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            lists = batch.column("prefix").to_pylist()
            sizes = np.array([len(x) // 8 for x in lists])
            columns = [np.frombuffer(b"".join(lists), np.int64), *(np.repeat(batch.column(c).to_numpy(), sizes) for c in ("node", "root"))]
            columns.append(np.arange(len(columns[0])) - np.repeat(np.cumsum(sizes) - sizes, sizes))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns[:3]), pa.array(columns[3], pa.int32())], names=["token", "node", "root", "at"])


def _whole_runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], by: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, some ten thousand at a time; rows equal in the first `by` columns come together."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def columns() -> list[np.ndarray]:
        out = []
        for name in names:
            parts = [b.column(name) for b in held]
            binary = pa.types.is_binary(parts[0].type)
            out.append(np.concatenate([np.frombuffer(b"".join(p.to_pylist()), np.uint8).reshape(-1, SIG) if binary else p.to_numpy() for p in parts]))
        return out

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < COMPARED:
            continue
        now = columns()
        last = np.logical_and.reduce([c == c[-1] for c in now[:by]])
        end = len(last) - int(last.sum())
        held = [pa.Table.from_batches(held).slice(end).combine_chunks().to_batches()[0]]
        rows = held[0].num_rows
        if end:
            yield [c[:end] for c in now]
    if rows:
        yield columns()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, node, root, at), sorted by token, of tokens that occur under several roots."""
    names = ("token", "node", "root", "at")
    for columns in _whole_runs(batches, names, 1):
        token, _, root, _ = columns
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        sizes = np.diff(np.concatenate((first, [len(token)])))
        keep = np.repeat(np.maximum.reduceat(root, first) != np.minimum.reduceat(root, first), sizes)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=list(names))


def _candidates(share: Fraction):
    """Rows sorted by (token, salt, size) to pairs (a, b) under different roots that places, sizes and parities don't rule out.

    The first shingle that two sets have in common, in the order of their prefixes, leaves them as many as stand behind
    it in either, itself included, to overlap in. At another shared one this may rule a pair out that the first one gave.
    """
    n, d = share.numerator, share.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, salt, node, root, at, size, sig in _whole_runs(batches, ("token", "salt", "node", "root", "at", "size", "sig"), 2):
            left = size - at
            live, lag, found = np.arange(len(token)), 1, []
            while len(live := live[live < len(token) - lag]):
                x, y = live, live + lag
                # Sizes grow within a bucket, so whoever is too small for this partner is so for all after it.
                ok = (token[x] == token[y]) & (salt[x] == salt[y]) & (size[x] * d >= size[y] * n)
                live = x = x[ok]
                y = x + lag
                # Sets of similarity n / d overlap in n / (n + d) of their sizes' sum at least ...
                both = size[x] + size[y]
                ok = (root[x] != root[y]) & (np.minimum(left[x], left[y]) * (n + d) >= both * n)
                x, y, both = x[ok], y[ok], both[ok]
                # ... and differ in (d - n) / (d + n) of it at most.
                ok = np.bitwise_count(sig[x] ^ sig[y]).sum(axis=1, dtype=np.int64) * (d + n) <= both * (d - n)
                x, y = node[x[ok]], node[y[ok]]
                if len(x):
                    found.append(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1))
                if found and (sum(map(len, found)) > COMPARED):
                    yield _pairs(np.unique(np.concatenate(found), axis=0))
                    found = []
                lag += 1
            if found:
                yield _pairs(np.unique(np.concatenate(found), axis=0))

    return run


def _possible(share: Fraction):
    """Pairs that sizes s, t and parities x, y don't rule out."""
    n, d = share.numerator, share.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, s, t, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "s", "t", "x", "y"))):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                least = min(len(x), len(y))
                apart = int(np.bitwise_count(_folded(x, least) ^ _folded(y, least)).sum(dtype=np.int64))
                if min(s, t) * d >= max(s, t) * n and apart * (d + n) <= (s + t) * (d - n):
                    found.append((a, b))
            if found:
                yield _pairs(np.array(found))

    return run


def _verified(share: Fraction):
    """Pairs whose shingle sets x and y have that Jaccard similarity or more."""
    n, d = share.numerator, share.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, x, y in zip(*(batch.column(c) for c in ("a", "b", "x", "y"))):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * d >= n * (len(x) + len(y) - both):
                    found.append((a.as_py(), b.as_py()))
            if found:
                yield _pairs(np.array(found))

    return run


def verified(pairs: DataFrame, prints: DataFrame, rows: DataFrame, width: int, share: Fraction) -> DataFrame:
    """Those of pairs (a, b) of nodes whose shingle sets have that Jaccard similarity; only their texts are read again."""
    left = prints.select(F.col("node").alias("a"), F.col("size").alias("s"), F.col("parities").alias("x"))
    right = prints.select(F.col("node").alias("b"), F.col("size").alias("t"), F.col("parities").alias("y"))
    pairs = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t", "x", "y").mapInArrow(releasing(_possible(share)), "a long, b long"))
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    needed = small(nodes.join(prints.select("node", "rid"), "node"))
    sets = per_text(rows.select("rid", "text").join(needed, "rid"), lambda t: (shingle_set(shingle_hashes(t, width)).tobytes(),), "x binary", tidy=True)
    sets = cut(sets.select("node", "x"))
    both = pairs.join(sets.withColumnRenamed("node", "a"), "a").join(sets.select(F.col("node").alias("b"), F.col("x").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(releasing(_verified(share)), "a long, b long"))


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, root: one row per row of docs; root names its group of documents reachable by links.

    Documents link exactly if their sets of shingles, told apart by 64 bits of hash, have that Jaccard similarity or more.
    Links that long fingerprints propose come first and make up most of the groups. What they miss shares a shingle
    of both prefixes, so between groups all pairs that do are looked at. Every proposed link is verified on whole sets.
    Null, empty and wordless texts are equal to each other. Repeated rows each get a row; an empty table gives none;
    other columns are not read.
    """
    share = Fraction(str(similarity))
    rows = with_rid(stable(docs), id_col, text_col)
    sketch = _sketch(width, share, common_shingles(rows, width))
    marks = cut(per_text(rows, sketch, "node long, fp binary, size long, sig binary, parities binary, prefix binary", tidy=True))
    first = marks.groupBy("node").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = marks.select("rid", "node").join(first, "node").filter(F.col("rid") != F.col("first")).select("rid")
    prints = marks.join(small(again), "rid", "left_anti").drop("id")
    sure = verified(similar_links(prints.select("node", "fp"), max_distance(similarity)), prints, rows, width, share)
    grouped = prints.join(small(components(sure)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    tokens = grouped.select("node", "root", "prefix").mapInArrow(releasing(_spread), "token long, node long, root long, at int")
    shared = cut(tokens.repartition("token").sortWithinPartitions("token").mapInArrow(releasing(_shared), "token long, node long, root long, at int"))
    shared = _cells(shared, "token", HOLDERS).join(prints.select("node", "size", "sig"), "node")
    shared = shared.select("token", "salt", "node", "root", "at", "size", "sig").repartition("token", "salt").sortWithinPartitions("token", "salt", "size")
    more = shared.mapInArrow(releasing(_candidates(share)), "a long, b long").distinct()
    roots = components(sure.unionByName(verified(more, prints, rows, width, share)))
    return marks.select("rid", "id", "node").join(roots, "node", "left").select("rid", "id", F.coalesce("root", "node").alias("root"))


def without_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of similar_documents, the first by (id, file order); columns as they were."""
    docs = stable(docs)
    rows = similar_documents(docs, width, similarity, id_col, text_col)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("f"), F.count(F.lit(1)).alias("n"))
    return without(docs, rows.join(first.filter("n > 1"), "root").filter(F.col("rid") != F.col("f.rid")))
