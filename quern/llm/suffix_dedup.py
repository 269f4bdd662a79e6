"""Suffix-array dedup over a corpus: longest-previous-factor arrays behind an anchor filter.

A passage counts as repeated if `length` bytes of it also start elsewhere. In every window of that length the least of
its k-gram hashes is its anchor; equal windows have equal anchors at equal places. Anchors that occur once rule
their windows out. The rest go, by anchor, to where all equal windows meet. There the suffixes that begin at the windows
are put in suffix order to a depth of `length`, with the common prefixes of neighbours. The nearest suffixes on both
sides of that order which stand earlier in the corpus, found by previous and next smaller positions, give each suffix
its longest previous factor, to that depth. Where it reaches `length`, the window is a later copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stable, with_rid

GRAM = 24
#: Bytes of text that are hashed at a time.
SPAN = 1 << 20
#: Occurrences beyond which an anchor's windows are dealt by their distance to it.
CROWD = 1000
DISTANCES = 16
#: Runs of windows whose anchors a task packs together.
OCCURRENCES = 500_000
#: Texts whose contexts a task holds at a time.
TEXTS = 1000
#: Windows that are put in order at a time, unless one anchor has more.
ORDERED = 100_000
#: Ranges of repeated windows that a task packs together.
FOUND = 200_000
#: Runs alike that one number stands for at most.
REPEATS = (1 << 15) - 1

_B = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    if not _tables:
        for base in (_B, pow(_B, -1, 1 << 64)):
            own = np.full(SPAN + 1024, base, np.uint64)
            own[0] = 1
            _tables.append(np.multiply.accumulate(own))
    return _tables


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the GRAM bytes at each position of at most SPAN + 1024 bytes."""
    up, down = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[i : i + w] for each i: minima up to and from the edges of blocks of w."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.uint64(_MASK))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows, distance, times): runs of windows with one anchor; distance: from the first window to it.

    times: so many runs alike in hash, windows and distance follow each other, as where a text repeats one sign.
    """
    out: list[tuple[np.ndarray, ...]] = []
    w = length - GRAM + 1
    for at in range(0, max(0, len(data) - length + 1), SPAN - length + 1):  # blocks share no window
        part = np.frombuffer(data, np.uint8, min(SPAN, len(data) - at), at)
        h = gram_hashes(part)
        # Of equal hashes the leftmost: the position fills the bits that the choice can spare.
        keyed = (h & np.uint64(_MASK ^ (SPAN - 1))) | np.arange(len(h), dtype=np.uint64)
        least = (_sliding_min(keyed, w) & np.uint64(SPAN - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        n = np.diff(np.concatenate((first, [len(least)])))
        hashes, distance = h[least[first]], least[first] - first
        other = (hashes[1:] != hashes[:-1]) | (n[1:] != n[:-1]) | (distance[1:] != distance[:-1])
        group = np.flatnonzero(np.concatenate(([True], other)))
        size = np.diff(np.concatenate((group, [len(first)])))
        pieces = -(-size // REPEATS)
        which = np.repeat(np.arange(len(group)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        own = group[which] + nth * REPEATS
        out.append((hashes[own], first[own] + at, n[own], distance[own], np.minimum(REPEATS, size[which] - nth * REPEATS)))
    if not out:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4)
    return tuple(np.concatenate(x) for x in zip(*out))


_OCC = "h long, n long, places binary"


def _occurrences(length: int):
    """Anchors of some hundred thousand windows' runs, each once with how often it stands there and where.

    places: pairs of rid and times << 48 | first window << 16 | windows << 8 | distance; the last two are below 256.
    """

    def pack(hs: list, places: list, times: list) -> pa.RecordBatch:
        return _packed(np.concatenate(hs).view(np.int64), np.concatenate(places), np.concatenate(times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, places, times, size = [], [], [], 0
        for batch in _slices(batches):
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text")):
                if (data := text.as_buffer()) is None or len(data) < length:
                    continue
                h, first, n, distance, again = anchors(data, length)
                hs.append(h)
                places.append(np.stack((np.full(len(h), rid), again << 48 | first << 16 | n << 8 | distance), axis=1))
                times.append(again)
                size += len(h)
                if size > OCCURRENCES:
                    yield pack(hs, places, times)
                    hs, places, times, size = [], [], [], 0
        if size:
            yield pack(hs, places, times)

    return run


def _packed(keys: np.ndarray, values: np.ndarray, weights: np.ndarray | None = None) -> pa.RecordBatch:
    """(h, n, places): rows of values packed by key, and the sum of their weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    edges = np.concatenate((new, [len(keys)]))
    flat = np.ascontiguousarray(values[order])
    bytes_ = (edges * flat.itemsize * flat.shape[1]).astype(np.int32)
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(bytes_.tobytes()), pa.py_buffer(flat.tobytes())])
    n = np.diff(edges) if weights is None else np.add.reduceat(weights[order], new)
    return pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(n), packed], names=["h", "n", "places"])


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated anchors (h, total, places) to (rid, anchors): rows (h, place, total) packed for each rid and batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("places").to_pylist()
        sizes = np.array([len(x) // 16 for x in lists])
        own = np.frombuffer(b"".join(lists), "<i8").reshape(-1, 2)
        rows = np.stack((np.repeat(batch.column("h").to_numpy(), sizes), own[:, 1], np.repeat(batch.column("total").to_numpy(), sizes)), axis=1)
        out = _packed(own[:, 0], rows)
        yield pa.RecordBatch.from_arrays([out.column("h"), out.column("places")], names=["rid", "anchors"])


_CONTEXT = "h long, near long, context binary, owners binary"


def _pieces(data: bytes, first: int, n: int, distance: int, many: bool, length: int) -> Iterator[tuple[int, int, int]]:
    """(near, first, windows) of a run of windows: where they meet their like among those of the same anchor.

    Equal windows stand at equal distances before their anchor. If an anchor is common, its windows are dealt by ranges of
    distances and by the bytes that all windows of such a range cover, so that only those meet which differ in
    DISTANCES bytes at either end at most.
    """
    if not many:
        yield 0, first, n
        return
    anchor = first + distance
    while n:
        group = distance // DISTANCES
        m = min(n, distance - group * DISTANCES + 1)
        # Windows of the range begin group * DISTANCES before the anchor at least, DISTANCES - 1 more at most.
        core = data[anchor - group * DISTANCES : anchor - group * DISTANCES - DISTANCES + 1 + length]
        yield xxhash.xxh64_intdigest(core, group) >> 1 | 1, first, m
        first, n, distance = first + m, n - m, distance - m


def _contexts(length: int):
    """Bytes that a run's windows cover, once for some hundred texts with all places (rid, first, times) where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found: dict[tuple[int, int, bytes], list[int]] = {}
            for rid, text, own in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), batch.column("anchors").to_pylist()):
                data = text.encode()
                for h, place, total in np.frombuffer(b"".join(own), "<i8").reshape(-1, 3).tolist():
                    times, first, n, distance = place >> 48, place >> 16 & 0xFFFFFFFF, place >> 8 & 255, place & 255
                    many = total > CROWD
                    if times > 1:
                        end = first + times * n + length - 1
                        parts = list(_pieces(data, first, n, distance, many, length))
                        if len(parts) == 1 and data[first : end - n] == data[first + n : end]:
                            found.setdefault((h, parts[0][0], data[first : first + n + length - 1]), []).extend((rid, first, times))
                            continue
                    for start in range(first, first + times * n, n):
                        for near, a, m in _pieces(data, start, n, distance, many, length):
                            found.setdefault((h, near, data[a : a + m + length - 1]), []).extend((rid, a, 1))
            if found:
                columns = [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array([k[2] for k in found], pa.binary())]
                columns.append(pa.array([np.array(v, "<i8").tobytes() for v in found.values()], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["h", "near", "context", "owners"])

    return run


def common_prefixes(windows: np.ndarray) -> np.ndarray:
    """Length of what each row of sorted windows shares with the row before it; 0 for the first."""
    out = np.zeros(len(windows), np.int64)
    for at in range(1, len(windows), 4096):
        unlike = windows[at : at + 4096] != windows[at - 1 : at - 1 + len(windows[at : at + 4096])]
        out[at : at + 4096] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), windows.shape[1])
    return out


def previous_smaller(places: np.ndarray, shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in suffix order the last one before it that stands earlier in the corpus, and what they share.

    shared: common prefixes of neighbours. -1 and 0 where there is none that shares `depth`, as nothing less is asked for.
    All are looked for at once: who isn't earlier passes on to whom it has found, so that steps double.
    """
    to, least = np.arange(len(places)) - 1, shared.copy()
    live = np.flatnonzero((to >= 0) & (least >= depth))
    while len(live := live[places[to[live]] > places[live]]):
        via = to[live]
        to[live], least[live] = to[via], np.minimum(least[live], least[via])
        live = live[(to[live] >= 0) & (least[live] >= depth)]
    return np.where(least >= depth, to, -1), np.where((least >= depth) & (to >= 0), least, 0)


def longest_previous_factors(order: np.ndarray, shared: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(factors, sources): for each suffix how much of it, from `depth` on, stands earlier, and whether it is where another's does.

    order: suffixes in suffix order; shared: what each shares with its neighbour before; places: of suffixes in the corpus.
    """
    ranked = places[order]
    before, left = previous_smaller(ranked, shared, depth)
    mirrored = np.concatenate((shared[1:], [0]))[::-1] if len(shared) else shared
    after, right = previous_smaller(ranked[::-1], mirrored, depth)
    after, right = np.where(after >= 0, len(order) - 1 - after, -1)[::-1], right[::-1]
    factors, sources = np.empty(len(order), np.int64), np.zeros(len(order), bool)
    factors[order] = np.maximum(left, right)
    for near in (before, after):
        sources[order[near[near >= 0]]] = True
    return factors, sources


def repeated_windows(contexts: list[bytes], leads: np.ndarray, length: int, keep_first: bool) -> np.ndarray:
    """Rows (rid, first, end) of runs of repeated windows at the first places of contexts; leads: rows (rid, first), contexts differ.

    If not keep_first, the windows that others repeat are runs too.
    """
    starts = np.array([len(c) - length + 1 for c in contexts])
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    offsets = np.cumsum([0, *map(len, contexts)])[:-1]
    of = np.repeat(np.arange(len(contexts)), starts)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)
    windows = np.lib.stride_tricks.sliding_window_view(flat, length)[offsets[of] + inner]
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{length}").ravel(), kind="stable")
    shared = common_prefixes(windows[order])
    del windows
    rid, at = leads[of, 0], leads[of, 1] + inner
    places = np.empty(len(of), np.int64)
    places[np.lexsort((at, rid))] = np.arange(len(of))
    factors, sources = longest_previous_factors(order, shared, places, length)
    hit = factors >= length
    if not keep_first:
        hit |= sources
    joined = hit[1:] & hit[:-1] & (of[1:] == of[:-1])
    first = np.flatnonzero(hit & ~np.concatenate(([False], joined)))
    last = np.flatnonzero(hit & ~np.concatenate((joined, [False])))
    return np.stack((rid[first], at[first], at[last] + 1), axis=1)


class _Group:
    """Contexts of one anchor as they stream past; of each only its first place is held, all others are later copies."""

    def __init__(self) -> None:
        self.leads: dict[bytes, tuple[int, int]] = {}
        self.copied: set[bytes] = set()

    def add(self, context: bytes, owners: bytes, windows: int) -> np.ndarray:
        """Window ranges (rid, first, end) of places that aren't the context's first."""
        own = np.frombuffer(owners, "<i8").reshape(-1, 3)
        best = int(np.lexsort((own[:, 1], own[:, 0]))[0]) if len(own) > 1 else 0
        lead = (int(own[best, 0]), int(own[best, 1]))
        out = np.stack((own[:, 0], own[:, 1], own[:, 1] + own[:, 2] * windows), axis=1)
        out[best, 1] += windows
        known = self.leads.get(context)
        if known is None or lead < known:
            self.leads[context] = lead
        if known is not None:
            rid, at = max(lead, known)
            out = np.concatenate((out, [(rid, at, at + windows)]))
        out = out[out[:, 1] < out[:, 2]]
        if len(out):
            self.copied.add(context)
        return out


def _spans(found: np.ndarray) -> pa.RecordBatch:
    """(rid, spans): ranges packed by rid."""
    out = _packed(found[:, 0], found[:, 1:])
    return pa.RecordBatch.from_arrays([out.column("h"), out.column("places")], names=["rid", "spans"])


def _ranges(length: int, keep_first: bool):
    """Contexts sorted by (h, near) to (rid, spans): window ranges, packed for each rid and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, _Group()
        waiting: list[tuple[bytes, tuple[int, int]]] = []
        windows = rows = 0
        ready: list[np.ndarray] = []

        def put(found: np.ndarray) -> None:
            nonlocal rows
            ready.append(found)
            rows += len(found)

        def solve() -> None:
            nonlocal waiting, windows
            if waiting:
                put(repeated_windows([c for c, _ in waiting], np.array([x for _, x in waiting], np.int64), length, keep_first))
            waiting, windows = [], 0

        def close() -> None:
            nonlocal windows
            if not keep_first and group.copied:
                put(np.array([(*group.leads[c], group.leads[c][1] + len(c) - length + 1) for c in group.copied], np.int64))
            if len(group.leads) > 1:
                waiting.extend(group.leads.items())
                windows += sum(len(c) - length + 1 for c in group.leads)
            if windows >= ORDERED:
                solve()

        for batch in batches:
            for h, near, context, owners in zip(*(batch.column(c).to_pylist() for c in ("h", "near", "context", "owners"))):
                if (h, near) != key:
                    close()
                    key, group = (h, near), _Group()
                if len(found := group.add(context, owners, len(context) - length + 1)):
                    put(found)
                if rows >= FOUND:
                    yield _spans(np.concatenate(ready))
                    ready, rows = [], 0
        close()
        solve()
        if rows:
            yield _spans(np.concatenate(ready))

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            yield whole.slice(at, TEXTS)


def merged(spans: list[bytes], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs that windows cover, from packed ranges of their starts."""
    flat = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
    if not len(flat):
        return []
    flat = flat[np.argsort(flat[:, 0], kind="stable")]
    ends = np.maximum.accumulate(flat[:, 1] + length - 1)
    new = np.flatnonzero(np.concatenate(([True], flat[1:, 0] > ends[:-1])))
    return list(zip(flat[new, 0].tolist(), ends[np.concatenate((new[1:] - 1, [len(flat) - 1]))].tolist()))


def _removed(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = []
            for rid, i, text, spans in zip(*(batch.column(c).to_pylist() for c in ("rid", "id", "text", "spans"))):
                data = (text or "").encode()
                runs = merged(spans or [], length)
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                out.append((rid, i, len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            types = (pa.int64(),) * 5 + (pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["rid", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeated_passages(docs: DataFrame, length: int = 200, keep_first: bool = True, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary; null unless with_text), one row per row of docs.

    Texts are UTF-8 bytes, null is empty, and matches stay inside a text. Each byte is removed that is covered by a window
    of `length` bytes which stands elsewhere too: anywhere, or only earlier in (file, row, byte) order if keep_first.
    Windows are judged on the input. Repeated rows are copies of each other; texts shorter than `length` stay whole; an
    empty table gives no rows; other columns are not read. length is from GRAM + 1 to 250.
    """
    if not GRAM < length <= 250:
        raise ValueError("length must be from 25 to 250")
    rows = with_rid(stable(docs), id_col, text_col)
    # Each task packs an anchor's places, so that a passage in very many texts has a row for each task and not for each text.
    seen = rows.mapInArrow(_occurrences(length), _OCC)
    sizes = seen.groupBy("h").agg(F.sum("n").alias("total")).filter("total > 1")
    again = seen.join(sizes, "h").select("h", "total", "places").mapInArrow(_by_text, "rid long, anchors binary")
    again = again.groupBy("rid").agg(F.collect_list("anchors").alias("anchors"))
    dealt = rows.repartition("rid")
    # id is carried so that both joins read one exchange of the texts.
    contexts = dealt.join(again, "rid").select("rid", "id", "text", "anchors").mapInArrow(_contexts(length), _CONTEXT)
    spans = contexts.repartition("h", "near").sortWithinPartitions("h", "near").mapInArrow(_ranges(length, keep_first), "rid long, spans binary")
    spans = spans.groupBy("rid").agg(F.collect_list("spans").alias("spans"))
    out = dealt.join(spans, "rid", "left").select("rid", "id", "text", "spans")
    return out.mapInArrow(_removed(length, with_text), "rid long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
