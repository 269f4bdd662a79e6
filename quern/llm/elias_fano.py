"""Elias-Fano coded monotone sequences and a two-level n-gram trie over them."""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Queries that are looked up at a time; bounds what a lookup unpacks.
STEP = 1 << 16


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit integers in about 2 + log2(universe / n) bits each.

    Each value's low bits are packed side by side. The high bits are a bit vector in which element i with high part h
    sets bit h + i; counts of ones before each 64-bit word make ranks and selections a search and one word.
    """

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, ((top + 1) // max(1, self.n)).bit_length() - 1)
        low = values & np.uint64((1 << self.low_bits) - 1)
        self.low = self._pack(low)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64) if self.low_bits else values.astype(np.int64)
        size = (int(high[-1]) if self.n else 0) + self.n + 1
        flags = np.zeros(-(-(size + 1) // 64) * 64, np.uint8)
        flags[high + np.arange(self.n)] = 1
        self.words = np.packbits(flags, bitorder="little").view(np.uint64)
        self._index()

    def _index(self) -> None:
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(ones)))
        self.zeros = 64 * np.arange(len(self.ones)) - self.ones

    def _pack(self, low: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(8, np.uint8)
        out = []
        for at in range(0, len(low), STEP):
            part = low[at : at + STEP]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : self.low_bits]
            out.append(np.packbits(bits.ravel(), bitorder="little"))  # STEP values fill whole bytes
        return np.concatenate([*out, np.zeros(16, np.uint8)])

    def _low(self, i: np.ndarray) -> np.ndarray:
        """Low bits of elements i: nine bytes hold any field of up to 64 bits that begins inside the first."""
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        first = self.low[byte[:, None] + np.arange(8)].copy().view(np.uint64).ravel()
        ninth = self.low[byte + 8].astype(np.uint64)
        value = first >> shift
        value |= np.where(shift > 0, ninth << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return value & np.uint64((1 << self.low_bits) - 1)

    def _select(self, counts: np.ndarray, k: np.ndarray, of: int) -> np.ndarray:
        """Position of the k-th (from 0) bit that is `of`."""
        word = np.searchsorted(counts, k, side="right") - 1
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if not of:
            bits ^= 1
        upto = np.cumsum(bits, axis=1, dtype=np.uint8)
        return 64 * word + np.argmax(upto > (k - counts[word]).astype(np.uint8)[:, None], axis=1)

    def get(self, i: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.uint64)
        for at in range(0, len(i), STEP):
            k = np.asarray(i[at : at + STEP], np.int64)
            high = (self._select(self.ones, k, 1) - k).astype(np.uint64)
            out[at : at + STEP] = (high << np.uint64(self.low_bits)) | self._low(k)
        return out

    def find(self, x: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of each x, or -1, in the whole sequence or among elements first to end (exclusive).

        The elements of x's high part lie between two zeros; those of them in the range are halved by their low bits.
        """
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        last = int(self.zeros[-1]) - 2
        for at in range(0, len(x), STEP):
            part = np.asarray(x[at : at + STEP], np.uint64)
            high = (part >> np.uint64(self.low_bits)).astype(np.int64)
            ok = (high >= 0) & (high <= last)
            if first is not None:
                ok &= first[at : at + STEP] < end[at : at + STEP]
            ask = np.flatnonzero(ok)
            high, low = high[ask], part[ask] & np.uint64((1 << self.low_bits) - 1)
            a = np.where(high > 0, self._select(self.zeros, np.maximum(high - 1, 0), 0) - high + 1, 0)
            b = self._select(self.zeros, high, 0) - high
            if first is not None:
                a, b = np.maximum(a, first[at + ask]), np.minimum(b, end[at + ask])
            while len(ask):  # halve [a, b) for all that are left
                live = a < b
                ask, a, b, low = ask[live], a[live], b[live], low[live]
                if not len(ask):
                    break
                mid = (a + b) >> 1
                got = self._low(mid)
                hit = got == low
                out[at + ask[hit]] = mid[hit]
                a, b = np.where(got < low, mid + 1, a), np.where(got < low, b, mid)
                keep = ~hit
                ask, a, b, low = ask[keep], a[keep], b[keep], low[keep]
        return out

    def to_files(self, folder: str, name: str) -> EliasFano:
        """The same sequence with its levels mapped from files."""
        for part in ("low", "words"):
            data = getattr(self, part)
            path = os.path.join(folder, f"{name}.{part}")
            data.tofile(path)
            setattr(self, part, np.memmap(path, data.dtype, "r"))
        return self


class Trie:
    """Contexts, and for each its successors with a quantised log10 probability.

    Level one holds context hashes; level two holds successors, made monotone by the context's index above SUCCESSOR
    bits. Pointers, monotone too, give the range of each context's successors, and a successor is looked for in the range
    of its context alone. Codes are one byte: 0 for none, else a probability's logarithm in even steps.
    """

    SUCCESSOR = 42
    LEAST, CODES = -9.0, 254

    def __init__(self, contexts: np.ndarray, keys: np.ndarray, probabilities: np.ndarray, folder: str | None = None):
        """contexts: sorted hashes; keys: sorted context index << SUCCESSOR | successor; a probability for each key."""
        if len(contexts) >= 1 << (63 - self.SUCCESSOR):
            raise ValueError("too many contexts for one trie")
        self.contexts = EliasFano(contexts)
        self.successors = EliasFano(keys)
        at = np.searchsorted(keys, np.arange(len(contexts) + 1, dtype=np.uint64) << np.uint64(self.SUCCESSOR))
        self.pointers = EliasFano(at)
        self.codes = self.quantise(probabilities)
        if folder:
            self.contexts.to_files(folder, "contexts")
            self.successors.to_files(folder, "successors")
            self.pointers.to_files(folder, "pointers")
            path = os.path.join(folder, "codes")
            self.codes.tofile(path)
            if len(self.codes):
                self.codes = np.memmap(path, np.uint8, "r")

    @classmethod
    def quantise(cls, p: np.ndarray) -> np.ndarray:
        steps = np.rint((np.log10(np.maximum(p, 10.0**cls.LEAST)) / -cls.LEAST + 1) * cls.CODES)
        return (1 + np.clip(steps, 0, cls.CODES)).astype(np.uint8)

    @classmethod
    def probability(cls, codes: np.ndarray) -> np.ndarray:
        """0 for code 0."""
        table = 10.0 ** ((np.arange(cls.CODES + 2) - 1) / cls.CODES * -cls.LEAST + cls.LEAST)
        table[0] = 0.0
        return table[codes]

    def context(self, hashes: np.ndarray) -> np.ndarray:
        return self.contexts.find(hashes)

    def range(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end of the successors of each context index; an empty range for -1."""
        if self.pointers.n < 2:  # no context
            return np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        at = np.maximum(context, 0)
        first, end = self.pointers.get(at).astype(np.int64), self.pointers.get(at + 1).astype(np.int64)
        return first, np.where(context >= 0, end, first)

    def lookup(self, context: np.ndarray, sizes: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of successors of contexts; the first sizes[0] successors are asked of context[0], and so on; -1 as context is none."""
        first, end = (np.repeat(x, sizes) for x in self.range(context))
        key = (np.repeat(np.maximum(context, 0), sizes).astype(np.uint64) << np.uint64(self.SUCCESSOR)) | successor
        at = self.successors.find(key, first, end)
        return np.where(at >= 0, self.codes[np.maximum(at, 0)] if len(self.codes) else 0, 0).astype(np.uint8)


def scratch() -> tempfile.TemporaryDirectory:
    """A folder of the worker's own, gone when closed."""
    return tempfile.TemporaryDirectory(prefix="quern-trie-")
