"""BPE encoding by a segment tree over adjacent pair ranks, and decoding.

A word's symbols stand at the leaves, as many as there are pairs; leaf i holds rank * width + i for the pair that begins at i.
The root is the minimum and so names the leftmost pair of the lowest rank. A merge changes three leaves at most, each mended up to
the root in logarithmic time, until the root says that no pair merges.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SLICE_ROWS, per_text, releasing, with_rid

DEFAULT = "word_bpe_49k.json"
NEVER = 1 << 62
#: Entries of each of a worker's two caches, after which it starts anew.
CACHED = 400_000
#: White space as Unicode has it; str.split() also splits at U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT_SPACE = regex.compile(f"[{SPACE}]+")
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: Code point ranges that the installed regex library takes for letters or numerals and the tokenizer,
#: which follows an earlier Unicode version, takes for signs.
NEW_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
    (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
    (0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6),
)
#: First and last code point and distance of capitals that Python's str.lower() doesn't know yet.
NEW_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1),
    (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
)
#: Code point ranges of marks that Python's NFC moves or composes and the tokenizer's leaves where they are.
NEW_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85),
    (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0),
    (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1),
    (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
_AT_MARK = regex.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEW_MARKS) + "])")
_AS_SIGN = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEW_LETTERS) + "]")
_CAPITALS = {c: c + d for a, b, d in NEW_CAPITALS for c in range(a, b + 1)}
_IS_CAPITAL = regex.compile("[" + "".join(map(chr, _CAPITALS)) + "]")
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from U+0100."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


def nfc(text: str) -> str:
    """NFC as the tokenizer has it: a mark that it doesn't know stays, and what stands before and after it is normalised by itself."""
    if unicodedata.is_normalized("NFC", text):
        return text  # parts of a normalised text are normalised
    if not _AT_MARK.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(p if k % 2 else unicodedata.normalize("NFC", p) for k, p in enumerate(_AT_MARK.split(text)))


class SegmentTreeBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = [vocab.get(c) for c in letters]
        self.final = [vocab.get(c + suffix) for c in letters]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.tokens = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec["added_tokens"]}
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"]
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: What all special strings begin with; a text without it needs no search for them.
        self.probe = os.path.commonprefix(list(self.special))
        self.words: dict[str, bytes] = {}
        self.chunks = _Chunks(self)

    def merge(self, symbols: list[int]) -> list[int]:
        """symbols after all merges."""
        n, pair = len(symbols), self.pairs.get
        if n < 2:
            return symbols
        width = n - 1
        tree = [NEVER] * (2 * width)
        made = [0] * width
        for i in range(width):
            if hit := pair(symbols[i] << 32 | symbols[i + 1]):
                tree[width + i], made[i] = hit[0] * width + i, hit[1]
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while (least := tree[1]) != NEVER:
            i = least % width
            j = after[i]
            symbols[i], symbols[j] = own, _ = made[i], -1
            after[i] = k = after[j]
            before[k] = i
            # The leaves of the new symbol and of those on both sides of it; one that is no leaf is the new symbol's again.
            if k < n and (hit := pair(own << 32 | symbols[k])):
                tree[width + i], made[i] = hit[0] * width + i, hit[1]
            else:
                tree[width + i] = NEVER
            if j < width:
                tree[width + j] = NEVER
            else:
                j = i
            if (x := before[i]) < 0:
                x = i
            elif hit := pair(symbols[x] << 32 | own):
                tree[width + x], made[x] = hit[0] * width + x, hit[1]
            else:
                tree[width + x] = NEVER
            for k in (i, j, x):
                k += width
                while k > 1:
                    k >>= 1
                    a, b = tree[2 * k], tree[2 * k + 1]
                    if b < a:
                        a = b
                    if tree[k] == a:
                        break
                    tree[k] = a
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> bytes:
        """Ids of one piece of a word, as little-endian 32-bit integers."""
        ids = self.words.get(word)
        if ids is None:
            data = word.encode()
            symbols = [self.inner[b] for b in data[:-1]]
            symbols.append(self.final[data[-1]])
            ids = array("I", self.merge([s for s in symbols if s is not None])).tobytes()
            if len(word) < 64:
                if len(self.words) >= CACHED:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian 32-bit integers; special strings become their ids."""
        if self.at_special and self.probe in text:
            parts = self.at_special.split(text)
            return b"".join(self.special[p] if k % 2 else self._plain(p) for k, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = nfc(text)
            if _IS_CAPITAL.search(text):
                text = text.translate(_CAPITALS)
        # Each code point is lowered for itself; only a final capital sigma would differ.
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        words = SPLIT_SPACE.split(text) if ODD_SPACE.search(text) else text.split()
        if len(self.chunks) >= CACHED:
            self.chunks.clear()
        return b"".join(map(self.chunks.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        """Tokens with a space between; the vocabulary has no decoder that would join them."""
        own = array("I")
        own.frombytes(ids)
        return " ".join(map(self.tokens.__getitem__, own))


def pieces(chunk: str) -> list[str]:
    """Runs of letters, single numerals and runs of other signs."""
    if chunk.isascii() or not _AS_SIGN.search(chunk):
        return PIECES.findall(chunk)
    known = _AS_SIGN.sub("�", chunk)
    return [chunk[m.start() : m.end()] for m in PIECES.finditer(known)]


class _Chunks(dict):
    """Ids of what stands between white space."""

    def __init__(self, bpe: SegmentTreeBPE):
        self.bpe = bpe

    def __missing__(self, chunk: str) -> bytes:
        ids = b"".join(map(self.bpe.word, pieces(chunk)))
        if len(chunk) < 64:
            self[chunk] = ids
        return ids


@lru_cache(2)
def load(path: str) -> SegmentTreeBPE:
    return SegmentTreeBPE(path)


def _path(path: str | None) -> str:
    return path or public_tokenizers.path(DEFAULT)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, n_tokens, ids (binary, little-endian unsigned 32-bit), one row per row of docs.

    Null and empty texts have no ids; texts of any length are encoded whole; repeated rows each get a row. Other
    columns are not read. Rows are handled where they lie: no shuffle.
    """
    where = _path(path)

    def ids(text: str | None) -> tuple[int, bytes]:
        out = load(where).encode(text) if text else b""
        return len(out) // 4, out

    return per_text(with_rid(docs, id_col, text_col), ids, "n_tokens long, ids binary")


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of the text decoded from those ids.

    One row per row of docs: null and empty texts have no ids and decode to nothing, texts of any length are taken whole,
    repeated rows each get a row, an empty table gives none, and other columns are not read.
    """
    where = _path(path)

    def digests(text: str | None) -> tuple[int, str, str]:
        bpe = load(where)
        ids = bpe.encode(text) if text else b""
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

    return per_text(with_rid(docs, id_col, text_col), digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id column, n_tokens, ids (array of int) and decoded (text), one row per row of docs; what decodes is what encode gave.

    Rows are treated as in encode_decode; other columns are left out, whatever their names.
    """
    where = _path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(where)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                ids = [bpe.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                edges = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(ids), "<u4").view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), values, pa.array(map(bpe.decode, ids), pa.string())], names=["id", "n_tokens", "ids", "decoded"])
        bpe.words.clear()
        bpe.chunks.clear()

    rows = with_rid(docs, id_col, text_col).mapInArrow(releasing(run), "id long, n_tokens long, ids array<int>, decoded string")
    return rows.select(F.col("id").alias(id_col), "n_tokens", "ids", "decoded")
