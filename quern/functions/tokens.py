"""Tokens of an injected tokenizer, as the places where they end in a text.

`Ends` gives, for a text, where each of its tokens ends, in code points and in order; the last one ends with the text.
Counts, cuts, overlaps and windows are places in that list, so a text is tokenized once and never put together again from ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import _c

Ends = Callable[[str], np.ndarray]


@dataclass(frozen=True)
class Characters:
    """Tokens of a fixed number of code points."""

    chars: int = 4

    def __call__(self, text: str) -> np.ndarray:
        return np.minimum(np.arange(self.chars, len(text) + self.chars, self.chars), len(text))


@dataclass(frozen=True)
class Pattern:
    """Tokens are matches of a pattern with what stands before each; what follows the last one belongs to it."""

    pattern: str = r"[^ \t-\r]+"

    def __call__(self, text: str) -> np.ndarray:
        ends = np.fromiter((m.end() for m in re.finditer(self.pattern, text)), np.int64)
        if len(ends):
            ends[-1] = len(text)
        return ends


@dataclass(frozen=True)
class Ranks:
    """Byte-pair tokens by a file of ranks, a token in base 64 and its rank a line; each worker reads the file once.

    A token that ends inside a character ends, as a place in the text, behind it.
    """

    path: str
    pattern: str

    def __call__(self, text: str) -> np.ndarray:
        encoding = _encoding(self.path, self.pattern)
        sizes = [len(encoding.decode_single_token_bytes(i)) for i in encoding.encode_ordinary(text)]
        ends = np.cumsum(np.array(sizes, np.int64))
        data = np.frombuffer(text.encode(), np.uint8)
        # How many characters begin before a byte: those are read by a token that ends there.
        begun = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        return begun[ends]


@lru_cache(4)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def truncate(text: str, n: int, ends: Ends) -> str:
    """The first n tokens; the whole text if it has no more."""
    at = ends(text)
    return text if len(at) <= n else text[: at[n - 1]] if n > 0 else ""


def suffix(text: str, n: int, ends: Ends) -> str:
    """The last n tokens; the whole text if it has no more."""
    at = ends(text)
    return "" if n <= 0 else text if len(at) <= n else text[at[len(at) - n - 1] :]


def windows(text: str, size: int, overlap: int, ends: Ends) -> list[str]:
    """Windows of `size` tokens, each beginning `overlap` tokens before the last one's end, until one reaches the end."""
    at = np.concatenate(([0], ends(text)))
    n, step = len(at) - 1, size - overlap
    last = 0 if n <= size else -(-(n - size) // step)
    return [text[at[i * step] : at[min(n, i * step + size)]] for i in range(last + 1)] if n else []


def count(c: Column | str, ends: Ends) -> Column:
    """How many tokens a text has; a null one has none."""

    @F.pandas_udf("int")
    def run(texts):
        return texts.map(lambda t: len(ends(t)) if t else 0).astype("int32")

    return run(_c(c))
