"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a text form a linked list and its adjacent pairs a heap by rank. The lowest pair is popped again and
again, the leftmost first; a pair of which a side has merged meanwhile is passed over. The count is the number of
initial symbols, a character without a piece standing for its bytes, minus the number of merges. No ids are made.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import CACHE_ENTRIES, per_text, with_rid

DEFAULT = "piece_bpe_32k.model"
SPACE = "▁"


class HeapCounter:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)  # reads the file; texts never go through it
        own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        own.sort(key=lambda i: (-model.get_score(i), i))
        #: Lower ranks merge first; pieces of equal score have equal ranks.
        self.rank: dict[str, int] = {}
        scores: dict[float, int] = {}
        for i in own:
            self.rank[model.id_to_piece(i)] = scores.setdefault(model.get_score(i), len(scores))
        inner = [p for p in self.rank if SPACE in p.lstrip(SPACE)]
        if inner:
            raise ValueError(f"pieces join words, such as {inner[0]!r}: texts can't be counted word by word")
        letters = {c for p in self.rank for c in p}
        if missing := letters - self.rank.keys():
            raise ValueError(f"{min(missing)!r} is in a piece but isn't one")
        self.words = _Words(self)

    def count_word(self, word: str) -> int:
        """Tokens of a text in which no piece can reach over white space."""
        rank = self.rank
        symbols = list(word)
        n = len(symbols)
        count = n
        for c in symbols:
            if c not in rank:
                count += len(c.encode()) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            if not symbols[i] or (j := after[i]) >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(symbols[i] + symbols[k])) is not None:
                    heappush(heap, (r, i, len(symbols[i]) + len(symbols[k])))
            if (h := before[i]) >= 0 and (r := rank.get(symbols[h] + symbols[i])) is not None:
                heappush(heap, (r, h, len(symbols[h]) + len(symbols[i])))
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self.words) >= CACHE_ENTRIES:
            self.words.clear()
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.words.__getitem__, text.split(" ")))
        marked = SPACE + text.replace(" ", SPACE)
        return sum(self.count_word(w) if len(w) > 64 else self.words.spaced(w) for w in re.findall(f"{SPACE}+[^{SPACE}]*", marked))


class _Words(dict):
    """Token counts of words, without the mark of the space before them."""

    def __init__(self, counter: HeapCounter):
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.count_word(SPACE + word)
        if len(word) < 64:
            self[word] = n
        return n

    def spaced(self, marked: str) -> int:
        return self[marked[1:]]


@lru_cache(2)
def load(path: str) -> HeapCounter:
    return HeapCounter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per row of docs.

    Null and empty texts have 0 bytes and tokens; texts of any length are counted whole; repeated rows each get a
    row. Other columns are not read. Rows are handled where they lie: no shuffle.
    """
    where = path or public_tokenizers.path(DEFAULT)

    def count(text: str | None) -> tuple[int, int]:
        return (len(text.encode()), load(where).count(text)) if text else (0, 0)

    return per_text(with_rid(docs, id_col, text_col), count, "n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
