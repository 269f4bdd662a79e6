"""Quality classifier: a generalised additive model with pairwise interactions, learnt by cyclic boosting.

Each feature is cut into bins. Boosting goes round the features; in each step a shallow tree over one feature's bins
is fitted to the residuals and added, damped, to that feature's lookup table. Then the pairs whose products of bins
explain most of what is left get tables of their own in the same way. A text's score is a sum of table entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, slices, with_rid
from quern.llm.quality_rules import MEASURES, measure

FEATURES = (
    "log_words", "mean_word", "symbols", "dup_lines", "repeated_words", "exclamations", "odd_words", "distinct_words",
    "capitals", "digits", "stops", "bars", "beyond_ascii", "top_word", "words_a_line", "byte_entropy", "short_words",
)
#: Labelled rows that the fit takes at most, those with the least hash of their id. More don't move the tables.
MAX_TRAIN = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1


def features(text: str | None) -> tuple[float, ...]:
    """FEATURES of a whole text; all 0 for null, empty and wordless ones."""
    m = dict(zip(MEASURES, measure(text)))
    n = m["n_words"]
    if not n:
        return (0.0,) * len(FEATURES)
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = Counter(data.split())
    share = counts[counts > 0] / len(data)
    upper, letters = int(counts[65:91].sum()), int(counts[65:91].sum() + counts[97:123].sum())
    return (
        float(np.log1p(n)), m["word_chars"] / n, m["n_symbols"] / m["word_chars"], m["n_dup_lines"] / m["n_lines"],
        m["n_repeat_words"] / n, m["n_exclaim"] / n, m["n_odd_words"] / n, len(words) / n, upper / max(1, letters),
        int(counts[48:58].sum()) / len(data), int(counts[46]) / n, int(counts[124]) / n, int(counts[128:].sum()) / len(data),
        words.most_common(1)[0][1] / n, n / m["n_lines"], float(-(share * np.log2(share)).sum()),
        sum(c for w, c in words.items() if len(w) <= 3) / n,
    )


@dataclass
class Model:
    """Tables by feature and pair; edges cut features into bins."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x: additions of looked-up bins."""
        total = np.full(len(x), self.bias)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for j in {k for p in self.pairs for k in p}}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between quantiles, half-way to the next value so that ties fall on one side."""
    values = np.unique(x)
    if len(values) < 2:
        return np.zeros(0)
    at = np.unique(np.searchsorted(values, np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])))
    # Rare values at either end get bins too: junk is rare.
    at = np.unique(np.clip(np.concatenate((at, np.linspace(1, len(values) - 1, min(bins, len(values) - 1)).astype(int))), 1, len(values) - 1))
    return (values[at - 1] + values[at]) / 2


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3, least: float = 5.0) -> np.ndarray:
    """Values by bin of a tree with some leaves, split greedily where the squared error falls most."""
    parts, g, w = [(0, len(gradient))], np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(weight)))
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cut = np.arange(a + 1, b)
            lg, lw, rg, rw = g[cut] - g[a], w[cut] - w[a], g[b] - g[cut], w[b] - w[cut]
            gain = lg**2 / (lw + 1) + rg**2 / (rw + 1) - (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1)
            gain[(lw < least * 0.01) | (rw < least * 0.01)] = 0
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], k, int(cut[i]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of labels y (0 or 1); without rows of both labels it says their share, or 0.5 without any."""
    model = Model(0.0, [_edges(c, BINS) for c in x.T] if len(x) else [], [])
    p = (y.sum() + 1) / (len(y) + 2)
    model.bias = float(np.log(p / (1 - p)))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
    total = np.full(len(y), model.bias)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            if len(model.edges[j]):
                r, h = residual()
                n = len(model.tables[j])
                step = RATE * _tree(np.bincount(b, r, n), np.bincount(b, h, n))
                model.tables[j] += step
                total += step[b]
    model.pair_edges = [_edges(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T)]
    r, h = residual()
    gains = []
    for a in range(len(bins)):
        for c in range(a):
            cell = coarse[a] * (len(model.pair_edges[c]) + 1) + coarse[c]
            g, w = np.bincount(cell, r), np.bincount(cell, h)
            gains.append((-(g**2 / (w + 1)).sum(), c, a))
    model.pairs = [(a, b) for _, a, b in sorted(gains)[:PAIRS]]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            r, h = residual()
            shape = model.pair_tables[k].shape
            cell = coarse[a] * shape[1] + coarse[b]
            g, w = np.bincount(cell, r, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)
            # A tree of depth two: the better feature's two sides, each with a tree over the other feature.
            rows = _tree(g.sum(1), w.sum(1), 2)
            side = rows == rows[0]
            step = np.zeros(shape)
            for s in (side, ~side):
                if s.any():
                    step[s] = _tree(g[s].sum(0), w[s].sum(0), 2)
            model.pair_tables[k] += RATE * step
            total += RATE * step[coarse[a], coarse[b]]
    return model


def in_fold(id_col: Column, fold: int = 5) -> Column:
    """True where crc32(id as text) mod fold is 0; a null id is held out."""
    return F.coalesce(crc_mod(id_col, fold) == 0, F.lit(True))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = [list(features(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fold: int = 5, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled rows outside the held-out fold, at most max_train of them, chosen by hash of the id.

    Null labels and ids are passed over; an id with several labels has their majority, a tie being 1.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    known = known.filter(~in_fold(F.col("id"), fold)).groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = with_rid(docs, id_col, text_col).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "y").agg(F.min_by("text", "rid").alias("text"))  # max_train rows: an id's first
    got = rows.select("id", "y", "text").mapInArrow(_vectors, "id long, y int, x array<double>").toArrow().to_pydict()
    order = sorted(range(len(got["id"])), key=lambda k: (got["id"][k], got["x"][k]))
    return fit(np.array([got["x"][k] for k in order]).reshape(-1, len(FEATURES)), np.array([got["y"][k] for k in order], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, score: one row per row of docs, from the text alone. Null and empty texts get a score like any other.

    Texts of any length are read whole, repeated rows each get a row, an empty table gives none, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), pa.array(model.score(x))], names=["rid", "id", "score"])

    return with_rid(docs, id_col, text_col).mapInArrow(run, "rid long, id long, score double")
