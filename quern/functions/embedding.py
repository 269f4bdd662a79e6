"""Embeddings: a deterministic one for offline work, and the interface of injected ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hash_vector(text: str, dimensions: int = 32) -> np.ndarray:
    """Byte i of the text adds (byte mod 31) / 31 to slot i mod dimensions; then unit length, unless it is null."""
    data = np.frombuffer((text or "").encode(), np.uint8) % 31
    slots = np.bincount(np.arange(len(data)) % dimensions, weights=data / 31.0, minlength=dimensions)
    norm = float(np.sqrt((slots * slots).sum()))
    return slots / (norm or 1.0)


def hash_embedding(text: Column | str, dimensions: int = 32) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([hash_vector(t, dimensions) for t in texts])

    return run(text)


def embed(text: Column | str, embedder: Embedder, batch: int = 64) -> Column:
    """Vectors from an injected embedder, in batches; a batch that comes back with another length raises."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list[list[float]] = []
            for at in range(0, len(texts), batch):
                asked = [t or "" for t in texts[at : at + batch]]
                got = embedder(asked)
                if len(got) != len(asked):
                    raise RuntimeError(f"asked for {len(asked)} embeddings, got {len(got)}")
                out += [list(map(float, v)) for v in got]
            yield pd.Series(out)

    return run(text)


PROVIDERS: dict[str, Callable[[], Embedder]] = {"hash": lambda: lambda texts: [hash_vector(t).tolist() for t in texts]}


def provider(name: str, has_key: bool = False, allow_hash: bool = True) -> Embedder:
    """A registered provider; the hash one also stands in for one without a key, if that is allowed."""
    if name in PROVIDERS and (name == "hash" or has_key):
        return PROVIDERS[name]()
    if not has_key and allow_hash:
        return PROVIDERS["hash"]()
    raise ValueError(f"no embedding provider {name!r}, or no key for it")


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(1.0)).otherwise(1.0 - dot(a, b) / size)


def model_name(provider: Column, model: Column, deployment: Column) -> Column:
    """The embedding model's name: a deployment's where the provider is a hosted deployment and names one."""
    return F.when((provider == "azure") & (F.coalesce(deployment, F.lit("")) != ""), deployment).otherwise(model)
