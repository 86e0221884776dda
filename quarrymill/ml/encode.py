"""Text to vectors: chunks, a pluggable encoder, and word-weighted unit means."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_WORDS, SIZE = 150, 384
REVISION = "hashing-1"
Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(chunks: list[str], size: int = SIZE) -> np.ndarray:
    """Deterministic stand-in for a sentence model: signed hashes of words and neighbouring pairs."""
    import xxhash

    out = np.zeros((len(chunks), size), np.float32)
    for r, c in enumerate(chunks):
        w = c.lower().split()
        for t in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]:
            h = xxhash.xxh64_intdigest(t)
            out[r, h % size] += 1.0 if h >> 63 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def chunks_of(text: str | None, size: int = CHUNK_WORDS) -> list[str]:
    w = (text or "").split()
    return [" ".join(w[i : i + size]) for i in range(0, len(w), size)]


def weighted_mean(vectors: np.ndarray, counts: list[int]) -> np.ndarray:
    v = (vectors * np.array(counts, np.float32)[:, None]).sum(0)
    return v / max(float(np.linalg.norm(v)), 1e-9)


def embedded(df: DataFrame, id_: str, text: str, encoder: Encoder = hashing_encoder, batch: int = 64, revision: str = REVISION) -> DataFrame:
    """(id, n_chunks, embedding array<float>): each text's chunks encoded, averaged by their words, at length 1. Texts without words
    have no vector. The encoder's revision is in the column's metadata."""
    kind = df.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [chunks_of(t) for t in b["t"]]
            flat = [c for p in parts for c in p]
            v = np.concatenate([encoder(flat[i : i + batch]) for i in range(0, len(flat), batch)]) if flat else np.zeros((0, SIZE), np.float32)
            out, at = [], 0
            for i, p in zip(b["i"], parts):
                if p:
                    out.append((i, len(p), weighted_mean(v[at : at + len(p)], [len(c.split()) for c in p]).tolist()))
                at += len(p)
            yield pd.DataFrame(out, columns=[id_, "n_chunks", "embedding"])

    got = df.select(F.col(id_).alias("i"), F.col(text).alias("t")).mapInPandas(run, f"{id_} {kind}, n_chunks int, embedding array<float>")
    return got.withMetadata("embedding", {"model_revision": revision, "chunk_words": CHUNK_WORDS})


def require_revision(df: DataFrame, revision: str = REVISION) -> DataFrame:
    got = df.schema["embedding"].metadata.get("model_revision")
    if got and got != revision:
        raise ValueError(f"vectors are of model revision {got}, not {revision}; embed again")
    return df


def mean_vector(vector: Column, size: int) -> list[Column]:
    """One average a dimension, all in built-in aggregates."""
    return [F.avg(F.get(vector, F.lit(k))).alias(f"d{k}") for k in range(size)]
