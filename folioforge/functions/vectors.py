"""Vector functions as Column expressions, and packing of half-precision vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from folioforge.schema import FLOATS


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Dot product over the product of the norms, which counts as 1e-12 at least."""
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def unit(a: Column) -> Column:
    """a with norm one; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(a)


def softmax3(a: Column, b: Column, c: Column) -> Column:
    """Probabilities of three logits, as a struct of entail, neutral and contradict."""
    top = F.greatest(a, b, c)
    e = [F.exp(x - top) for x in (a, b, c)]
    total = e[0] + e[1] + e[2]
    return F.struct(*[(x / total).alias(n) for x, n in zip(e, ("entail", "neutral", "contradict"))])


@F.pandas_udf(BinaryType())
def pack_half(vectors: pd.Series) -> pd.Series:
    """Little-endian half-precision bytes of each vector."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f2").tobytes())


@F.pandas_udf(FLOATS)
def unpack_half(packed: pd.Series) -> pd.Series:
    return packed.map(lambda b: None if b is None else np.frombuffer(b, "<f2").astype(np.float32))


@F.pandas_udf(FLOATS)
def mean_pool(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The unit mean of the token vectors (a flat array) whose mask is set."""
    for tokens, masks in parts:
        out = []
        for flat, mask in zip(tokens, masks):
            mask = np.asarray(mask, bool)
            if not mask.any():
                raise ValueError("a mask selects no token")
            mean = np.asarray(flat, np.float64).reshape(len(mask), -1)[mask].mean(axis=0)
            norm = np.sqrt((mean * mean).sum())
            out.append((mean / norm if norm > 0 else mean).astype(np.float32))
        yield pd.Series(out)


def hashed(texts: list[str], size: int = 64, most_words: int = 512) -> np.ndarray:
    """A deterministic stand-in for an embedding model: each of the first words adds or takes one
    at a place that its checksum names; rows have norm one, or zero without words."""
    out = np.zeros((len(texts), size), np.float32)
    for row, text in zip(out, texts):
        for word in text.lower().split()[:most_words]:
            h = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[8:], "little")
            row[h % size] += 1 if h >> 63 else -1
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norms > 0, norms, 1)


def embed(text: Column, model: Callable[[list[str]], np.ndarray] = hashed, at_once: int = 32) -> Column:
    """The vector that a model gives each text, in order; null for null. The model is called with
    at most `at_once` texts and is loaded once a worker if it is a function of a module."""

    @F.pandas_udf(FLOATS)
    def embedded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            known, out = texts.dropna(), pd.Series([None] * len(texts), index=texts.index, dtype=object)
            for a in range(0, len(known), at_once):
                some = known.iloc[a : a + at_once]
                for i, v in zip(some.index, model(some.tolist())):
                    out[i] = np.asarray(v, np.float32)
            yield out

    return embedded(text)
