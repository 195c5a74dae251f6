"""Vectors: cosine, norms, hashed bag-of-words, centroids, codec, providers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.text import tokenize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unequal sizes, empty ones, nulls and zero vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot(a, b) / n).otherwise(0.0)


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(F.transform(a, lambda x: x.cast("float")))


#: Characters of tokens that an embedding task splits at once.
RUN_CHARS = 1_000_000


@lru_cache(maxsize=200_000)
def _place(token: str, dim: int) -> tuple[int, float]:
    """Bucket and sign of a token: 60 bits of its MD5, the top one the sign."""
    h = int(hashlib.md5(token.encode()).hexdigest()[:15], 16)
    return h % dim, -1.0 if h >> 59 else 1.0


def bag(tokens: list[str], dim: int) -> np.ndarray:
    v = np.zeros(dim)
    for t in tokens if tokens is not None else ():
        i, s = _place(t, dim)
        v[i] += s
    n = np.sqrt(v @ v)
    return v / n if n > 0 else v


def bags(texts: list[list[str] | None], dim: int) -> np.ndarray:
    """bag() of many token lists at once: distinct tokens are placed once, and places are summed in one count."""
    lists = [t if t is not None else () for t in texts]
    row = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
    if not len(row):
        return np.zeros((len(lists), dim))
    code, distinct = pd.factorize(np.concatenate([np.asarray(t, object) for t in lists if len(t)]))
    place = [_place(t, dim) for t in distinct]
    at, sign = np.array([p for p, _ in place]), np.array([s for _, s in place])
    v = np.bincount(row * dim + at[code], sign[code], len(lists) * dim).reshape(len(lists), dim)
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, n, out=v, where=n > 0)


def hashed_bow(text: Column, dim: int = 256) -> Column:
    """Hashed bag-of-words of tokenize(text), of unit length (zero without tokens). Tokens come from the JVM in one string a row
    (none holds a blank); a batch is split and summed in runs of about RUN_CHARS, so memory doesn't grow with a batch's words."""

    @F.pandas_udf("array<double>")
    def embed(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in tokens:
            out = []
            for run in runs(list(batch)):
                out.extend(bags([t.split(" ") if t else None for t in run], dim))
            yield pd.Series(out)

    return embed(F.array_join(tokenize(text), " "))


def runs(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of about RUN_CHARS in all; a longer one is a run of its own."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and total + n > RUN_CHARS:
            yield texts[start:i]
            start, total = i, 0
        total += n
    if texts[start:]:
        yield texts[start:]


def encode_vector(vector: Column) -> Column:
    """Little-endian 32-bit floats as binary."""

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(vector)


def decode_vector(data: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else np.frombuffer(x[: len(x) // 4 * 4], "<f4"))

    return run(data)


def centroid(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Normalised mean of unit vectors of each group: pre-aggregated sums by place, no group is gathered."""
    places = df.select(*keys, F.posexplode(unit(F.col(vector))).alias("place", "x")).groupBy(*keys, "place").agg(F.sum(F.col("x").cast("double")).alias("x"))
    got = places.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("p"))
    return got.select(*keys, unit(F.transform("p", lambda s: s["x"])).alias("centroid"))


class Provider:
    """Text to vector: an expression, so that batches and streams use it alike."""

    def __init__(self, name: str, dim: int, make: Callable[[Column], Column]) -> None:
        self.model_id, self.dim, self.embed = f"{name}:{dim}", dim, make


def provider(name: str = "hashed_bow", dim: int = 256, remote: Callable[[list[str]], list[list[float]]] | None = None) -> Provider:
    """hashed_bow, or `remote`: a function for batches of texts, whose failures give zero vectors."""
    if name == "hashed_bow":
        dim = max(16, dim)
        return Provider(name, dim, lambda text: hashed_bow(text, dim))
    if remote is None:
        raise ValueError(f"unknown embedding provider {name}")

    def make(text: Column) -> Column:
        @F.pandas_udf("array<double>")
        def run(t: pd.Series) -> pd.Series:
            try:
                return pd.Series(list(remote([x or "" for x in t])))
            except Exception:
                return pd.Series([[0.0] * dim] * len(t))

        return run(text)

    return Provider(name, dim, make)


def reembed(memories: DataFrame, p: Provider) -> DataFrame:
    return memories.withColumn("embedding", F.transform(p.embed(F.col("content")), lambda x: x.cast("float")))


def mismatched(memories: DataFrame, p: Provider) -> DataFrame:
    """Counts of stored sizes that aren't the provider's."""
    return memories.where("embedding is not null").groupBy(F.size("embedding").alias("dim")).count().where(F.col("dim") != p.dim)
