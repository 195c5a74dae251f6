"""Sketches (K1-K6): Bloom filter, Count-Min, HyperLogLog, reservoir, seeded hash. All states are aggregates of hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeded_hash(seed: int, *keys: Column) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """(bits, probes) for n keys at false-positive rate p: at least 64 bits, 1 to 16 probes."""
    bits = max(64, math.ceil(-max(n, 1) * math.log(p) / math.log(2) ** 2))
    return bits, min(16, max(1, round(bits / max(n, 1) * math.log(2))))


def _probes(key: Column, bits: int, probes: int) -> Column:
    """Double hashing: h1 + i * h2, h2 odd."""
    h1, h2 = F.shiftright(seeded_hash(1, key), 1), F.shiftright(seeded_hash(2, key), 1)
    wide = lambda h: F.pmod(h, F.lit(bits))
    return F.array(*[F.pmod(wide(h1) + F.lit(i) * (wide(h2) + 1), F.lit(bits)) for i in range(probes)])


def bloom_build(df: DataFrame, key: str, n: int = 10_000, p: float = 0.01) -> DataFrame:
    """The filter as words of 63 bits (word, mask): distinct set bits are OR-ed map-side first."""
    bits, probes = bloom_size(n, p)
    at = df.select(F.explode(_probes(F.col(key), bits, probes)).alias("b"))
    return at.groupBy(F.floor(F.col("b") / 63).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(b, 63) as int)))").alias("mask"))


def bloom_contains(df: DataFrame, key: str, bloom: DataFrame, n: int = 10_000, p: float = 0.01) -> DataFrame:
    """df with `maybe`: false for keys that certainly aren't in the filter. The filter's size is set by n and p, so it may be broadcast up to 8 MB."""
    bits, probes = bloom_size(n, p)
    side = F.broadcast(bloom) if bits <= 1 << 26 else bloom
    keys = df.select(key).distinct()
    need = keys.select(key, F.explode(_probes(F.col(key), bits, probes)).alias("b")).withColumn("word", F.floor(F.col("b") / 63))
    hit = need.join(side, "word", "left").withColumn("set", F.coalesce(F.expr("mask & shiftleft(1L, cast(pmod(b, 63) as int)) <> 0"), F.lit(False)))
    return df.join(hit.groupBy(key).agg(F.bool_and("set").alias("maybe")), key)


def count_min_build(df: DataFrame, key: str, width: int = 2048, depth: int = 4, weight: Column | None = None) -> DataFrame:
    """Cells (row, cell, c): at most width * depth rows, whatever the input."""
    cells = F.array(*[F.struct(F.lit(r).alias("row"), F.pmod(seeded_hash(100 + r, F.col(key)), F.lit(width)).alias("cell")) for r in range(depth)])
    return df.select(F.explode(cells).alias("x"), (F.lit(1) if weight is None else weight).alias("w")).groupBy("x.row", "x.cell").agg(F.sum("w").alias("c"))


def count_min_estimate(keys: DataFrame, key: str, sketch: DataFrame, width: int = 2048, depth: int = 4) -> DataFrame:
    """(key, estimate): the least of a key's cells; never below the true count."""
    cells = F.array(*[F.struct(F.lit(r).alias("row"), F.pmod(seeded_hash(100 + r, F.col(key)), F.lit(width)).alias("cell")) for r in range(depth)])
    need = keys.select(key, F.explode(cells).alias("x")).select(key, "x.row", "x.cell")
    got = need.join(F.broadcast(sketch) if width * depth <= 1 << 20 else sketch, ["row", "cell"], "left")
    return got.groupBy(key).agg(F.min(F.coalesce("c", F.lit(0))).alias("estimate"))


def count_min_settled(df: DataFrame, key: str, width: int = 2048, depth: int = 4) -> DataFrame:
    """(key, estimate) of each key of df from its sketch, with the true count at any load: the estimate of a key that has a
    cell for itself is its count; keys all of whose cells are shared may have too large ones, and are counted from their rows."""
    keys = df.select(key).distinct()
    about = count_min_estimate(keys, key, count_min_build(df, key, width, depth), width, depth)
    cells = F.array(*[F.struct(F.lit(r).alias("row"), F.pmod(seeded_hash(100 + r, F.col(key)), F.lit(width)).alias("cell")) for r in range(depth)])
    alone = keys.select(key, F.explode(cells).alias("x")).groupBy("x.row", "x.cell").agg(F.count("*").alias("n"), F.min(key).alias("own")).where("n = 1").select("own").distinct()
    crowded = keys.join(alone, keys[key].eqNullSafe(alone["own"]), "left_anti").select(F.col(key).alias("_k"))
    true = df.join(crowded, F.col(key).eqNullSafe(F.col("_k")), "left_semi").groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    return about.join(true, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, F.coalesce("_n", "estimate").alias("estimate"))


def hll(column: Column, p: int = 12) -> Column:
    """A HyperLogLog state; merge with hll_union_agg, read with hll_sketch_estimate."""
    return F.hll_sketch_agg(column, F.lit(p))


def reservoir(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """A uniform sample of k rows that depends on seed and keys alone (the smallest seeded hashes)."""
    return df.orderBy(seeded_hash(seed, F.col(key)), key).limit(k)
