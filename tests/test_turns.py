"""Greedy passes in rounds against the passes row by row, and what they write."""

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from mnemora.operators import consolidate as co
from mnemora.operators.turns import draw, fold, settle_apart, take_turns
from tests.test_greedy import DAY, draws, folds, independent


def test_rounds_of_few_turns_are_the_whole_pass(spark):
    """blocks of 8 rows and rounds of 8 turns, two eras, ties, rows near none and rows that draw earlier ones."""
    r = np.random.default_rng(3)
    n = 90
    v = np.repeat(r.normal(size=(9, 6)), 10, 0)[r.permutation(n)] + r.normal(0, 0.4, (n, 6))
    era, f, at, old = (np.arange(n) // 50, r.integers(0, 3, n), r.integers(0, 40, n), r.random(n) < 0.1)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    met = (u @ u.T >= 0.75) & (era[:, None] == era[None])
    near = [set(np.flatnonzero(m).tolist()) - {i} for i, m in enumerate(met)]
    rows = spark.createDataFrame([(f"m{i:02d}", i, x.tolist(), int(era[i]), int(f[i]), int(at[i]), int(old[i]), int(not old[i])) for i, x in enumerate(v)], "id string, o long, embedding array<double>, era int, f int, at long, old int, new int")
    run = lambda order, facts, rule, **k: {(int(x["id"][1:]), int(x["by"][1:])) for x in take_turns(rows, order, facts, 0.75, rule, "era", block=8, most=8, **k).collect()}
    parent = dict(run(["o"], ["f"], fold))
    ends = {}
    for k in parent:
        ends[k] = parent[k]
        while ends[k] in parent:
            ends[k] = parent[ends[k]]
    assert ends == folds(n, near, f.tolist()) and ends
    for least, width in ((2, 99), (4, 25)):
        got = run(["o"], ["at"], draw(least, lambda span, w=width: span <= w), later=False)
        assert {(s, i) for i, s in got} == draws(n, near, at.tolist(), least, width) and got
    got = run(["new", "o"], ["old"], settle_apart)
    assert {i for i, _ in got} == independent(n, near, set(np.flatnonzero(old).tolist())) and got


def test_copies_make_no_pairs(spark):
    """2,400 equal rows have 2.9 million pairs; what the passes write grows with the rows."""
    n = 2_400
    rows = spark.range(n).select(F.concat(F.lit("m"), F.col("id")).alias("id"), (F.col("id") * DAY).alias("created_at"), F.lit("semantic").alias("memory_type"), F.lit(0.5).alias("importance_score"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.lit(0).alias("era"), F.lit(0.9).alias("low"))
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in root.rglob("*") if p.is_file())
    before = size()
    assert co.keepers(rows).count() == n - 1
    assert co.burst_members(rows, None, 2, 1.0, 1e9).count() == n
    assert co.foundations(rows).count() == 1
    assert size() - before < 10_000_000
