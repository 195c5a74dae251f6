"""Greedy rounds and block-wise segmentation against the sequential rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.operators import consolidate as co
from mnemora.operators.greedy import bursts, first_independent, fold_pairs
from mnemora.operators.ranges import positions, prefix_states
from mnemora.operators.segment import segment, segmented
from mnemora.plans.config import Segment

DAY = 86_400


def graph(seed, n, degree, chain):
    r = random.Random(seed)
    edges = {tuple(sorted(r.sample(range(n), 2))) for _ in range(n * degree // 2)}
    if chain:  # one component, and a clique whose rows all depend on each other
        edges |= {(i, i + 1) for i in range(n - 1)} | {(i, j) for i in range(12) for j in range(i + 1, 12)}
    near = [set() for _ in range(n)]
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return r, sorted(edges), near


def folds(n, near, rank):
    parent = {}
    for i in range(n):
        for j in sorted(x for x in near[i] if x > i):
            if i in parent:
                break
            if j in parent:
                continue
            if rank[i] >= rank[j]:
                parent[j] = i
            else:
                parent[i] = j
    out = {}
    for k in parent:
        end = parent[k]
        while end in parent:
            end = parent[end]
        out[k] = end
    return out


def draws(n, near, at, least, width):
    free, out = set(range(n)), set()
    for i in range(n):
        if i in free:
            own = {i} | (near[i] & free)
            if len(own) >= least and max(at[j] for j in own) - min(at[j] for j in own) <= width:
                free -= own
                out |= {(i, j) for j in own}
    return out


def independent(n, near, taken):
    out = set()
    for i in range(n):
        if i not in taken and not near[i] & (taken | out):
            out.add(i)
    return out


@pytest.mark.parametrize(("seed", "n", "degree", "chain"), [(1, 60, 3, False), (2, 120, 6, True)])
def test_rounds_are_the_sequential_pass(spark, seed, n, degree, chain):
    r, edges, near = graph(seed, n, degree, chain)
    pairs = spark.createDataFrame(edges, "p long, q long")
    rank = [r.randrange(5) if seed % 2 else i // 3 for i in range(n)]  # ties; ranks that rise with the order
    nodes = spark.createDataFrame([(i, rank[i], r.randrange(100)) for i in range(n)], "pos long, rank long, at long")
    assert {k["pos"]: k["keeper"] for k in fold_pairs(nodes, pairs).collect()} == folds(n, near, rank)
    at = [x["at"] for x in nodes.orderBy("pos").collect()]
    assert {(k["seed"], k["pos"]) for k in bursts(nodes, pairs, 3, F.col("span") <= 60).collect()} == draws(n, near, at, 3, 60)
    taken = {i for i in range(n) if r.random() < 0.1}
    assert {k["pos"] for k in first_independent(nodes.select("pos", F.col("pos").isin(taken).alias("taken")), pairs).collect()} == independent(n, near, taken)


def test_passes_by_rounds_and_by_groups_agree(spark):
    r = np.random.default_rng(5)
    v = np.repeat(r.normal(size=(6, 8)), 12, 0) + r.normal(0, 0.35, (72, 8))
    rows = [(f"m{i:02d}", int(1e9 + i // 2 * DAY), ("semantic", "foundation")[i % 17 == 0], float(i % 4) / 4, x.tolist(), 0, 0.8) for i, x in enumerate(v)]
    live = co.cut_lineage(spark.createDataFrame(rows, "id string, created_at long, memory_type string, importance_score double, embedding array<double>, era int, low double"))
    pairs = co.cut_lineage(co.similar_pairs(live, 0.8, within="era"))
    assert pairs.count() > 100
    for run in (lambda g: co.keepers(live, pairs, g), lambda g: co.burst_members(live, pairs, 4, 0.5, 30.0, g), lambda g: co.foundations(live, pairs, g)):
        whole, rounds = ({tuple(x) for x in run(g).collect()} for g in (2_000, 0))
        assert whole == rounds and whole


def streams(seed):
    r = np.random.default_rng(seed)
    c = Segment(window=int(r.integers(1, 6)), tau=int(r.integers(2, 12)), gamma=float(r.uniform(0, 1.2)), radius=int(r.integers(0, 4)), min_len=int(r.integers(1, 5)))
    return c, {f"s{k}": np.eye(5)[(np.arange(n) // int(r.integers(2, 30))) % 5] + r.normal(0, 0.25, (n, 5)) for k, n in enumerate(r.integers(0, 300, 20).tolist())}


@pytest.mark.parametrize(("seed", "ranges"), [(1, 1), (2, 3), (4, 17)])
def test_blocks_of_a_stream_make_the_whole(spark, seed, ranges):
    c, many = streams(seed)
    rows = [(s, i, v.tolist(), float(v[0])) for s, m in many.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "stream_id string, ord long, embedding array<double>, given double")
    got = segmented(df, c, size=48, ranges=ranges).toPandas()
    for s, m in many.items():
        ev, signal = segment(m, c)
        g = got[got["stream"] == s].sort_values("ord")
        assert g["event"].tolist() == np.repeat(np.arange(len(ev)), [b - a for a, b in ev]).tolist() and np.allclose(g["surprise"], signal) and g["pos"].tolist() == list(range(len(m)))
    got = segmented(df, c, signal="given", size=48, ranges=ranges).toPandas() if seed == 1 else None
    for s, m in many.items() if got is not None else ():
        ev = segment(m, c, m[:, 0])[0]
        assert got[got["stream"] == s].sort_values("ord")["event"].tolist() == np.repeat(np.arange(len(ev)), [b - a for a, b in ev]).tolist()


def test_no_stream_is_one_group(spark, capsys):
    df = spark.range(300).select(F.lit("one").alias("stream_id"), F.col("id").alias("ord"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    got = segmented(df, Segment(window=2), size=64)
    got.explain()
    groups = [line for line in capsys.readouterr().out.splitlines() if "FlatMapGroupsInArrow" in line]
    assert groups and got.count() == 300 and got.groupBy("stream").agg(F.countDistinct("pos").alias("n")).first()["n"] == 300


def test_positions_and_states(spark):
    df = spark.createDataFrame([(k, i) for k, n in (("a", 50), ("b", 1), (None, 20)) for i in range(n)], "s string, o long")
    got = positions(df, "s", ["o"], 5).collect()
    assert len(got) == 71 and all(r["pos"] == r["o"] and r["n"] == {"a": 50, "b": 1, None: 20}[r["s"]] for r in got)
    r = random.Random(1)
    tables = [[r.randrange(4) for _ in range(4)] for _ in range(1200)]
    now, want = 2, []
    for t in tables:
        want.append(now)
        now = t[now]
    states = prefix_states(spark.createDataFrame([("x", i, t) for i, t in enumerate(tables)], "stream string, block long, table array<int>"), 2)
    assert [x["state"] for x in states.orderBy("block").collect()] == want


def test_many_events_become_eras_like_few(spark, monkeypatch):
    r, at, spans, a = random.Random(3), [], [], 0
    for _ in range(60):
        n = r.randrange(1, 6)
        spans.append((a, a + n))
        a += n
    for _ in range(a):
        at.append((at[-1] if at else 0) + r.randrange(0, 2 * DAY))
    events = spark.createDataFrame([(x, y, at[x], at[y - 1]) for x, y in spans], "a long, b long, first long, last long")
    few = co.era_spans(events, 4, 5.0)
    monkeypatch.setattr(co, "SMALL", 0)
    assert co.era_spans(events, 4, 5.0) == few and few == co.merge_micro(spans, at, 4, 5.0) and len(few) > 5
