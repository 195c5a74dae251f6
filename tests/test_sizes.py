"""Results that must not depend on how large a table is."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora.functions import sketch
from mnemora.plans.queries import QUERIES


def _events(spark, folder, users):
    spark.range(users * 3).select((F.col("id") % users).alias("user_id"), F.col("id").alias("event_id")).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_bloom_filter_is_made_for_its_keys(spark, tmp_path):
    got = QUERIES["k1_bloom"](spark, _events(spark, tmp_path, 60_000)).first()
    assert tuple(got) == (60_000, 30_000, 0, True)


def test_crowded_count_min_sketch_is_settled(spark):
    rows = spark.range(9_000).select(F.when(F.col("id") >= 3, F.col("id") % 2_000).alias("k"))
    about = sketch.count_min_estimate(rows.distinct(), "k", sketch.count_min_build(rows, "k", 256, 2), 256, 2)
    true = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    assert {r["k"]: r["estimate"] for r in about.collect()} != true
    assert {r["k"]: r["estimate"] for r in sketch.count_min_settled(rows, "k", 256, 2).collect()} == true
    assert {r["k"]: r["estimate"] for r in sketch.count_min_settled(rows, "k", 2, 1).collect()} == true


def test_vectors_are_written_once(spark, tmp_path, monkeypatch):
    """However many blocks there are, a row is in one of them, and results are those of brute force."""
    import numpy as np

    from mnemora.operators import similarity as sm

    written = []
    monkeypatch.setattr(sm, "store", lambda *a, was=sm.store: (written.append(was(*a)), written[-1])[1])
    rng = np.random.default_rng(5)
    v = rng.integers(-1, 2, (120, 6)).astype(float)
    v[60:70] = v[0]
    df = spark.createDataFrame([(f"k{i}", x.tolist(), int(i % 7)) for i, x in enumerate(v)], "id string, embedding array<double>, at long")
    u = sm.unit_rows(list(v))
    g = u @ u.T
    pairs = {(i, j) for i in range(120) for j in range(i + 1, 120) if g[i, j] >= 0.83}
    names = {tuple(sorted((f"k{i}", f"k{j}"))) for i, j in pairs}
    assert {(r["a"], r["b"]) for r in sm.similar_pairs(df, 0.83, block=16).collect()} == names
    label = {r["id"]: r["component"] for r in sm.connected(df.select("id"), sm.linked(df, 0.83, block=16, side=2)).collect()}
    whole = {r["id"]: r["component"] for r in sm.connected(df.select("id"), spark.createDataFrame(sorted(names), "a string, b string")).collect()}
    assert label == whole
    sums = {r["id"]: r for r in sm.neighbor_sums(df, 0.83, "at", block=16).collect()}
    for i in range(120):
        others = [j for j in range(120) if j != i]
        near = [j for j in others if g[i, j] >= 0.83]
        r = sums[f"k{i}"]
        assert abs(r["best"] - max(0.0, *(g[i, j] for j in others))) < 1e-9
        assert (r["near"], r["first"], r["last"]) == (len(near), min((j % 7 for j in near), default=None), max((j % 7 for j in near), default=None))
    for b in written:
        rows = [n for g_ in b.groups.values() for _, n in g_]
        assert len(rows) > 4 and sum(rows) == 120
        assert spark.read.parquet(b.path).count() == 120


def test_embedding_splits_few_words_at_a_time(spark):
    """A batch of many words is embedded in runs, with the vectors of each text alone."""
    import numpy as np

    from mnemora.functions import vector

    texts = ["apple pear " * 60_000, None, "", "one", "plum " * 250_000, "fig kiwi fig"] + [f"word{i} tree" for i in range(50)]
    assert [len(r) for r in vector.runs([t * 2 if t else t for t in texts])] != [len(texts)]
    assert sum(vector.runs(texts), []) == texts
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r["id"]: r["v"] for r in df.select("id", vector.hashed_bow(F.col("text"), 64).alias("v")).collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], vector.bag((t or "").split(), 64))
