"""Batched retrieval against single retrievals, keyed spreading, bounded nearest neighbours."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.functions import scoring as m
from mnemora.functions import text as x
from mnemora.functions.text import tokenize
from mnemora.functions.vector import cosine, hashed_bow
from mnemora.operators import graph, retrieve
from mnemora.operators.similarity import cut_lineage, knn, similar_pairs
from mnemora.plans.config import Config, Spreading
from mnemora.sources.schemas import empty
from test_engine import NOW, memory

WORDS = "ledger billing invoice deploy postgres sqlite coffee tea garden train bridge river paint violin".split()


@pytest.fixture(scope="module")
def store(spark):
    r = np.random.default_rng(2)
    rows = [{"id": f"m{i:02d}", "content": " ".join(r.choice(WORDS, 6)), "days": float(i % 7), "memory_type": ["episodic", "semantic"][i % 2], "topic": WORDS[i % 5], "entities": [WORDS[i % 9]], "tags": [f"session:{i % 3}"]} for i in range(40)]
    mem = memory(spark, [*rows, {"id": "gone", "content": "ledger", "memory_type": "archive"}]).withColumn("embedding", hashed_bow(F.col("content"), 32).cast("array<float>"))
    edges = spark.createDataFrame([(f"m{i:02d}", f"m{(i * 7 + 3) % 40:02d}", "co_occurred", float(1 + i % 4)) for i in range(0, 40, 2)], "src_id string, dst_id string, edge_type string, weight double")
    return cut_lineage(mem), cut_lineage(edges)


@pytest.mark.parametrize(("spreading", "block"), [(False, 256), (False, 2), (True, 3)])
def test_batch_is_each_query_alone(spark, store, spreading, block):
    mem, edges = store
    c = replace(Config(), spreading=replace(Spreading(), enabled=spreading, max_hops=2))
    o = retrieve.Options(top_k=4, min_score=0.05)
    texts = ["invoice for the ledger", "coffee or tea", "violin", "", "nothing of these"]
    asks = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string").select("query_id", hashed_bow(F.col("text"), 32).alias("vector"), tokenize("text").alias("tokens"))
    got = retrieve.retrieve_batch(mem, edges, asks, NOW, c, o, block=block)
    assert got.columns == ["query_id", "rank", "id", "relevance", "score", "total"]
    by = {q: [(x["id"], round(x["total"], 6)) for x in sorted((y for y in got.collect() if y["query_id"] == q), key=lambda y: y["rank"])] for q in range(len(texts))}
    for row in asks.collect()[:3]:
        vector, tokens = F.array(*[F.lit(v) for v in row["vector"]]), F.array(*[F.lit(t) for t in row["tokens"]])
        one = retrieve.retrieve(mem, edges, empty(spark, "epochs"), vector, tokens, NOW, c, o).collect()
        assert sorted(by[row["query_id"]], key=lambda x: (-x[1], x[0])) == sorted(((x["id"], round(x["total"], 6)) for x in one), key=lambda x: (-x[1], x[0])) and one
    none = retrieve.retrieve_batch(mem, edges, asks.limit(0), NOW, c, o)
    assert none.count() == 0


def test_rows_are_embedded_once(spark, store):
    """However many blocks of queries there are."""
    mem, edges = store
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def counted(v: pd.Series) -> pd.Series:
        made.add(len(v))
        return v

    asks = mem.select(F.col("id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"), tokenize("content").alias("tokens"))
    got = retrieve.pools(mem.withColumn("embedding", counted("embedding")), asks, 5, block=4)
    assert got.count() == 5 * mem.count() and made.value == mem.count()


def test_pools_are_those_of_all_pairs(spark):
    """Copies, texts without words, other sizes of vectors, and none: ties go to the earlier row, then the smaller id."""
    r = np.random.default_rng(7)
    texts = [" ".join(r.choice(WORDS, r.integers(1, 12))) for _ in range(60)]
    rows = [{"id": f"m{i:03d}", "content": "" if i % 41 == 0 else texts[i % 60], "days": float(i % 5), "topic": WORDS[i % 7] if i % 3 else None, "entities": [WORDS[i % 9]], "tags": [f"session:{i % 3}", WORDS[i % 4]]} for i in range(300)]
    v = F.when(F.col("id") != "m007", F.when(F.col("id") == "m009", F.array(F.lit(1.0))).otherwise(hashed_bow(F.col("content"), 32)))
    mem = cut_lineage(memory(spark, rows).withColumn("embedding", v))
    asks = cut_lineage(mem.where("substr(id, 3) % 4 = 1 and id not in ('m009')").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"), tokenize("content").alias("tokens")))
    held = mem.select("id", "created_at", "embedding", "content", "tags", "topic", "entities")
    q = asks.crossJoin(held)
    t = F.col("tokens")
    rel = m.candidate_relevance(cosine(F.col("embedding"), F.col("vector")), x.keyword_overlap(t, F.col("content"), F.col("tags"), F.col("topic"), F.col("entities")), x.entity_overlap(t, F.col("topic"), F.col("entities")))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rel"), "created_at", "id"))
    want = q.withColumn("rel", F.round(F.coalesce(rel, F.lit(0.0)), 9)).withColumn("n", place).where("n <= 20")
    key = lambda df, c: {(a["query_id"], a["id"], a[c]) for a in df.collect()}
    assert key(retrieve.pools(held, asks, 20, block=16), "relevance") == key(want, "rel")


def test_spreading_apart(spark, store):
    adj = graph.adjacency(store[1])
    seeds = spark.createDataFrame([(q, f"m{i:02d}", 1.0) for q in range(3) for i in (q * 2, q * 2 + 8)], "q int, id string, strength double")
    s = Spreading(max_hops=3, floor=0.0)
    apart = graph.spread(seeds, adj, s, ["q"])
    for q in range(3):
        alone = graph.spread(seeds.where(F.col("q") == q).drop("q"), adj, s)
        key = lambda x: (x["id"], round(x["activation"], 9), x["depth"], tuple(x["path"]), tuple(x["edges"]))
        assert {key(x) for x in apart.where(F.col("q") == q).collect()} == {key(x) for x in alone.collect()}


def test_nearest_are_those_of_all_pairs(spark):
    r = np.random.default_rng(4)
    v = np.repeat(r.normal(size=(30, 6)), 3, 0)  # copies tie
    df = cut_lineage(spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 6), (1002, [1.0, 2.0])], "id long, embedding array<double>"))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    g = np.round(u @ u.T, 9)
    want = {(i, j) for i in range(90) for j in sorted((x for x in range(90) if x != i and g[i, x] >= 0.2), key=lambda x: (-g[i, x], x))[:4]}
    got = knn(df, 4, 0.2, digits=9, block=16)
    assert {(x["id"], x["other"]) for x in got.collect()} == want and got.where("rank > 4").count() == 0
    assert similar_pairs(df, 0.2, block=16).count() == sum(g[i, j] >= 0.2 for i in range(90) for j in range(i + 1, 90))


def test_common_words_are_counted_for_whole_blocks():
    """By a matrix product for words with a column, from the rows that have them for others; in runs, and with words that no query knows."""
    r = np.random.default_rng(5)
    lists = lambda n: [r.choice(60, r.integers(0, 25), replace=False) * 7 for _ in range(n)]
    words = lambda rows: retrieve.Words(np.concatenate([[0], np.cumsum([len(x) for x in rows])]), np.concatenate([*rows, []]).astype(np.int64))
    asks, rows = lists(23), lists(31)
    asks = [a[a < 280] for a in asks]
    known = np.unique(words(asks).code)
    own, every = words(asks).numbered(known), words(rows).numbered(known)
    assert every.sizes.tolist() == [int(np.isin(x, known).sum()) for x in rows]
    column = np.full(len(known), -1)
    column[[3, 17, 5]] = [0, 1, 2]
    (a, light), (b, rest) = retrieve.dense(own, column), retrieve.dense(every, column)
    want = [[len(set(x) & set(y)) for y in rows] for x in asks]
    for most in (1, 40, 1 << 20):
        assert (retrieve.Postings.of(every, len(known)).shared(own, 0, 23, most) == want).all()
        got = a[4:20] @ b.T + retrieve.Postings.of(rest, len(known)).shared(light, 4, 20, most)
        assert (got == want[4:20]).all()


def test_blocks_that_meet_once_serve_both():
    """Sums and nearest of two blocks from one product of each pair: more rows than a byte counts, copies, rows without a time."""
    import pyarrow as pa

    from mnemora.operators import similarity as sm
    from mnemora.operators.blocks import Rows, unit

    r = np.random.default_rng(9)
    v, t = unit(r.integers(-1, 2, (900, 6)).astype(float)), [None if i % 11 == 0 or i >= 890 else int(i * 37 % 101) for i in range(900)]
    cut = [("a", 0, 600), ("b", 600, 890), ("c", 890, 900)]
    blocks = [Rows(n, pa.array(np.arange(a, z)), v[a:z], pa.table({"t": pa.array(t[a:z], pa.int64())})) for n, a, z in cut]
    g = v @ v.T
    np.fill_diagonal(g, -np.inf)
    made = []

    def once(state):
        class Counted(state):
            def meet(self, s, m, b):
                made.append(m.size)
                super().meet(s, m, b)

        return Counted

    tell = lambda state: [x for lefts, rights in ((blocks[:2], blocks[:2]), (blocks[:2], blocks[2:]), (blocks[2:], blocks[2:])) for out in sm._mutual(state)(lefts, iter(rights)) for x in out.to_pylist()]
    sums = tell(lambda rows: once(sm.Sums)(rows, 0.8))
    assert sum(made) == 600 * 600 + 600 * 290 + 290 * 290 + 890 * 10 + 10 * 10
    for i in range(900):
        mine, near = [x for x in sums if x["id"] == i], np.flatnonzero(g[i] >= 0.8)
        times = [t[j] for j in near if t[j] is not None]
        assert abs(max(x["best"] for x in mine) - max(0.0, g[i].max())) < 1e-12 and sum(x["near"] for x in mine) == len(near)
        assert [x for x in (min(x["first"] for x in mine), max(x["last"] for x in mine))] == ([min(times), max(times)] if times else [np.iinfo(np.int64).max, np.iinfo(np.int64).min])
    near = tell(lambda rows: sm.Nearest(rows, 4, 0.3, 9))
    for i in range(900):
        want = sorted(((-round(g[i, j], 9), j) for j in range(900) if round(g[i, j], 9) >= 0.3))[:4]
        assert sorted((-x["cosine"], x["other"]) for x in near if x["id"] == i)[:4] == want


def test_passes_compute_vectors_once(spark, store):
    """Sums, nearest and topics read a computed vector from where it was written; rows without one are left out."""
    from mnemora.operators import consolidate as co
    from mnemora.sources.schemas import SCHEMAS

    mem, _ = store
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def counted(v: pd.Series) -> pd.Series:
        made.add(len(v))
        return v.map(lambda x: np.asarray(x, float) if x is not None else None)

    mem = mem.withColumn("embedding", F.when(F.col("id") != "m03", F.col("embedding")))
    live = mem.where("memory_type <> 'archive'").count()
    shaped = mem.withColumn("embedding", counted("embedding"))
    was = 0
    for run in (lambda: co.neighbor_stats(shaped, NOW).select("id"), lambda: graph.semantic_edges(shaped, 0.1, 3, NOW).select(F.explode(F.array("src_id", "dst_id")).alias("id")), lambda: co.refine_topics({n: empty(spark, n) for n in SCHEMAS} | {"memory_items": shaped}, Config(), NOW)["memory_items"].select("id").where("id <> 'm03'")):
        ids = {r["id"] for r in run().collect()}
        assert ids and "m03" not in ids
        assert made.value - was <= live + 1  # the archived one may be computed
        was = made.value
