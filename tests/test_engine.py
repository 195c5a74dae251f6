"""Behaviour of the store, graph, segmentation, ingest, retrieval, consolidation and streaming."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.functions.text import tokenize
from mnemora.functions.vector import hashed_bow, literal_vector
from mnemora.operators import consolidate as co
from mnemora.operators import graph, retrieve
from mnemora.operators.ingest import ingest
from mnemora.operators.segment import boundary_scores, merge_micro, segment, segment_streams
from mnemora.operators.similarity import connected, similar_pairs
from mnemora.plans.config import Config, Segment, Spreading
from mnemora.sources import store as st
from mnemora.sources.schemas import SCHEMAS, conform, empty
from mnemora.streaming.writer import flush, rolling_surprise, write_stream

NOW, DAY = 1_706_745_600, 86_400


def memory(spark, rows):
    """rows: dicts with id, content, days and any other column."""
    base = {"memory_type": "episodic", "entities": [], "tags": []}
    data = [base | {k: v for k, v in r.items() if k != "days"} | {"created_at": int(NOW - r.get("days", 0) * DAY)} for r in rows]
    names = sorted({k for r in data for k in r})
    schema = [f for f in SCHEMAS["memory_items"].fields if f.name in names]
    from pyspark.sql.types import StructType

    df = spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in data], StructType(schema))
    return conform(df.withColumn("content_hash", F.sha2("content", 256)), "memory_items")


def state(spark, mem, **tables):
    return {n: empty(spark, n) for n in SCHEMAS} | {"memory_items": mem} | tables


def angle(deg):
    return [math.cos(math.radians(deg)), math.sin(math.radians(deg))]


def test_store_versions_and_cascade(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/m")
    assert s.read("memory_items").count() == 0
    mem = memory(spark, [{"id": "a", "content": "x"}, {"id": "b", "content": "y", "memory_type": "semantic"}])
    s.save("memory_items", mem)
    v = s.data_version("memory_items")
    s.append("memory_items", memory(spark, [{"id": "c", "content": "x"}, {"id": "d", "content": "z"}]))
    assert {r["id"] for r in s.read("memory_items").collect()} == {"a", "b", "d"} and s.data_version("memory_items") != v
    links = spark.createDataFrame([("a", "b", "updates"), ("b", "d", "supports")], SCHEMAS["memory_links"])
    m2, l2, _ = st.cascade_delete(mem, links, empty(spark, "memory_edges"), spark.createDataFrame([("a",)], "id string"))
    assert [r["id"] for r in m2.collect()] == ["b"] and l2.count() == 1
    assert st.set_column(mem, ["a"], "pinned", True).where("pinned").count() == 1


def test_walk(spark):
    edges = lambda rows: graph.adjacency(spark.createDataFrame(rows, "src_id string, dst_id string, edge_type string, weight double"))
    seeds = spark.createDataFrame([("A", 1.0)], "id string, strength double")
    got = {r["id"]: r for r in graph.spread(seeds, edges([("A", "B", "sequence", 1.0), ("B", "C", "sequence", 1.0)]), Spreading(max_hops=2)).collect()}
    assert got["C"]["depth"] == 2 and got["C"]["path"] == ["A", "B", "C"] and got["B"]["activation"] == pytest.approx(0.25) and got["C"]["activation"] == pytest.approx(0.0625) and got["A"]["activation"] == 0
    weak = {r["id"] for r in graph.spread(seeds, edges([("A", "B", "co_occurred", 0.1), ("B", "C", "co_occurred", 0.1)]), Spreading(max_hops=3, floor=0.02)).collect()}
    assert weak == {"A", "B"}
    two = spark.createDataFrame([("A", 1.0), ("A2", 1.0)], "id string, strength double")
    both = {r["id"]: r["activation"] for r in graph.spread(two, edges([("A", "T", "sequence", 1.0), ("A2", "T", "sequence", 1.0)]), Spreading()).collect()}
    assert both["T"] == pytest.approx(0.5)
    cycle = graph.spread(seeds, edges([("A", "B", "co_occurred", 1.0), ("B", "C", "co_occurred", 1.0), ("C", "A", "co_occurred", 1.0)]), Spreading(max_hops=5)).count()
    assert cycle == 3
    paths = graph.maximal_paths(graph.spread(seeds, edges([("A", "B", "sequence", 1.0), ("B", "C", "sequence", 1.0)]), Spreading(max_hops=2)), 12)
    assert [r["path"] for r in paths.collect()] == [["A", "B", "C"]]


def test_similarity_and_components(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(90)], "id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if u[i] @ u[j] >= 0.6}
    assert {(r["a"], r["b"]) for r in similar_pairs(df, 0.6, block=16).collect()} == want
    pairs = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected(spark.range(35), pairs).collect()}
    assert got[20] == 0 and got[31] == 30 and got[25] == 25


def _jitter(axis, n, seed, dim=16, noise=0.02):
    v = np.random.default_rng(seed).normal(0, noise, (n, dim))
    v[:, axis] += 1
    return v


def test_segmentation():
    three = np.concatenate([_jitter(a, 10, a) for a in range(3)])
    assert [a for a, _ in segment(three, Segment(window=4))[0]] == [0, 10, 20]
    assert segment(_jitter(0, 30, 5), Segment(window=4))[0] == [(0, 30)]
    assert segment(three[:0])[0] == [] and segment(three[:2])[0] == [(0, 2)]
    a, b = segment(three, Segment(window=4)), segment(three * 10, Segment(window=4))
    assert a[0] == b[0] and np.allclose(a[1], b[1])
    z = three.copy()
    z[25] = 0
    assert segment(z, Segment(window=4))[1][25] == 1.0
    assert boundary_scores([10, 19], [10, 20]) == (1.0, 1.0, 1.0)
    rng = np.random.default_rng(3)
    for _ in range(100):  # whatever the settings, events tile the stream and keep their least length
        n, k = int(rng.integers(0, 60)), int(rng.integers(1, 5))
        c = Segment(window=int(rng.integers(1, 9)), tau=int(rng.integers(2, 20)), gamma=float(rng.uniform(0, 2)), radius=int(rng.integers(0, 5)), min_len=k)
        ev = segment(rng.normal(size=(n, 4)), c)[0]
        assert [x for e in ev for x in range(*e)] == list(range(n)) and all(q - p >= k for p, q in ev[:-1])
    assert merge_micro([(0, 2), (2, 8), (8, 9)], [i * DAY for i in range(9)], 4, 5.0) == [(0, 8), (8, 9)]


def test_segment_streams_and_streaming(spark, tmp_path):
    rows = [(s, i, v.tolist()) for s in ("p", "q") for i, v in enumerate(np.concatenate([_jitter(a, 12, a) for a in range(2)]))]
    df = spark.createDataFrame(rows, "stream_id string, ord long, embedding array<double>")
    c = Segment(window=4)
    got = segment_streams(df, c)
    assert got.groupBy("stream").agg(F.countDistinct("event").alias("n")).where("n = 2").count() == 2
    df.coalesce(1).sortWithinPartitions("ord").write.parquet(str(tmp_path / "in"))
    q = rolling_surprise(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), c).writeStream.format("memory").queryName("rolling").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    both = spark.table("rolling").join(got.withColumnRenamed("stream", "stream_id").withColumnRenamed("surprise", "s"), ["stream_id", "ord"])
    assert both.count() == 48 and both.where("abs(surprise - s) > 1e-6").count() == 0 and spark.table("rolling").where("boundary and ord = 12").count() == 2


REQUEST = "text string, source string, tags array<string>, memory_type string, session_id string, role string, arrival_ts long"


def test_ingest(spark):
    long = "# Heading\n" + "The invoice system keeps ledgers for every customer account. " * 180
    rows = [("the api key lives in 1password", None, None, None, "s", "user", 1), ("The  API key lives in 1password", None, None, None, "s", "user", 2), (long, "file", ["project:x"], None, None, None, 3), ("  ", None, None, None, None, None, 4), ("remember that I love coffee", None, None, None, "s", "user", 5)]
    out = ingest(spark.createDataFrame(rows, REQUEST), empty(spark, "memory_items"))
    mem = {r["content"][:8]: r for r in out["memory_items"].collect()}
    assert len(mem) == 3
    key = mem["the api "]
    assert key["recurrence_score"] == pytest.approx(0.2) and key["access_count"] == 1
    doc = mem["# Headin"]
    assert doc["memory_type"] == "raw_event" and doc["importance_score"] <= 0.10 and out["source_chunks"].count() > 1 and doc["topic"] == "x"
    assert mem["remember"]["memory_type"] == "preference" and {r["evidence_type"] for r in out["memory_evidence"].where(F.col("memory_id") == mem["remember"]["id"]).collect()} >= {"explicit_remember_request"}
    again = ingest(spark.createDataFrame(rows[:1], REQUEST), out["memory_items"])["memory_items"]
    assert again.count() == 3 and again.where("recurrence_score > 0.3").count() == 1


def test_stream_ingest(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/m")
    spark.createDataFrame([("one fact here", None, None, None, "s", "user", 1), ("another fact", None, None, None, "s", "user", 2)], REQUEST).write.parquet(str(tmp_path / "in"))
    q = write_stream(spark.readStream.schema(REQUEST).parquet(str(tmp_path / "in")), s, str(tmp_path / "cp"))
    flush(q)
    q.stop()
    assert s.read("memory_items").count() == 2 and s.read("raw_events").count() == 2


def _vec(spark, mem):
    return mem.withColumn("embedding", F.transform(hashed_bow(F.col("content")), lambda v: v.cast("float")))


def ask(spark, mem, text, c=Config(), edges=None, epochs=None, **o):
    return retrieve.retrieve(mem, edges if edges is not None else empty(spark, "memory_edges"), epochs if epochs is not None else empty(spark, "epochs"), hashed_bow(F.lit(text)), tokenize(F.lit(text)), NOW, c, retrieve.Options(**o)).collect()


def test_retrieval(spark):
    rows = [{"id": "t", "content": "invoice ledger payment reconciliation", "importance_score": 0.1, "days": 3}] + [{"id": f"n{i}", "content": f"weather walk number {i} sunshine", "importance_score": 0.9, "days": 1} for i in range(60)]
    mem = _vec(spark, memory(spark, rows))
    assert ask(spark, mem, "invoice payment ledger", top_k=3)[0]["id"] == "t"
    assert ask(spark, mem, "invoice payment ledger", top_k=3, min_score=0.99) == []
    rows = [{"id": "a", "content": "billing uses stripe", "tags": ["session:1"], "source": "chat"}, {"id": "b", "content": "billing uses paypal", "stale": True}, {"id": "c", "content": "billing uses cash", "days": 50}, {"id": "d", "content": "billing uses cards", "memory_type": "archive"}]
    mem = _vec(spark, memory(spark, rows))
    ids = lambda **o: {r["id"] for r in ask(spark, mem, "billing uses", **o)}
    assert ids() == {"a", "c"} and ids(include_stale=True) == {"a", "b", "c"} and ids(include_archived=True) == {"a", "c", "d"} and ids(exclude_session="1") == {"c"} and ids(since=NOW - DAY) == {"a"}
    total = lambda **o: {r["id"]: r["total"] for r in ask(spark, mem, "billing uses", **o)}["a"]
    assert total(damping=0.5) == pytest.approx(total() / 2)
    eras = conform(spark.createDataFrame([("e0", 0, NOW - 60 * DAY, NOW - 10 * DAY), ("e1", 1, NOW - 10 * DAY, None)], "id string, ordinal long, started_at long, ended_at long"), "epochs")
    assert {r["id"] for r in ask(spark, mem, "billing uses", epochs=eras, era=0)} == {"c"}
    assert {r["id"] for r in ask(spark, mem, "billing uses", epochs=eras, era=9)} == {"a", "c"}


def test_retrieval_conflicts_and_association(spark):
    rows = [{"id": "old", "content": "the main database runs on Postgres", "topic": "db", "days": 10}, {"id": "new", "content": "migrated the main database to SQLite", "topic": "db", "days": 1}, {"id": "far", "content": "lunch with Ann", "days": 2}]
    mem = _vec(spark, memory(spark, rows))
    c = Config()
    on = replace(c, contradiction=replace(c.contradiction, enabled=True))
    assert {r["id"] for r in ask(spark, mem, "main database")} >= {"old", "new"}
    assert "old" not in {r["id"] for r in ask(spark, mem, "main database", on)} and mem.where("stale").count() == 0
    edges = conform(spark.createDataFrame([("new", "far", "sequence", 5.0)], "src_id string, dst_id string, edge_type string, weight double"), "memory_edges")
    near = replace(c, spreading=replace(c.spreading, enabled=True, inject=True, seeds=2))
    got = {r["id"]: r["total"] for r in ask(spark, mem, "main database", near, edges, top_k=2)}
    assert got["far"] > 0 and len(got) == 3
    links = empty(spark, "memory_links")
    m2, l2 = retrieve.supersede(mem, links, ["old", "new"], "old", "new")
    assert m2.where("stale").count() == 1 and l2.count() == 1 and retrieve.supersede(mem, links, ["new"], "old", "new")[1].count() == 0


def test_cooccurrence(spark):
    mem = memory(spark, [{"id": i, "content": i} for i in "abc"])
    turns = conform(spark.createDataFrame([("1", "s", NOW, ["a", "b"]), ("2", "s", NOW + 1, ["a", "b", "b"]), ("3", "s", NOW + 2, ["a", "c", "gone"])], "id string, session_id string, created_at long, memory_ids array<string>"), "chat_turns")
    e = {(r["src_id"], r["dst_id"]): r["weight"] for r in graph.cooccurrence_edges(turns, mem, 0.02, 0.1, NOW).collect()}
    assert set(e) == {("a", "b"), ("a", "c")} and e["a", "b"] > e["a", "c"]
    s = {(r["src_id"], r["dst_id"]) for r in graph.sequence_edges(turns, mem, 0.02, 0.1, NOW).collect()}
    assert ("b", "a") in s and ("a", "c") in s and s == {(r["src_id"], r["dst_id"]) for r in graph.sequence_edges(turns, mem, 0.02, 0.1, NOW, scope="session").collect()}


def test_merge_and_bursts(spark):
    rows = [{"id": "a", "content": "one", "embedding": [1.0, 0.0], "importance_score": 0.5, "access_count": 3, "tags": ["x"], "days": 2}, {"id": "b", "content": "two", "embedding": [1.0, 0.01], "importance_score": 0.7, "access_count": 2, "tags": ["y"], "pinned": True, "days": 1}, {"id": "c", "content": "far", "embedding": [0.0, 1.0]}]
    s = co.merge_duplicates(state(spark, memory(spark, rows)), Config(), NOW)
    kept = {r["id"]: r for r in s["memory_items"].collect()}
    assert set(kept) == {"b", "c"} and kept["b"]["access_count"] == 5 and kept["b"]["importance_score"] == 0.7 and kept["b"]["pinned"] and kept["b"]["created_at"] == NOW - 2 * DAY and set(kept["b"]["tags"]) == {"x", "y"}
    assert s["memory_links"].where("relation = 'duplicates'").count() == 1
    rows = [{"id": f"r{i}", "content": f"ate noodles {i}", "embedding": [1.0, 0.02 * i], "days": 3 + i * 0.01} for i in range(5)] + [{"id": "odd", "content": "fire drill", "embedding": [0.75, 0.66], "days": 3.02}, {"id": "old", "content": "start", "embedding": [-1.0, 0.0], "days": 100}]
    s = co.collapse_bursts(state(spark, memory(spark, rows)), Config(), NOW)
    got = s["memory_items"].collect()
    assert {r["id"] for r in got} >= {"odd", "old"} and not any(r["id"].startswith("r") for r in got) and sum(r["content"].startswith("Gist of 5") for r in got) == 1


def test_habits_eras_and_topics(spark):
    rows = [{"id": f"h{i}", "content": f"plays games {i}", "memory_type": "semantic", "embedding": angle(i * 2), "days": d} for i, d in enumerate([100, 80, 60, 40, 20, 1])]
    s = co.promote_to_foundation(state(spark, memory(spark, rows)), Config(), NOW)
    assert s["memory_items"].where("memory_type = 'foundation'").count() == 1
    rows = [{"id": f"e{i:02d}", "content": f"note {i}", "embedding": angle(a), "days": 60 - 5 * i} for i, a in enumerate([0, 6, 12, 18, 24, 30, 90, 96, 102, 108, 114, 120])]
    c = Config()
    c = replace(c, segment=replace(c.segment, window=3))
    era = co.eras(memory(spark, rows), c).orderBy("ordinal").collect()
    assert [e["member_count"] for e in era] == [6, 6] and era[1]["ended_at"] is None and era[1]["drift_in"] > 0.3
    rows = [{"id": f"p{i}", "content": f"c{i}", "embedding": angle(i), "entities": ["payments"], "topic": f"t{i}", "days": i} for i in range(3)] + [{"id": "x", "content": "kept", "embedding": angle(4), "tags": ["project:own"], "topic": "own"}]
    got = {r["id"]: r["topic"] for r in co.refine_topics(state(spark, memory(spark, rows)), Config(), NOW)["memory_items"].collect()}
    assert {got[f"p{i}"] for i in range(3)} == {"payments"} and got["x"] == "own"


def test_contradictions(spark):
    c = Config()
    c = replace(c, contradiction=replace(c.contradiction, enabled=True, min_similarity=0.5))
    rows = [{"id": "a", "content": "main database runs on Postgres", "topic": "db", "embedding": angle(0), "days": 10}, {"id": "b", "content": "migrated the main database to SQLite", "topic": "db", "embedding": angle(40), "days": 5}]
    s = co.mark_stale(co.infer_contradictions(state(spark, memory(spark, rows)), c), NOW)
    assert {r["id"]: r["stale"] for r in s["memory_items"].collect()} == {"a": True, "b": False}
    off = co.infer_contradictions(state(spark, memory(spark, rows)), Config())
    assert off["memory_links"].count() == 0
    rows.append({"id": "z", "content": "switched the main database back to Postgres", "topic": "db", "embedding": angle(20), "days": 1})
    s = co.revive(s | {"memory_items": s["memory_items"].unionByName(memory(spark, rows[2:]))}, c, NOW)
    assert {r["id"]: r["stale"] for r in s["memory_items"].collect()}["a"] is False and s["memory_links"].where("target_id = 'a'").count() == 0
    both = [{"id": "k", "content": "likes coffee", "topic": "drink", "embedding": angle(0), "days": 3}, {"id": "t", "content": "likes tea", "topic": "drink", "embedding": angle(40), "days": 2}]
    assert co.mark_stale(co.infer_contradictions(state(spark, memory(spark, both)), c), NOW)["memory_items"].where("stale").count() == 0
    assert co.cardinality([(0, 10), (20, 30)]) == "single" and co.cardinality([(0, 30), (10, 40)]) == "multi" and co.cardinality([(5, 5), (9, 9)]) == "unknown"


def test_consolidate_whole(spark):
    rows = [{"id": f"m{i}", "content": f"fact number {i} about payments and ledgers {i % 3}", "days": i, "access_count": i % 5, "memory_type": ["episodic", "raw_event", "semantic"][i % 3], "tags": [f"session:{i % 4}"], "entities": ["payments"]} for i in range(24)] + [{"id": "dead", "content": "old", "memory_type": "archive", "days": 200}]
    turns = conform(spark.createDataFrame([("1", "s", NOW - 5, ["m1", "m2"]), ("2", "s", NOW - 4, ["m2", "m3"])], "id string, session_id string, created_at long, memory_ids array<string>"), "chat_turns")
    raw = conform(spark.createDataFrame([(f"r{i}", f"log {i}", NOW - (80 + i) * DAY) for i in range(30)], "id string, content string, created_at long"), "raw_events")
    s = co.consolidate(state(spark, _vec(spark, memory(spark, rows)), chat_turns=turns, raw_events=raw), Config(), NOW)
    mem = s["memory_items"].collect()
    assert "dead" not in {r["id"] for r in mem} and len({r["content_hash"] for r in mem}) == len(mem)
    assert sum(r["content"].startswith("Pruned 19 raw events") for r in mem) == 1 and s["raw_events"].count() == 11
    run = s["consolidation_runs"].first()
    assert run["deleted"] == 1 and s["epochs"].count() >= 1
