"""Turns, packs, single-memory operations, store appends and migrations, injected functions."""

import json

import numpy as np
from pyspark.sql import functions as F

from mnemora.functions.extract import correction, judge
from mnemora.functions.vector import provider
from mnemora.operators import agent, consolidate, graph, retrieve, segment
from mnemora.operators.ingest import ingest, warm_filter
from mnemora.plans.config import Config, Segment, load
from mnemora.sources.schemas import SCHEMAS, empty
from mnemora.sources.store import Store, open_in_memory

NOW = 1_700_000_000
TEXTS = ["the lighthouse keeper paints the old door blue", "the lighthouse keeper paints the old door blue every spring", "bread needs flour water salt and time", "trains to the coast leave on sunday mornings"]


def stored(spark):
    req = spark.createDataFrame([(t, "chat", [f"session:{i}"], None, str(i), "user", NOW - 1000 + i) for i, t in enumerate(TEXTS)], "text string, source string, tags array<string>, memory_type string, session_id string, role string, arrival_ts long")
    return ingest(req, empty(spark, "memory_items"))["memory_items"]


def test_novelty_falls_with_likeness(spark):
    mem = stored(spark)
    by = {r["content"]: r["salience"] for r in mem.collect()}
    v = {r["content"]: np.array(r["embedding"], float) for r in mem.collect()}
    cos = v[TEXTS[0]] @ v[TEXTS[1]]
    assert by[TEXTS[0]] == 1.0 and abs(by[TEXTS[1]] - (1 - cos)) < 1e-6 and by[TEXTS[1]] < 0.4
    again = ingest(spark.createDataFrame([(TEXTS[2], NOW), ("a new thing entirely", NOW + 1)], "text string, arrival_ts long").selectExpr("text", "'x' as source", "array() as tags", "cast(null as string) as memory_type", "'s' as session_id", "'user' as role", "arrival_ts"), mem, warm=warm_filter(mem))["memory_items"]
    assert again.count() == 5 and again.where("access_count = 1").count() == 1


def test_turns_are_prepared_and_finished(spark):
    mem = stored(spark)
    tables = open_in_memory(spark) | {"memory_items": mem}
    p = agent.prepare_turn(mem, tables["memory_edges"], tables["epochs"], "be kind", [("user", "hi"), ("assistant", "hello")], ["which door"], "what colour does the lighthouse keeper paint", NOW, session="9")
    assert p.query.startswith("which door\n") and p.messages[0] == ("system", "be kind") and p.messages[-1][1].endswith("what colour does the lighthouse keeper paint") and "Relevant memories" in p.messages[-1][1]
    assert len(p.ids) >= 2 and p.context_chars == sum(len(r["content"]) for r in p.pack.collect())
    out = agent.finish_turn(tables, "9", p, "blue", {"prompt_tokens": 12}, "local", "m", NOW)
    assert out["memory_items"].count() == mem.count() + 2 and out["chat_turns"].first()["prompt_tokens"] == 12 and out["raw_events"].count() == 2
    assert out["memory_edges"].count() == len(p.ids) * (len(p.ids) - 1) // 2
    own = agent.prepare_turn(mem, tables["memory_edges"], tables["epochs"], "", [], [], TEXTS[3], NOW, session="3")
    assert not any(i == r["id"] for i in own.ids for r in mem.where(F.col("content") == TEXTS[3]).collect())
    js = json.loads(agent.pack_json(p.pack, p.query, NOW, 0.25, p.pack.limit(0)).first()["json"])
    assert [m["id"] for m in js["memories"]] == p.ids and js["min_score"] == 0.25 and "near_misses" not in js and "total" in js["memories"][0]["score"]


def test_single_memories(spark):
    mem = stored(spark)
    i = mem.orderBy("id").first()["id"]
    links = spark.createDataFrame([("other", i, "updates"), (i, "x", "supports")], SCHEMAS["memory_links"])
    assert agent.pin(mem, [i], NOW).where("pinned").count() == 1 and agent.archive(agent.pin(mem, [i], NOW), [i], NOW).where("memory_type = 'archive' and not pinned").count() == 1
    fresh, left = agent.revive_one(mem.withColumn("stale", F.lit(True)), links, i, NOW)
    assert fresh.where("not stale").count() == 1 and left.count() == 1
    seen = json.loads(agent.inspect(mem, links, empty(spark, "memory_evidence"), empty(spark, "memory_edges"), i).first()["json"])
    assert seen["memory"]["id"] == i and len(seen["links"]) == 2 and seen["evidence"] == []
    assert agent.config_view(Config())["chat.top_k"] == 6 and agent.config_view(load("[chat]\ntop_k = 3"))["chat.top_k"] == 3


def test_store_appends_and_migrates(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    turn = spark.createDataFrame([("t1", NOW)], "id string, created_at long")
    s.insert_chat_turn(turn)
    s.insert_chat_turn(turn.withColumn("id", F.lit("t2")))
    assert {r["id"] for r in s.read("chat_turns").collect()} == {"t1", "t2"} and len(s._versions("chat_turns")) == 2
    s.compact("chat_turns")
    assert s.read("chat_turns").count() == 2 and len(s._versions("chat_turns")) == 1
    link = spark.createDataFrame([("a", "b", "supports")], SCHEMAS["memory_links"])
    s.append("memory_links", link)
    s.append("memory_links", link)
    assert s.read("memory_links").count() == 1
    s.replace_epochs(spark.createDataFrame([("e2", 1), ("e1", 0)], "id string, ordinal long"))
    assert [r["id"] for r in s.list_epochs().collect()] == ["e1", "e2"]
    spark.createDataFrame([("old", "text")], "id string, content string").write.parquet(f"file://{tmp_path}/store/memory_items/v00000001-00000000")
    assert s.migrate() == ["memory_items"] and s.migrate() == [] and s.read("memory_items").first()["importance_score"] == 0.5
    assert s.read("store_meta").where("key = 'schema_version'").count() == 1


def test_corrections_by_wording():
    cases = {"we moved from Boston to Denver": ("Boston", "Denver"), "use Rust instead of Go": ("Go", None), "we no longer use Redis": ("use", None), "actually fine": (None, None), "back to Denver": None, "plain words": None}
    got = {t: correction(t) for t in cases}
    assert got == cases
    assert judge("the host is alpha", "the host is beta", "single") == (0.7, "slot|alpha|beta") and judge("the host is alpha", "the host is beta", "multi") is None


def test_injected_functions(spark):
    v = np.concatenate([np.tile(np.eye(4)[0], (12, 1)), np.tile(np.eye(4)[1], (12, 1))]) + 1e-3
    own = segment.surprise(segment._units(v), Segment(window=3, predictor=lambda w: w[-1]))
    assert own.argmax() == 12 and own[5] < 1e-6
    rows = spark.createDataFrame([(0, i, TEXTS[0] if i < 12 else TEXTS[2]) for i in range(24)], "stream_id long, ord long, text string")
    got = segment.segment_texts(rows, provider(), Segment(window=3)).collect()
    assert {r["model_id"] for r in got} == {"hashed_bow:256"} and len({r["event"] for r in got}) == 2
    top = stored(spark).withColumn("total", F.lit(1.0)).withColumn("topic", F.lit("t"))
    c = load("[contradiction]\nenabled = true")
    assert retrieve.resolve_latest(top, c, lambda a, b, k: (1.0, "said so")).count() == 1
    s = {"memory_items": stored(spark).withColumn("memory_type", F.lit("episodic")), "memory_links": empty(spark, "memory_links")}
    near = s["memory_items"].withColumn("embedding", F.array(*[F.lit(1.0).cast("float")] * 4))
    new = consolidate.summarize_clusters(s | {"memory_items": near}, Config(), NOW, lambda texts: f"{len(texts)} things")
    assert new["memory_items"].where("memory_type = 'semantic'").first()["content"] == "4 things" and new["memory_links"].count() == 4


def test_spreading_brings_in_neighbours(spark):
    mem = stored(spark)
    ids = [r["id"] for r in mem.orderBy("created_at").collect()]
    edges = spark.createDataFrame([(min(ids[0], ids[2]), max(ids[0], ids[2]), "co_occurred", 4.0, 4, NOW, NOW)], SCHEMAS["memory_edges"])
    vector, tokens = retrieve.query_columns(spark, TEXTS[0])
    plain = retrieve.retrieve(mem, edges, empty(spark, "epochs"), vector, tokens, NOW, Config(), retrieve.Options(min_score=0.4))
    wide = retrieve.retrieve(mem, edges, empty(spark, "epochs"), vector, tokens, NOW, load("[spreading]\nenabled = true\ninject = true\nseeds = 1"), retrieve.Options(min_score=0.4))
    assert ids[2] not in {r["id"] for r in plain.collect()} and ids[2] in {r["id"] for r in wide.collect()}
    reach = graph.spread(spark.createDataFrame([(ids[0], 1.0)], "id string, strength double"), graph.adjacency(edges), Config().spreading)
    assert {r["id"]: r["depth"] for r in reach.collect()} == {ids[0]: 0, ids[2]: 1}
