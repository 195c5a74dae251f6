"""More registered queries: parsing, rendering, scores, ingest and writes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import parsing as ps
from mnemora.functions import scoring as m
from mnemora.functions import text as x
from mnemora.functions.vector import centroid, decode_vector, encode_vector
from mnemora.operators import graph, reports, retrieve
from mnemora.operators.ingest import ingest, source_documents, split_arrivals, warm_filter
from mnemora.plans.queries import _LIVE, LNK, MEM, NOW, RAW, SQL, query
from mnemora.sources import fixtures as fx
from mnemora.sources import store as st
from mnemora.sources.schemas import conform, empty

c = F.col


def _docs(s: SparkSession, d: str) -> DataFrame:
    return fx.read(s, d, "documents")


# parsing


@query("n1_n2_json_lists", "SELECT id, to_json(tags)::VARCHAR AS json, 3::BIGINT AS n, 0::BIGINT AS bad FROM mem", MEM)
def _n1(s: SparkSession, d: str) -> DataFrame:
    js = ps.encode_list(c("tags"))
    return fx.memories(s, d).select("id", js.alias("json"), F.size(ps.decode_list(js)).cast("long").alias("n"), F.size(ps.decode_list(F.lit("[broken"))).cast("long").alias("bad"))


@query("n3_n4_tool_call", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 't' || doc_id WHEN 1 THEN 'plain' END AS tool, CASE doc_id % 3 WHEN 0 THEN '{"n":' || doc_id || '}' WHEN 1 THEN '{}' END AS args FROM documents""")
def _n4(s: SparkSession, d: str) -> DataFrame:
    n = c("doc_id").cast("string")
    said = F.when(c("doc_id") % 3 == 0, F.concat(F.lit('so:\n```json\n{"tool":"t'), n, F.lit('","args":{"n":'), n, F.lit("}}\n```\ndone"))).when(c("doc_id") % 3 == 1, F.lit('{"tool":"plain"}')).otherwise(F.lit("```\nno call\n```"))
    return _docs(s, d).select("doc_id", ps.tool_call(said).alias("call")).select("doc_id", "call.tool", "call.args")


@query("n5_shell_command", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ls ' || doc_id || chr(10) || 'wc -l x' END AS command FROM documents")
def _n5(s: SparkSession, d: str) -> DataFrame:
    said = F.when(c("doc_id") % 2 == 0, F.concat(F.lit("run\n```bash\n# list\n$ ls "), c("doc_id").cast("string"), F.lit("\n\nwc -l x\n```"))).otherwise(F.lit("nothing to run"))
    return _docs(s, d).select("doc_id", ps.shell_command(said).alias("command"))


@query("n7_supersede_args", "SELECT doc_id, CASE WHEN doc_id % 4 NOT IN (0, 3) THEN 'a' || doc_id END AS loser_id, CASE WHEN doc_id % 4 NOT IN (0, 3) THEN 'b' END AS winner_id FROM documents")
def _n7(s: SparkSession, d: str) -> DataFrame:
    n = c("doc_id").cast("string")
    args = F.when(c("doc_id") % 4 == 0, F.lit('{"loser_id":"a","winner_id":"a"}')).when(c("doc_id") % 4 == 3, F.lit('{"loser_id":"a"}')).otherwise(F.concat(F.lit('{"loser_id":" a'), n, F.lit('","winner_id":"b "}')))
    return _docs(s, d).select("doc_id", ps.supersede_args(args).alias("x")).select("doc_id", "x.loser_id", "x.winner_id")


@query("z7_stream_lines", "SELECT doc_id, 'w' || doc_id AS delta, doc_id % 2 = 0 AS done, doc_id AS prompt_tokens, CASE WHEN doc_id % 3 <> 0 THEN doc_id * 2 ELSE -1 END AS duration_ms, CASE WHEN doc_id % 5 <> 0 THEN 'v' || doc_id END AS sse FROM documents")
def _z7(s: SparkSession, d: str) -> DataFrame:
    n = c("doc_id").cast("string")
    ms = F.when(c("doc_id") % 3 != 0, F.concat(F.lit(',"total_duration":'), (c("doc_id") * 2_000_000 + 5).cast("string"))).otherwise("")
    line = F.concat(F.lit('{"message":{"content":"w'), n, F.lit('"},"done":'), (c("doc_id") % 2 == 0).cast("string"), F.lit(',"prompt_eval_count":'), n, ms, F.lit("}"))
    sse = F.when(c("doc_id") % 5 == 0, F.lit(": keep-alive")).otherwise(F.concat(F.lit('data: {"choices":[{"delta":{"content":"v'), n, F.lit('"}}]}')))
    return _docs(s, d).select("doc_id", ps.ndjson_line(line).alias("x"), ps.sse_line(sse)["delta"].alias("sse")).select("doc_id", "x.delta", "x.done", "x.prompt_tokens", F.coalesce("x.duration_ms", F.lit(-1)).alias("duration_ms"), "sse")


@query("x29_model_names", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['m' || doc_id || ':latest', 'z'] ELSE ['m' || doc_id] END AS names, true AS found, doc_id % 2 = 1 AS exact FROM documents")
def _x29(s: SparkSession, d: str) -> DataFrame:
    n = c("doc_id").cast("string")
    reply = F.when(c("doc_id") % 2 == 0, F.concat(F.lit('{"models":[{"name":"m'), n, F.lit(':latest"},{"name":"z"}]}'))).otherwise(F.concat(F.lit('{"data":[{"id":"m'), n, F.lit('"}]}')))
    names = ps.model_names(reply)
    want = F.concat(F.lit("m"), n)
    return _docs(s, d).select("doc_id", names.alias("names"), F.exists(names, lambda k: ps.model_matches(k, want)).alias("found"), F.exists(names, lambda k: k == want).alias("exact"))


# text and rendering


@query("x7_is_long", f"SELECT id, mode NOT IN ('conversation_message', 'mixed_message') AS long FROM ({SQL['x6_input_mode']})")
def _x7(s: SparkSession, d: str) -> DataFrame:
    a = _docs(s, d).select(F.concat(F.lit("d"), "doc_id").alias("id"), c("text").alias("t"))
    b = fx.read(s, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), c("html").alias("t"))
    return a.union(b).select("id", x.is_long(x.input_mode(c("t"))).alias("long"))


@query("x17_raw_words", "SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda t: regexp_replace(t, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda t: t <> '') AS w FROM documents)")
def _x17(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", x.raw_words(c("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("x24_x27_context", "SELECT id, 'Relevant memories:' || chr(10) || '- [' || memory_type || '] ' || content || chr(10) || chr(10) || 'ask' AS message, ['fact ' || doc_id, 'two'] AS remembered FROM mem", MEM)
def _x24(s: SparkSession, d: str) -> DataFrame:
    block = x.context_block(F.array(F.struct("memory_type", c("content").alias("text"))))
    said = F.concat(F.lit("ok\n```remember\n- fact "), F.substring("id", 5, 20), F.lit("\n\n* two\n```"))
    return fx.memories(s, d).select("id", x.wrap_message(F.lit("ask"), block).alias("message"), x.remembered(said).alias("remembered"))


@query("x28_render_path", """SELECT source_id, target_id, '"' || trim(substr(a.content, 1, 60)) || '" —(linked to)→ "' || trim(substr(b.content, 1, 60)) || '"' AS path FROM lnk JOIN mem a ON a.id = source_id JOIN mem b ON b.id = target_id""", MEM, LNK)
def _x28(s: SparkSession, d: str) -> DataFrame:
    mem = fx.memories(s, d)
    side = lambda i, t: mem.select(c("id").alias(i), c("content").alias(t))
    both = fx.links(s, d).join(side("source_id", "a"), "source_id").join(side("target_id", "b"), "target_id")
    return both.select("source_id", "target_id", x.render_path(F.array("a", "b"), F.array("relation")).alias("path"))


# scores


@query("m11_m12_f5_damped", "SELECT id, CASE WHEN source = 'chat' AND memory_type IN ('raw_event', 'episodic') THEN true ELSE false END AS conversational, round(importance_score * CASE WHEN source = 'chat' AND memory_type IN ('raw_event', 'episodic') THEN 0.6 ELSE 1 END, 6) AS total, round(least(0.15 * salience * 3, 0.15), 6) AS gain FROM mem", MEM)
def _m11(s: SparkSession, d: str) -> DataFrame:
    talk = F.coalesce(retrieve.is_conversational(), F.lit(False))
    return fx.memories(s, d).select("id", talk.alias("conversational"), F.round(m.damped(c("importance_score"), talk, 0.6), 6).alias("total"), F.round(m.association_boost(c("salience") * 3, 0.15), 6).alias("gain"))


@query("m15_m16_ingest_type", """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'raw_event' WHEN k = 'preference_weak' THEN 'preference' WHEN k IN ('goal_candidate', 'identity_candidate') THEN 'semantic' ELSE 'episodic' END AS memory_type,
CASE WHEN doc_id % 7 = 0 THEN 0.10::DOUBLE ELSE greatest(least((doc_id % 10) / 10.0, 0.65), CASE k WHEN 'preference_weak' THEN 0.30 WHEN 'goal_candidate' THEN 0.60 WHEN 'identity_candidate' THEN 0.70 WHEN 'correction_signal' THEN 0.45 ELSE 0 END, CASE WHEN k = 'preference_weak' THEN 0.30 ELSE 0.20 END)::DOUBLE END AS importance
FROM (SELECT doc_id, (['preference_weak', 'goal_candidate', 'identity_candidate', 'correction_signal', NULL])[doc_id % 5 + 1] AS k FROM documents)""")
def _m15(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(k) for k in ("preference_weak", "goal_candidate", "identity_candidate", "correction_signal")])
    kinds = F.when(c("doc_id") % 5 < 4, F.array(F.element_at(names, F.least(c("doc_id") % 5, F.lit(3)).cast("int") + 1))).otherwise(F.array().cast("array<string>"))
    rows = _docs(s, d).select("doc_id", kinds.alias("kinds"), (c("doc_id") % 7 == 0).alias("long")).withColumn("memory_type", m.inferred_type(c("kinds"), c("long")))
    return rows.select("doc_id", "memory_type", m.base_importance(c("memory_type"), c("kinds"), (c("doc_id") % 10) / 10, c("long")).alias("importance"))


@query("f7_near_misses", "SELECT id, total FROM (SELECT id, created_at, importance_score * salience AS total FROM mem) WHERE total > 0 AND total < 0.3 ORDER BY total DESC, created_at, id LIMIT 20", MEM)
def _f7(s: SparkSession, d: str) -> DataFrame:
    scored = fx.memories(s, d).withColumn("total", c("importance_score") * c("salience"))
    return retrieve.near_misses(scored, retrieve.Options(min_score=0.3)).select("id", "total")


@query("g6_boost", "SELECT id, round(importance_score + CASE WHEN doc_id % 3 = 0 AND salience > 0 THEN least(0.15 * salience * 2, 0.15) ELSE 0 END, 6) AS total FROM mem", MEM)
def _g6(s: SparkSession, d: str) -> DataFrame:
    mem = fx.memories(s, d).withColumn("total", c("importance_score"))
    reach = mem.where(F.substring("id", 5, 20).cast("long") % 3 == 0).select("id", (c("salience") * 2).alias("activation"))
    return graph.boost(mem, reach, 0.15).select("id", F.round("total", 6).alias("total"))


@query("f9_typed_nodes", f"SELECT id, round({_LIVE}, 6) AS decay, count(*) OVER () AS total_count FROM mem WHERE created_at BETWEEN {NOW - 30 * 86400} AND {NOW} AND memory_type IN ('semantic', 'preference') ORDER BY {_LIVE} DESC, created_at, id LIMIT 40", MEM)
def _f9(s: SparkSession, d: str) -> DataFrame:
    got = reports.graph_nodes(fx.memories(s, d), NOW, types=["semantic", "preference"], limit=40)
    return got.select("id", F.round("decay", 6).alias("decay"), "total_count")


# vectors


@query("a14_v6_centroid", "SELECT g, round(sum(x * k) / sqrt(sum(x * x)), 3) AS projection, 1.0::DOUBLE AS norm FROM (SELECT g, k, sum(v / n) AS x FROM (SELECT vec_id % 5 AS g, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) GROUP BY ALL) GROUP BY g")
def _a14(s: SparkSession, d: str) -> DataFrame:
    got = centroid(fx.read(s, d, "embeddings").select((c("vec_id") % 5).alias("g"), "embedding"), ["g"])
    total = lambda f: F.aggregate(F.transform("centroid", f), F.lit(0.0), lambda a, b: a + b)
    return got.select("g", F.round(total(lambda v, k: v.cast("double") * (k + 1)), 3).alias("projection"), F.round(F.sqrt(total(lambda v: v.cast("double") * v)), 3).alias("norm"))


@query("s28_vector_codec", "SELECT vec_id, len(embedding) * 4 AS bytes, true AS same FROM embeddings")
def _s28(s: SparkSession, d: str) -> DataFrame:
    v = c("embedding").cast("array<float>")
    return fx.read(s, d, "embeddings").select("vec_id", v.alias("v"), encode_vector(v).alias("data")).select("vec_id", F.octet_length("data").cast("long").alias("bytes"), (decode_vector(c("data")) == c("v")).alias("same"))


# store and ingest


@query("s18_newest_first", "SELECT id, created_at FROM raw ORDER BY created_at DESC, id DESC LIMIT 25", RAW)
def _s18(s: SparkSession, d: str) -> DataFrame:
    return st.newest_first(fx.raw_events(s, d), 25, "created_at").select("id", "created_at")


@query("s20_replace_edges", "SELECT 'semantic_similar' AS edge_type, count(*) AS n, 1.0::DOUBLE AS weight FROM lnk UNION ALL SELECT 'sequence', count(*), 2.0 FROM lnk", LNK)
def _s20(s: SparkSession, d: str) -> DataFrame:
    make = lambda kind, w: conform(fx.links(s, d).select(c("source_id").alias("src_id"), c("target_id").alias("dst_id"), F.lit(kind).alias("edge_type"), F.lit(w).alias("weight")), "memory_edges")
    got = st.replace_edges(make("semantic_similar", 1.0).union(make("sequence", 1.0)), make("sequence", 2.0), "sequence")
    return got.groupBy("edge_type").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))


@query("s27_conform", "SELECT doc_id AS id, 0.5::DOUBLE AS importance_score, 1.0::DOUBLE AS recency_score, 0::BIGINT AS access_count, false AS stale, 0::BIGINT AS tags FROM documents")
def _s27(s: SparkSession, d: str) -> DataFrame:
    got = conform(_docs(s, d).select(c("doc_id").alias("id"), c("text").alias("content")), "memory_items")
    return got.select(c("id").cast("long").alias("id"), "importance_score", "recency_score", "access_count", "stale", F.size("tags").cast("long").alias("tags"))


_WORDS = "list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda t: t <> '')"


@query("i2_source_documents", f"SELECT content_hash, array_to_string(w[1:40], ' ') AS summary, CASE WHEN len(w) <= 550 THEN 1 ELSE ceil((len(w) - 550) / 470.0)::BIGINT + 1 END AS chunks FROM (SELECT DISTINCT m.content_hash, {_WORDS} AS w FROM mem m JOIN documents USING (doc_id) WHERE doc_id % 4 = 0 AND trim(text) <> '')", MEM)
def _i2(s: SparkSession, d: str) -> DataFrame:
    long = _docs(s, d).where("doc_id % 4 = 0 and trim(text) <> ''").select("text", x.content_hash(c("text")).alias("content_hash"), F.lit("log_dump").alias("mode"), F.lit("s").alias("session_id"), F.lit(NOW).alias("arrival_ts")).dropDuplicates(["content_hash"])
    docs, parts = source_documents(long)
    n = parts.groupBy(c("source_id").alias("id")).agg(F.count("*").alias("chunks"))
    return docs.join(n, "id").select(c("raw_text_hash").alias("content_hash"), "summary", "chunks")


_ARRIVE = "arr AS (SELECT content_hash, count(*) AS n FROM (SELECT content_hash FROM mem WHERE trim(content) <> '' UNION ALL SELECT content_hash FROM mem WHERE doc_id % 4 = 0 AND trim(content) <> '') GROUP BY 1), old AS (SELECT DISTINCT content_hash FROM mem WHERE doc_id % 3 = 0)"


def _requests(s: SparkSession, d: str) -> DataFrame:
    one = _docs(s, d).select("text", F.lit("notes").alias("source"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("memory_type"), F.lit("s1").alias("session_id"), F.lit("user").alias("role"), (F.lit(NOW) + c("doc_id")).alias("arrival_ts"), "doc_id")
    return one.union(one.where("doc_id % 4 = 0")).drop("doc_id")


@query("i4_j12_k2_arrivals", "SELECT content_hash, CASE WHEN content_hash IN (FROM old) THEN 0 ELSE 1 END AS fresh, n - CASE WHEN content_hash IN (FROM old) THEN 0 ELSE 1 END AS again FROM arr", MEM, _ARRIVE)
def _i4(s: SparkSession, d: str) -> DataFrame:
    """The store's hashes are asked through its warmed Bloom filter."""
    stored = fx.memories(s, d).where(F.substring("id", 5, 20).cast("long") % 3 == 0)
    ready = _requests(s, d).where(F.trim("text") != "").withColumn("content_hash", x.content_hash(c("text")))
    fresh, again = split_arrivals(ready, stored, warm_filter(stored))
    counts = ready.select("content_hash").distinct().join(fresh.groupBy("content_hash").agg(F.count("*").alias("fresh")), "content_hash", "left").join(again, "content_hash", "left")
    return counts.select("content_hash", F.coalesce("fresh", F.lit(0)).cast("int").alias("fresh"), F.coalesce("times", F.lit(0)).alias("again"))


@query("i1_i3_ingest", "SELECT content_hash, n - 1 AS access_count, round(least(1.0, 0.2 * (n - 1)), 6) AS recurrence_score, 'notes' AS source FROM arr", MEM, _ARRIVE)
def _i1(s: SparkSession, d: str) -> DataFrame:
    got = ingest(_requests(s, d), empty(s, "memory_items"))["memory_items"]
    plain = F.when(c("source").isin("code_block", "log_dump", "pasted_document", "article_draft"), "notes").otherwise(c("source"))
    return got.select("content_hash", "access_count", F.round("recurrence_score", 6).alias("recurrence_score"), plain.alias("source"))
