"""Memory tables derived from the driver's tables, and the same derivations in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.text import STOPWORDS, content_hash, tokenize
from mnemora.functions.vector import hashed_bow
from mnemora.sources.schemas import conform

NOW = 1_706_745_600
_TYPES = ("episodic", "episodic", "episodic", "semantic", "semantic", "raw_event", "raw_event", "preference", "procedural", "archive")
_RELATIONS = ("supports", "contradicts", "updates", "duplicates", "derived_from", "belongs_to_project")
_EVENT = {"click": "retrieval_success", "purchase": "user_confirmation", "refund": "user_correction", "login": "cross_day_recurrence"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """memory_items from `documents`: types, times, flags and counts by arithmetic on doc_id; entities from the first tokens; vectors by hashed_bow."""
    d = read(spark, sf_dir, "documents")
    if vectors:  # a small table is one row group, so one task would embed all of it
        d = d.repartition(max(spark.sparkContext.defaultParallelism, d.rdd.getNumPartitions()))
    n = F.col("doc_id")
    kind = F.when(n % 97 == 0, "foundation").otherwise(F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (n % 10).cast("int") + 1))
    named = F.array_sort(F.array_distinct(F.slice(F.filter(tokenize(F.col("text")), lambda t: F.octet_length(t) > 3), 1, 8)))
    at = F.lit(NOW) - (n % 120) * 86400 - n
    rows = d.select(
        F.concat(F.lit("mem_"), n).alias("id"), F.col("text").alias("content"), kind.alias("memory_type"), F.when(n % 9 == 0, "chat").otherwise(F.col("source")).alias("source"), F.when(n % 8 != 0, F.col("source")).alias("topic"), named.alias("entities"),
        F.array(F.concat(F.lit("project:"), F.col("source")), F.concat(F.lit("lang:"), F.col("lang")), F.concat(F.lit("session:"), n % 50)).alias("tags"), at.alias("created_at"), at.alias("updated_at"), (n % 5).alias("access_count"), (0.3 + (n % 7) * 0.1).alias("importance_score"), ((n % 4) * 0.1).alias("recurrence_score"),
        ((n % 10) / 10.0).alias("salience"), F.lit(0.5).alias("confidence"), (n % 11 == 0).alias("stale"), (n % 13 == 0).alias("pinned"), content_hash(F.col("text")).alias("content_hash"),
    )
    if vectors:
        rows = rows.withColumn("embedding", hashed_bow(F.col("content")))
        # vectors stay in double precision here, so that thresholds fall the same way in the oracle
        return rows
    return conform(rows, "memory_items")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    d = read(spark, sf_dir, "documents")
    total = d.select("doc_id").where("doc_id >= 11")
    return total.select(F.concat(F.lit("mem_"), n).alias("source_id"), F.concat(F.lit("mem_"), n - n % 11).alias("target_id"), F.element_at(F.array(*[F.lit(r) for r in _RELATIONS]), (n % 6).cast("int") + 1).alias("relation"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chat_turns from `conversations`: a row for each user message, with up to three memories."""
    c, t, n = F.col("conv_id"), F.col("turn"), read(spark, sf_dir, "documents").count()
    ids = F.array(F.concat(F.lit("mem_"), (c * 7 + t) % n), F.concat(F.lit("mem_"), (c * 3 + 1) % n), F.concat(F.lit("mem_"), (c + t * t) % n))
    rows = read(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat(F.lit("turn_"), c, F.lit("_"), t).alias("id"), F.concat(F.lit("conv_"), c % 40).alias("session_id"), (F.lit(NOW - 100 * 86400) + (c % 90) * 86400 + c * 60 + t).alias("created_at"), F.col("text").alias("user_text"), F.lit("").alias("assistant_text"), F.lit("m").alias("model"), F.lit("b").alias("backend"), F.when(c % 5 != 0, F.char_length("text") + 10).alias("prompt_tokens"), F.when(c % 7 != 0, t * 3 + 5).alias("completion_tokens"), F.when(c % 3 != 0, c * 2 + 100).alias("total_duration_ms"), F.when(c % 4 != 0, c + 50).alias("llm_duration_ms"), (t + 3).alias("retrieve_duration_ms"), F.lit(3).alias("context_memory_count"), (c % 200).alias("context_chars"), ids.alias("memory_ids"))
    return conform(rows, "chat_turns")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memory_evidence from `events`."""
    e, n = read(spark, sf_dir, "events"), read(spark, sf_dir, "documents").count()
    kind = F.lit("topic_repeated")
    for k, v in _EVENT.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return e.select(F.concat(F.lit("ev_"), F.col("event_id")).alias("id"), F.concat(F.lit("mem_"), F.col("event_id") % n).alias("memory_id"), kind.alias("evidence_type"), ((F.col("event_id") % 10) / 10.0).alias("strength"), F.lit("chat").alias("source"), F.concat(F.lit("s_"), F.col("user_id")).alias("session_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("raw_"), F.col("event_id")).alias("id"), F.concat(F.lit("s_"), F.col("user_id") % 30).alias("session_id"), F.lit("user").alias("role"), F.col("event_type").alias("content"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"), F.sha2(F.col("event_type"), 256).alias("content_hash"))


_stop = ", ".join(f"'{w}'" for w in STOPWORDS)
TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) > 1 AND t NOT IN (" + _stop + "))"


def tokens_sql(column: str) -> str:
    return TOKENS.format(column)


MEM_SQL = f"""d0 AS (SELECT *, {tokens_sql("text")} AS toks FROM documents),
mem AS (SELECT 'mem_' || doc_id AS id, doc_id, text AS content, toks,
  CASE WHEN doc_id % 97 = 0 THEN 'foundation' ELSE (['episodic','episodic','episodic','semantic','semantic','raw_event','raw_event','preference','procedural','archive'])[doc_id % 10 + 1] END AS memory_type,
  CASE WHEN doc_id % 9 = 0 THEN 'chat' ELSE source END AS source, CASE WHEN doc_id % 8 <> 0 THEN source END AS topic,
  list_sort(list_distinct(list_filter(toks, lambda t: strlen(t) > 3)[1:8])) AS entities,
  ['project:' || source, 'lang:' || lang, 'session:' || (doc_id % 50)] AS tags,
  {NOW} - (doc_id % 120) * 86400 - doc_id AS created_at, doc_id % 5 AS access_count, 0.3::DOUBLE + (doc_id % 7) * 0.1::DOUBLE AS importance_score,
  (doc_id % 4) * 0.1::DOUBLE AS recurrence_score, (doc_id % 10) / 10.0::DOUBLE AS salience, doc_id % 11 = 0 AS stale, doc_id % 13 = 0 AS pinned,
  sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS content_hash FROM d0)"""
LINK_SQL = "lnk AS (SELECT 'mem_' || doc_id AS source_id, 'mem_' || (doc_id - doc_id % 11) AS target_id, (['supports','contradicts','updates','duplicates','derived_from','belongs_to_project'])[doc_id % 6 + 1] AS relation FROM documents WHERE doc_id >= 11)"
TURN_SQL = f"""trn AS (SELECT 'turn_' || conv_id || '_' || turn AS id, 'conv_' || (conv_id % 40) AS session_id, {NOW} - 100 * 86400 + (conv_id % 90) * 86400 + conv_id * 60 + turn AS created_at, text AS user_text,
  CASE WHEN conv_id % 5 <> 0 THEN length(text) + 10 END AS prompt_tokens, CASE WHEN conv_id % 7 <> 0 THEN turn * 3 + 5 END AS completion_tokens, CASE WHEN conv_id % 3 <> 0 THEN conv_id * 2 + 100 END AS total_duration_ms,
  CASE WHEN conv_id % 4 <> 0 THEN conv_id + 50 END AS llm_duration_ms, turn + 3 AS retrieve_duration_ms, 3 AS context_memory_count, conv_id % 200 AS context_chars,
  ['mem_' || ((conv_id * 7 + turn) % (SELECT count(*) FROM documents)), 'mem_' || ((conv_id * 3 + 1) % (SELECT count(*) FROM documents)), 'mem_' || ((conv_id + turn * turn) % (SELECT count(*) FROM documents))] AS memory_ids FROM conversations WHERE role = 'user')"""
EVIDENCE_SQL = "evd AS (SELECT 'ev_' || event_id AS id, 'mem_' || (event_id % (SELECT count(*) FROM documents)) AS memory_id, CASE event_type WHEN 'click' THEN 'retrieval_success' WHEN 'purchase' THEN 'user_confirmation' WHEN 'refund' THEN 'user_correction' WHEN 'login' THEN 'cross_day_recurrence' ELSE 'topic_repeated' END AS evidence_type, (event_id % 10) / 10.0::DOUBLE AS strength, floor(epoch(ts))::BIGINT AS created_at FROM events)"
RAW_SQL = "raw AS (SELECT 'raw_' || event_id AS id, 's_' || (user_id % 30) AS session_id, event_type AS content, floor(epoch(ts))::BIGINT AS created_at FROM events)"
#: Hashed bag-of-words of any text as rows (id, bucket, x), of unit length.
BAG_SQL = """hsh AS (SELECT id, ('0x' || substr(md5(unnest(toks)), 1, 15))::BIGINT AS h FROM mem),
bag0 AS (SELECT id, h % 256 AS bucket, sum(CASE WHEN h >= 576460752303423488 THEN -1.0 ELSE 1.0 END)::DOUBLE AS x FROM hsh GROUP BY ALL),
len AS (SELECT id, sqrt(sum(x * x)) AS n FROM bag0 GROUP BY id),
bag AS (SELECT bag0.id, bucket, x / n AS x FROM bag0 JOIN len USING (id) WHERE n > 0 AND x <> 0)"""
