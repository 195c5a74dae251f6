"""Batch ingest (I1-I6, J12, M15-M17, M19): requests in order of arrival to rows of all tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.functions import scoring as m
from mnemora.functions import text as x
from mnemora.functions.extract import parsed
from mnemora.functions.sketch import bloom_build, bloom_contains
from mnemora.functions.vector import Provider, provider
from mnemora.operators.blocks import stored
from mnemora.operators.similarity import neighbor_sums

CHUNK, OVERLAP = 550, 80


def chat_request(session: str, text: Column, role: Column, at: Column) -> list[Column]:
    """Columns of an ingest request for a chat message; the assistant's are raw events."""
    return [text.alias("text"), F.lit("chat").alias("source"), F.array(F.lit(f"session:{session}")).alias("tags"), F.when(role == "assistant", "raw_event").alias("memory_type"), F.lit(session).alias("session_id"), role.alias("role"), at.alias("arrival_ts")]


def _said() -> Column:
    """That a text isn't empty once it is normalized."""
    return F.col("text").rlike("(?U)\\S")


def prepare(requests: DataFrame, embed: Provider | None = None) -> DataFrame:
    """Requests with everything a row alone tells: hash, mode, candidates, type, keywords, topic, importance, vector. Empty texts go."""
    embed = embed or provider()
    df = requests.where(_said()).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    df = df.withColumn("content", x.normalize(F.col("text"))).withColumn("content_hash", F.sha2(F.lower("content"), 256)).withColumn("mode", x.input_mode(F.col("text")))
    df = df.withColumn("parse", parsed(F.col("text"), F.col("mode"))).withColumn("long", x.is_long(F.col("mode"))).withColumn("kinds", F.transform("parse.candidates", lambda c: c["candidate_type"]))
    df = df.withColumn("memory_type", F.coalesce("memory_type", m.inferred_type(F.col("kinds"), F.col("long")))).withColumn("entities", x.keywords(F.col("content"), 8))
    df = df.withColumn("topic", x.guess_topic(F.col("tags"), F.col("entities")))
    first = x.initial_importance(F.col("content"), F.col("memory_type"), F.col("tags"))
    df = df.withColumn("importance_score", m.base_importance(F.col("memory_type"), F.col("kinds"), first, F.col("long")))
    df = df.withColumn("confidence", F.greatest("parse.confidence", F.when(F.col("long"), 0.35).otherwise(0.5)))
    return df.withColumn("embedding", F.transform(embed.embed(F.col("content")), lambda v: v.cast("float"))).withColumn("relevance", m.content_relevance(F.col("content"), F.col("entities")))


def split_arrivals(prepared: DataFrame, memories: DataFrame, warm: tuple[DataFrame, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(first arrivals of new hashes, (content_hash, times, last) of all repeats). Rows of a hash are pre-aggregated, first arrivals with
    their columns, so a text that arrives very often is no hot window."""
    order = F.struct("arrival_ts", F.coalesce("session_id", F.lit("")).alias("s"), F.col("text").alias("t"))
    seen = prepared.groupBy("content_hash").agg(F.count("*").alias("n"), F.max("arrival_ts").alias("last"), F.min_by(F.struct(*prepared.columns), order).alias("first"))
    known = memories.select("content_hash").distinct().withColumn("known", F.lit(1))
    if warm is None:
        seen = seen.join(known, "content_hash", "left")
    else:  # what the filter doesn't hold is new for certain
        asked = bloom_contains(seen, "content_hash", warm[0], warm[1])
        seen = asked.where("maybe").drop("maybe").join(known, "content_hash", "left").unionByName(asked.where("not maybe").drop("maybe").withColumn("known", F.lit(None).cast("int")))
    fresh = seen.where("known is null").select("first.*")
    again = seen.select("content_hash", (F.col("n") - F.when(F.col("known").isNull(), 1).otherwise(0)).alias("times"), "last").where("times > 0")
    return fresh, again


def warm_filter(memories: DataFrame, arrivals: int = 0) -> tuple[DataFrame, int]:
    """K2: the Bloom filter of all stored hashes and the number of keys that it is made for (10,000 at least)."""
    n = max(10_000, memories.count() + arrivals)
    return bloom_build(memories, "content_hash", n), n


def ingest(requests: DataFrame, memories: DataFrame, embed: Provider | None = None, warm: tuple[DataFrame, int] | None = None) -> dict[str, DataFrame]:
    """New tables: memory_items, raw_events, memory_evidence, source_documents, source_chunks, sessions (new rows of the last five).

    A repeated text reinforces the stored row: recurrence +0.2 and access +1 each time. Provisional salience (A10, M17) is
    novelty, 1 less the largest cosine to a stored row or an earlier one of the batch, times relevance.
    `warm` (K2): a Bloom filter of the stored hashes, of warm_filter(); hashes that it doesn't hold skip the join with the store.
    """
    ready = requests.where(_said()).withColumn("content_hash", x.content_hash(F.col("text")))
    fresh, again = split_arrivals(ready, memories, warm)
    fresh = stored(prepare(fresh, embed))  # only what is new is parsed and embedded, and once
    novelty = neighbor_sums(memories.select("content_hash", "created_at", "embedding"), 2.0, "created_at", "content_hash", queries=fresh.select("content_hash", F.col("arrival_ts").alias("created_at"), "embedding"))
    fresh = fresh.join(novelty.select(F.col("id").alias("content_hash"), "best"), "content_hash", "left").withColumn("novel", m.provisional_salience(F.coalesce("best", F.lit(0.0)), F.col("relevance")))
    ident = x.new_id("mem", F.col("content_hash"))
    zero, none = F.lit(0.0), F.lit(None)
    source = F.when(F.col("long"), F.coalesce("source", "mode")).otherwise(F.col("source"))
    doc_tag = F.when(F.col("long"), F.array_union("tags", F.array(F.concat(F.lit("source_doc:"), x.new_id("src", F.col("content_hash")))))).otherwise(F.col("tags"))
    rows = fresh.select(
        ident.alias("id"), "content", none.cast("string").alias("summary"), "memory_type", source.alias("source"), "topic", "entities", doc_tag.alias("tags"), F.col("arrival_ts").alias("created_at"), F.col("arrival_ts").alias("updated_at"), none.cast("long").alias("last_accessed_at"), F.lit(0).cast("long").alias("access_count"),
        "importance_score", zero.alias("recurrence_score"), F.lit(1.0).alias("recency_score"), F.col("importance_score").alias("decay_score"), F.col("novel").alias("salience"), "confidence", F.lit(False).alias("stale"), F.lit(False).alias("pinned"), "embedding", "content_hash",
    )
    items = memories.unionByName(rows.select(*memories.columns))
    hit = F.coalesce("times", F.lit(0))
    items = items.join(again, "content_hash", "left").withColumn("recurrence_score", m.reinforced(F.col("recurrence_score"), hit)).withColumn("access_count", F.col("access_count") + hit).withColumn("last_accessed_at", F.greatest("last_accessed_at", "last")).withColumn("updated_at", F.greatest("updated_at", "last"))
    events = fresh.select(x.new_id("evt", F.col("content_hash"), F.col("arrival_ts").cast("string")).alias("id"), "session_id", "role", "content", F.col("arrival_ts").alias("created_at"), "content_hash")
    kinds = F.array(
        F.when(F.lower("text").contains("remember"), F.struct(F.lit("explicit_remember_request").alias("evidence_type"), F.lit(0.8).alias("strength"))),
        F.when(F.array_contains("kinds", "correction_signal"), F.struct(F.lit("user_correction").alias("evidence_type"), F.lit(0.9).alias("strength"))),
        F.when(F.col("parse.confidence") >= 0.45, F.struct(F.lit("topic_repeated").alias("evidence_type"), F.least("parse.confidence", F.lit(0.6)).alias("strength"))),
    )
    evidence = fresh.select(ident.alias("memory_id"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("e"), "session_id", F.col("arrival_ts").alias("created_at"))
    evidence = evidence.select(x.new_id("ev", F.col("memory_id"), F.col("e.evidence_type")).alias("id"), "memory_id", "e.evidence_type", "e.strength", F.lit("ingest").alias("source"), "session_id", "created_at")
    documents, parts = source_documents(fresh.where("long"))
    sessions = ready.where("session_id is not null").join(fresh.select("content_hash"), "content_hash", "left_semi").groupBy(F.col("session_id").alias("id")).agg(F.max(F.lit(None).cast("string")).alias("title"), F.min("arrival_ts").alias("created_at"), F.max("arrival_ts").alias("updated_at"))
    return {"memory_items": items.select(*memories.columns), "raw_events": events, "memory_evidence": evidence, "source_documents": documents, "source_chunks": parts, "sessions": sessions}


def source_documents(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (16 keywords, 5 topics, the first 40 words) and their chunks (8 keywords, 3 topics). long: text, content_hash, mode, session_id, arrival_ts."""
    ident = x.new_id("src", F.col("content_hash"))
    words = F.split(x.normalize(F.col("text")), " ")
    docs = long.select(ident.alias("id"), F.col("content_hash").alias("raw_text_hash"), F.col("mode").alias("source_type"), "session_id", F.array_join(F.slice(words, 1, 40), " ").alias("summary"), x.keywords(F.col("text"), 16).alias("entities"), x.keywords(F.col("text"), 5).alias("topics"), F.col("arrival_ts").alias("created_at"))
    each = long.select(ident.alias("source_id"), F.posexplode(x.chunks(F.col("text"), CHUNK, OVERLAP)).alias("chunk_index", "text"))
    parts = each.select(x.new_id("chk", F.col("source_id"), F.col("chunk_index").cast("string")).alias("id"), "source_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text", F.array_join(F.slice(F.split("text", " "), 1, 40), " ").alias("summary"), x.keywords(F.col("text"), 8).alias("entities"), x.keywords(F.col("text"), 3).alias("topics"))
    return docs, parts


def prior_messages(messages: DataFrame, n: int, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n user messages before each row of its conversation, oldest first."""
    # a user message carries the last n of its kind, and each row takes those of the last user message before it
    user = F.col("role") == "user"
    kind = W.partitionBy(conversation, F.coalesce(user, F.lit(False))).orderBy(turn).rowsBetween(1 - n, 0)
    before = W.partitionBy(conversation).orderBy(turn).rowsBetween(W.unboundedPreceding, -1)
    got = messages.withColumn("_said", F.when(user, F.collect_list("text").over(kind)))
    return got.withColumn("prior", F.coalesce(F.last("_said", ignorenulls=True).over(before), F.array().cast("array<string>"))).drop("_said")


def history(messages: DataFrame, turns: int, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last 2 * turns messages of each conversation."""
    over = W.partitionBy(conversation).orderBy(F.desc(turn))
    return messages.withColumn("back", F.row_number().over(over)).where(F.col("back") <= 2 * turns).drop("back")
