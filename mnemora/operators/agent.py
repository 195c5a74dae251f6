"""Turns of a conversation (R4, I6), context packs and reports as JSON (N8), and what a user does to single memories."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import text as x
from mnemora.functions.vector import Provider
from mnemora.operators import retrieve as rt
from mnemora.operators.ingest import chat_request, ingest
from mnemora.operators.similarity import cut_lineage
from mnemora.plans.config import Config
from mnemora.sources.schemas import conform
from mnemora.sources.store import bump_cooccurrence, clear_supersession, insert_ignore, set_column


@dataclass(frozen=True)
class Prepared:
    """What a turn sends and what it was made from. pack: the rows of one retrieval, at most top_k and injected ones."""

    text: str
    query: str
    messages: list[tuple[str, str]]
    pack: DataFrame
    ids: list[str]
    context_chars: int


def prepare_turn(memories: DataFrame, edges: DataFrame, epochs: DataFrame, system: str, history: list[tuple[str, str]], prior: list[str], text: str, now: int, c: Config = Config(), session: str | None = None, embed: Provider | None = None) -> Prepared:
    """Earlier user messages are folded into the query alone; memories go before the new message, so that all before
    it stays as it was sent the last time. The session's own rows aren't retrieved."""
    spark = memories.sparkSession
    query = rt.contextual_query(prior, text, c.chat.context_turns)
    vector, tokens = rt.query_columns(spark, query, embed)
    o = rt.Options(top_k=c.chat.top_k, min_score=c.chat.gate, exclude_session=session, damping=c.chat.damping)
    pack = cut_lineage(rt.retrieve(memories, edges, epochs, vector, tokens, now, c, o))
    rows = pack.orderBy(F.desc("total"), "created_at", "id").select("id", "memory_type", "content").collect()
    shown = spark.createDataFrame([([(r["memory_type"], r["content"]) for r in rows], text)], "m array<struct<memory_type:string,text:string>>, t string")
    message = shown.select(x.wrap_message(F.col("t"), x.context_block(F.col("m"))).alias("w")).first()["w"]
    return Prepared(text, query, [("system", system), *history, ("user", message)], pack, [r["id"] for r in rows], sum(len(r["content"]) for r in rows))


def chat_turn(spark: SparkSession, session: str, p: Prepared, reply: str, usage: dict[str, int], backend: str, model: str, now: int, retrieve_ms: int = 0) -> DataFrame:
    """The metrics row of a completed turn."""
    row = {"session_id": session, "created_at": now, "user_text": p.text, "assistant_text": reply, "model": model, "backend": backend, "retrieve_duration_ms": retrieve_ms, "context_memory_count": len(p.ids), "context_chars": p.context_chars, **usage}
    made = spark.range(1).select(x.new_id("turn", F.lit(session), F.lit(p.text), F.lit(str(now))).alias("id"), *[F.lit(v).alias(k) for k, v in row.items()], F.array(*[F.lit(i) for i in p.ids]).cast("array<string>").alias("memory_ids"))
    return conform(made, "chat_turns")


def finish_turn(tables: dict[str, DataFrame], session: str, p: Prepared, reply: str, usage: dict[str, int], backend: str, model: str, now: int, embed: Provider | None = None) -> dict[str, DataFrame]:
    """Both messages are ingested (an empty reply isn't), the turn is recorded, and memories used together are bumped."""
    spark = tables["memory_items"].sparkSession
    said = spark.createDataFrame([("user", p.text, now), ("assistant", reply, now + 1)], "role string, said string, at long").where("trim(said) <> ''")
    requests = said.select(*chat_request(session, F.col("said"), F.col("role"), F.col("at")))
    new = ingest(requests, tables["memory_items"], embed)
    turn = chat_turn(spark, session, p, reply, usage, backend, model, now)
    out = dict(tables) | {"memory_items": new["memory_items"], "chat_turns": tables["chat_turns"].unionByName(turn)}
    for name in ("raw_events", "memory_evidence"):
        out[name] = insert_ignore(tables[name], conform(new[name], name), ["id"])
    if len(p.ids) >= 2:
        out["memory_edges"] = bump_cooccurrence(tables["memory_edges"], turn)
    return out


def pack_json(pack: DataFrame, query: str, now: int, min_score: float = 0.0, near_misses: DataFrame | None = None) -> DataFrame:
    """One row `json` of a context pack. pack and near_misses hold the few rows of one retrieval; empty parts are left out."""
    rows = lambda df: df.agg(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("o"), F.struct("id", "content", "memory_type", "topic", "created_at", "relevance", "score").alias("m")))).getField("m").alias("m"))
    got = rows(pack).withColumnRenamed("m", "memories")
    parts = [F.lit(query).alias("query"), F.lit(now).cast("long").alias("generated_at"), "memories", F.lit(float(min_score)).alias("min_score")]
    if near_misses is not None:
        got = got.join(F.broadcast(rows(near_misses).select(F.when(F.size("m") > 0, F.col("m")).alias("near_misses"))))  # one row by one row
        parts.append("near_misses")
    return got.select(F.to_json(F.struct(*parts)).alias("json"))


def report_json(run: DataFrame) -> DataFrame:
    """A row `json` of each consolidation run."""
    return run.select(F.to_json(F.struct("*")).alias("json"))


def pin(memories: DataFrame, ids: list[str], now: int, on: bool = True) -> DataFrame:
    return set_column(set_column(memories, ids, "pinned", on), ids, "updated_at", now)


def archive(memories: DataFrame, ids: list[str], now: int) -> DataFrame:
    """Archived by hand, whatever the type; a pin goes."""
    out = memories
    for column, value in (("memory_type", "archive"), ("pinned", False), ("updated_at", now)):
        out = set_column(out, ids, column, value)
    return out


def revive_one(memories: DataFrame, links: DataFrame, memory: str, now: int) -> tuple[DataFrame, DataFrame]:
    """A stale memory is fresh again and loses the links that superseded it."""
    return set_column(set_column(memories, [memory], "stale", False), [memory], "updated_at", now), clear_supersession(links, memory)


def inspect(memories: DataFrame, links: DataFrame, evidence: DataFrame, edges: DataFrame, memory: str) -> DataFrame:
    """One row `json`: a memory with its links, evidence and edges (of one memory, so they are few)."""
    own = memories.where(F.col("id") == memory).drop("embedding").select(F.struct("*").alias("memory"))
    every = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    for name, df in (("links", links.where((F.col("source_id") == memory) | (F.col("target_id") == memory))), ("evidence", evidence.where(F.col("memory_id") == memory)), ("edges", edges.where((F.col("src_id") == memory) | (F.col("dst_id") == memory)))):
        own = own.join(F.broadcast(every(df, name)))
    return own.select(F.to_json(F.struct("memory", "links", "evidence", "edges")).alias("json"))


def config_view(c: Config) -> dict[str, Any]:
    """All settings with their values, by dotted names."""

    def flat(values: dict[str, Any], at: str) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for k, v in values.items():
            out |= flat(v, f"{at}{k}.") if isinstance(v, dict) else {f"{at}{k}": v}
        return out

    return flat(asdict(c), "")
