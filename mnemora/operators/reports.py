"""Fixed reports: store statistics, chat metrics, conflicts, graph view, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.scoring import age_days, decay_rate, decay_resisted, decay_score
from mnemora.sources.schemas import MEMORY_TYPES


def chat_metrics(turns: DataFrame) -> DataFrame:
    """One row: counts, averages (null without values), sums (0 without) and what follows from them."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}")
    means = [F.avg(c).alias(f"avg_{c}") for c in ("prompt_tokens", "completion_tokens", "total_duration_ms", "llm_duration_ms", "retrieve_duration_ms", "context_memory_count")]
    got = turns.agg(F.count("*").alias("turns"), *means, *[total(c) for c in ("prompt_tokens", "completion_tokens", "context_chars", "context_memory_count")])
    injected = F.col("sum_context_chars") / F.lit(4.0)
    return got.select("*", injected.alias("injected_tokens"), F.try_divide(injected, F.col("turns")).alias("injected_per_turn"), F.try_divide(injected, F.col("sum_prompt_tokens")).alias("injected_share"), F.try_divide(injected, F.col("sum_context_memory_count")).alias("tokens_per_memory"))


def type_counts(memories: DataFrame) -> DataFrame:
    """(memory_type, n) for all seven types, zeros kept."""
    types = memories.sparkSession.createDataFrame([(t,) for t in MEMORY_TYPES], "memory_type string")
    return types.join(memories.groupBy("memory_type").agg(F.count("*").alias("n")), "memory_type", "left").select("memory_type", F.coalesce("n", F.lit(0)).alias("n"))


def store_stats(memories: DataFrame, raw: DataFrame, links: DataFrame, sessions: DataFrame, epochs: DataFrame) -> DataFrame:
    own = memories.agg(F.count("*").alias("total"), F.count_if("stale").alias("stale"), F.count_if("pinned").alias("pinned"))
    for name, df in (("raw_events", raw), ("links", links), ("sessions", sessions), ("epochs", epochs)):
        own = own.join(F.broadcast(df.agg(F.count("*").alias(name))))  # one row by one row
    return own


def conflicts(links: DataFrame, memories: DataFrame) -> DataFrame:
    """Supersessions in force: (winner_id, loser_id, relation, winner, loser), the loser stale."""
    named = links.where(F.col("relation").isin("updates", "contradicts")).select(F.col("source_id").alias("winner_id"), F.col("target_id").alias("loser_id"), "relation")
    winner = memories.select(F.col("id").alias("winner_id"), F.col("content").alias("winner"))
    loser = memories.where("stale").select(F.col("id").alias("loser_id"), F.col("content").alias("loser"))
    return named.join(loser, "loser_id").join(winner, "winner_id").select("winner_id", "loser_id", "relation", "winner", "loser")


def live_decay(now: int, resist: float = 0.7) -> Column:
    return decay_resisted(F.col("importance_score"), decay_rate(F.col("memory_type")), age_days(F.col("created_at"), now), F.col("pinned"), F.col("salience"), resist)


def graph_nodes(memories: DataFrame, now: int, since: int | None = None, until: int | None = None, types: list[str] | None = None, limit: int = 500, resist: float = 0.7) -> DataFrame:
    """Nodes of the window (the last 30 days), the least faded first, up to `limit` (500 at most), with the count before the limit."""
    low, high = now - 30 * 86_400 if since is None else since, now if until is None else until
    some = memories.where(F.col("created_at").between(low, high))
    some = some.where(F.col("memory_type").isin(types)) if types else some
    total = some.agg(F.count("*").alias("total_count"))
    shown = some.select("id", F.substring("content", 1, 120).alias("preview"), "memory_type", "topic", "tags", "created_at", "pinned", "stale", live_decay(now, resist).alias("decay"))
    return shown.orderBy(F.desc("decay"), "created_at", "id").limit(min(500, limit)).join(F.broadcast(total))


def graph_edges(nodes: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """Links (weight 1) and edges between kept nodes."""
    every = links.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("relation").alias("kind"), F.lit(1.0).alias("weight")).unionByName(edges.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.col("edge_type").alias("kind"), "weight"))
    return every.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "kind", "weight")


def visible(nodes: DataFrame, edges: DataFrame, at: int, types: list[str] | None = None, tag: str = "", isolated: bool = True, min_decay: float = 0.0) -> DataFrame:
    """What a viewer shows at time `at`: born, of a type, with a tag that holds a text, not isolated, not faded."""
    got = nodes.where(F.col("created_at") <= at)
    got = got.where(F.col("memory_type").isin(types)) if types else got
    got = got.where(F.exists("tags", lambda t: F.lower(t).contains(tag.lower()))) if tag else got
    if not isolated:
        got = got.join(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")
    faded = decay_score(F.col("importance_score"), decay_rate(F.col("memory_type")), age_days(F.col("created_at"), at), F.col("pinned"))
    return got.where(faded >= min_decay)


def decay_histogram(memories: DataFrame, now: int, bins: int = 10) -> DataFrame:
    """(bin, n): counts of live decay in equal bins, the last one closed."""
    return memories.groupBy(F.least(F.lit(bins - 1), F.floor(live_decay(now) * bins)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def compression(runs: DataFrame) -> DataFrame:
    """(id, summaries, sources): how many memories each run's summaries stand for."""
    return runs.select("id", F.size("summaries").cast("long").alias("summaries"), F.aggregate("summaries", F.lit(0).cast("long"), lambda s, x: s + F.size(x["source_ids"])).alias("sources"))
