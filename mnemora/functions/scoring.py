"""Scores as column expressions (M1-M19). `now` is always given, in unix seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora.plans.config import LAMBDA, Neighbors, Weights

# Weights of evidence, bases of the importance revision and of ingest.
EVIDENCE_WEIGHT = {"explicit_remember_request": 0.30, "user_confirmation": 0.25, "retrieval_success": 0.25, "cross_session_recurrence": 0.20, "cross_day_recurrence": 0.20, "session_theme_support": 0.10, "graph_cluster_support": 0.10}
REVISION_BASE = {"foundation": 0.70, "preference": 0.35, "semantic": 0.30, "procedural": 0.30, "episodic": 0.20, "raw_event": 0.10, "archive": 0.05}
INGEST_FLOOR = {"foundation": 0.70, "preference": 0.30, "semantic": 0.20, "procedural": 0.30, "episodic": 0.20, "raw_event": 0.10, "archive": 0.05}
CANDIDATE_BASE = {"identity_candidate": 0.70, "goal_candidate": 0.60, "preference_strong": 0.50, "preference_weak": 0.30, "episodic_candidate": 0.20, "correction_signal": 0.45}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def pick(key: Column, values: dict[str, float], otherwise: float) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def age_days(created_at: Column, now: int) -> Column:
    return F.greatest(F.lit(now) - created_at, F.lit(0)) / F.lit(86_400.0)


def decay_rate(memory_type: Column, rates: dict[str, float] = LAMBDA) -> Column:
    return pick(memory_type, rates, 0.0)


def decay_score(importance: Column, rate: Column, days: Column, pinned: Column) -> Column:
    return F.when(pinned, importance).otherwise(importance * F.exp(-rate * days))


def decay_resisted(importance: Column, rate: Column, days: Column, pinned: Column, salience: Column, resist: float) -> Column:
    return decay_score(importance, rate * (1 - min(1.0, max(0.0, resist)) * clamp(salience)), days, pinned)


def recency_score(days: Column) -> Column:
    return F.exp(-0.1 * days)


def candidate_relevance(cosine: Column, keyword: Column, entity: Column) -> Column:
    return clamp(0.7 * F.greatest(cosine, F.lit(0.0)) + 0.2 * keyword + 0.1 * entity)


def retrieval_score(relevance: Column, importance: Column, recurrence: Column, recency: Column, graph: Column, pinned: Column, stale: Column, w: Weights = Weights()) -> Column:
    """A struct of the score's parts and their total."""
    parts = {"relevance": w.relevance * relevance, "importance": w.importance * importance, "recurrence": w.recurrence * recurrence, "recency": w.recency * recency, "graph": w.graph * graph, "pin": F.when(pinned, w.pin).otherwise(0.0), "stale": F.when(stale, -w.stale).otherwise(0.0)}
    total = F.lit(0.0)
    for v in parts.values():
        total = total + v
    return F.struct(*[v.alias(k) for k, v in parts.items()], total.alias("total"))


def association_only(boost: Column) -> Column:
    """The score of a row that association alone brought in."""
    return F.struct(*[F.lit(0.0).alias(k) for k in ("relevance", "importance", "recurrence", "recency", "graph", "pin", "stale")], boost.alias("total"))


def association_boost(activation: Column, factor: float) -> Column:
    return F.least(factor * activation, F.lit(factor))


def damped(total: Column, conversational: Column, damping: float) -> Column:
    return F.when(conversational & F.lit(damping < 1), total * damping).otherwise(total)


def content_relevance(content: Column, entities: Column) -> Column:
    long, named = F.char_length(content) >= 16, F.size(entities) > 0
    return F.when(long & named, 1.0).when(long, 0.7).when(named, 0.4).otherwise(0.1)


def neighbor_class(best: Column, count: Column, density: Column, spread: Column, p: Neighbors = Neighbors()) -> Column:
    return F.when(best < p.surprise_max, "surprise").when((count >= 2) & (spread <= p.tight), "burst").when((count >= 2) & (spread >= p.wide) & (density >= p.habit_density), "habit").otherwise("ordinary")


def salience(best: Column, density: Column, spread: Column, relevance: Column) -> Column:
    return clamp(F.greatest(clamp(1 - best), density * spread) * clamp(relevance))


def provisional_salience(best: Column, relevance: Column) -> Column:
    """Novelty at ingest, weighted by content."""
    return clamp(clamp(1 - best) * clamp(relevance))


def recurrence_blend(raw: Column, sessions: Column, days: Column, contexts: Column, reuse: Column) -> Column:
    return F.least(F.lit(1.0), 0.10 * F.log1p(raw) + 0.25 * F.log1p(sessions) + 0.35 * F.log1p(days) + 0.20 * F.least(contexts / 8, F.lit(1.0)) + 0.10 * F.log1p(reuse))


def revised_importance(memory_type: Column, evidence: Column, graph: Column, recurrence: Column, decay: Column, corrections: Column) -> Column:
    return clamp(pick(memory_type, REVISION_BASE, 0.05) + evidence + 0.15 * graph + 0.20 * recurrence - 0.25 * (1 - clamp(decay)) - 0.40 * corrections, 0.05)


def base_importance(memory_type: Column, candidate_types: Column, initial: Column, long: Column) -> Column:
    """Importance at ingest: 0.10 for long inputs, else the largest of initial (to 0.65), candidates' and type's floors."""
    best = F.coalesce(F.array_max(F.transform(candidate_types, lambda c: pick(c, CANDIDATE_BASE, 0.10))), F.lit(0.0))
    return F.when(long, 0.10).otherwise(clamp(F.greatest(F.least(initial, F.lit(0.65)), best, pick(memory_type, INGEST_FLOOR, 0.05)), 0.05))


def inferred_type(candidate_types: Column, long: Column) -> Column:
    kinds = F.filter(candidate_types, lambda c: c.isin("preference_strong", "preference_weak", "goal_candidate", "identity_candidate", "project_fact_candidate"))
    first = F.try_element_at(kinds, F.lit(1))
    return F.when(long, "raw_event").when(first.startswith("preference"), "preference").when(first.isNotNull(), "semantic").otherwise("episodic")


def reinforced(recurrence: Column, times: Column) -> Column:
    return F.least(F.lit(1.0), recurrence + 0.2 * times)


def context_share(chars: Column, prompt_tokens: Column) -> Column:
    """Percent of a prompt that injected context makes up; null without a prompt."""
    return F.least(F.lit(100.0), F.try_divide(chars / 4.0, prompt_tokens) * 100)
