"""Table schemas, enums and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 9
# The enums of the data model.
MEMORY_TYPES = ("raw_event", "episodic", "semantic", "procedural", "preference", "foundation", "archive")
RELATIONS = ("supports", "contradicts", "updates", "duplicates", "derived_from", "belongs_to_project")
EDGE_TYPES = ("co_occurred", "semantic_similar", "sequence")
EVIDENCE_TYPES = ("explicit_remember_request", "user_confirmation", "user_correction", "topic_repeated", "cross_session_recurrence", "cross_day_recurrence", "retrieval_success", "retrieval_failure", "session_theme_support", "graph_cluster_support", "connected_memory_created", "llm_auditor_support")
EVIDENCE_SOURCES = ("ingest", "chat", "consolidation", "retrieval", "auditor")

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_LIST, _VECTOR = T.ArrayType(_S), T.ArrayType(T.FloatType())


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


SCHEMAS = {
    "memory_items": _struct(id=_S, content=_S, summary=_S, memory_type=_S, source=_S, topic=_S, entities=_LIST, tags=_LIST, created_at=_L, updated_at=_L, last_accessed_at=_L, access_count=_L, importance_score=_D, recurrence_score=_D, recency_score=_D, decay_score=_D, salience=_D, confidence=_D, stale=_B, pinned=_B, embedding=_VECTOR, content_hash=_S),
    "memory_links": _struct(source_id=_S, target_id=_S, relation=_S),
    "memory_edges": _struct(src_id=_S, dst_id=_S, edge_type=_S, weight=_D, co_count=_L, created_at=_L, last_activated=_L),
    "raw_events": _struct(id=_S, session_id=_S, role=_S, content=_S, created_at=_L, content_hash=_S),
    "sessions": _struct(id=_S, title=_S, created_at=_L, updated_at=_L),
    "chat_turns": _struct(id=_S, session_id=_S, created_at=_L, user_text=_S, assistant_text=_S, model=_S, backend=_S, prompt_tokens=_L, completion_tokens=_L, total_duration_ms=_L, llm_duration_ms=_L, retrieve_duration_ms=_L, context_memory_count=_L, context_chars=_L, memory_ids=_LIST),
    "consolidation_runs": _struct(id=_S, ran_at=_L, merged=_L, bursts=_L, summarized=_L, promoted=_L, stale=_L, archived=_L, deleted=_L, summaries=T.ArrayType(_struct(summary_id=_S, source_ids=_LIST))),
    "store_meta": _struct(key=_S, value=_S),
    "epochs": _struct(id=_S, ordinal=_L, started_at=_L, ended_at=_L, centroid=_VECTOR, label=_S, summary=_S, member_count=_L, drift_in=_D),
    "memory_evidence": _struct(id=_S, memory_id=_S, evidence_type=_S, strength=_D, source=_S, session_id=_S, created_at=_L),
    "source_documents": _struct(id=_S, raw_text_hash=_S, source_type=_S, session_id=_S, summary=_S, entities=_LIST, topics=_LIST, created_at=_L),
    "source_chunks": _struct(id=_S, source_id=_S, chunk_index=_L, text=_S, summary=_S, entities=_LIST, topics=_LIST),
    "session_themes": _struct(id=_S, label=_S, supporting_nodes=_LIST, confidence=_D, session_id=_S),
    "prediction_snapshots": _struct(id=_S, memory_id=_S, predicted_importance=_D, predicted_lifetime_days=_D, predicted_consolidation_probability=_D, model_version=_S, created_at=_L),
    "outcome_snapshots": _struct(id=_S, memory_id=_S, actual_importance=_D, evidence_count=_L, survived_days=_L, correction_count=_L, created_at=_L),
}
KEYS = {"memory_items": ["content_hash"], "memory_links": ["source_id", "target_id", "relation"], "source_documents": ["raw_text_hash"], "source_chunks": ["source_id", "chunk_index"]}
_ENUMS = {"memory_items": {"memory_type": MEMORY_TYPES}, "memory_links": {"relation": RELATIONS}, "memory_edges": {"edge_type": EDGE_TYPES}, "memory_evidence": {"evidence_type": EVIDENCE_TYPES}}
_DEFAULTS = {"importance_score": 0.5, "recurrence_score": 0.0, "recency_score": 1.0, "decay_score": 0.5, "salience": 0.0, "confidence": 1.0, "access_count": 0, "stale": False, "pinned": False}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def one_of(column: str, values: tuple[str, ...]) -> object:
    """The column itself; the query fails on a value outside the enum (null passes)."""
    return F.when(F.col(column).isNull() | F.col(column).isin(*values), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.col(column)))).alias(column)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Rows of any older layout in the table's schema: missing columns get defaults, types are cast, enums checked, lists are never null."""
    out = []
    for f in SCHEMAS[name].fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(_DEFAULTS.get(f.name)).cast(f.dataType)
        if f.name in _ENUMS.get(name, {}) and f.name in df.columns:
            c = one_of(f.name, _ENUMS[name][f.name])
        elif f.dataType == _LIST:
            c = F.coalesce(c, F.array().cast(_LIST))
        elif f.name in _DEFAULTS:
            c = F.coalesce(c, F.lit(_DEFAULTS[f.name]).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)
