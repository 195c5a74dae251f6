"""The memory store over Parquet: reads, and writes as functions from tables to tables.

Tables are immutable DataFrames; a write returns the new table, and `Store.save` publishes it as a new version, so
readers never see half a write. Touches, events, turns and runs are appended.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.sources.schemas import KEYS, SCHEMAS, VERSION, conform, empty

_SUPERSEDES = ("updates", "contradicts")


class Store:
    """Named tables under a root path of any file system that Spark writes to; `pointer` rows name each table's current version."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> list[str]:
        """Finished writes: the last whole version (v...) and what was appended to it since (a...), in order."""
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        done = sorted((s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and fs.exists(self._fs(f"{self.root}/{name}/{s.getPath().getName()}/_SUCCESS")[1])), key=lambda n: (n[1:9], n[0] == "a", n))
        whole = max((i for i, n in enumerate(done) if n[0] == "v"), default=0)
        return done[whole:]

    def _next(self, name: str, kind: str) -> str:
        """A path of its own for each writer: two that take one number don't overwrite each other."""
        n = max((int(v[1:9]) for v in self._versions(name)), default=0) + 1
        return f"{self.root}/{name}/{kind}{n:08d}-{uuid.uuid4().hex[:8]}"

    def read(self, name: str) -> DataFrame:
        """The current rows in today's schema; an empty table if there are none."""
        parts = [conform(self.spark.read.parquet(f"{self.root}/{name}/{v}"), name) for v in self._versions(name)]
        return reduce(DataFrame.unionByName, parts) if parts else empty(self.spark, name)

    def save(self, name: str, df: DataFrame) -> None:
        """Publish a whole new version; the marker file of the finished write makes it current. memory_items and memory_edges are partitioned by type."""
        w = conform(df, name).write
        part = {"memory_items": "memory_type", "memory_edges": "edge_type"}.get(name)
        (w.partitionBy(part) if part else w).parquet(self._next(name, "v"))

    def append(self, name: str, rows: DataFrame) -> None:
        """S14 and the like: new rows are written beside the old ones, which aren't read again but for their keys where the table has some."""
        fresh = conform(rows, name)
        if name in KEYS:
            fresh = fresh.dropDuplicates(KEYS[name]).join(self.read(name).select(*KEYS[name]), KEYS[name], "left_anti").select(*fresh.columns)
        fresh.write.parquet(self._next(name, "a"))

    def compact(self, name: str) -> None:
        """One whole version of what was appended; older ones are deleted (readers that began before may still hold them)."""
        old = self._versions(name)
        if len(old) > 1:
            self.save(name, self.read(name))
            for v in old:
                fs, p = self._fs(f"{self.root}/{name}/{v}")
                fs.delete(p, True)

    def replace_epochs(self, epochs: DataFrame) -> None:
        """The eras of a run replace all earlier ones at once."""
        self.save("epochs", epochs)

    def list_epochs(self) -> DataFrame:
        return self.read("epochs").orderBy("ordinal")

    def insert_chat_turn(self, turn: DataFrame) -> None:
        self.append("chat_turns", turn)

    def migrate(self) -> list[str]:
        """Tables of an older layout are written anew in today's schema; gives their names. A second call finds none."""
        moved = []
        for name, schema in SCHEMAS.items():
            versions = self._versions(name)
            if any(set(self.spark.read.parquet(f"{self.root}/{name}/{v}").columns) != set(schema.fieldNames()) for v in versions):
                self.save(name, self.read(name))
                moved.append(name)
        if self.spark.createDataFrame([("schema_version", str(VERSION))], SCHEMAS["store_meta"]).exceptAll(self.read("store_meta")).count():
            self.save("store_meta", self.read("store_meta").where("key <> 'schema_version'").unionByName(self.spark.createDataFrame([("schema_version", str(VERSION))], SCHEMAS["store_meta"])))
        return moved

    def data_version(self, name: str) -> str | None:
        """Changes whenever a table does."""
        return (self._versions(name) or [None])[-1]

    def schema_version(self) -> int:
        return VERSION


def open_in_memory(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: empty(spark, name) for name in SCHEMAS}


# reads


def list_memories(memories: DataFrame, memory_type: str | None = None) -> DataFrame:
    return (memories if memory_type is None else memories.where(F.col("memory_type") == memory_type)).orderBy("created_at", "id")


def get(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) == value).limit(1)


def all_hashes(memories: DataFrame) -> DataFrame:
    return memories.select("content_hash")


def links_for(links: DataFrame, node: str) -> DataFrame:
    return links.where((F.col("source_id") == node) | (F.col("target_id") == node))


def events_older_than(events: DataFrame, cutoff: int) -> DataFrame:
    return events.where(F.col("created_at") < cutoff).orderBy("created_at", "id")


def recent(df: DataFrame, limit: int | None, time: str = "created_at") -> DataFrame:
    """The newest rows, oldest of them first; None: all."""
    newest = df.orderBy(F.desc(time), F.desc("id"))
    return (newest if limit is None else newest.limit(limit)).orderBy(time, "id")


def newest_first(df: DataFrame, limit: int, time: str = "ran_at") -> DataFrame:
    return df.orderBy(F.desc(time), F.desc("id")).limit(limit)


def neighbors(edges: DataFrame, node: str, edge_type: str) -> DataFrame:
    own = edges.where((F.col("edge_type") == edge_type) & ((F.col("src_id") == node) | (F.col("dst_id") == node)))
    return own.select(F.when(F.col("src_id") == node, F.col("dst_id")).otherwise(F.col("src_id")).alias("id"), "weight")


def evidence_for(evidence: DataFrame, memory: str) -> DataFrame:
    return evidence.where(F.col("memory_id") == memory).orderBy("created_at", "id")


def source_chunks(chunks: DataFrame, source: str) -> DataFrame:
    return chunks.where(F.col("source_id") == source).orderBy("chunk_index")


def epoch_starts(epochs: DataFrame) -> DataFrame:
    return epochs.select("started_at").orderBy("started_at")


# writes


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and rows of new whose keys aren't there yet (one of each)."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Whole-row update: rows of new replace those of old with their key."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def set_column(df: DataFrame, ids: list[str], column: str, value: object) -> DataFrame:
    """pin, stale, type and the like, for given ids."""
    return df.withColumn(column, F.when(F.col("id").isin(ids), F.lit(value).cast(df.schema[column].dataType)).otherwise(F.col(column)))


def set_embedding(df: DataFrame, vectors: DataFrame) -> DataFrame:
    new = vectors.select("id", F.col("embedding").alias("new"))
    return df.join(new, "id", "left").withColumn("embedding", F.coalesce("new", "embedding")).select(*df.columns)


def apply_touches(memories: DataFrame, touches: DataFrame) -> DataFrame:
    """touches: an append-only log of (id, at). Counts are added, the latest time stays."""
    seen = touches.groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    got = memories.join(seen, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("n", F.lit(0))).withColumn("last_accessed_at", F.greatest("last_accessed_at", "at"))
    return got.select(*memories.columns)


def cascade_delete(memories: DataFrame, links: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of `gone` (id) leave the memories, and links and edges at either end."""

    def without(df: DataFrame, *ends: str) -> DataFrame:
        for e in ends:
            df = df.join(gone.select(F.col("id").alias(e)), e, "left_anti")
        return df

    return without(memories, "id").select(*memories.columns), without(links, "source_id", "target_id").select(*links.columns), without(edges, "src_id", "dst_id").select(*edges.columns)


def clear_supersession(links: DataFrame, target: str) -> DataFrame:
    return links.where(~((F.col("target_id") == target) & F.col("relation").isin(*_SUPERSEDES)))


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The earliest creation, the latest update, and the latest title that isn't null."""
    every = old.unionByName(new.select(*old.columns))
    return every.groupBy("id").agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.col("updated_at"))).alias("title"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def upsert_meta(log: DataFrame) -> DataFrame:
    """The latest value of each key of a log (key, value, at)."""
    return log.groupBy("key").agg(F.max_by("value", "at").alias("value"))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest weight and count of each edge; its first creation stays."""
    every = old.unionByName(new.select(*old.columns))
    order = F.struct("last_activated", "co_count", "weight")
    return every.groupBy("src_id", "dst_id", "edge_type").agg(F.max_by("weight", order).alias("weight"), F.max_by("co_count", order).alias("co_count"), F.min("created_at").alias("created_at"), F.max("last_activated").alias("last_activated"))


def replace_edges(old: DataFrame, new: DataFrame, edge_type: str) -> DataFrame:
    return old.where(F.col("edge_type") != edge_type).unionByName(new.select(*old.columns))


def id_pairs(ids: Column) -> Column:
    """All pairs (a, b), a < b, of an array of ids. For arrays of bounded size (the memories of one turn)."""
    distinct = F.array_sort(F.array_distinct(ids))
    return F.flatten(F.transform(distinct, lambda a: F.transform(F.filter(distinct, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def bump_cooccurrence(edges: DataFrame, turns: DataFrame, ids: str = "memory_ids", at: str = "created_at") -> DataFrame:
    """Each turn adds 1 to weight and count of each pair of its distinct memories."""
    pairs = turns.select(F.explode(id_pairs(F.col(ids))).alias("p"), F.col(at).alias("at")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    new = pairs.select(F.col("a").alias("src_id"), F.col("b").alias("dst_id"), F.lit("co_occurred").alias("edge_type"), F.col("n").cast("double").alias("weight"), F.col("n").alias("co_count"), F.col("first").alias("created_at"), F.col("last").alias("last_activated"))
    both = edges.unionByName(new)
    return both.groupBy("src_id", "dst_id", "edge_type").agg(F.sum("weight").alias("weight"), F.sum("co_count").alias("co_count"), F.min("created_at").alias("created_at"), F.max("last_activated").alias("last_activated"))


def empty_like(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], T.StructType(df.schema.fields))
