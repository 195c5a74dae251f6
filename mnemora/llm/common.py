"""Shared pieces of the training-data operators: scratch tables, word hashes, offsets, components."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that an executor works on at once.
BATCH_BYTES = 1_000_000

_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder if all runs
    in one process (local mode), else a folder in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        own = tempfile.mkdtemp(prefix="mnemora-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
    else:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_mnemora"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


@contextmanager
def owned(paths: list[str]) -> Iterator[None]:
    """Scratch tables made inside are listed in `paths`; their owner deletes them once nothing reads them. Others stay."""
    token = _owner.set(paths)
    try:
        yield
    finally:
        _owner.reset(token)


def delete(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _owner.get()) is not None:
        paths.append(path)
    return path


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, key: str) -> DataFrame:
    """materialize() into buckets of `key`, as many as shuffles have partitions: joins by it, of tables dealt alike, read the
    buckets and shuffle no side. The catalog, which is where Spark keeps buckets, forgets the table at once; its files are
    scratch like others. Shuffle files of the write go as soon as the driver collects what referred to them, so it does."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    entry, parts = f"mnemora_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(entry)
    got = spark.table(entry)
    got.isEmpty()  # the files are listed while the entry is there
    spark.sql(f"DROP TABLE {entry}")
    spark.sparkContext._jvm.System.gc()
    return got


def give_back() -> None:
    """Free memory of this worker's allocators goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its task's memory back to the system at its end. Workers live on and wait for other
    work, several an executor; what they leave in their allocators would count beside that of the tasks that run."""

    @wraps(f)
    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        give_back()

    return run


def records(df: DataFrame, *extra: str) -> DataFrame:
    """One struct column `rec` with all of a row, so that own columns never clash with the input's."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("rec"), *extra)


def records_beside(df: DataFrame, text: str, *extra: object) -> DataFrame:
    """`rec` with all of a row but its text, which is the column `__text` beside it: texts are kept and moved once."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text] or [F.lit(0).alias("_")]
    return df.select(F.struct(*rest).alias("rec"), *extra, F.col(f"`{text}`").alias("__text"))


def unpack(df: DataFrame, names: list[str], **own: object) -> DataFrame:
    """rec.* followed by own columns; a column of the input with an own column's name gives way."""
    return df.select(*[F.col("rec").getField(c).alias(c) for c in names if c not in own], *[F.col(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in own.items()])


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs of rows of about `limit` bytes in all; a longer row is a run of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_runs(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of about `limit` bytes of text, with the texts."""
    texts = utf8(batch.column(column))
    for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), limit):
        yield batch.slice(a, b - a), texts[a:b]


def column_runs(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `limit` bytes of text; the texts stay in their column."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(size, limit):
        yield batch.slice(a, b - a)


class WordHashes(dict):
    """Memo of 64-bit word hashes; trim() bounds it."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def trim(self, most: int = 150_000) -> None:
        if len(self) > most:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (xor-shift-multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased words `[^\\x20\\x09-\\x0D]+`: bytes.split() cuts at exactly these six bytes."""
    return text.lower().split()


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle; no words, none."""
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    acc = np.full(n, len(h) if len(h) < k else k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(k, len(h))):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(acc)


def partition_offsets(counts: DataFrame, order: list[str], n: str, name: str) -> DataFrame:
    """Adds `start`, the sum of `n` over all rows before in the given total order.

    A range sort, a sum for each partition on the driver (as many numbers as partitions) and running sums within
    partitions: no window without a partition key.
    """
    spark = counts.sparkSession
    names = counts.columns

    @tidy
    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(names.index(n)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = before + np.cumsum(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - v, pa.int64()), pa.array(np.full(len(v), part), pa.int32())], names=[*names, "start", "part"])
            before = int(ends[-1]) if len(v) else before

    schema = T.StructType([*counts.schema.fields, T.StructField("start", T.LongType()), T.StructField("part", T.IntegerType())])
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = materialize(counts.repartitionByRange(shuffles, *order).sortWithinPartitions(*order).mapInArrow(running, schema), name)
    sums = sorted(local.groupBy("part").agg(F.max(F.col("start") + F.col(n)).alias("s")).collect())
    base, total = [], 0
    for r in sums:
        base.append((r["part"], total))
        total += r["s"]
    shift = spark.createDataFrame(base, "part int, shift long")
    return local.join(F.broadcast(shift), "part").select(*names, (F.col("start") + F.col("shift")).alias("start"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): label is the smallest node of the component. edges: a, b (long); nodes without an edge are absent.

    Alternating large and small stars; each round is a written table. A node's neighbours are never gathered: sums over them
    are made before the shuffle, and joins of them to their node's minimum are plain joins, which AQE splits where a
    node (the centre of a large star) is hot.
    """
    e = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while not e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() or not e.groupBy("u").count().where("count > 1").isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = materialize(pair.select("x.*").where("u != v").distinct(), name)
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
