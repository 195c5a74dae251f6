"""Packing along a space-filling curve.

Each document's ids are hashed into a vector (square roots of counts, random signs for `dims` directions), squashed to
integers and numbered along a Hilbert curve, so that documents with similar vocabulary are neighbours. Documents are
range-sorted by (curve key, doc_id, row) and laid end to end; sequences are the cuts of that one line at each `length`
ids. Only the last sequence can be short, so padding is less than one sequence in all, and no bin search is needed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.llm.common import column_runs, materialize, mix64, partition_offsets, records, table, tidy
from mnemora.llm.tokens import RUN_BYTES, ChunkIds, default_path, vocabulary

LENGTH, END, DIMS, BITS = 4096, 2, 4, 8


def hilbert_key(axes: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points [n, dims] below 2 ** bits, by Skilling's transform (2004)."""
    x = axes.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(len(x)):
            inside = (x[i] & bit) != 0
            swap = np.where(inside, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << one) | ((axis >> np.uint64(b)) & one)
    return key


def signs(vocab: int, dims: int) -> np.ndarray:
    """A fixed matrix of +1 and -1, from a hash of each cell's number."""
    return np.where(mix64(np.arange(1, vocab * dims + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63), 1, -1).astype(np.float32).reshape(vocab, dims)


def curve_key(ids: list[np.ndarray], matrix: np.ndarray, bits: int) -> np.ndarray:
    point = np.empty((len(ids), matrix.shape[1]))
    for i, a in enumerate(ids):
        u, c = np.unique(a, return_counts=True)
        point[i] = np.sqrt(c) @ matrix[u] / np.sqrt(len(a))
    top = (1 << bits) - 1
    return hilbert_key(np.minimum((1 << bits) / (1 + np.exp(-1.702 * point)), top).astype(np.int64), bits)


def tokenize(df: DataFrame, text: str, path: str, end: int) -> DataFrame:
    """rec (without the text), row, n (ids), key (on the curve), ids (zstd of little-endian ids), written to the shared folder."""
    base = records(df, F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("__text"))
    base = base.select(F.struct(*[F.col("rec").getField(c).alias(c) for c in df.columns if c != text]).alias("rec"), "row", "__text")
    vocab = vocabulary(path)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, matrix, pack = ChunkIds(path, end), signs(vocab, DIMS), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in column_runs(batch, "__text", RUN_BYTES):
                flat, n = memo.encode_column(part.column("__text"))
                arrays = np.split(flat, np.cumsum(n)[:-1])
                key = curve_key(arrays, matrix, BITS).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("rec"), part.column("row"), pa.array(n), pa.array(key), pa.array([pack.compress(x.data) for x in arrays], pa.binary())], names=["rec", "row", "n", "key", "ids"])

    schema = T.StructType([base.schema["rec"], *[T.StructField(c, T.LongType()) for c in ("row", "n", "key")], T.StructField("ids", T.BinaryType())])
    return materialize(base.mapInArrow(run, schema), "tokens", "none")


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary, uint32).

    Null and empty texts are the end id alone. Equal keys are ordered by doc_id (null first), then by row; repeated
    rows are packed as often as they occur. A text longer than a sequence goes on in the next ones. An empty table gives
    no rows. Other columns of the input aren't used, whatever their names.
    """
    path = path or default_path()
    keep = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    tokens = tokenize(keep, "text", path, end).select(F.col("rec.doc_id").alias("doc_id"), "row", "n", "key", "ids")
    starts = partition_offsets(tokens.select("key", "doc_id", "row", "n"), ["key", "doc_id", "row"], "n", "pack-starts")
    joined = tokens.select("row", "doc_id", "ids").join(starts.select("row", F.col("start").alias("at")), "row")
    wide = np.dtype("<u2" if vocabulary(path) <= 1 << 16 else "<u4")

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, packed, at in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("at").to_pylist(), strict=True):
                ids = np.frombuffer(unpack.decompress(packed), wide).astype("<u4")
                a = 0
                while a < len(ids):
                    b = min(len(ids), a + length - (at + a) % length)
                    raw = ids[a:b].tobytes()
                    rows.append((doc, a, b - a, zlib.crc32(raw), len(ids), (at + a) // length, (at + a) % length, raw))
                    size += len(raw)
                    a = b
                if size > 4_000_000:
                    yield _pieces(rows)
                    rows, size = [], 0
            yield _pieces(rows)

    return joined.select("doc_id", "ids", "at").mapInArrow(cut, T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], T.StructField("ids", T.BinaryType())]))


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], None if any(x is not None for x in cols[0]) else pa.int64()), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(cols[7], pa.binary())], names=names)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` packed into sequences of 4096 ids: a row for each piece."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")
