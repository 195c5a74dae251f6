"""Training-order materialisation of token sequences.

A document's ids are cut into sequences of `length`; sequences are numbered 0..N-1 in the order of the table (partitions
and rows as they are read). A keyed Feistel network over the least even number of bits that holds N, with cycle-walking,
is a bijection of 0..N-1, so every sequence has a global slot and no slot is empty; the order needs no sort and no
state but the key. Tasks take ranges of slots: as slots are evenly used, the bounds are known beforehand, and blocks go
straight to the task of their range. Each shard is sorted by slot and written as one file of fixed-stride records:
slot s is at (s mod records) * stride of shard s // records, so a reader can begin or go on at any slot by one seek.
Record: doc_id (int64; the least value for null), chunk and count of ids (uint32 each), then the ids, zero-padded.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.common import column_runs, materialize, mix64, new_path, table
from mnemora.llm.tokens import RUN_BYTES, ChunkIds, default_path, vocabulary
from mnemora.llm.warc import open_store

LENGTH, RECORDS, KEY, END, ROUNDS = 256, 4096, 20_240_101, 2, 6
_NULL = np.iinfo(np.int64).min
_MANIFEST = "shard long, path string, records long, bytes long"


def feistel(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slot of each index of 0..n-1: a bijection that depends on the key."""
    half = np.uint64(max(1, ((max(n - 1, 1)).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & mask)
        x = left << half | right
        out[todo] = x
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def record_type(length: int, wide: np.dtype) -> np.dtype:
    return np.dtype([("doc", "<i8"), ("chunk", "<u4"), ("count", "<u4"), ("ids", wide, (length,))])


def write_shards(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, records: int = RECORDS, key: int = KEY, end: int = END) -> DataFrame:
    """The manifest, one row a shard: shard, path, records, bytes. doc_id: a whole number. Written once.

    Null and empty texts are the end id alone; texts of any length are cut into as many sequences as they need. Repeated
    rows are sequences of their own. An empty table has no shards. The least 64-bit number as an id reads back as null,
    for which it stands. Other columns of the input aren't used.
    Blocks of sequences for one shard travel together, compressed; a task writes a shard under a name of its own, so a task that is run
    again leaves an orphan at worst.
    """
    spark = df.sparkSession
    path = path or default_path()
    wide = np.dtype("<u2" if vocabulary(path) <= 1 << 16 else "<u4")
    rec = record_type(length, wide)
    base = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, memo, pack = TaskContext.get().partitionId(), 0, ChunkIds(path, end), zstandard.ZstdCompressor(level=5)
        for b in batches:
            for run in column_runs(b, "text", RUN_BYTES):
                ids, size = memo.encode_column(run.column("text"))
                n = -(-size // length)
                doc = run.column("doc").fill_null(_NULL).to_numpy().astype("<i8")
                # one row for a run of documents: heads and ids, compressed together
                body = pack.compress(struct.pack("<q", len(size)) + doc.tobytes() + size.astype("<i8").tobytes() + ids.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at]), pa.array([int(n.sum())]), pa.array([body], pa.binary())], names=["part", "at", "n", "body"])
                at += int(n.sum())

    tokens = materialize(base.mapInArrow(tokenize, "part int, at long, n long, body binary"), "shard-tokens", "none")
    sums = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    first, total = {}, 0
    for p in sorted(sums):
        first[p] = total
        total += sums[p]
    if not total:
        return spark.createDataFrame([], _MANIFEST)
    root = new_path(spark, "shards")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=4)
        held: list[np.ndarray] = []
        slots: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            data, slot = np.concatenate(held), np.concatenate(slots)
            order = np.argsort(slot)
            data, slot = data[order], slot[order]
            shard = slot // records
            cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            bodies = [pack.compress((slot[a:b] % records).astype("<u4").tobytes() + data[a:b].tobytes()) for a, b in zip(cut, [*cut[1:], len(slot)], strict=True)]
            sizes = np.diff(np.append(cut, len(slot)))
            yield pa.RecordBatch.from_arrays([pa.array(shard[cut]), pa.array(sizes), pa.array(bodies, pa.binary())], names=["shard", "n", "body"])
            held.clear()
            slots.clear()

        for b in batches:
            for part, at, body in zip(*[b.column(c).to_pylist() for c in ("part", "at", "body")], strict=True):
                raw = unpack.decompress(body)
                docs = struct.unpack_from("<q", raw)[0]
                doc = np.frombuffer(raw, "<i8", docs, 8)
                size = np.frombuffer(raw, "<i8", docs, 8 + 8 * docs)
                ids = np.frombuffer(raw, wide, -1, 8 + 16 * docs)
                n = -(-size // length)
                out = np.zeros(int(n.sum()), rec)
                chunk = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
                out["doc"], out["chunk"] = np.repeat(doc, n), chunk
                out["count"] = np.minimum(length, np.repeat(size, n) - chunk * length)
                begin = np.repeat(np.cumsum(size) - size, n) + chunk * length
                use = np.arange(length) < out["count"][:, None].astype(np.int64)
                where = begin[:, None] + np.arange(length)
                out["ids"][use] = ids[where[use]]
                held.append(out)
                slots.append(feistel(first[part] + at + np.arange(len(out)), total, key))
                if sum(map(len, held)) * rec.itemsize > 32_000_000:
                    yield from flush()
        yield from flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: list[bytes] = []
        last = None
        store, base_path = open_store(root)
        store.create_dir(base_path, recursive=True)

        def close() -> pa.RecordBatch:
            parts = [unpack.decompress(x) for x in held]
            n = [len(p) // (4 + rec.itemsize) for p in parts]
            slot = np.concatenate([np.frombuffer(p, "<u4", k) for p, k in zip(parts, n, strict=True)])
            data = np.concatenate([np.frombuffer(p, rec, k, 4 * k) for p, k in zip(parts, n, strict=True)])
            data = data[np.argsort(slot)]
            name = f"{base_path}/shard-{last:06d}-{uuid.uuid4().hex}.bin"
            with store.open_output_stream(name, compression=None) as f:
                f.write(data.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([name]), pa.array([len(data)], pa.int64()), pa.array([data.nbytes], pa.int64())], names=["shard", "path", "records", "bytes"])

        for b in batches:
            for shard, body in zip(b.column("shard").to_pylist(), b.column("body").to_pylist(), strict=True):
                if shard != last and held:
                    yield close()
                    held.clear()
                last = shard
                held.append(body)
        if held:
            yield close()

    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // records)))
    blocks = tokens.select("part", "at", "body").mapInArrow(place, "shard long, n long, body binary")
    shards = -(-total // records)
    ranges = blocks.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int"))  # the task of a range of shards
    got = ranges.sortWithinPartitions("shard").select("shard", "body").mapInArrow(write, _MANIFEST)
    return materialize(got.withColumn("path", F.concat(F.lit(root.split(":/", 1)[0] + "://" if ":/" in root else ""), "path")), "shard-manifest")


def read_records(path: str, at: int, count: int, rec: np.dtype) -> np.ndarray:
    """`count` records from record `at` of a shard on, by one seek; fewer at its end."""
    store, name = open_store(path)
    with store.open_input_file(name) as f:
        f.seek(at * rec.itemsize)
        return np.frombuffer(f.read(count * rec.itemsize), rec)


class SlotReader:
    """Reads sequences in training order from any slot on; `slot` is all the state there is to resume.

    The manifest stays a table: the places of `PAGE` shards are fetched at a time.
    """

    PAGE = 256

    def __init__(self, manifest: DataFrame, length: int = LENGTH, records: int = RECORDS, path: str | None = None) -> None:
        self.manifest, self.paths = manifest, {}
        self.total = int(manifest.agg(F.sum("records")).first()[0] or 0)
        self.rec, self.records, self.slot = record_type(length, np.dtype("<u2" if vocabulary(path or default_path()) <= 1 << 16 else "<u4")), records, 0

    def _path(self, shard: int) -> str:
        if shard not in self.paths:
            self.paths = {r["shard"]: r["path"] for r in self.manifest.where(F.col("shard").between(shard, shard + self.PAGE - 1)).select("shard", "path").collect()}
        return self.paths[shard]

    def read(self, count: int) -> list[np.ndarray]:
        """The ids of the next sequences."""
        out: list[np.ndarray] = []
        while len(out) < count and self.slot < self.total:
            got = read_records(self._path(self.slot // self.records), self.slot % self.records, count - len(out), self.rec)
            out += [r["ids"][: r["count"]] for r in got]
            self.slot += len(got)
        return out


def read_shards(manifest: DataFrame, length: int = LENGTH, records: int = RECORDS, path: str | None = None) -> DataFrame:
    """All records, read back in order: slot, shard, doc_id, chunk, count, ids_crc32 (of little-endian uint32 ids)."""
    wide = np.dtype("<u2" if vocabulary(path or default_path()) <= 1 << 16 else "<u4")
    rec = record_type(length, wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                for at in range(0, r["records"], 8192):
                    got = read_records(r["path"], at, min(8192, r["records"] - at), rec)
                    crc = [zlib.crc32(x["ids"][: x["count"]].astype("<u4").tobytes()) for x in got]
                    doc = got["doc"].astype(np.int64)
                    slot = r["shard"] * records + at + np.arange(len(got))
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.full(len(got), r["shard"], np.int64)), pa.array(doc, mask=doc == _NULL), *[pa.array(got[c].astype(np.int64)) for c in ("chunk", "count")], pa.array(crc, pa.int64())], names=["slot", "shard", "doc_id", "chunk", "count", "ids_crc32"])

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(tasks, "shard").mapInArrow(run, "slot long, shard long, doc_id long, chunk long, count long, ids_crc32 long")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` as sequences of up to 256 ids in training order, written to shards and read back."""
    return read_shards(write_shards(table(spark, sf_dir, "documents")))
