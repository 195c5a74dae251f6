"""Blocks of vectors in the shared folder, and products of blocks in tasks that read them.

Rows are dealt into blocks of bounded size and written once, one folder a block. A task is given names of blocks, holds its
left ones and reads the right ones one after the other. So a vector is written once, however many blocks it is held
against, and nothing but names of blocks is sent to tasks.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a block, and of a product that a task holds at once.
BLOCK, STEP = 4096, 256


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; without one, a temporary folder in local mode, else one in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_mnemora"
    own = tempfile.mkdtemp(prefix="mnemora-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def flat(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


@dataclass
class Rows:
    """A block in memory, in the order of its keys: unit vectors, the same in single precision, and the other columns."""

    name: str
    keys: pa.Array
    x: np.ndarray
    table: pa.Table

    def __post_init__(self) -> None:
        self.fast = self.x.astype(np.float32)

    @property
    def doubt(self) -> float:
        """How far a cosine in single precision may be from the one in double precision, at most (twice the bound of sums of products)."""
        return (self.x.shape[1] + 8) * 1.2e-7

    def __len__(self) -> int:
        return len(self.x)

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()


def unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


@dataclass
class Blocks:
    """Blocks as written: their folder and, for each group of rows that may meet, names and sizes of its blocks."""

    spark: SparkSession
    path: str
    groups: dict[str, list[tuple[str, int]]]

    def read(self, name: str) -> Rows:
        disk, base = fs.FileSystem.from_uri(self.path if ":/" in self.path else f"file://{self.path}")
        files = sorted(f.path for f in disk.get_file_info(fs.FileSelector(f"{base}/block={name}")) if f.path.endswith(".parquet"))
        t = pa.concat_tables([pq.read_table(f, filesystem=disk, partitioning=None) for f in files]).combine_chunks().sort_by("k")
        v = flat(t.column("v"))
        x = np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64)
        return Rows(name, flat(t.column("k")), unit(x.reshape(len(t), len(x) // len(t))), t.drop_columns(["v"]))

    def reader(self) -> Callable[[str], Rows]:
        """read() for tasks; the session stays here."""
        return Blocks(None, self.path, {}).read  # type: ignore[arg-type]

    def run(self, tickets: list[tuple[list[str], list[str]]], product: Callable[[list[Rows], Iterator[Rows]], Iterator[pa.RecordBatch]], schema: object, lefts: Blocks | None = None) -> DataFrame:
        """product(left blocks, right blocks as they are read) for each ticket, one a task. `lefts`: the table of the left blocks, where it is another one."""
        sc, read = self.spark.sparkContext, self.reader()
        first, apart = (lefts or self).reader(), lefts is not None

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for names, rights in zip(b.column("lefts").to_pylist(), b.column("rights").to_pylist(), strict=True):
                    held = [first(n) for n in names]
                    own = {} if apart else {r.name: r for r in held}
                    yield from product(held, (own.get(n) or read(n) for n in rights))

        rows = self.spark.createDataFrame(sc.parallelize(tickets, max(1, min(len(tickets), 50_000))), "lefts array<string>, rights array<string>")
        return rows.mapInArrow(work, schema)

    def squares(self, side: int) -> list[tuple[list[str], list[str]]]:
        """Tickets that hold every pair of blocks of a group, in squares of `side` blocks: (lefts, rights). Where lefts and rights are the same, pairs of blocks come twice."""
        out = []
        for blocks in self.groups.values():
            names = [n for n, _ in blocks]
            runs = [names[a : a + side] for a in range(0, len(names), side)]
            out += [(p, q) for i, p in enumerate(runs) for q in runs[i:]]
        return out

    def side(self, most: int = 16) -> int:
        """Blocks of a side of a square, so that there are some squares for each core; `most` at most, which a task holds."""
        n, cores = sum(map(len, self.groups.values())), self.spark.sparkContext.defaultParallelism
        return max(1, min(most, int(n / (8 * cores) ** 0.5)))

    def earlier(self, most: int, at: str) -> list[tuple[list[str], list[str]]]:
        """Tickets that hold each block against all blocks whose least `at` isn't beyond its largest, at most `most` at a time."""
        spans = self.spark.read.schema(f"{at} bigint, block string").parquet(self.path).groupBy("block").agg(F.min(at).alias("low"), F.max(at).alias("high"))
        span = {r["block"]: (r["low"], r["high"]) for r in spans.collect()}  # a row a block
        names = [n for blocks in self.groups.values() for n, _ in blocks]
        out = []
        for a in names:
            held = [n for n in names if span[n][0] <= span[a][1]]
            out += [([a], held[s : s + most]) for s in range(0, len(held), most)]
        return out

    def runs(self, most: int) -> list[list[str]]:
        """Names of the blocks of each group, at most `most` at a time."""
        return [[n for n, _ in blocks[s : s + most]] for blocks in self.groups.values() for s in range(0, len(blocks), most)]


def stored(df: DataFrame) -> DataFrame:
    """df as written once in the shared folder: vectors that are computed from texts aren't computed for each reader."""
    path = f"{scratch(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(df: DataFrame, key: str, vector: str, within: str | None = None, extra: dict[str, object] | None = None, block: int = BLOCK, runs: bool = False) -> Blocks:
    """Deal rows with a vector into blocks of about `block` rows with equal `within` and vector size, and write them: columns k, v and `extra` (columns by name).
    `runs`: keys are numbers, and a block has those of one run of `block` numbers; its name ends with the run's number."""
    spark = df.sparkSession
    # sizes are counted without the vectors, which may be computed
    n = df.groupBy((F.col(within) if within else F.lit(0)).alias("w")).agg(F.count("*").alias("n"))
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), (F.col(within) if within else F.lit(0)).alias("w"), *[F.lit(c).alias(a) if isinstance(c, (bool, int)) else c.alias(a) for a, c in (extra or {}).items()])
    rows = rows.join(n, "w")
    place = F.concat(F.lit("b"), F.hex(F.xxhash64("w", F.size("v"))), F.lit("_"), F.expr(f"k div {block}" if runs else f"pmod(xxhash64(k), ceil(n / {block}))"))
    place = F.when(F.col("v").isNull(), "none").otherwise(place)  # no filter, for which a computed vector would be computed once more
    path = f"{scratch(spark)}/blocks-{uuid.uuid4().hex}"
    rows.withColumn("block", place).drop("w", "n").repartition("block").write.option("compression", "zstd").partitionBy("block").parquet(path)
    got = Blocks(spark, path, {})
    schema = f"k {rows.schema['k'].dataType.simpleString()}, block string"
    for r in sorted(spark.read.schema(schema).parquet(path).groupBy("block").agg(F.count("*").alias("n")).collect()):  # a row a block
        if r["block"] == "none":
            continue
        got.groups.setdefault(r["block"].rsplit("_", 1)[0], []).append((r["block"], r["n"]))
    return got
