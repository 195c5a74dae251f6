"""Media columns: a text's bytes as 8-bit mono FLAC, and PCM blocks and features read back from stored streams.

A byte is one sample. Rice codes are short where residuals are near zero, so bytes are numbered by how often prose uses
them (`_OFTEN` first, then the others in their order) and sample 0, -1, 1, -2, ... stands for number 0, 1, 2, 3, ...
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.llm import flac
from mnemora.llm.common import materialize, slices, table, text_runs, unpack

ALIGN, RUN_BYTES = 64, 1_200_000
_OFTEN = b" etaoinsrhldcumfpgwybvkxjqz.,\n\xc3"
_ORDER = _OFTEN + bytes(b for b in range(256) if b not in _OFTEN)
#: From a byte to its sample (as an unsigned byte, 128 is 0), and back.
TO_SAMPLE = bytes.maketrans(_ORDER, bytes(128 + (r // 2 if r % 2 == 0 else -(r + 1) // 2) for r in range(256)))
FROM_SAMPLE = bytes.maketrans(TO_SAMPLE, bytes(range(256)))


def to_flac(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """The input's columns but `text`, with n_bytes and the binary column `media`.

    The payload is the text as UTF-8 (null: empty) and zero bytes up to a positive multiple of 64. Texts of any length
    are one stream; runs of rows are cut by bytes, so memory doesn't depend on the number of rows in a batch. Equal texts
    give equal streams, repeated rows stay, an empty table gives no rows. Columns of the input that are called n_bytes
    or like `media` give way.
    """
    rest = [c for c in df.columns if c != text]
    base = df.select(F.struct(*([df[f"`{c}`"] for c in rest] or [F.lit(0).alias("_")])).alias("rec"), df[f"`{text}`"].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_runs(batch, "__text", RUN_BYTES):
                streams = flac.encode([(t + bytes(-len(t) % ALIGN if t else ALIGN)).translate(TO_SAMPLE) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("rec"), pa.array([len(t) for t in texts], pa.int64()), pa.array(streams, pa.binary())], names=["rec", "n_bytes", "media"])

    got = base.mapInArrow(run, T.StructType([base.schema["rec"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))
    return unpack(got, rest, n_bytes="n_bytes", **{media: "media"})


def pcm_blocks(df: DataFrame, media: str = "media") -> DataFrame:
    """Decoded frames of any 8-bit mono stream: the input's columns but `media`, with block, sample_offset and pcm (unsigned samples, binary).

    Null streams have no blocks, repeated ones have theirs each; broken ones raise. Input columns with these names give way.
    """
    rest = [c for c in df.columns if c != media]
    base = df.select(F.struct(*([df[f"`{c}`"] for c in rest] or [F.lit(0).alias("_")])).alias("rec"), df[f"`{media}`"].alias("__media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("__media").is_valid())
            for part, streams in text_runs(batch, "__media", RUN_BYTES):
                rows = [(i, b, s, p) for i, g in groupby(flac.blocks(streams), key=lambda x: x[0]) for b, (_, s, p) in enumerate(g)]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("rec").take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], names=["rec", "block", "sample_offset", "pcm"])

    fields = [T.StructField("block", T.LongType()), T.StructField("sample_offset", T.LongType()), T.StructField("pcm", T.BinaryType())]
    return unpack(base.mapInArrow(run, T.StructType([base.schema["rec"], *fields])), rest, block="block", sample_offset="sample_offset", pcm="pcm")


def feature(pcm: np.ndarray) -> str:
    """Samples, sum, energy, zero crossings and peak of 8-bit samples (bytes less 128), as whole numbers."""
    x = pcm.astype(np.int64) - 128
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={int(np.abs(x).max()) if len(x) else 0}"


#: What read_back() tells of a stream and its payload.
FACTS = {
    "payload_bytes": (T.LongType(), lambda s, p: len(p)),
    "payload_sha256": (T.StringType(), lambda s, p: hashlib.sha256(p).hexdigest()),
    "tail_crc32": (T.LongType(), lambda s, p: zlib.crc32(p[-ALIGN:])),
    "media_bytes": (T.LongType(), lambda s, p: len(s)),
    "media_sha256": (T.StringType(), lambda s, p: hashlib.sha256(s).hexdigest()),
    "feature": (T.StringType(), lambda s, p: feature(np.frombuffer(p, np.uint8))),
}


def read_back(df: DataFrame, media: str = "media", only: tuple[str, ...] = (*FACTS, "blocks")) -> DataFrame:
    """The input's columns but `media`, with what the stored streams hold once they are decoded and their checksums verified.

    payload_bytes, payload_sha256, tail_crc32 and feature are of the payload, media_bytes and media_sha256 of the stream;
    blocks are its PCM blocks in order (sample_offset, pcm as unsigned samples), so that a reader can begin at any of them.
    A null stream gives nulls, a broken one raises; input columns with these names give way. `only`: those of these columns
    that are made; streams are decoded and verified whichever they are.
    """
    rest = [c for c in df.columns if c != media]
    base = df.select(F.struct(*([df[f"`{c}`"] for c in rest] or [F.lit(0).alias("_")])).alias("rec"), df[f"`{media}`"].alias("__media"))
    block = T.ArrayType(T.StructType([T.StructField("sample_offset", T.LongType()), T.StructField("pcm", T.BinaryType())]))
    facts = {n: f for n, f in FACTS.items() if n in only}
    own = [*[T.StructField(n, k) for n, (k, _) in facts.items()], *([T.StructField("blocks", block)] if "blocks" in only else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("__media").to_pylist()
            for a, b in slices(np.array([len(s or b"") for s in every], np.int64), RUN_BYTES):
                streams = every[a:b]
                there = [i for i, s in enumerate(streams) if s is not None]
                parts: list[list[tuple[int, bytes]]] = [[] for _ in streams]
                for i, at, p in flac.blocks([streams[i] for i in there]):
                    parts[there[i]].append((at, p))
                rows = []
                for s, found in zip(streams, parts, strict=True):
                    p = b"".join(x for _, x in found).translate(FROM_SAMPLE)
                    rows.append([None if s is None else make(s, p) for _, make in facts.values()])
                cols = [pa.array([r[i] for r in rows], pa.int64() if k == T.LongType() else pa.string()) for i, (k, _) in enumerate(facts.values())]
                if "blocks" in only:
                    ends = np.cumsum([0, *map(len, parts)])
                    inner = pa.StructArray.from_arrays([pa.array([at for f in parts for at, _ in f], pa.int64()), pa.array([p for f in parts for _, p in f], pa.binary())], names=["sample_offset", "pcm"])
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, mask=pa.array([s is None for s in streams])))
                yield pa.RecordBatch.from_arrays([batch.column("rec").slice(a, b - a), *cols], names=["rec", *[f.name for f in own]])

    return unpack(base.mapInArrow(run, T.StructType([base.schema["rec"], *own])), rest, **{f.name: f.name for f in own})


def op5_media(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = (*FACTS, "blocks")) -> DataFrame:
    """Every text of `documents` stored as FLAC in the shared folder and read back from there: sizes, digests, features and PCM blocks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_back(materialize(to_flac(docs), "media", "none"), only=only)
