"""Corpus pipeline over `documents`: quality, line dedup, near-dedup, decontamination, packing.

Each stage works on all rows that its predecessor kept, is written as Parquet and read again as the next one's input; a
stage's result is to be written before the next stage is called, which deletes the scratch tables of the one before.
SQL can't express the classifier, signatures or packing, so ORACLE_SQL is None; tests/llm/test_pipeline.py holds run()
against brute force.

For all stages: input columns pass through whatever their names are (own columns never clash with them). Null and empty
texts are kept by every stage that filters, unless the classifier rejects an empty text's figures, and packed as an end
id alone. Texts of any length are read whole. Repeated rows are rows of their own until near-dedup, which keeps one of
each group; of rows with equal texts and ids it is the first in the order of the files. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from mnemora.llm import decontaminate as benchmark
from mnemora.llm.common import delete, owned, shared_root, table
from mnemora.llm.line_dedup import drop_lines
from mnemora.llm.near_dedup import near_dedup
from mnemora.llm.packing import pack
from mnemora.llm.quality import quality_scores

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []  # scratch tables of the stage that ran last


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, _left)
        with owned(_left):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Null hosts and languages are sites of their own; without labels of
    both kinds all are kept. Repeated rows are judged alike."""
    return quality_scores(docs, table(spark, sf_dir, "labels")).where("keep").select(*docs.columns)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates; n_chars is that of the text that is left. A null text stays
    null; a text of which no line is left becomes empty; copies of a document count once."""
    return drop_lines(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8), that with the smallest id (null last).
    Documents without words are in no group and all stay."""
    return near_dedup(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exactly or edited. Items without words are in no document; an item that is
    listed twice counts once."""
    return benchmark.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a packed sequence. Equal places on the curve are ordered by id, then by row."""
    return pack(docs).drop("ids")


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", decontaminate), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of `documents` after all stages. Tables between stages are deleted when the last one is written."""
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    paths = [f"{root}/{i}-{name}" for i, (name, _) in enumerate(STAGES)]
    for path, (_, stage) in zip(paths, STAGES, strict=True):
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    delete(spark, [*paths[:-1], *_left])
    _left.clear()
    return docs
