"""Filter interaction audit: what each filter removes in every order, and what it would have removed alone.

A text fails filters A to D by itself; E asks for an identical text with a smaller id anywhere in the table. Exact copies
are found in an RDD routed by fingerprint (xxhash): a task first keeps the chains of its own partition, so that of all rows
with one text only those of the least id there travel with it (a text of a third of all rows is sent once a partition);
rows that are non-minimal already travel without it, dealt by their id. Partitions of the routed RDD are sorted by
fingerprint, so one chain is held at a time; a chain has full texts, so equal fingerprints of different texts part.

Rows then are a mask of five bits. `combineByKey` adds them up as count vectors, a vector of 32 masks for each part, and all
120 orders are read from these vectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, permutations
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.common import BATCH_BYTES, materialize, table, text_runs, tidy

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of text that the chains of a map task hold before they are sent on.
CHAIN_BYTES = 64_000_000
UPPER, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"

#: A row whose mask is complete: (id, part, mask). Rows on their way: those of one text and its least id, or without a text a settled one.
Settled = tuple[Any, str, int]
ROUTED = "key long, least long, raw binary, rows array<struct<part: string, mask: int>>"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def mask_of(raw: bytes, points: int) -> int:
    """Bits of the filters A to D that a text of so many code points fails."""
    words = raw.split()
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * (len(raw) - len(raw.translate(None, UPPER))) > 3 * points, len(raw.translate(None, MARKS)) < len(raw))
    return sum(1 << i for i, f in enumerate(fails) if f)


class Chains:
    """Texts by fingerprint: each with its least id and the (part, mask) of the rows that have this id."""

    def __init__(self) -> None:
        self.of: dict[int, list[list[Any]]] = {}
        self.size = 0

    def add(self, key: int, raw: bytes, least: Any, rows: list[tuple[str, int]]) -> Iterator[Settled]:
        """Rows that are non-minimal from now on."""
        chain = self.of.setdefault(key, [])
        for link in chain:
            if link[0] == raw:
                if least > link[1]:
                    yield from ((least, p, m | COPY) for p, m in rows)
                elif least == link[1]:
                    link[2] += rows
                else:
                    yield from ((link[1], p, m | COPY) for p, m in link[2])
                    link[1:] = [least, list(rows)]
                return
        chain.append([raw, least, list(rows)])
        self.size += len(raw)


@tidy
def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chains of a partition as rows of ROUTED: open ones go to their fingerprint with their text, settled rows to their id without."""
    chains, held = Chains(), []

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            key, least, raw, rows = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(least, pa.int64()), pa.array(raw, pa.binary()), pa.array(rows, pa.list_(pa.struct([("part", pa.string()), ("mask", pa.int32())])))], names=["key", "least", "raw", "rows"])
            held.clear()

    def drain() -> Iterator[pa.RecordBatch]:
        size = 0
        for key, chain in chains.of.items():
            for raw, least, own in chain:
                held.append((key, least, raw, [{"part": p, "mask": m} for p, m in own]))
                size += len(raw)
                if size > BATCH_BYTES:
                    yield from out()
                    size = 0
        yield from out()
        chains.__init__()

    for batch in batches:
        for part, texts in text_runs(batch, "text"):
            for i, lang, raw, points in zip(part.column("id").to_pylist(), part.column("part").to_pylist(), texts, pc.utf8_length(part.column("text")).to_pylist(), strict=True):
                mask, key = mask_of(raw, points), xxhash.xxh3_64_intdigest(raw)
                if i is None:  # no id is smaller or larger than none
                    held.append((key, i, None, [{"part": lang, "mask": mask}]))
                    continue
                held.extend((xxhash.xxh3_64_intdigest(str(row[0]).encode()), row[0], None, [{"part": row[1], "mask": row[2]}]) for row in chains.add(key, raw, i, [(lang, mask)]))
            yield from out()
            if chains.size > CHAIN_BYTES:
                yield from drain()
    yield from drain()


def _settle(routed: Iterable[tuple[int, Row]]) -> Iterator[Settled]:
    """All rows of a routed, sorted partition with their masks complete."""
    for key, group in groupby(routed, key=lambda kv: kv[0]):
        chains = Chains()
        for _, (_, least, raw, rows) in group:
            rows = [(r[0], r[1]) for r in rows]
            if raw is None:
                yield from ((least, p, m) for p, m in rows)
            else:
                yield from chains.add(key, raw, least, rows)
        for _, least, own in chains.of.get(key, []):
            yield from ((least, p, m) for p, m in own)


def fail_masks(docs: DataFrame, text: str = "text", id: str = "doc_id", part: str = "lang") -> RDD:
    """(id, part, mask) for each row. Chains of map tasks are stored once, in the shared folder."""
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    stored = materialize(rows.mapInArrow(_local, ROUTED), "chains").rdd
    parts = max(stored.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored.map(lambda r: (r[0], r)).repartitionAndSortWithinPartitions(parts, lambda key: key % parts).mapPartitions(_settle)


def _vector() -> np.ndarray:
    return np.zeros((32, 3), np.int64)


def _count(vector: np.ndarray, row: tuple[int, int, int]) -> np.ndarray:
    vector[row[0]] += (1, row[1], row[2])
    return vector


def report(part: str, vector: np.ndarray) -> Iterator[tuple[Any, ...]]:
    """The rows of a part: every order and step, from its counts of masks (all rows, good ones, toxic ones)."""
    masks = np.arange(32)
    steps = []
    for order in permutations(range(5)):
        alive = np.ones(32, bool)
        for step, f in enumerate(order, 1):
            fails = masks >> f & 1 == 1
            gone = vector[alive & fails].sum(0)
            late = vector[~alive & fails, 0].sum()
            alive &= ~fails
            steps.append(("".join(FILTERS[k] for k in order), step, f, vector[alive, 0].sum(), gone, late))
    shapley = [sum(int(s[4][0]) for s in steps if s[2] == f) for f in range(5)]
    for order, step, f, kept, gone, late in steps:
        yield part, order, step, int(kept), int(gone[0]), int(late), int(vector[1 << f, 0]), int(gone[1]), int(gone[2]), shapley[f]


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", part: str = "lang") -> DataFrame:
    """One row for each part, order of the five filters and step.

    Null texts are empty and copies of each other, a null part is the empty string. Rows with a null id have no labels and
    are neither copies nor originals. Rows that repeat an id with its text are no copies of each other; an id with several
    labels is good or toxic if one of them says so. An empty table has no parts and no rows. Other columns play no part,
    whatever their names.
    """
    spark = docs.sparkSession
    rows = spark.createDataFrame(fail_masks(docs, text, id, part), "id long, part string, mask int", verifySchema=False)
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"))
    marked = rows.join(known, "id", "left").select("part", "mask", F.coalesce("good", F.lit(0)), F.coalesce("bad", F.lit(0))).rdd
    vectors = marked.map(lambda r: (r[0], (r[1], r[2], r[3]))).combineByKey(lambda row: _count(_vector(), row), _count, np.add)
    return spark.createDataFrame(vectors.flatMap(lambda kv: report(*kv)), SCHEMA, verifySchema=False)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all `documents`, with a part for each language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_LETTER = lambda n: f"(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS {n})"
OP13_SQL = f"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
low AS (SELECT t, min(doc_id) AS m FROM w GROUP BY t),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > m THEN 'E' ELSE '' END) AS fails
  FROM w JOIN low USING (t) LEFT JOIN lab USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, fails),
o AS (SELECT a || b || c || d || e AS filter_order FROM {_LETTER("a")}, {_LETTER("b")}, {_LETTER("c")}, {_LETTER("d")}, {_LETTER("e")} WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT part, filter_order, step, letter, n, good, bad, fails, contains(fails, letter) AS hit, length(translate(fails, before, '')) = length(fails) AS alive FROM g, s),
y AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (alive AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (alive AND hit), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (NOT alive AND hit), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (alive AND hit), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (alive AND hit), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM y"""
