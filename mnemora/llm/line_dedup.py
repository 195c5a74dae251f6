"""Line dedup with a log-template tree of fixed depth.

A line's words with a digit are fields from the start. The tree's levels are the number of words and the leading
words; a leaf holds the lines that agree in these. In a leaf, a word that stands at its place in at least `support`
lines is fixed, any other is a field, so lines that differ in names or codes share a template; where more than
`fields` of the words would be fields, the leaf holds unlike lines, and the line itself is the template. This rule needs no order of arrival,
so leaves of any size are counted by pre-aggregated sums and no leaf is gathered in one task.
A template without a fixed word (a line of numbers) is no template. Else it recurs if it stands in documents of at least
`min_docs` copy classes: copies of one document, however many, count once, and are the business of document dedup. Copy
classes come from sketches, so that no texts are moved for them: the least hash of a document's `WINDOW`-byte windows in
each of `BINS` classes of hashes (one-permutation minwise hashing). Equal sketches are one node, named by its hash. Nodes
that share a band of bins are held against the one of the smallest name, and are its copies if `ALIKE` of the bins agree. So
classes depend on texts alone, not on how the input is split. A passage that fills half of two documents makes a third of
their bins agree. Only documents that hold a template of `min_docs` documents have a say.
Lines of recurring templates are dropped, in passages of any number of lines and lines of any number of words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.llm.common import WordHashes, components, materialize, mix64, new_path, records_beside, table, text_runs, tidy, unpack
from mnemora.llm.warc import open_store

LEAD, SUPPORT, MIN_DOCS, FIELDS = 3, 3, 3, 0.4
WINDOW, BINS, BAND, ALIKE = 16, 64, 4, 0.6
_FIELD = re.compile(rb"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_STAR = b"<*>"


def masked(line: bytes) -> list[bytes]:
    """Words of a line, those with a digit as fields."""
    words = line.split()
    return [_STAR if _FIELD.fullmatch(w) else w for w in words] if re.search(rb"[0-9]", line) else words


def _hash(x: bytes) -> int:
    return xxhash.xxh3_64_intdigest(x)


def line_keys(text: bytes, lead: int) -> tuple[list[int], list[int], list[int]]:
    """(position, leaf, line) of the lines with words, as hashes."""
    at, leaf, line = [], [], []
    for i, x in enumerate(text.split(b"\n")):
        words = masked(x)
        if words:
            at.append(i)
            leaf.append(_hash(b"%d " % len(words) + b" ".join(words[:lead])))
            line.append(_hash(b" ".join(words)) if any(w != _STAR for w in words) else 0)
    return at, leaf, line


def sketches(texts: list[bytes]) -> np.ndarray:
    """[texts, BINS] least window hashes, as uint64; the largest value where a bin is empty. A-Z are lower-cased."""
    top = np.iinfo(np.uint64).max
    out = np.full((len(texts), BINS), top, np.uint64)
    size = np.array([max(len(t), WINDOW) for t in texts], np.int64)
    data = np.frombuffer(b"".join([t.lower().ljust(WINDOW, b"\0") for t in texts]) + bytes(WINDOW), np.uint8)
    words = np.zeros(len(data) - 8, np.uint64)  # the 8 bytes from each place on
    for j in range(8):
        words |= data[j : j + len(words)].astype(np.uint64) << np.uint64(8 * j)
    n = len(data) - WINDOW
    with np.errstate(over="ignore"):
        h = mix64(words[:n] * np.uint64(0x9E3779B97F4A7C15) + words[8 : 8 + n])
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(texts)), size)
    inside = np.arange(n) <= (ends - WINDOW)[owner]
    h, owner = h[inside], owner[inside]
    np.minimum.at(out.reshape(-1), owner * BINS + (h >> np.uint64(58)).astype(np.int64), h)
    return out


def copy_classes(docs: DataFrame) -> DataFrame:
    """(row, comp) of rows with a sketch: the smallest name of a sketch that their copies lead to. docs: row, bins (binary), bands."""
    named = docs.select("row", F.xxhash64("bins").alias("node"), "bins", "bands")
    some = materialize(named.groupBy("node").agg(F.first("bins").alias("bins"), F.first("bands").alias("bands")), "lines-nodes")
    side = lambda n: some.select(F.col("node").alias(n), F.col("bins").alias(f"s{n}"))

    @tidy
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, BINS) for c in ("sa", "sb"))
            full = (x != np.iinfo(np.uint32).max) | (y != np.iinfo(np.uint32).max)
            same = ((x == y) & full).sum(1) >= ALIKE * full.sum(1)
            yield batch.select(["a", "b"]).filter(pa.array(same))

    bands = some.select("node", F.explode("bands").alias("key"))
    first = bands.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    pairs = bands.join(first.hint("merge"), "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    met = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    links = met.select("a", "b", "sa", "sb").mapInArrow(alike, "a long, b long")
    label = components(links, "lines-classes")
    return named.select("row", "node").join(label.hint("merge"), "node", "left").select("row", F.coalesce("label", "node").alias("comp"))


def beside_rows(side: DataFrame, name: str) -> Column:
    """An expression over `row` of the documents: the list that `side` (row, list of long) has for it, null where it has none.

    Documents stay where they are. A row's high bits are the partition that it was read in; the lists of each such partition
    are written in order of rows, as one file of the shared folder, and the tasks that meet its rows read that file. The
    driver knows a file name for each partition. A file's name is its own, so a task that is run again leaves an orphan at worst.
    """
    spark = side.sparkSession
    root, schema = new_path(spark, name), pa.schema([("row", pa.int64()), ("list", pa.list_(pa.int64()))])

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        store.create_dir(base, recursive=True)
        part, out, writer, file = -1, [], None, None
        for batch in batches:
            parts = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(parts, prepend=parts[:1] - 1)) if len(parts) else parts
            for a, b in zip(cut, [*cut[1:], len(parts)], strict=True):
                if parts[a] != part:
                    if writer:
                        writer.close()
                        file.close()
                    part = int(parts[a])
                    out.append((part, f"{part}-{uuid.uuid4().hex}"))
                    file = store.open_output_stream(f"{base}/{out[-1][1]}", compression=None)
                    writer = pa.ipc.new_stream(file, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                piece = batch.slice(a, b - a)
                writer.write_batch(pa.RecordBatch.from_arrays([piece.column(1), piece.column(2).cast(schema.field(1).type)], schema=schema))
        if writer:
            writer.close()
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([n for _, n in out], pa.string())], names=["part", "file"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = side.toDF("row", "list").select(F.expr("shiftright(row, 33)").alias("part"), "row", "list").repartition(tasks, "part").sortWithinPartitions("part", "row")
    files = {r["part"]: r["file"] for r in placed.mapInArrow(write, "part long, file string").collect()}

    def look(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        store, base = open_store(root)
        none = (np.zeros(0, np.int64), pa.array([], schema.field(1).type))
        part, held = -1, none
        for batch in rows:
            row, found = batch.to_numpy(zero_copy_only=False), []
            parts = row >> 33
            cut = np.flatnonzero(np.diff(parts, prepend=parts[:1] - 1)) if len(row) else row
            for a, b in zip(cut, [*cut[1:], len(row)], strict=True):
                if parts[a] != part:
                    part, held = int(parts[a]), none
                    if part in files:
                        with store.open_input_file(f"{base}/{files[part]}") as f:
                            got = pa.ipc.open_stream(f.read()).read_all().combine_chunks()
                        held = (got["row"].to_numpy(), got["list"].combine_chunks())
                known, lists = held
                at = known.searchsorted(row[a:b])
                there = np.append(known, -1)[at] == row[a:b]
                found.append(lists.take(pa.array(np.where(there, at, 0), pa.int64(), mask=~there)))
            yield pa.concat_arrays(found) if found else none[1]

    look.__annotations__ = {"rows": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(look, T.ArrayType(T.LongType()))("row")


def recurring(df: DataFrame, text: str = "text", lead: int = LEAD, support: int = SUPPORT, min_docs: int = MIN_DOCS, fields: float = FIELDS) -> DataFrame:
    """Columns rec (the input row but its text), row, parts (the text's lines), n_lines (with words), drop (positions of lines to drop, from 0).

    A null text has null parts, an empty one a single empty line; neither has lines to drop. Texts and lines of any
    length are read whole. A line that a document repeats counts once for its template and is dropped at every place.
    Repeated rows are copies of one document. An empty table gives no rows; columns of the input stay in `rec`.
    """
    base = records_beside(df, text, F.monotonically_increasing_id().alias("row"))
    long_list = T.ArrayType(T.LongType())
    schema = T.StructType([base.schema["rec"], T.StructField("row", T.LongType()), T.StructField("text", base.schema["__text"].dataType), *[T.StructField(c, long_list) for c in ("at", "leaf", "line", "bands")], T.StructField("bins", T.BinaryType())])

    @tidy
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_runs(batch, "__text"):
                got = [line_keys(t, lead) for t in texts]
                ends = pa.array(np.cumsum([0, *[len(g[0]) for g in got]]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.array([x for g in got for x in g[c]], np.uint64).view(np.int64))) for c in range(3)]
                bins = sketches(texts)
                band = np.tile(np.arange(BINS // BAND, dtype=np.uint64), (len(texts), 1))
                with np.errstate(over="ignore"):
                    for j in range(BAND):
                        band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + bins[:, j::BAND])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * (BINS // BAND), pa.int32()), pa.array(band.ravel().view(np.int64)))
                short = pa.array([x.tobytes() for x in (bins & np.uint64(0xFFFFFFFF)).astype(np.uint32)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("rec"), part.column("row"), part.column("__text"), *lists, bands, short], names=["rec", "row", "text", "at", "leaf", "line", "bands", "bins"])

    # joins are merge joins at any size (hints), as what they meet grows with the corpus
    docs = base.mapInArrow(keys, schema).select("rec", "row", F.split("text", "\n", -1).alias("parts"), "at", "leaf", "line", "bands", "bins")
    docs = materialize(docs, "lines")
    every = docs.select("row", F.explode(F.arrays_zip("at", "leaf", "line")).alias("x")).select("row", "x.*").where("line <> 0")
    leaves = every.groupBy("leaf").agg(F.count("*").alias("c")).where(F.col("c") >= min_docs).select("leaf")
    lines = materialize(every.join(leaves.hint("merge"), "leaf"), "lines-often")
    # leaves with unlike lines: the words of one of each kind of line, weighted by how often it stands
    kinds = lines.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("rep"))
    mixed = kinds.groupBy("leaf").agg(F.count("*").alias("k"), F.sum("n").alias("c")).where("k > 1").select("leaf")
    reps = kinds.join(mixed.hint("merge"), "leaf").select("leaf", "line", "n", F.col("rep.row").alias("row"), F.col("rep.at").alias("at"))
    wanted = reps.groupBy("row").agg(F.flatten(F.collect_list(F.array("at", "leaf", "line", "n"))).alias("want"))  # at most a document's lines

    @tidy
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for part, texts in text_runs(batch, "some"):
                found = part.column("want").to_pylist()
                rows = [(*want[4 * i + 1 : 4 * i + 4], memo.of(masked(x)).view(np.int64)) for t, want in zip(texts, found, strict=True) for i, x in enumerate(t.split(b"\n"))]
                memo.trim()
                yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["leaf", "line", "n", "words"])

    wanted = docs.select("parts", beside_rows(wanted, "lines-wanted").alias("want")).where("want is not null")
    places = F.expr("transform(sequence(0, size(want) - 1, 4), i -> parts[int(want[i])])")
    wanted = wanted.select(F.array_join(places, "\n").alias("some"), "want")
    word = wanted.mapInArrow(words, "leaf long, line long, n long, words array<long>")
    word = materialize(word, "lines-words").select("leaf", "line", "n", F.posexplode("words").alias("place", "word"))
    fixed = word.groupBy("leaf", "place", "word").agg(F.sum("n").alias("c")).where(F.col("c") >= support).select("leaf", "place", "word", F.lit(True).alias("fixed"))
    shape = word.join(fixed.hint("merge"), ["leaf", "place", "word"], "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)) & (F.col("word") != F.lit(np.uint64(_hash(_STAR)).astype(np.int64).item())))
    shape = shape.groupBy("leaf", "line").agg(F.expr("bit_xor(xxhash64(leaf, place, if(fixed, word, 0L)))").alias("shape"), F.avg((~F.col("fixed")).cast("int")).alias("open"))
    shape = shape.select("leaf", "line", F.when(F.col("open") <= fields, F.col("shape")).otherwise(F.col("line")).alias("template"))
    lines = lines.join(shape.hint("merge"), ["leaf", "line"], "left").withColumn("template", F.coalesce("template", "line"))
    lines = materialize(lines.select("row", "at", "template"), "lines-templates")
    holds = lines.select("template", "row").distinct()
    often = holds.groupBy("template").agg(F.count("*").alias("rows")).where(F.col("rows") >= min_docs).select("template")
    holds = materialize(holds.join(often.hint("merge"), "template"), "lines-holds")
    holders = beside_rows(holds.select("row").distinct().withColumn("list", F.array().cast("array<bigint>")), "lines-holders")
    classes = copy_classes(materialize(docs.select("row", "bands", "bins", holders.alias("holds")).where("holds is not null").drop("holds"), "lines-sketches"))
    often = holds.join(classes.hint("merge"), "row").select("template", "comp").distinct().groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("template")
    drop = beside_rows(lines.join(often.hint("merge"), "template").groupBy("row").agg(F.array_sort(F.collect_list("at")).alias("drop")), "lines-drop")
    return docs.select("rec", "row", "parts", F.size("at").cast("long").alias("n_lines"), F.coalesce(drop, F.array().cast("array<bigint>")).alias("drop"))


def _clean(parts: object, drop: object) -> object:
    """The text without the lines at the dropped positions; a null text stays null. Linear in the lines."""
    every = F.sequence(F.lit(0).cast("long"), (F.size(parts) - 1).cast("long"))
    left = F.transform(F.array_except(every, drop), lambda i: parts[i.cast("int")])
    return F.array_join(F.when(F.size(drop) == 0, parts).otherwise(left), "\n")


def drop_lines(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars", **options: object) -> DataFrame:
    """The input's rows and columns, with recurring lines cut from the text (and n_chars, if there, counted anew where a
    line was cut). No row is dropped: a text of which nothing is left is empty. Otherwise as recurring()."""
    got = recurring(df, text, **options).withColumn("clean", _clean(F.col("parts"), F.col("drop")))
    own = {text: F.col("clean")} | ({n_chars: F.when(F.size("drop") == 0, F.col("rec").getField(n_chars)).otherwise(F.char_length("clean")).cast(df.schema[n_chars].dataType)} if n_chars in df.columns else {})
    return unpack(got, df.columns, **own).select(*df.columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents`: doc_id, n_lines (with words), n_dropped, and sha-256 of the text that is left (null: of an empty one)."""
    got = recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    clean = F.coalesce(_clean(F.col("parts"), F.col("drop")), F.lit(""))
    return got.select(F.col("rec.doc_id").alias("doc_id"), "n_lines", F.size("drop").cast("long").alias("n_dropped"), F.sha2(clean, 256).alias("kept_sha256"))
