"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, union by stars.

1. One pass over the texts makes each row's set of word shingles (64-bit hashes), the set's 128-bit fingerprint and a
   SuperMinHash signature (Ertl 2017): each element draws a random permutation of the slots and gives slot p_j the
   value j + r_j, so that an element's ranks are correlated over slots. Rounds j run in lockstep for all elements
   that are still needed; a document ends early, once all its slots are filled.
2. Rows of one fingerprint are one class, as their sets are equal. Only one row of a class goes on.
3. Bands of `rows` slots make bucket keys. In each bucket all members are verified against one pivot, the smallest, so k
   copies cost k - 1 verifications; a pivot's members are dealt into groups of `GROUP`, and its text goes once to each.
   Links found so far are joined to components.
4. What is left are members of one bucket in different components. The distances to the pivot are known and the Jaccard
   distance is a metric, so members of the pivot's component that are nearer to it than any foreign member by more than
   a link's distance go. The foreign members (few) are the queries against the rest, in blocks of bounded rows and
   bytes. A task compares signatures, verifies on the spot the pairs that agree in `hint` slots and first met in this
   bucket, and stops for two components once they are linked: only links leave it, so rows grow with links between
   components and not with pairs.
5. Every link is confirmed on full sets: 100 * intersection >= percent * union. Alternating stars find the components.

Recall: a pair at the threshold shares a bucket with probability 1 - (1 - 0.8 ** 5) ** 26 = 0.99997. `hint` lies six
standard deviations of a MinHash signature below the threshold (SuperMinHash has less variance), which costs less than
1e-8; all else is exact. tests/llm/test_near_dedup.py holds results against all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.llm.common import WordHashes, components, materialize, mix64, records_beside, shingle_hashes, table, text_runs, tidy, unpack, words_of

BANDS, ROWS = 26, 5
#: Members of a pivot in one group; rows and shingles of one block of comparisons.
GROUP, BLOCK, BLOCK_SHINGLES = 256, 1024, 2_000_000
_R = np.uint64((1 << 48) - 1)


def superminhash(elements: np.ndarray, owner: np.ndarray, docs: int, m: int, work: int = 150_000) -> np.ndarray:
    """Signatures [docs, m] of uint64. owner: the document of each element, ascending. A document without elements keeps the largest value."""
    top = np.iinfo(np.uint64).max
    h = np.full(docs * m, top, np.uint64)
    if not len(elements):
        return h.reshape(docs, m)

    def draw(e: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            x = mix64(e + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & int(top)))
        return j + ((x >> np.uint64(48)) * np.uint64(m - j) >> np.uint64(16)).astype(np.int64), (np.uint64(j) << np.uint64(48)) | (mix64(x) & _R)

    slot, value = draw(elements, 0)
    np.minimum.at(h, owner * m + slot, value)
    open_ = (h.reshape(docs, m) == top).any(axis=1) & (np.bincount(owner, minlength=docs) > 0)
    left = np.flatnonzero(open_[owner])
    for a in _cuts(owner[left], work):
        own = left[a]
        e, o = elements[own], owner[own]
        perm = np.tile(np.arange(m, dtype=np.uint8), (len(e), 1))
        rows = np.arange(len(e))
        perm[rows, slot[own]], perm[:, 0] = 0, slot[own]
        for j in range(1, m):
            k, value = draw(e, j)
            p = perm[rows, k]
            perm[rows, k] = perm[rows, j]
            np.minimum.at(h, o * m + p, value)
            ids = np.unique(o)
            busy = np.zeros(docs, bool)
            busy[ids] = (h.reshape(docs, m)[ids] == top).any(axis=1)
            keep = busy[o]
            if not keep.any():
                break
            if keep.mean() < 0.7:
                e, o, perm = e[keep], o[keep], perm[keep]
                rows = np.arange(len(e))
    return h.reshape(docs, m)


def _cuts(owner: np.ndarray, work: int) -> Iterator[slice]:
    """Slices of about `work` elements that don't part a document."""
    start = 0
    while start < len(owner):
        end = min(start + work, len(owner))
        if end < len(owner):
            end = max(int(np.searchsorted(owner, owner[end], "left")), start)
            if end == start:
                end = int(np.searchsorted(owner, owner[start], "right"))
        yield slice(start, end)
        start = end


def _signer(text: str, k: int, bands: int, rows: int):  # noqa: ANN202
    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, m = WordHashes(), bands * rows
        for batch in batches:
            for part, texts in text_runs(batch, text):
                sets = [shingle_hashes(memo.of(words_of(x)), k) for x in texts]
                memo.trim()
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                sig = superminhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), len(sets), m)
                with np.errstate(over="ignore"):
                    key = np.tile(np.arange(bands, dtype=np.uint64), (len(sets), 1))
                    for j in range(rows):
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j::rows])
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(key.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("rec"), part.column("row"), part.column(text), pa.array(n), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), keys, pa.array([x.tobytes() for x in (mix64(sig) >> np.uint64(56)).astype(np.uint8)], pa.binary())], names=["rec", "row", "text", "n", "fp", "bands", "sig"])

    return sign


def _overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same, len(both) - same


def _verifier(k: int, percent: int):  # noqa: ANN202
    """Rows of a group: first its pivot (b is null), then members. Gives a, b, linked, dist for each member."""

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, pivot = WordHashes(), np.zeros(0, np.uint64)
        for whole in batches:
            for batch, texts in text_runs(whole, "text"):
                out = []
                for a, b, t in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), texts, strict=True):
                    got = shingle_hashes(memo.of(words_of(t)), k)
                    memo.trim()
                    if b is None:
                        pivot = got
                    else:
                        out.append((a, b, *_overlap(pivot, got)))
                a, b, same, union = (np.array(x, np.int64) for x in (zip(*out, strict=True) if out else [()] * 4))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(100 * same >= percent * union), pa.array(1 - same / np.maximum(union, 1))], names=["a", "b", "linked", "dist"])

    return verify


class _Roots(dict):
    """Union-find over the components that one group meets."""

    def of(self, x: int) -> int:
        while (y := self.get(x, x)) != x:
            self[x] = self.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.of(x), self.of(y)
        self[max(x, y)] = min(x, y)


def _comparer(k: int, percent: int, hint: int):  # noqa: ANN202
    """Links between components within each group, one for two components at most. A group's queries come first, then
    what they are held against; a group without these is held against itself."""
    memo = WordHashes()

    def links(key: int, g: list[np.ndarray], texts: list[bytes]) -> pa.RecordBatch:
        role, ids, comp, n, bands, sig = g
        sets: dict[int, np.ndarray] = {}
        roots, out = _Roots(), []

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_hashes(memo.of(words_of(texts[i])), k)
            return sets[i]

        queries = int((role == 0).sum())
        alone = queries == len(ids)
        for q in range(queries):
            first = q + 1 if alone else queries
            m = (comp[first:] != comp[q]) & (100 * np.minimum(n[first:], n[q]) >= percent * np.maximum(n[first:], n[q]))
            c = np.flatnonzero(m) + first
            agree = (sig[c] == sig[q]).sum(1)
            c, agree = c[agree >= hint], agree[agree >= hint]
            if len(c):  # a pair is the business of the first bucket that it shares
                c, agree = (x[bands[q][(bands[c] == bands[q]).argmax(1)] == key] for x in (c, agree))
            for i in c[np.argsort(-agree, kind="stable")].tolist():
                if roots.of(int(comp[q])) != roots.of(int(comp[i])):
                    same, union = _overlap(of(q), of(i))
                    if 100 * same >= percent * union:
                        out.append((min(int(ids[q]), int(ids[i])), max(int(ids[q]), int(ids[i]))))
                        roots.join(int(comp[q]), int(comp[i]))
        memo.trim()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        texts: list[bytes] = []
        last = None
        for whole in batches:
            for batch, more in text_runs(whole, "text", 8_000_000):
                g = list(zip(*[batch.column(c).to_pylist() for c in ("key", "i", "j")], strict=True))
                cols = [*[batch.column(c).to_numpy(zero_copy_only=False) for c in ("role", "id", "comp", "n")], batch.column("bands").flatten().to_numpy().reshape(len(g), -1), np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(len(g), -1)]
                edges = [i for i in range(len(g)) if not i or g[i] != g[i - 1]]
                for a, b in zip(edges, [*edges[1:], len(g)], strict=True):
                    if g[a] != last and held:
                        yield links(last[0], [np.concatenate(x) for x in zip(*held, strict=True)], texts)
                        held, texts = [], []
                    last = g[a]
                    held.append([c[a:b] for c in cols])
                    texts += more[a:b]
        if held:
            yield links(last[0], [np.concatenate(x) for x in zip(*held, strict=True)], texts)

    return compare


def _labels(s: DataFrame, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """fp, comp of every set: the component's smallest row. s: row, text, n, fp, bands, sig."""
    full = s.where("n > 0")
    classes = materialize(full.groupBy("fp").agg(F.min("row").alias("id"), F.min("n").alias("n")), "smh-classes")
    # a set of up to 3 shingles can only link to an equal one where percent is 80
    small = 100 // max(1, 100 - percent)
    one = full.select("row", "bands").join(classes.where(F.col("n") + 1 >= small).select(F.col("id").alias("row"), "n"), "row")
    buckets = one.select(F.explode("bands").alias("key"), F.struct(F.col("row").alias("id"), "n").alias("x"))
    members = materialize(buckets.join(buckets.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "key"), "smh-buckets")
    wanted = members.select(F.col("x.id").alias("row")).distinct()
    texts = materialize(s.select("row", "text", "bands", "sig").join(wanted, "row").withColumnRenamed("row", "id"), "smh-texts")
    parts = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    limit = 1 - percent / 100 + 1e-9  # the distance of a link
    pivot = members.groupBy("key").agg(F.min("x").alias("p"))
    met = members.join(pivot, "key").select("key", "x", "p", F.expr("1 - least(x.n, p.n) / greatest(x.n, p.n)").alias("low"))
    pairs = met.where(F.expr(f"x.id <> p.id and low <= {limit}")).select(F.col("p.id").alias("a"), F.col("x.id").alias("b")).distinct()
    pairs = materialize(pairs, "smh-met")
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    theirs = pairs.join(groups, "a").select("a", F.expr("pmod(hash(b), groups)").alias("group"), "b").join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "group", "b", "text")
    own = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group")).join(texts.select(F.col("id").alias("a"), "text"), "a").select("a", "group", F.lit(None).cast("long").alias("b"), "text")
    tested = theirs.union(own).repartition(parts, "a", "group").sortWithinPartitions("a", "group", F.asc_nulls_first("b"))
    tested = materialize(tested.select("a", "b", "text").mapInArrow(_verifier(shingle, percent), "a long, b long, linked boolean, dist double"), "smh-pairs")
    links = tested.where("linked").select("a", "b")
    label = components(links, "smh-components")

    met = met.select("key", F.col("x.id").alias("id"), F.col("p.id").alias("a"), F.col("x.n").alias("n"), "low").join(tested.select("a", F.col("b").alias("id"), "dist"), ["a", "id"], "left")
    met = met.join(label.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.expr("id = a").alias("own"), "dist", "low", F.coalesce("label", "id").alias("comp"))
    met = materialize(met, "smh-comps")
    # buckets with members of several components, without what the pivot's distances rule out
    open_ = met.groupBy("key").agg(F.max(F.when(F.col("own"), F.col("comp"))).alias("pc"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi and c > 2").select("key", "pc")
    rest = materialize(met.where("not own").join(open_, "key"), "smh-rest")
    foreign = rest.where("comp <> pc").groupBy("key").agg(F.min(F.coalesce("dist", "low")).alias("m"))
    rest = rest.join(foreign, "key").where(f"comp <> pc or dist is null or dist >= m - {limit}")
    blocks = lambda mine: F.greatest(F.lit(1), F.ceil(F.count(F.when(mine, 1)) / BLOCK), F.ceil(F.sum(F.when(mine, F.col("n"))) / BLOCK_SHINGLES)).cast("int")
    many = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), blocks(F.col("comp") != F.col("pc")).alias("ask"), blocks(F.col("comp") == F.col("pc")).alias("held")).where("lo <> hi").select("key", "ask", "held")
    rest = materialize(rest.join(many, "key").select("key", "id", "comp", "n", F.expr("comp <> pc").alias("asks"), "ask", "held", F.expr("pmod(hash(id), if(comp <> pc, ask, held))").alias("mine")), "smh-dealt")
    place = "array(named_struct('i', {i}, 'j', {j}, 'role', {r}))"
    cells = {
        "not asks": ("ask", place.format(i="t", j="mine", r=1)),
        "asks": ("held + ask", f"if(t < held, {place.format(i='mine', j='t', r=0)}, {place.format(i='least(mine, t - held)', j='held + greatest(mine, t - held)', r='if(mine <= t - held, 0, 1)')})"),
    }
    dealt = [rest.where(who).withColumn("t", F.explode(F.expr(f"sequence(0, {count} - 1)"))).select("key", "id", "comp", "n", F.expr(cell)[0].alias("c")).select("key", "id", "comp", "n", "c.*") for who, (count, cell) in cells.items()]
    hint = int(bands * rows * max(0.0, percent / 100 - 6 * (percent * (100 - percent) / 1e4 / (bands * rows)) ** 0.5))
    cells = dealt[0].union(dealt[1]).join(texts, "id").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "role")
    more = materialize(cells.select("key", "i", "j", "role", "id", "comp", "n", "bands", "sig", "text").mapInArrow(_comparer(shingle, percent, hint), "a long, b long"), "smh-links")
    if not more.isEmpty():
        label = components(links.union(more), "smh-components")
    return classes.join(label.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("label", "id").alias("comp"))


def _signed(df: DataFrame, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """rec (the input row but its text), row (long, unique, in the order of the table's files), text, n (set size), fp, bands, sig."""
    base = records_beside(df, text, F.monotonically_increasing_id().alias("row"))
    schema = T.StructType([base.schema["rec"], T.StructField("row", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])
    return materialize(base.mapInArrow(_signer("__text", shingle, bands, rows), schema), "smh-rows")


def near_duplicates(df: DataFrame, text: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Columns rec (the input row but its text), text, row (long, unique), n (set size), comp (smallest row of its component).

    Nulls and texts without words have empty sets, are their own component and link with nothing; they take no part in
    joins. Texts of any length are compared whole. Rows with equal sets are linked. Repeated rows, equal ids and null
    ids don't matter here: rows are told apart by `row`. An empty table gives no rows.
    """
    s = _signed(df, text, shingle, bands, rows)
    label = _labels(s, shingle, percent, bands, rows)
    some = s.where("n > 0").join(label, "fp").select("rec", "text", "row", "n", "comp")
    return some.union(s.where("n = 0").select("rec", "text", "row", "n", F.col("row").alias("comp")))


def near_dedup_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The input's columns with n_shingles, component_id (smallest id of the component; nulls don't count) and kept (the row has that id).

    Every row is returned, repeated ones as often as they occur (all of them kept, if they have the smallest id). An
    input column called n_shingles, component_id or kept gives way. Otherwise as near_duplicates().
    """
    s = _signed(df, text, shingle, bands, rows)
    ident = F.col("rec").getField(doc_id)
    ids = s.where("n > 0").groupBy("fp").agg(F.min(ident).alias("least")).join(_labels(s, shingle, percent, bands, rows), "fp").select("fp", "comp", "least")
    ids = materialize(ids, "smh-ids")
    low = ids.select("fp", "comp").join(ids.groupBy("comp").agg(F.min("least").alias("low")), "comp").select("fp", "low")
    got = s.where("n > 0").join(low, "fp").select("rec", "text", "n", "low").union(s.where("n = 0").select("rec", "text", "n", ident.alias("low")))
    return unpack(got, df.columns, **{text: "text"}, n_shingles="n", component_id="low", kept=F.coalesce(ident == F.col("low"), F.lit(False)))


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The input's rows and columns, one row of each component: that with the smallest id (null last); of several rows
    with this id, repeated ones among them, the first in the order of the table's files. Otherwise as near_duplicates()."""
    s = _signed(df, text, shingle, bands, rows)
    ident = F.col("rec").getField(doc_id)
    first = s.where("n > 0").groupBy("fp").agg(F.min(F.struct(ident.isNull().alias("z"), ident.alias("i"), F.col("row").alias("row"))).alias("o"))
    keep = first.join(_labels(s, shingle, percent, bands, rows), "fp").groupBy("comp").agg(F.min("o").alias("o")).select(F.col("o.row").alias("row"))
    got = s.where("n > 0").join(keep, "row", "left_semi").select("rec", "text").union(s.where("n = 0").select("rec", "text"))
    return unpack(got, df.columns, **{text: "text"}).select(*df.columns)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of `documents` on sets of 2-word shingles: doc_id, n_shingles, component_id, kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup_report(docs, shingle=2).select("doc_id", "n_shingles", "component_id", "kept")
