"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Symbols are words (A-Z lower-cased, without punctuation at their ends). Items of the benchmark are the small side: they
are held in blocks of bounded size, and all documents are read against each block.
Items are classed by length (`lo` to `hi` words, a third apart). A window begins at every word of a document where the
next `lo` words hold as many word pairs of the block as an item with all its edits would leave there: `lo` - 1 - 2 * edits.
That is a lower bound, so no window is lost.
Windows and items go through the random walk of Chakraborty, Goldenberg and Koucky: step j writes the current symbol and
moves on if a random bit of (j, symbol) says so, which maps edit distance to Hamming distance. A walk goes 1.5 * `lo`
steps, which keeps it within the item. Each walk is cut to `BITS` sampled places `TABLES` times, and an equal sample in
the block's hash table makes an item a candidate for the window. How many walks a class needs is found by planting
edited copies of its items until `recall` of them meet; more edits or longer items take more walks. Items of more than `LONG`
words are searched by `k` consecutive parts of about `PART` words: of e edits at most e / k fall into one of them, so a
part within its share of the edits leads to the item wherever the item is. A class that no number of walks brings to
`recall` is searched without: every window that the lossless count leaves is a candidate for each of its items.
Candidates are verified by the exact edit distance of the item to the best-matching part of the document around them.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mnemora.llm.common import WordHashes, materialize, mix64, records, table, text_runs, tidy, unpack

RATE, BITS, TABLES, RECALL, BLOCK_WORDS = 0.15, 4, 4, 0.999, 500_000
#: Numbers of walks to choose from, and planted copies to choose by.
WALKS, TRIALS = (1, 2, 4, 6, 8, 12, 16, 24, 32, 48, 64), 600
#: Words beyond which an item is searched by parts, and words of a part.
LONG, PART = 220, 110
#: Bytes of text that are searched at once.
RUN_BYTES = 3_000_000
_EDGE = b".,;:!?\"'()[]{}"


class Symbols(WordHashes):
    """Memo of symbols: odd 64-bit hashes of words without the punctuation at their ends (0 pads)."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.strip(_EDGE) or word) | 1
        return h

    def read(self, text: bytes) -> np.ndarray:
        return self.of(text.lower().split())


def allowed(n: int, rate: float) -> int:
    return int(rate * n + 1e-9)


def walk_keys(line: np.ndarray, starts: np.ndarray, walks: int, steps: int) -> np.ndarray:
    """Sampled keys [starts, walks * TABLES] of the walks that begin at `starts` of a line of symbols. 0 ends a text: walks stay there."""
    salt = mix64(np.arange(1, walks * steps + 1, dtype=np.uint64)).reshape(walks, steps)
    pick = (mix64(np.arange(1, walks * TABLES * BITS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(steps)).astype(np.int64).reshape(walks, TABLES, BITS)
    place = np.repeat(starts[None], walks, 0)
    code = np.empty((steps, walks, len(starts)), np.uint64)
    for j in range(steps):
        c = code[j] = line[place]
        place += (mix64(c ^ salt[:, j, None]) & np.minimum(c, np.uint64(1))).astype(np.int64)
    walk = np.arange(walks)[:, None]
    key = np.repeat(np.arange(1, walks * TABLES + 1, dtype=np.uint64).reshape(walks, TABLES, 1), len(starts), 2)
    with np.errstate(over="ignore"):
        for b in range(BITS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + code[pick[:, :, b], walk])
    return key.reshape(-1, len(starts)).T


def laid_out(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all sequences in one line, each followed by 0, and where each begins."""
    n = np.array([len(s) + 1 for s in seqs], np.int64)
    end = np.zeros(1, np.uint64)
    return np.concatenate([end[:0], *[x for s in seqs for x in (s, end)]]), np.cumsum(n) - n


def _column_ends(item: list[int], text: list[int], free: bool) -> list[int]:
    """Edits of the whole item against text[:j], for j = 0, 1, ...; free: the part may begin anywhere. Bit-parallel (Myers 1999), on whole numbers of any size."""
    m, top = len(item), 1 << (len(item) - 1)
    peq: dict[int, int] = {}
    for i, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << i
    full, plus, minus, score = (1 << m) - 1, (1 << m) - 1, 0, m
    out = [score]
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | minus
        xh = ((eq & plus) + plus ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full | (not free), down << 1 & full
        plus, minus = down | ~(xv | up) & full, up & xv
        out.append(score)
    return out


def best_part(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """(edits, start, end) of the part of `text` nearest to `item`: of equal ones that which ends first, then the longest."""
    ends = _column_ends(item, text, True)
    cost = min(ends)
    end = ends.index(cost)
    back = _column_ends(item[::-1], text[:end][::-1], False)
    return cost, end - (len(back) - 1 - back[::-1].index(cost)), end


class LengthClass:
    """Parts of `lo` to `hi` words (short items whole): steps and number of walks, and the hash table from sampled keys to parts."""

    def __init__(self, lo: int, hi: int, items: np.ndarray, rate: float, edits: int = 0) -> None:
        self.lo, self.items = lo, items
        self.need = max(1, lo - 1 - 2 * max(allowed(hi, rate), edits))
        self.steps = max(1, lo * 3 // 2 if lo >= 8 else lo)
        self.walks = 1

    def plant(self, seqs: list[np.ndarray], rate: float, recall: float) -> int:
        """The least of WALKS by which `recall` of planted copies with all edits meet their item; 0 if none does."""
        r = random.Random(self.lo)
        pairs = []
        for trial in range(TRIALS):
            s = seqs[self.items[trial % len(self.items)]]
            x = s.tolist()
            for _ in range(allowed(len(s), rate)):
                at = r.randrange(len(x))
                x[at : at + 1] = r.choice([[], [r.getrandbits(63) | 1], [x[at], r.getrandbits(63) | 1]])
            pairs.append((s, np.array([*x, *(r.getrandbits(63) | 1 for _ in range(self.steps))], np.uint64)))
        keys = [walk_keys(*laid_out(list(side)), WALKS[-1], self.steps) for side in zip(*pairs, strict=True)]
        met = (keys[0] == keys[1]).reshape(TRIALS, WALKS[-1], TABLES).any(2)
        return next((w for w in WALKS if met[:, :w].any(1).mean() >= recall), 0)

    def index(self, line: np.ndarray, begin: np.ndarray) -> None:
        if not self.walks:
            return
        keys = walk_keys(line, begin[self.items], self.walks, self.steps)
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.owner = keys.ravel()[order], np.repeat(self.items, keys.shape[1])[order]

    def meet(self, line: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of every window that shares a sampled key with an item, once each."""
        if not self.walks:
            return np.repeat(starts, len(self.items)), np.tile(self.items, len(starts))
        found = []
        for a in range(0, len(starts), 1024):
            some = starts[a : a + 1024]
            keys = walk_keys(line, some, self.walks, self.steps)
            low, high = np.searchsorted(self.keys, keys.ravel(), "left"), np.searchsorted(self.keys, keys.ravel(), "right")
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            found.append(np.unique(np.stack([np.repeat(np.repeat(some, keys.shape[1]), n), self.owner[at]], 1), axis=0))
        return tuple(np.concatenate(found).T) if found else (starts, starts)


class Items:
    """One block of the benchmark: symbols, word pairs, and length classes with their hash tables."""

    def __init__(self, rows: list[tuple[object, bytes]], rate: float, recall: float, walks: list[int] | None = None) -> None:
        """walks: of each class, where they have been found before."""
        memo = Symbols()
        self.ids = [i for i, _ in rows]
        self.seq = [memo.read(t) for _, t in rows]
        n = np.array([len(s) for s in self.seq])
        self.edits = np.array([allowed(int(x), rate) for x in n])
        # what is searched: an item, or its parts with their share of its edits
        cut = [(i, len(s) * p // k, len(s) * (p + 1) // k, k) for i, s in enumerate(self.seq) for k in (1 if len(s) <= LONG else -(-len(s) // PART),) for p in range(k)]
        self.item, self.offset = np.array([c[0] for c in cut], np.int64), np.array([c[1] for c in cut], np.int64)
        seqs, share = [self.seq[i][a:b] for i, a, b, _ in cut], np.array([self.edits[i] // k for i, _, _, k in cut], np.int64)
        m = np.array([len(s) for s in seqs])
        self.classes: list[LengthClass] = []
        left = np.unique(m)
        while len(left):
            lo = int(left[0])
            hi = max(lo, lo * 4 // 3)
            own = np.flatnonzero((m >= lo) & (m <= hi))
            self.classes.append(LengthClass(lo, hi, own, rate, int(share[own].max())))
            left = left[left > hi]
        line, begin = laid_out(seqs)
        for i, c in enumerate(self.classes):
            c.walks = walks[i] if walks else c.plant(seqs, rate, recall)
            c.index(line, begin)
        self.parts = {}
        for k in (1, 2):  # single words seed items of one word, pairs all others
            h = np.unique(np.concatenate([np.zeros(0, np.uint64), *[run_hashes(s, k) for s in self.seq if (len(s) == 1) == (k == 1)]]))
            bloom = np.zeros(1 << 22, bool)
            bloom[(h & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.parts[k] = (h, bloom)

    def _marks(self, line: np.ndarray, k: int) -> np.ndarray:
        """Running count of the line's k-word runs that are the block's."""
        h, bloom = self.parts[k]
        r = run_hashes(line, k)
        at = np.flatnonzero(bloom[(r & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(at):
            at = at[h[np.minimum(np.searchsorted(h, r[at]), len(h) - 1)] == r[at]]
        out = np.zeros(len(line) + 1, np.int32)
        out[at + 1] = 1
        return np.cumsum(out, dtype=np.int32)

    def hits(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item, edits, start, end) of each item within its edits of a part of the text, in words; the best part of each."""
        line, begin = laid_out(texts)
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        near: dict[tuple[int, int], list[int]] = {}
        marks = {k: self._marks(line, k) for k in {min(c.lo, 2) for c in self.classes}}
        for c in self.classes:
            m, span = marks[min(c.lo, 2)], max(1, c.lo - 1)
            if not m[-1]:
                continue
            # a window may begin after the last pairs that it has room for; the line's end is cut off
            count = m[np.minimum(np.arange(len(line)) + span, len(line))] - m[:-1]
            starts, parts = c.meet(line, np.flatnonzero(count >= c.need))
            text = np.searchsorted(begin, starts, "right") - 1
            for d, b, i in zip(text.tolist(), (starts - begin[text] - self.offset[parts]).tolist(), self.item[parts].tolist(), strict=True):
                near.setdefault((d, i), []).append(b)
        for (d, i), places in near.items():
            e, n = int(self.edits[i]), len(self.seq[i])
            regions: list[list[int]] = []
            for b in sorted(places):
                if regions and b - e <= regions[-1][1]:
                    regions[-1][1] = b + n + e
                else:
                    regions.append([max(0, b - e), b + n + e])
            for low, high in regions:
                cost, x, y = best_part(self.seq[i].tolist(), texts[d][low:high].tolist())
                if cost <= e and (cost, low + x) < out[d].get(i, (1 << 60,))[:2]:
                    out[d][i] = (cost, low + x, low + y)
        return [[(i, *v) for i, v in sorted(found.items())] for found in out]


def run_hashes(s: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(s) - k + 1)
    acc = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + s[j : j + n])
    return acc


_held: dict[str, Items] = {}


def _items(name: str, rows: list[tuple[object, bytes]], rate: float, recall: float, walks: list[int]) -> Items:
    """The block's tables, made once in a worker process; those of one block are held at a time."""
    if name not in _held:
        _held.clear()
        _held[name] = Items(rows, rate, recall, walks)
    return _held[name]


def leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, recall: float = RECALL) -> DataFrame:
    """Columns rec (the input row), row, and hits: an array of (item_id, edits, start, end), sorted by item. Rows without hits have an empty array.

    An item of n words is found in parts within floor(rate * n) edits of it. Null texts and texts without words have no
    hits, nor do items without words; texts and items of any length are read whole. An item is found however often it is
    listed, and an id with several texts has a hit for each that is found. Of parts with equally many edits that which
    begins first counts; different items may share a part. Repeated rows have hits of their own; an empty table or
    benchmark gives none. Columns of the input stay in `rec`, so their names don't matter.
    The benchmark is read to the driver in blocks of at most BLOCK_WORDS words (or one item); a block is one pass over
    the documents, and of several passes each is written before the next block is read, so one block is held at a time.
    """
    spark = df.sparkSession
    base = records(df, F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("__text"))
    ident = benchmark.schema[item_id].dataType
    hit = T.ArrayType(T.StructType([T.StructField("item_id", ident), T.StructField("edits", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    def scan(docs: DataFrame, rows: list[tuple[object, bytes]]) -> DataFrame:
        walks = [c.walks for c in Items(rows, rate, recall).classes]
        name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(rows)  # at most BLOCK_WORDS words
        kept = [c for c in docs.columns if c != "__text"]

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, memo = _items(name, shared.value, rate, recall, walks), Symbols()
            for batch in batches:
                for part, texts in text_runs(batch, "__text", RUN_BYTES):
                    hits = items.hits([memo.read(t) for t in texts])
                    memo.trim()
                    found = [[{"item_id": items.ids[i], "edits": e, "start": x, "end": y} for i, e, x, y in one] for one in hits]
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(found, to_arrow_type(hit))], names=[*kept, "hits"])

        return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], T.StructField("hits", hit)]))

    blocks = _blocks(benchmark.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null"))
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return base.select("rec", "row", F.array().cast(hit).alias("hits"))
    if second is None:
        return scan(base, first).select("rec", "row", F.array_sort("hits").alias("hits"))
    every: DataFrame | None = None
    for rows in chain([first, second], blocks):
        got = materialize(scan(base.select("row", "__text"), rows).where(F.size("hits") > 0), "leaks")
        every = got if every is None else every.union(got)
    sums = every.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))  # a document's own hits
    return base.select("rec", "row").join(sums, "row", "left").select("rec", "row", F.coalesce("hits", F.array().cast(hit)).alias("hits"))


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, bytes]]]:
    held, size = [], 0
    for r in items.toLocalIterator():
        t = r["t"].encode()
        n = len(t.split())
        if not n:
            continue
        if held and size + n > BLOCK_WORDS:
            yield held
            held, size = [], 0
        held.append((r["i"], t))
        size += n
    if held:
        yield held


def decontaminate(df: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The input's rows and columns, without rows that have hits (see leaks()). Null and empty texts stay."""
    return unpack(leaks(df, benchmark, **options).where(F.size("hits") == 0), df.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (doc_id, item_id) with a part of the document within the item's edits: edits, start and end in words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = leaks(docs, table(spark, sf_dir, "benchmark"))
    return got.select(F.col("rec.doc_id").alias("doc_id"), F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.edits", "h.start", "h.end")
