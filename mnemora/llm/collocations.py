"""Phrase collocations: a minimal perfect hash over Apriori-safe candidates, counted in arrays by slot.

Frequent words of each language get numbers, and the texts become a stored stream of numbers. Then, for phrases of 2, 3 and
4 words in turn:

1. A phrase is a candidate only if both phrases of one word less in it are frequent, and if the bucket that its key falls
   into reaches the support in all (mappers fill arrays of buckets, which are summed in a tree and saturate there).
   Neither test can lose a frequent phrase.
2. A minimal perfect hash numbers the distinct candidates. A key is (slot of the first words, number of the last word), so
   it stands for its phrase exactly; it is stored by slot and compared at each lookup.
3. Mappers `bincount` slots into arrays; the arrays' pieces are summed in a tree of tasks, and frequent slots stay.

Cuts are read by slot from the counts of the shorter phrases. Only structures of at most `slots` keys are built and sent to
mappers. Where the candidates of a level are more, their counts are sums over shuffled rows of keys; where the frequent
words or phrases of a level are more, all phrases are counted as rows of text (`by_rows`). Results are the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.llm.common import delete, give_back, materialize, mix64, owned, table, text_runs, tidy

SUPPORT, LONGEST, TOP, INSIDE_PERCENT = 30, 4, 2_000, 80
#: Most keys of a structure that mappers hold; most buckets of the pre-count (a byte each; one for four words of the corpus); slots of a piece; arrays that one task adds up.
SLOTS, BUCKETS, PIECE, FAN = 1 << 22, 1 << 27, 1 << 16, 64
#: Words that a mapper counts, and keys that it gathers, before it hands on.
MEMO, KEYS = 150_000, 500_000
CUTS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", b"\n" * 10)
LAST = np.uint64((1 << 32) - 1)
RESULT = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


class PerfectHash:
    """Distinct 64-bit keys to 0 .. n - 1. A key is placed at the first level where it meets no other; its slot is the number of placed keys before it."""

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        left, before = keys, 0
        while len(left):
            if len(self.levels) == 100:
                raise ValueError("keys repeat")
            size = -(-2 * len(left) // 64) * 64
            at = self._place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(bits).astype(np.int64)
            self.levels.append((bits, before + np.cumsum(ones) - ones, size))
            before += int(ones.sum())
            left = left[~alone[at]]
        self.keys = keys
        slot = self.slots(keys)
        self.keys = np.empty_like(keys)
        self.keys[slot] = keys

    def __len__(self) -> int:
        return len(self.keys)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key, whether it was built in or not; -1 where no level has its place."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, base, size) in enumerate(self.levels):
            at = self._place(keys[left], level, size)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = word >> bit & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = base[at[hit] >> 6] + np.bitwise_count(below)
            left = left[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, verified against the stored ones; -1 for others."""
        slot = self.slots(keys)
        known = slot >= 0
        known[known] = self.keys[slot[known]] == keys[known]
        return np.where(known, slot, -1)


@dataclass
class Level:
    """Frequent phrases of one length (words are length 1): slots and, by slot, counts. `other`: more bits of words' keys."""

    slot: PerfectHash
    count: np.ndarray
    other: np.ndarray | None = None

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, other: np.ndarray | None = None) -> Level:
        slot = PerfectHash(keys)
        order = np.argsort(slot.slots(keys))
        return cls(slot, counts[order], None if other is None else other[order])


def keys_of(lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of a language's words, in halves."""
    digest = partial(xxhash.xxh3_128_digest, seed=xxhash.xxh3_64_intdigest(lang.encode()))
    both = np.frombuffer(b"".join(map(digest, words)), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 1], both[:, 0]


class Numbers:
    """Numbers of the frequent words of one language, -1 for others; what a worker has met is kept."""

    def __init__(self, lang: str, words: Level) -> None:
        self.lang, self.words = lang, words
        self.of: dict[bytes, int] = {}

    def learn(self, words: set[bytes]) -> None:
        new = list(words.difference(self.of))
        if len(self.of) + len(new) > MEMO:
            self.of, new = {}, list(words)
        if new:
            low, high = keys_of(self.lang, new)
            got = self.words.slot.find(low)
            known = got >= 0
            known[known] = self.words.other[got[known]] == high[known]
            self.of.update(zip(new, np.where(known, got, -1).tolist(), strict=True))

    def stream(self, texts: list[bytes]) -> list[int]:
        """The numbers of folded texts' words, -1 at the end of each piece."""
        pieces = [piece.split() for t in texts for piece in t.split(b"\n")]
        self.learn(set().union(*pieces))
        out: list[int] = []
        for words in pieces:
            if words:
                out += map(self.of.__getitem__, words)
                out.append(-1)
        return out


def fold(text: bytes) -> bytes:
    """A-Z in lower case; the characters that part pieces are line ends."""
    return text.lower().translate(CUTS)


def _langs(batch: pa.RecordBatch) -> list[str]:
    return batch.column("lang").to_pylist()


def count_words(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[bytes]] = {}

        def drain() -> Iterator[pa.RecordBatch]:
            for lang, c in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])
            seen.clear()

        for batch in batches:
            for part, texts in text_runs(batch, "text"):
                for lang, t in zip(_langs(part), texts, strict=True):
                    seen.setdefault(lang, Counter()).update(fold(t).split())
                if sum(map(len, seen.values())) > MEMO:
                    yield from drain()
        yield from drain()

    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def number_streams(rows: DataFrame, words: Any) -> DataFrame:
    """(ids): the texts of a run as one stream of numbers of 32 bits."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Numbers] = {}
        for batch in batches:
            for part, texts in text_runs(batch, "text"):
                ids: list[int] = []
                for lang in dict.fromkeys(langs := _langs(part)):
                    if lang not in by:
                        if len(by) > 100:
                            by.clear()
                        by[lang] = Numbers(lang, words.value)
                    ids += by[lang].stream([fold(t) for t, x in zip(texts, langs, strict=True) if x == lang])
                yield pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int32).tobytes()], pa.binary())], names=["ids"])

    return rows.mapInArrow(run, "ids binary")


def joined(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of phrases of k words whose first and whose last k - 1 words are frequent. s: slots of phrases of k - 1 words by place."""
    n = max(len(ids) - k + 1, 0)
    at = np.flatnonzero((s[:n] >= 0) & (s[1 : n + 1] >= 0))
    return s[at].astype(np.uint64) << np.uint64(32) | ids[at + k - 1].astype(np.uint64), at


def next_keys(ids: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Keys of all Apriori-safe phrases one word longer than the last level's."""
    s = ids
    for k, level in enumerate(levels[1:], 2):
        keys, at = joined(s, ids, k)
        s = np.full(len(ids), -1, np.int64)
        s[at] = level.slot.find(keys)
    return joined(s, ids, len(levels) + 1)[0]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(buckets)).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], keys_of: Callable[[np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
    """Keys of a task's streams, in portions of about KEYS."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for b in batch.column("ids"):
            held.append(keys_of(np.frombuffer(b.as_buffer(), np.int32).astype(np.int64)))
            size += len(held[-1])
            if size > KEYS:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


PIECES = "piece int, node int, at binary, n binary"


def pieces(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What is not 0 of a task's array, by pieces."""
    node = TaskContext.get().partitionId()
    for piece in range(-(-len(counts) // PIECE)):
        part = counts[piece * PIECE : (piece + 1) * PIECE]
        at = np.flatnonzero(part)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([node], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())], names=["piece", "node", "at", "n"])


def tree_sum(parts: DataFrame, leaves: int, kind: type, most: int | None = None) -> DataFrame:
    """Sums arrays piece by piece, FAN at a time, until each piece is one. most: sums stop there."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(PIECE, np.int64)
        for at, n in zip(group["at"].to_pylist(), group["n"].to_pylist(), strict=True):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, kind)
        at = np.flatnonzero(total)
        kept = (total if most is None else np.minimum(total, most)).astype(kind)[at]
        give_back()
        return pa.table({"piece": group["piece"][:1], "node": group["node"][:1], "at": pa.array([at.astype(np.uint16).tobytes()], pa.binary()), "n": pa.array([kept.tobytes()], pa.binary())})

    while True:
        leaves = -(-leaves // FAN)
        parts = parts.withColumn("node", F.expr(f"cast(node div {FAN} as int)")).groupBy("piece", "node").applyInArrow(add, PIECES)
        if leaves <= 1:
            return parts


def heavy_buckets(streams: DataFrame, held: Any, buckets: int) -> np.ndarray:
    """A bit for each bucket whose keys reach the support together."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.uint8)
        for keys in _gathered(batches, lambda ids: next_keys(ids, held.value)):
            b, n = np.unique(bucket_of(keys, buckets), return_counts=True)
            counts[b] = np.minimum(counts[b] + n, SUPPORT)
        yield from pieces(counts)

    heavy = np.zeros(buckets, bool)
    for row in tree_sum(streams.mapInArrow(run, PIECES), streams.rdd.getNumPartitions(), np.uint8, SUPPORT).toLocalIterator():  # at most BUCKETS bytes
        at = row["piece"] * PIECE + np.frombuffer(row["at"], np.uint16).astype(np.int64)
        heavy[at[np.frombuffer(row["n"], np.uint8) >= SUPPORT]] = True
    return np.packbits(heavy, bitorder="little")


def safe_keys(streams: DataFrame, held: Any, buckets: int, counted: bool = False) -> DataFrame:
    """Distinct Apriori-safe keys in heavy buckets (key), or with their counts, of those that reach the support (key, n).
    held: (levels, bits of the buckets). Distinct keys travel as sorted arrays, a row for each task and range of hashes, and
    are united in a tree; a range is small at any size, as there are more of them in a larger corpus."""

    def heavy(keys: np.ndarray) -> np.ndarray:
        b = bucket_of(keys, buckets)
        return keys[held.value[1][b >> 3] >> (b & 7).astype(np.uint8) & 1 == 1]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # a task hands a key on once, as long as its keys are few
        for more in _gathered(batches, lambda ids: heavy(next_keys(ids, held.value[0]))):
            keys, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, np.ones(len(more), np.int64)]), len(keys)).astype(np.int64)
            if len(keys) > KEYS:
                yield keys, n
                keys, n = keys[:0], n[:0]
        yield keys, n

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in gathered(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    if counted:
        return streams.mapInArrow(rows, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT)
    ranges = max(1, buckets >> 16)

    @tidy
    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        for keys, _ in gathered(batches):
            where = bucket_of(keys, ranges)
            order = np.argsort(where, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(keys) else ():
                yield pa.RecordBatch.from_arrays([pa.array(where[part[:1]], pa.int32()), pa.array([node], pa.int32()), pa.array([keys[part].tobytes()], pa.binary())], names=["piece", "node", "keys"])

    def unite(group: pa.Table) -> pa.Table:
        keys = np.unique(np.frombuffer(b"".join(group["keys"].to_pylist()), np.uint64))
        give_back()
        return pa.table({"piece": group["piece"][:1], "node": group["node"][:1], "keys": pa.array([keys.tobytes()], pa.binary())})

    @tidy
    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys in batch.column("keys"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys.as_buffer(), np.int64))], names=["key"])

    schema, leaves = "piece int, node int, keys binary", streams.rdd.getNumPartitions()
    parts = streams.mapInArrow(arrays, schema)
    while True:
        leaves = -(-leaves // FAN)
        parts = parts.withColumn("node", F.expr(f"cast(node div {FAN} as int)")).groupBy("piece", "node").applyInArrow(unite, schema)
        if leaves <= 1:
            return parts.mapInArrow(spelled, "key long")


def count_slots(streams: DataFrame, held: Any) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of the candidates that reach the support. held: (levels, perfect hash of the candidates)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(held.value[1]), np.int64)
        for keys in _gathered(batches, lambda ids: next_keys(ids, held.value[0])):
            slot = held.value[1].find(keys)
            counts += np.bincount(slot[slot >= 0], minlength=len(counts))
        yield from pieces(counts)

    @tidy
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["n"], np.int64)
                at = row["piece"] * PIECE + np.frombuffer(row["at"], np.uint16).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at[n >= SUPPORT]), pa.array(n[n >= SUPPORT])], names=["slot", "n"])

    got = tree_sum(streams.mapInArrow(run, PIECES), streams.rdd.getNumPartitions(), np.int64).mapInArrow(frequent, "slot long, n long").toArrow()  # at most `slots` rows
    return got["slot"].to_numpy(), got["n"].to_numpy()


def phrase_levels(streams: DataFrame, words: Level, slots: int) -> list[Level] | None:
    """Frequent phrases of 1 to LONGEST words; None where a level has more than `slots` of them."""
    share, levels = streams.sparkSession.sparkContext.broadcast, [words]
    buckets = int(np.clip(1 << int(words.count.sum() // 4).bit_length(), PIECE, BUCKETS))
    for _ in range(2, LONGEST + 1):
        scratch: list[str] = []
        with owned(scratch):
            held = share(levels)
            bits = heavy_buckets(streams, held, buckets)
            held.destroy()
            held = share((levels, bits))
            keys = materialize(safe_keys(streams, held, buckets), "candidates")
            if few := keys.count() <= slots:
                hashed = PerfectHash(_unsigned(keys.toArrow()["key"]))
                arrays = share((levels, hashed))
                slot, n = count_slots(streams, arrays)
                arrays.destroy()
                level = Level.of(hashed.keys[slot], n)
            else:  # too many for arrays: their counts come in rows
                keys = materialize(safe_keys(streams, held, buckets, counted=True), "counted")
                if few := keys.count() <= slots:
                    got = keys.toArrow()
                    level = Level.of(_unsigned(got["key"]), got["n"].to_numpy())
            held.destroy()
            delete(streams.sparkSession, scratch)
        if not few:
            return None
        levels = [*levels, level]
    return levels


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def words_of(levels: list[Level], k: int, slot: np.ndarray) -> list[np.ndarray]:
    """Numbers of the words of phrases of k words."""
    out: list[np.ndarray] = []
    for n in range(k, 1, -1):
        key = levels[n - 1].slot.keys[slot]
        out.insert(0, (key & LAST).astype(np.int64))
        slot = (key >> np.uint64(32)).astype(np.int64)
    return [slot, *out]


def slot_of(levels: list[Level], words: list[np.ndarray]) -> np.ndarray:
    """Slots of frequent phrases by their words."""
    slot = words[0]
    for n, w in enumerate(words[1:], 2):
        slot = levels[n - 1].slot.find(slot.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64))
    return slot


def read_cuts(spark: SparkSession, levels: list[Level], vocabulary: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r): each candidate phrase that no longer one covers; l and r hold the counts for each cut, from the first on."""
    held = spark.sparkContext.broadcast(levels)
    lists = pa.list_(pa.int64())
    sizes = [len(level.slot) for level in levels]
    rows = spark.range(0, sum(sizes[1:])).withColumnRenamed("id", "row")
    firsts = np.cumsum([0, *sizes[1:]]).tolist()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            row = batch.column("row").to_numpy()
            for k in range(2, LONGEST + 1):
                mine = row[(row >= firsts[k - 2]) & (row < firsts[k - 1])]
                if not len(mine):
                    continue
                slot = mine - firsts[k - 2]
                words, a = words_of(own, k, slot), own[k - 1].count[slot]
                parts = {(i, j): slot_of(own, words[i:j]) for i in range(k) for j in range(i + 1, k + 1) if j - i < k}
                number = lambda i, j: own[j - i - 1].count[parts[i, j]]  # noqa: B023, E731
                l, r = np.stack([number(0, c) for c in range(1, k)], 1), np.stack([number(c, k) for c in range(1, k)], 1)
                hides = [np.where(100 * a >= INSIDE_PERCENT * number(i, j), firsts[j - i - 2] + parts[i, j], -1) for i, j in parts if j - i >= 2] or [np.full(len(a), -1)]
                yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(list(np.stack(words, 1)), lists), pa.array(a), pa.array(list(l), lists), pa.array(list(r), lists), pa.array(list(np.stack(hides, 1)), lists)], names=["row", "words", "a", "l", "r", "hides"])

    cuts = rows.mapInArrow(run, "row long, words array<long>, a long, l array<long>, r array<long>, hides array<long>")
    hidden = cuts.select(F.explode("hides").alias("row")).where("row >= 0").distinct()
    kept = cuts.drop("hides").join(hidden, "row", "left_anti")
    spelled = kept.select("row", F.posexplode("words").alias("at", "number")).join(vocabulary, "number").groupBy("row").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    return kept.join(spelled, "row").select("lang", "phrase", "a", "l", "r")


def by_rows(rows: DataFrame) -> DataFrame:
    """The same as read_cuts() from shuffled rows of phrases, for vocabularies and candidates of any number."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_runs(batch, "text"):
                for lang in set(langs := _langs(part)):
                    yield from _phrases(lang, [fold(t) for t, x in zip(texts, langs, strict=True) if x == lang])

    all_ = rows.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    f = materialize(all_.where(F.col("n") >= SUPPORT), "phrases")
    word = F.split("phrase", " ")
    some = f.withColumn("w", word).where("size(w) > 1").withColumnRenamed("n", "a")
    part = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    cut = some.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    side = lambda key, n: f.select("lang", F.col("phrase").alias(key), F.col("n").alias(n))
    cut = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    cuts = cut.groupBy("lang", "phrase", "a").agg(F.array_sort(F.collect_list(F.struct("k", "l", "r"))).alias("c")).select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"))
    inner = some.select("lang", F.col("a").alias("over"), "w", F.explode(F.expr("filter(flatten(transform(sequence(2, greatest(2, size(w) - 1)), n -> transform(sequence(1, size(w) - n + 1), i -> struct(i, n)))), s -> s.n < size(w))")).alias("s"))
    inner = inner.select("lang", "over", F.expr("array_join(slice(w, s.i, s.n), ' ')").alias("phrase")).groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    hidden = inner.join(f, ["lang", "phrase"]).where(100 * F.col("over") >= INSIDE_PERCENT * F.col("n")).select("lang", "phrase")
    return cuts.join(hidden, ["lang", "phrase"], "left_anti")


def _phrases(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Distinct phrases of a run with their counts."""
    numbers: dict[bytes, int] = {}
    ids: list[int] = []
    for t in texts:
        for piece in t.split(b"\n"):
            ids += [numbers.setdefault(w, len(numbers)) for w in piece.split()]
            ids.append(-1)
    words, one = list(numbers), np.array(ids, np.int64)
    s = one
    for k in range(1, LONGEST + 1):
        at = np.flatnonzero(one >= 0) if k == 1 else joined(s, one, k)[1]
        key = one[at] if k == 1 else s[at] * max(len(words), 1) + one[at + k - 1]
        _, first, same, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        s = np.full(len(one), -1, np.int64)
        s[at] = same
        text = [b" ".join(words[w] for w in ids[i : i + k]) for i in at[first].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text), pa.string()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"])


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, slots: int = SLOTS) -> DataFrame:
    """RESULT for each language: its `top` phrases by their lowest-scoring cut.

    Null texts are empty, a null language is `und` (as one of that name); an empty table, and languages without a
    frequent phrase, have no rows. Repeated rows count each time; texts are read whole. Ties go to the higher count, then to the phrase that comes
    first in UTF-8. Other columns play no part, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    scratch: list[str] = []
    with owned(scratch):
        every = materialize(count_words(rows), "words")
        totals = materialize(every.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        frequent = every.where(F.col("n") >= SUPPORT)
        many = frequent.count() > slots
        vocabulary = None if many else materialize(with_keys(frequent), "vocabulary")
    levels = None
    if vocabulary is not None:
        own = vocabulary.select("low", "high", "n").toArrow()  # at most `slots` rows
        low = _unsigned(own["low"])
        if len(np.unique(low)) == len(low):
            words = Level.of(low, own["n"].to_numpy(), _unsigned(own["high"]))
            inner: list[str] = []
            held = spark.sparkContext.broadcast(words)
            with owned(inner):
                streams = materialize(number_streams(rows, held), "streams")
            held.destroy()
            levels = phrase_levels(streams, words, slots)
            delete(spark, inner)
    if levels is None:
        found = by_rows(rows)
    else:
        held = spark.sparkContext.broadcast(levels[0].slot)

        @tidy
        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("word"), pa.array(held.value.find(b.column("low").to_numpy().view(np.uint64)))], names=["lang", "word", "number"])

        found = read_cuts(spark, levels, vocabulary.select("lang", "word", "low").mapInArrow(number, "lang string, word string, number long"))
    # exact at any size: products have up to 28 digits
    score = "array_min(transform(l, (x, i) -> struct(cast((2000000 * cast(a as decimal(20, 0))) div (cast(x as decimal(20, 0)) + cast(r[i] as decimal(20, 0))) as bigint) as score, i as k, x as l, r[i] as r)))"
    scored = found.withColumn("cut", F.expr(score)).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", place).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def with_keys(words: DataFrame) -> DataFrame:
    """(lang, word, n, low, high): the two halves of each word's key."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang in pc.unique(b.column("lang")).to_pylist():
                own = b.filter(pc.equal(b.column("lang"), lang))
                half = [pa.array(h.view(np.int64)) for h in keys_of(lang, [w.encode() for w in own.column("word").to_pylist()])]
                yield pa.RecordBatch.from_arrays([own.column("lang"), own.column("word"), own.column("n"), *half], names=["lang", "word", "n", "low", "high"])

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, word string, n long, low long, high long")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of `documents`."""
    return collocations(table(spark, sf_dir, "documents"))


_PART = lambda i, j: f"array_to_string(w[{i} : {j}], ' ')"
OP12_SQL = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, {_PART("i", "i + k - 1")} AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL), t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {SUPPORT}),
cut AS (SELECT c.lang, c.k, c.phrase, a, j, x.n AS l, y.n AS r, (2000000::HUGEINT * a // (x.n + y.n))::BIGINT AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f x ON x.lang = c.lang AND x.phrase = {_PART(1, "j")} JOIN f y ON y.lang = c.lang AND y.phrase = {_PART("j + 1", "c.k")}),
low AS (SELECT lang, phrase, a, l, r, score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sub AS (SELECT lang, {_PART("i", "i + n - 1")} AS phrase, a FROM (SELECT lang, w, a, n, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM c))),
hid AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN sub USING (lang, phrase) WHERE 100 * sub.a >= {INSIDE_PERCENT} * c.a)
SELECT lang, rank, phrase, a, l, r, t.n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low ANTI JOIN hid USING (lang, phrase)) JOIN t USING (lang) WHERE rank <= {TOP}"""
