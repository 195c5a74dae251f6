"""LM scoring with a weighted backoff automaton whose states and arcs are tables dealt by hash.

Counts cover the whole training side, and the model grows with it: all words are kept, and all bigrams and trigrams that
stand at least `MIN_GRAM` times, at any size. A state is a context (its count, and the mass of its kept continuations);
an arc is an n-gram with its count. Neither meets the driver or a broadcast. Texts are taken in chunks of bounded size;
a chunk asks the parts of the table for the n-grams that it holds, in three rounds:

1. words and bigrams: counts. Of the chunks that hold an n-gram, one is told that it owns it.
2. trigrams whose bigrams are kept (others can't be): counts; owners of bigrams give their discounted counts to the state
   of the first word, and every chunk reads the sums for its words.
3. the same for trigrams and the states of two words.

Chunks send each n-gram once, so that a common one is a number a chunk in its part. Chunks and answers are dealt into the
same buckets when they are written, so that they meet without being shuffled. With the answers a chunk has all
states and arcs that its texts pass, and follows them for all tokens at once: an arc's probability is its discounted
share plus the failure arc's mass times the probability in the suffix. `Automaton` is the same model, state by state.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.llm.common import WordHashes, dealt, mix64, records_beside, table, text_runs, unpack

MIN_GRAM, DISCOUNT = 2, 0.5
#: Bytes of text in a chunk, and tokens for each part of the tables.
CHUNK_BYTES, PART_TOKENS = 4_000_000, 1_000_000
#: Hash that stands for the end of a text (a token of its own; words are hashed from other bytes).
END = xxhash.xxh3_64_intdigest(b"\n<end>\n")


def _hashes(memo: WordHashes, texts: list[bytes]) -> list[np.ndarray]:
    out = []
    for t in texts:
        words = t.lower().split()
        words.append(b"")  # the end's place
        h = memo.of(words)
        h[-1] = END
        out.append(h)
    memo.trim()
    return out


def _dump(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps(arrays, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _load(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))


def _planes(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, lowest bytes first, so that the high bytes compress."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _keys(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def _tight(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()))) if x.dtype.kind != "f" and len(x) else x


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of n-grams, of 52 bits (the highest ones), as keys are most of what is moved."""
    with np.errstate(over="ignore"):
        return mix64(mix64(a) * np.uint64(0x9E3779B97F4A7C15) + b) & np.uint64(0xFFFFFFFFFFFFF000)


class Chunk:
    """Texts as distinct words' hashes and places among them, with what has been learnt of their n-grams."""

    def __init__(self, words: np.ndarray, at: np.ndarray, lens: np.ndarray, train: np.ndarray) -> None:
        self.words, self.at, self.lens = words, at.astype(np.int64), lens
        self.train = np.repeat(train, lens)
        self.place = np.arange(len(at)) - np.repeat(np.cumsum(lens) - lens, lens)
        # the token's bigram and trigram end at it; those without are left out
        self.i2 = np.flatnonzero(self.place >= 1)
        key2 = _mix(words[self.at[self.i2 - 1]], words[self.at[self.i2]])
        self.keys2, first, self.of2 = np.unique(key2, return_index=True, return_inverse=True)
        self.u2, self.v2 = self.at[self.i2[first] - 1], self.at[self.i2[first]]

    def counts(self, of: np.ndarray, tokens: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(of[self.train[tokens]], minlength=size)

    def ask_words(self) -> list[tuple[np.ndarray, np.ndarray]]:
        every = np.arange(len(self.at))
        return [(self.words, self.counts(self.at, every, len(self.words))), (self.keys2, self.counts(self.of2, self.i2, len(self.keys2)))]

    def learn_words(self, got: list[np.ndarray], least_word: float, least: float) -> None:
        (self.c1, self.own1), (self.c2, self.own2) = ((x >> 1, (x & 1) > 0) for x in got)
        self.known = self.c1 >= least_word
        self.kept2 = (self.c2 >= least) & self.known[self.u2] & self.known[self.v2]
        of = np.full(len(self.at), -1)
        of[self.i2] = self.of2
        kept = np.append(self.kept2, False)
        i3 = np.flatnonzero(self.place >= 2)
        self.i3 = i3[kept[of[i3 - 1]] & kept[of[i3]]]
        self.of = of
        self.keys3, first, self.of3 = np.unique(_mix(self.keys2[of[self.i3 - 1]], self.words[self.at[self.i3]]), return_index=True, return_inverse=True)
        self.u3 = of[self.i3[first] - 1]  # the bigram that is the trigram's context
        self.states1, self.states2 = np.flatnonzero(self.c1 >= least), np.flatnonzero(self.kept2)

    def ask_trigrams(self) -> list[tuple[np.ndarray, np.ndarray]]:
        mine = self.kept2 & self.own2
        give = np.bincount(self.u2[mine], self.c2[mine] - DISCOUNT, minlength=len(self.words))
        return [(self.keys3, self.counts(self.of3, self.i3, len(self.keys3))), (self.words[self.states1], give[self.states1])]

    def learn_trigrams(self, got: list[np.ndarray], least: float) -> None:
        self.c3, self.own3 = got[0] >> 1, (got[0] & 1) > 0
        self.kept3 = self.c3 >= least
        self.left1 = np.ones(len(self.words))
        self.left1[self.states1] = np.maximum(1 - got[1] / self.c1[self.states1], 1e-12)

    def ask_states(self) -> list[tuple[np.ndarray, np.ndarray]]:
        mine = self.kept3 & self.own3
        give = np.bincount(self.u3[mine], self.c3[mine] - DISCOUNT, minlength=len(self.keys2))
        return [(self.keys2[self.states2], give[self.states2])]

    def learn_states(self, got: list[np.ndarray]) -> None:
        self.left2 = np.ones(len(self.keys2))
        self.left2[self.states2] = np.maximum(1 - got[0] / self.c2[self.states2], 1e-12)

    def scores(self, n: int, rare_n: int, rare_v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: words seen in training, sum of log10(c + 1), log10 of its probability."""
        one = np.where(self.known, self.c1, (rare_n + 1) * (self.c1 + 1) / (rare_n + rare_v + 1)) / (n + 1)
        two = np.where(self.kept2, (self.c2 - DISCOUNT) / np.maximum(self.c1[self.u2], 1), 0) + self.left1[self.u2] * one[self.v2]
        p = one[self.at]
        p[self.i2] = two[self.of2]
        i3 = np.flatnonzero(self.place >= 2)
        p[i3] *= self.left2[self.of[i3 - 1]]
        p[self.i3] += np.where(self.kept3, (self.c3 - DISCOUNT) / self.c2[self.u3], 0)[self.of3]
        ends = np.cumsum(self.lens) - self.lens
        total = lambda x: np.add.reduceat(x, ends) if len(ends) else x
        return total((self.c1 > 0).astype(np.int64)[self.at]), total(np.log10(self.c1 + 1.0)[self.at]), total(np.log10(p))


def _chunks(base: DataFrame) -> DataFrame:
    """chunk, recs, tokens, learnt (training tokens), body."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("recs", T.ArrayType(base.schema["rec"].dataType)), T.StructField("tokens", T.LongType()), T.StructField("learnt", T.LongType()), T.StructField("body", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, number = WordHashes(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in text_runs(batch, "__text", CHUNK_BYTES):
                hashes = _hashes(memo, texts)
                lens, train = np.array([len(h) for h in hashes]), part.column("__train").to_numpy(zero_copy_only=False).astype(bool)
                words, at = np.unique(np.concatenate(hashes), return_inverse=True)
                recs = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("rec"))
                yield pa.RecordBatch.from_arrays([pa.array([number]), recs, pa.array([len(at)]), pa.array([int(lens[train].sum())]), pa.array([_dump(words, _tight(at), lens, train)])], names=["chunk", "recs", "tokens", "learnt", "body"])
                number += 1

    return dealt(base.mapInArrow(run, schema), "lm-chunks", "chunk")


def _slices(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's range of sorted keys begins and ends."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


def _round(chunks: DataFrame, parts: int, ask: Callable[[Chunk, list], list], past: list[DataFrame], name: str, owners: int) -> DataFrame:
    """chunk, got: the sums of what all chunks sent for each key that a chunk named, by part. For the first `owners` kinds
    of keys, twice the sum, and 1 more for one of the chunks that named the key."""

    width = len(past)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one chunk at a time
                row = batch.slice(k, 1).to_pylist()[0]
                kinds = ask(Chunk(*_load(row["body"])), [row[f"got{i}"] for i in range(width)])
                cuts = [_slices(k, parts) for k, _ in kinds]
                to = [p for p in range(parts) if any(c[p] < c[p + 1] for c in cuts)]
                blobs = [_dump(*[y for (k, x), c in zip(kinds, cuts, strict=True) for y in (_planes(k[c[p] : c[p + 1]]), _tight(x[c[p] : c[p + 1]]))]) for p in to]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([row["chunk"]] * len(to), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "chunk", "blob"])

    def answer(group: pa.Table) -> pa.Table:
        blobs = [_load(b) for b in group["blob"].to_pylist()]
        replies: list[list[np.ndarray]] = [[] for _ in blobs]
        for kind in range(len(blobs[0]) // 2):
            keys = [_keys(b[2 * kind]) for b in blobs]
            ends = np.cumsum([len(k) for k in keys])
            keys, values = np.concatenate(keys), np.concatenate([b[2 * kind + 1].astype(np.int64 if kind < owners else np.float64) for b in blobs])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
            sums = np.add.reduceat(values[order], np.flatnonzero(new))[np.cumsum(new) - 1] if len(keys) else values
            out = np.empty_like(values)
            out[order] = sums * 2 + new if kind < owners else sums
            for reply, x in zip(replies, np.split(out, ends[:-1]), strict=True):
                reply.append(_tight(x))
        return pa.table({"chunk": group["chunk"], "x": pa.array([{"part": p, "blob": _dump(*r)} for p, r in zip(group["part"].to_pylist(), replies, strict=True)], pa.struct([("part", pa.int32()), ("blob", pa.binary())]))})

    sent = _with(chunks.select("chunk", "body"), past).mapInArrow(send, "part int, chunk long, blob binary")
    got = sent.groupBy("part").applyInArrow(answer, "chunk long, x struct<part:int,blob:binary>")
    got = got.groupBy("chunk").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return dealt(got.select("chunk", F.col("x.blob").alias("got")), name, "chunk")


def _with(chunks: DataFrame, past: list[DataFrame]) -> DataFrame:
    for i, got in enumerate(past):
        chunks = chunks.join(got.withColumnRenamed("got", f"got{i}"), "chunk", "left")
    return chunks


def _joined(got: list[bytes] | None, kinds: int) -> list[np.ndarray]:
    """Answers of all parts, in the order of the keys."""
    parts = [_load(b) for b in got or []]
    return [np.concatenate([np.zeros(0, np.int64), *[p[k] if p[k].dtype.kind == "f" else p[k].astype(np.int64) for p in parts]]) for k in range(kinds)]


class Automaton:
    """States, arcs and failure arcs. Symbols: 0..words-1, then <rare>."""

    def __init__(self, words: int, uni: np.ndarray, bi: dict[tuple[int, int], int], tri: dict[tuple[int, int, int], int], discount: float = DISCOUNT) -> None:
        self.base = words + 1
        total = int(uni.sum())
        # one more count for <rare>, so that unseen words have some mass in an empty or closed corpus
        add = np.zeros(words + 1)
        add[words] = 1
        root = np.log10((uni + add) / (total + 1))
        context = {u: s for s, u in enumerate(sorted({u for u, _ in bi}), 1)}
        pairs = {p: len(context) + s for s, p in enumerate(sorted({(u, v) for u, v, _ in tri}), 1)}
        suffix = lambda *g: pairs.get(g[-2:], context.get(g[-1], 0)) if len(g) > 1 else context.get(g[0], 0)
        size = 1 + len(context) + len(pairs)
        self.fail, self.left = [0] * size, [0.0] * size
        self.root = list(zip(root.tolist(), [context.get(w, 0) for w in range(words + 1)], strict=True))
        self.arcs: dict[int, tuple[float, int]] = {}
        kept = [0.0] * size
        for (u, _), c in bi.items():
            kept[context[u]] += (c - discount) / int(uni[u])
        for (u, v, _), c in tri.items():
            kept[pairs[u, v]] += (c - discount) / bi[u, v]
        for s in range(1, size):
            self.left[s] = math.log10(max(1.0 - kept[s], 1e-12))
        for (u, v), s in pairs.items():
            self.fail[s] = context.get(v, 0)
            del u
        p1 = 10.0**root
        p2: dict[tuple[int, int], float] = {}
        for (u, v), c in bi.items():
            p2[u, v] = (c - discount) / int(uni[u]) + 10.0 ** self.left[context[u]] * p1[v]
            self.arcs[context[u] * self.base + v] = (math.log10(p2[u, v]), suffix(u, v))
        for (u, v, w), c in tri.items():
            low = p2[v, w] if (v, w) in p2 else 10.0 ** self.left[context[v]] * p1[w] if v in context else p1[w]
            s = pairs[u, v]
            self.arcs[s * self.base + w] = (math.log10((c - discount) / bi[u, v] + 10.0 ** self.left[s] * low), suffix(u, v, w))

    def score(self, symbols: list[int]) -> float:
        arcs, fail, left, root, base = self.arcs, self.fail, self.left, self.root, self.base
        state, total = 0, 0.0
        for w in symbols:
            while state:
                hit = arcs.get(state * base + w)
                if hit is not None:
                    break
                total += left[state]
                state = fail[state]
            else:
                hit = root[w]
            total += hit[0]
            state = hit[1]
        return total


def score_texts(df: DataFrame, train: object, text: str = "text", word_share: float = 0.0, gram_share: float = 0.0) -> DataFrame:
    """The input's columns but `text`, with n_tokens, n_known, train_tokens, base_score and score.

    train: a boolean column that says which rows are learnt from (null: not). Null and empty texts are the end token
    alone; texts of any length are one sequence (a long one is a chunk of its own). Repeated rows are learnt from and
    scored as often as they occur. Own columns take the place of input columns of their names; an empty table gives no rows. With an empty training side N = V = 0: each token has base log10(0 + 1) - log10(0 + 1) = 0. Shares above 0
    make a smaller model: words and n-grams below that share of the training tokens aren't kept, such words are one class.
    """
    lean = [c for c in df.columns if c != text]
    chunks = _chunks(records_beside(df, text, F.coalesce(train, F.lit(False)).alias("__train")))
    tokens, n = (int(x or 0) for x in chunks.agg(F.sum("tokens"), F.sum("learnt")).first())
    parts = 1 + tokens // PART_TOKENS
    least_word, least = max(1.0, word_share * n), max(float(MIN_GRAM), gram_share * n)

    def first(c: Chunk, got: list) -> Chunk:
        c.learn_words(_joined(got[0], 2), least_word, least)
        return c

    def second(c: Chunk, got: list) -> Chunk:
        first(c, got).learn_trigrams(_joined(got[1], 2), least)
        return c

    one = _round(chunks, parts, lambda c, _: c.ask_words(), [], "lm-words", 2)

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for got in batch.column("got").to_pylist():
                x = _joined(got, 1)[0]
                c = (x >> 1)[(x & 1) > 0]
                rare = c[(c > 0) & (c < least_word)]
                yield pa.RecordBatch.from_arrays([pa.array([int((c > 0).sum())]), pa.array([int(rare.sum())]), pa.array([len(rare)])], names=["v", "rare_n", "rare_v"])

    v, rare_n, rare_v = (int(x or 0) for x in one.select("got").mapInArrow(vocabulary, "v long, rare_n long, rare_v long").agg(F.sum("v"), F.sum("rare_n"), F.sum("rare_v")).first())
    two = _round(chunks, parts, lambda c, got: first(c, got).ask_trigrams(), [one], "lm-trigrams", 1)
    three = _round(chunks, parts, lambda c, got: second(c, got).ask_states(), [one, two], "lm-states", 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                body, *got = (row.column(c)[0].as_py() for c in ("body", "got0", "got1", "got2"))
                c = second(Chunk(*_load(body)), got)
                c.learn_states(_joined(got[2], 1))
                known, low, path = c.scores(n, rare_n, rare_v)
                yield pa.RecordBatch.from_arrays([row.column("recs").flatten(), pa.array(c.lens, pa.int64()), pa.array(known, pa.int64()), pa.array(low), pa.array(path)], names=["rec", "n_tokens", "n_known", "low", "path"])

    every = _with(chunks.select("chunk", "recs", "body"), [one, two, three])
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("low", T.DoubleType()), T.StructField("path", T.DoubleType())]
    got = every.mapInArrow(run, T.StructType([T.StructField("rec", chunks.schema["recs"].dataType.elementType), *fields]))
    base_score = F.col("low") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return unpack(got, lean, n_tokens="n_tokens", n_known="n_known", train_tokens=F.lit(n).cast("long"), base_score=base_score, score="path")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of `documents` scored by a model of those with crc32(doc_id) mod 7 other than 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    got = score_texts(docs, ~held)
    return got.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
