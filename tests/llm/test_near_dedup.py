"""Near-dedup against all pairs."""

import random

import pytest

from mnemora.llm import near_dedup
from mnemora.llm.common import WordHashes, shingle_hashes, words_of


def brute(texts, k, percent=80):
    """The smallest index of each text's component, by all pairs of sets; texts without words stay alone."""
    memo = WordHashes()
    sets = [set(shingle_hashes(memo.of(words_of((t or "").encode())), k).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
                links += 1
    return [find(i) for i in range(len(texts))], links


def families(seed, base_words, sizes):
    """Copies with edits of all grades on both sides of the threshold, chains of edits, exact copies and loners."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    out = []
    for size in sizes:
        base = r.choices(vocabulary, k=base_words)
        walk = list(base)
        for _ in range(size):
            x = list(base)
            for _ in range(r.randrange(0, base_words // 6)):
                at = r.randrange(len(x))
                x[at : at + 1] = r.choice([[], [r.choice(vocabulary)], [x[at], r.choice(vocabulary)]])
            out.append(" ".join(x))
            walk[r.randrange(len(walk))] = r.choice(vocabulary)
            out.append(" ".join(walk))
    out += [" ".join(r.choices(vocabulary, k=base_words)) for _ in range(20)]
    out += [out[0], out[0].upper(), out[3], None, None, "", " \t ", "one", "one", "one two", "ONE\x0btwo", "ſ one two three", "one two three four five six seven eight"]
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "k", "words", "sizes", "block"), [(1, 2, 60, (60, 25, 8), 1024), (2, 5, 90, (40, 30), 16), (3, 2, 30, (50, 50), 7)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, k, words, sizes, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)  # several blocks of a bucket
    monkeypatch.setattr(near_dedup, "GROUP", 5)
    texts = families(seed, words, sizes)
    want, links = brute(texts, k)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in near_dedup.near_dedup_report(df, shingle=k).collect()}
    assert links > 100 and [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in got)
    kept = sorted(r["doc_id"] for r in near_dedup.near_dedup(df, shingle=k).select("doc_id").collect())
    assert kept == sorted(set(want))


def test_signatures_decide(spark, monkeypatch):
    """Without equal bands nothing meets: results come from the signatures."""
    texts = families(4, 60, (20,))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sign = near_dedup.superminhash
    monkeypatch.setattr(near_dedup, "superminhash", lambda e, o, docs, m, **x: sign(e, o, docs, m, **x) ^ (near_dedup.np.arange(docs, dtype="u8")[:, None] + near_dedup.np.uint64(1)))
    alone = near_dedup.near_duplicates(df, shingle=2)
    assert alone.select("comp").distinct().count() > len(set(brute(texts, 2)[0])) + 10


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5), (1, "a b c d e f", 5), (None, "a b c d e f", 5), (2, None, 5), (2, "x" * 200_000, 5), (3, "w " * 150_000, 5), (4, "w " * 150_000, 5)], "doc_id long, text string, kept int")
    got = near_dedup.near_dedup_report(df, shingle=2).collect()
    assert len(got) == 7 and sorted((r["doc_id"] or 0, r["component_id"], r["n_shingles"], r["kept"]) for r in got) == [(0, 1, 5, False), (1, 1, 5, True), (1, 1, 5, True), (2, 2, 0, True), (2, 2, 1, True), (3, 3, 1, True), (4, 3, 1, False)]
    kept = near_dedup.near_dedup(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 2, 3]
    assert near_dedup.near_dedup(df.limit(0)).count() == 0
