"""Copy classes of line dedup: the same for any split of the input, and close to all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from mnemora.llm.line_dedup import ALIKE, drop_lines, sketches


def corpus(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 9))) for _ in range(2000)]
    line = lambda k: " ".join(r.choices(words, k=k))
    passages = [line(r.randrange(8, 60)) for _ in range(25)]
    out = []
    while len(out) < n:
        own = [line(r.randrange(4, 25)) for _ in range(r.randrange(2, 12))]
        if r.random() < 0.5:
            own.insert(r.randrange(len(own)), r.choice(passages))
        copies = r.choice([1, 1, 1, 1, 3, 8])
        for _ in range(copies):
            out.append("\n".join(" ".join(w if r.random() > 0.02 else r.choice(words) for w in x.split()) if copies > 1 and x not in passages else x for x in own))
    r.shuffle(out)
    return [*out[:n], None, "", out[0], out[0]]


def test_lines_do_not_depend_on_splits(spark):
    texts = corpus(3, 900)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = []
    for split in (df.coalesce(1), df.repartition(7), df.repartition(3, F.col("doc_id") % 11).orderBy(F.desc("doc_id"))):
        kept.append({(x["doc_id"], x["text"]) for x in drop_lines(split).collect()})
    assert kept[0] == kept[1] == kept[2] and sum(t != texts[i] for i, t in kept[0]) > 100


def test_copy_classes_hold_what_all_pairs_link(spark):
    """Of the documents that some other sketch is alike to, at least nine in ten are in one class with one of them."""
    from mnemora.llm import line_dedup as k
    from mnemora.llm.common import mix64

    bins = sketches([t.encode() for t in corpus(5, 700) if t])
    same = (bins[:, None] == bins[None]).sum(2) >= ALIKE * k.BINS
    np.fill_diagonal(same, False)
    band = np.tile(np.arange(k.BINS // k.BAND, dtype=np.uint64), (len(bins), 1))
    with np.errstate(over="ignore"):
        for j in range(k.BAND):
            band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + bins[:, j :: k.BAND])
    short = (bins & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    rows = [(i, bytearray(short[i].tobytes()), band[i].view(np.int64).tolist()) for i in range(len(bins))]
    comp = {x["row"]: x["comp"] for x in k.copy_classes(spark.createDataFrame(rows, "row long, bins binary, bands array<long>")).collect()}
    linked = np.flatnonzero(same.any(1))
    met = sum(any(comp[int(i)] == comp[int(j)] for j in np.flatnonzero(same[i])) for i in linked)
    assert len(linked) > 200 and met >= 0.9 * len(linked)
