"""Repetition, collocations and the audit of filters: kernels, brute force, and edge rows."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from mnemora.llm import audit, collocations, repeats
from mnemora.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, kept string, n string, rank string, mask string"


def spans_of(words, least):
    """Maximal repeated substrings of `least` words or more: (words covered, how many, the longest)."""
    covered, found = set(), {}
    n = len(words)
    for k in range(least, n):
        at = defaultdict(list)
        for i in range(n - k + 1):
            at[tuple(words[i : i + k])].append(i)
        for g, places in at.items():
            if len(places) > 1:
                covered |= {p for i in places for p in range(i, i + k)}
                left = {words[i - 1] if i else ("start", i) for i in places}
                right = {words[i + k] if i + k < n else ("end", i) for i in places}
                if len(left) > 1 and len(right) > 1:
                    found[g] = k
    return len(covered), len(found), max(found.values(), default=0)


@pytest.mark.parametrize("seed", range(6))
def test_repeats_against_all_substrings(seed):
    r = random.Random(seed)
    texts = [[r.choice("abc" if seed % 2 else "abcdefgh") for _ in range(r.randrange(0, 40))] for _ in range(8)] + [["x"] * 20, ["p", "q"] * 8, []]
    texts[3] = texts[2]  # copies share no repeat
    for least in (1, 3, 5):
        ids = {}
        word = np.array([ids.setdefault(w, len(ids)) for t in texts for w in t], np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        got = repeats.repeats(doc, word, len(texts), least)
        for d, t in enumerate(texts):
            assert (int(got.covered[doc == d].sum()), int(got.count[d]), int(got.longest[d])) == spans_of(t, least)
            assert int(got.window[doc == d].sum()) == spans_of(t, 3)[0]


def test_long_repetition_is_measured_whole():
    line = " ".join(f"w{i}" for i in range(500))
    figures = repeats.measure([f"{line}\n{line}".encode(), b"y " * 50_000, "É".encode() * 3], 10)
    assert figures["longest_repeat"].tolist() == [500, 49_999, 0] and figures["covered_words"].tolist() == [1000, 50_000, 0]
    assert figures["n_dup_lines"].tolist() == [1, 0, 0] and figures["word_chars"][2] == 3


def rows():
    r = random.Random(4)
    prose = " ".join(f"w{r.randrange(400)}" for _ in range(300))
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [prose, None, "", " \t\n", "one", prose, f"{prose} {passage} und {passage}", "a b c d " * 40, "X" * 20_000, "# * $ %", prose]
    out = [(i, t, ("en", None, "und")[i % 3], "s", "clash", "n", "r", "m") for i, t in enumerate(texts)]
    return [*out, out[0], (None, prose, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (0, 0, 1), (5, 1, 0), (7, 0, 1), (99, 1, 1), (None, 1, 1), (10, None, None)], "doc_id long, quality int, toxic int")


def test_repetition_on_edges(docs, none):
    got = repeats.repetition(docs)
    assert set(got.columns) == {*docs.columns, *repeats.FIGURES, "base_failed"} and got.count() == 13
    by = {(x["doc_id"], x["text"]): x for x in got.collect()}
    assert [i for (i, _), x in by.items() if x["kept"]] == [0, 5, 10, None]
    assert by[6, rows()[6][1]]["longest_repeat"] == 60 and not by[6, rows()[6][1]]["base_failed"] and by[1, None]["base_failed"] and by[8, "X" * 20_000]["word_chars"] == 20_000
    assert repeats.repetition(none).count() == 0 and repeats.repetition(docs, carry=["source"]).columns == ["source", *repeats.FIGURES, "base_failed", "kept"]


def brute_phrases(data, support=30, top=2000):
    f, n = Counter(), Counter()
    for text, lang in data:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    big = {(g, p): a for (g, p), a in f.items() if a >= support and len(p) > 1}
    hidden = {(g, p[i:j]) for (g, p), a in big.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * f[g, p[i:j]]}
    out = defaultdict(list)
    for (g, p), a in big.items():
        if (g, p) not in hidden:
            score, k = min((2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k) for k in range(1, len(p)))
            out[g].append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
    return {(g, i, p.decode(), -a, l, r, n[g], -s) for g, many in out.items() for i, (s, a, p, l, r) in enumerate(sorted(many)[:top], 1)}


def phrases(seed):
    r = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "é", "ü-x", *[f"w{i}" for i in range(12)]]
    weights = [6, 5, 4, 4, 3, 2, 2] + [1] * 12
    line = lambda: "".join(w + r.choice([" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for w in r.choices(words, weights, k=80))
    some = [(line() + ("New York city hall " if i % 3 else ""), r.choice(["en", "en", "de", None, "und"])) for i in range(150)]
    return [*some, (None, "en"), ("", None), ("...", "fr"), ("rare words only", "fr"), *some[:20]]


@pytest.mark.parametrize("slots", [1 << 22, 150, 60, 5])
def test_collocations_against_brute_force(spark, monkeypatch, slots):
    """Whether arrays, rows of keys or rows of text count the phrases."""
    data = phrases(1)
    monkeypatch.setattr(collocations, "KEYS", 500)
    df = spark.createDataFrame([(t, x, "clash") for t, x in data], "text string, lang string, n string").repartition(5)
    got = collocations.collocations(df, slots=slots)
    assert tuple(got.columns) == collocations.RESULT and {tuple(x) for x in got.collect()} == brute_phrases(data)


def test_collocations_rank_ties_and_edges(spark, none, docs):
    data = phrases(2)
    got = collocations.collocations(spark.createDataFrame(data, "text string, lang string"), top=7)
    assert {tuple(x) for x in got.collect()} == brute_phrases(data, top=7)
    assert collocations.collocations(none).count() == 0 and {x["lang"] for x in collocations.collocations(docs).collect()} <= {"en", "und"}


def test_perfect_hash():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 200_000):
        keys = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        h = collocations.PerfectHash(keys)
        assert sorted(h.find(keys).tolist()) == list(range(len(keys))) and (h.keys[h.find(keys)] == keys).all()
        other = np.setdiff1d(r.integers(0, 1 << 63, 1000, dtype=np.uint64), keys)
        assert (h.find(other) == -1).all()
    with pytest.raises(ValueError, match="repeat"):
        collocations.PerfectHash(np.array([7, 7], np.uint64))


def test_arrays_are_summed_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FAN", 3)
    at, n = np.array([0, 5, 65_535], np.uint16).tobytes(), lambda v, k: np.array([v, 1, 2], k).tobytes()
    parts = spark.createDataFrame([(p, node, bytearray(at), bytearray(n(9, np.int64))) for p in (0, 4) for node in range(20)], collocations.PIECES)
    got = {x["piece"]: np.frombuffer(x["n"], np.int64).tolist() for x in collocations.tree_sum(parts, 20, np.int64).collect()}
    assert got == {0: [180, 20, 40], 4: [180, 20, 40]}
    parts = spark.createDataFrame([(0, node, bytearray(at), bytearray(n(9, np.uint8))) for node in range(20)], collocations.PIECES)
    assert np.frombuffer(collocations.tree_sum(parts, 20, np.uint8, 30).first()["n"], np.uint8).tolist() == [30, 20, 30]


def brute_audit(data, marks):
    first = {}
    for i, t, _ in data:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    known = defaultdict(lambda: (0, 0))
    for i, q, x in marks:
        known[i] = (max(known[i][0], int(q == 1)), max(known[i][1], int(x == 1)))
    facts = defaultdict(list)
    for i, t, lang in data:
        t = t or ""
        w = t.split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        facts[lang or ""].append(({k for k, v in fails.items() if v}, *(known[i] if i is not None else (0, 0))))
    out = {}
    for part, many in facts.items():
        gone_by = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [m for m in many if f in m[0] and not m[0] & before]
                out[part, "".join(order), step] = [sum(not m[0] & (before | {f}) for m in many), len(gone), sum(f in m[0] and bool(m[0] & before) for m in many), sum(m[0] == {f} for m in many), sum(m[1] for m in gone), sum(m[2] for m in gone), f]
                gone_by[f] += len(gone)
        for key in out:
            if key[0] == part:
                out[key][-1] = gone_by[out[key][-1]]
    return out


def check(got, want):
    assert {(x["part"], x["filter_order"], x["step"]): [x[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for x in got.collect()} == want


def test_audit_against_brute_force(spark, docs, none, labels, monkeypatch):
    marks = [tuple(x) for x in labels.collect()]
    check(audit.audit(docs, labels), brute_audit([x[:3] for x in rows()], marks))
    monkeypatch.setattr(audit, "CHAIN_BYTES", 1_000)  # chains are sent on again and again
    check(audit.audit(docs.repartition(7), labels), brute_audit([x[:3] for x in rows()], marks))
    assert audit.audit(none, labels).count() == 0 and audit.audit(none, labels.limit(0)).count() == 0


def test_equal_fingerprints_of_different_texts_part(spark, labels, monkeypatch):
    chains = audit.Chains()
    out = [list(chains.add(1, t, i, [("p", 0)])) for i, t in [(5, b"x"), (3, b"y"), (4, b"x"), (9, b"y"), (3, b"y"), (4, b"x")]]
    assert out == [[], [], [(5, "p", audit.COPY)], [(9, "p", audit.COPY)], [], []]
    assert chains.of == {1: [[b"x", 4, [("p", 0), ("p", 0)]], [b"y", 3, [("p", 0), ("p", 0)]]]}
    r = random.Random(8)
    many = [(i, r.choice(["same text", f"t{i % 40}", "Other | text"]), r.choice(["en", "de"])) for i in range(400)]
    r.shuffle(many)
    check(audit.audit(spark.createDataFrame(many, "doc_id long, text string, lang string").repartition(6), labels), brute_audit(many, [tuple(x) for x in labels.collect()]))


def test_queries_are_registered():
    assert {"op11_repetition", "op12_collocations", "op13_filter_audit"} <= QUERIES.keys()
