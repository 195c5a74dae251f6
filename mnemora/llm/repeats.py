"""Quality rules on repetition, from suffix arrays over words.

The texts of a run share one suffix array; a suffix starts with its text's number, so suffixes of different texts never
have a prefix in common. Prefix doubling sorts only what is still tied, so a run takes as many rounds as its longest
repeat has binary digits; longest common prefixes (LCP) of neighbours come from the ranks of these rounds. An LCP interval
is a set of suffixes with a common prefix that no longer one covers; it is a maximal repeat if its occurrences also differ
in the word before. The union of the spans of all maximal repeats of `least` words or more is what a text repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.llm.common import records_beside, table, text_runs, tidy, unpack

SYMBOLS, BLANK = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
CONTINUES = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point


@dataclass(frozen=True)
class Limits:
    """Base: least words, and percent of words in repeated windows of 3. Repeats: from `least` words on; most percent of a
    text's words inside them, most words of a single one."""

    words: int = 50
    window_percent: int = 50
    least: int = 10
    covered_percent: int = 40
    longest: int = 50


def suffix_array(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffixes in order, ranks by prefixes of 1, 2, 4, ... words). doc ascends; equal ranks at a level mean equal prefixes in one text."""
    n = len(word)
    key = doc.astype(np.int64) * (int(word.max(initial=0)) + 1) + word
    order = np.argsort(key, kind="stable")
    ranks = [_starts(key[order])]
    rank = np.empty(n, np.int64)
    rank[order] = ranks.pop()
    levels, width = [rank.astype(np.int32)], 1
    sa = order
    while True:
        sizes = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(sizes[rank[sa]] > 1)  # places of the array still in question, whole groups each
        if not len(tied):
            return sa, levels
        left = sa[tied]
        right = left + width
        inside = right < n
        inside[inside] = doc[right[inside]] == doc[left[inside]]
        second = np.zeros(len(left), np.int64)
        second[inside] = rank[right[inside]] + 1
        key = rank[left] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sa = sa.copy()
        sa[tied] = left[order]
        rank = rank.copy()
        rank[left[order]] = tied[_starts(key[order])]
        levels.append(rank.astype(np.int32))
        width *= 2


def _starts(ordered: np.ndarray) -> np.ndarray:
    """For each place of an ordered array, where its run of equal values starts."""
    first = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - 1))
    return np.repeat(first, np.diff(np.append(first, len(ordered))))


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Words that each suffix of the array shares with the one before it; 0 for the first."""
    n = len(sa)
    out = np.zeros(n, np.int64)
    a, b = sa[1:].copy(), sa[:-1].copy()
    got, live = np.zeros(max(n - 1, 0), np.int64), np.arange(max(n - 1, 0))
    for k in range(len(levels) - 1, -1, -1):
        x, y = a[live], b[live]
        inside = np.maximum(x, y) < n
        live_now = live[inside]
        x, y = x[inside], y[inside]
        # both still in their texts: a shared prefix ends before either text does
        same = (levels[k][x] == levels[k][y]) & (doc[x] == doc[sa[1:][live_now]]) & (doc[y] == doc[sa[:-1][live_now]])
        hit = live_now[same]
        got[hit] += 1 << k
        a[hit] += 1 << k
        b[hit] += 1 << k
    out[1:] = got
    return out


def intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """LCP intervals (first place, last place, words) of `least` words or more."""
    out: list[tuple[int, int, int]] = []
    places = np.flatnonzero(lcp >= least)
    open_: list[tuple[int, int]] = []  # (first place, words), words rising
    before = -2
    for i, h in zip(places.tolist(), lcp[places].tolist(), strict=True):
        if i != before + 1:
            out += [(a, before, w) for a, w in open_]
            open_ = []
        first = i - 1
        while open_ and open_[-1][1] > h:
            first, w = open_.pop()
            out.append((first, i - 1, w))
        if not open_ or open_[-1][1] < h:
            open_.append((first, h))
        before = i
    return out + [(a, before, w) for a, w in open_]


@dataclass
class Repeats:
    """For the words of a run: which lie in repeats, and for each text the maximal repeats' number and longest."""

    window: np.ndarray
    covered: np.ndarray
    count: np.ndarray
    longest: np.ndarray


def repeats(doc: np.ndarray, word: np.ndarray, docs: int, least: int, window: int = 3) -> Repeats:
    n = len(word)
    sa, levels = suffix_array(doc, word) if n else (np.zeros(0, np.int64), [])
    lcp = common_prefixes(sa, levels, doc) if n else np.zeros(0, np.int64)
    best = np.zeros(n, np.int64)  # the longest repeat at each word: its suffix's innermost interval
    best[sa] = np.maximum(lcp, np.append(lcp[1:], 0)) if n else lcp
    before = np.where(sa > 0, word[sa - 1] if n else word, -1)
    if n:
        before = np.where((sa > 0) & (doc[sa - 1] == doc[sa]), before, -1 - sa)  # the first word of a text has no word before it
    changes = np.cumsum(np.diff(before, prepend=before[:1]) != 0)
    count, longest = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    for first, last, words in intervals(lcp, least):
        if changes[last] > changes[first]:  # occurrences differ to the left: maximal
            d = doc[sa[first]]
            count[d] += 1
            longest[d] = max(longest[d], words)
    # where an innermost interval isn't maximal, the same occurrences one word earlier cover it
    return Repeats(_union(best, window, window), _union(best, least, None), count, longest)


def _union(best: np.ndarray, least: int, width: int | None) -> np.ndarray:
    """Words inside spans of `width` (else their own) words that start where repeats of `least` words do."""
    at = np.flatnonzero(best >= least)
    edge = np.bincount(at, minlength=len(best) + 1) - np.bincount(at + (best[at] if width is None else width), minlength=len(best) + 1)
    return np.cumsum(edge)[: len(best)] > 0


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "n_repeats", "longest_repeat")


def measure(texts: list[bytes], least: int) -> dict[str, np.ndarray]:
    """The figures of whole texts."""
    ids: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(texts))
    word = np.fromiter((ids.setdefault(w, len(ids)) for ws in words for w in ws), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    found = repeats(doc, word, len(texts), least)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    per = lambda f: np.fromiter(f, np.int64, len(texts))
    inside = lambda flags: np.bincount(doc[flags], minlength=len(texts)).astype(np.int64)
    return {
        "n_words": sizes, "word_chars": per(len(t.translate(None, CONTINUES + BLANK)) for t in texts), "n_symbols": per(len(t) - len(t.translate(None, SYMBOLS)) for t in texts),
        "n_dup_lines": per(len(x) - len(set(x)) for x in lines), "n_repeat_words": inside(found.window), "covered_words": inside(found.covered), "n_repeats": found.count, "longest_repeat": found.longest,
    }


def repetition(df: DataFrame, text: str = "text", limits: Limits = Limits(), carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of the input (all by default) with FIGURES, base_failed and kept.

    Null and empty texts have no words and fail the base rule; an empty table has no rows; texts are measured whole,
    however long, and repeated rows alike. Words are case-sensitive. An input column with a name of these gives way.
    """
    names = df.columns if carry is None else carry
    rest = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text])])
    base = records_beside(rest, text)
    wanted = text in names
    figures = T.StructType([T.StructField(n, T.LongType()) for n in FIGURES])
    schema = T.StructType([base.schema["rec"], *([base.schema["__text"]] if wanted else []), *figures.fields])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_runs(batch, "__text"):
                own = [part.column("rec"), *([part.column("__text")] if wanted else [])]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(v) for v in measure(texts, limits.least).values()]], names=schema.names)

    got = base.mapInArrow(run, schema)
    n = F.col("n_words")
    failed = (n < limits.words) | (100 * F.col("n_repeat_words") > limits.window_percent * n)
    verdict = (100 * F.col("covered_words") <= limits.covered_percent * n) & (F.col("longest_repeat") <= limits.longest)
    own = {**{k: F.col(k) for k in FIGURES}, "base_failed": failed, "kept": ~failed & verdict}
    if not wanted:
        return unpack(got, [c for c in names], **own)
    return unpack(got.withColumn("rec", F.struct(*[(F.col("__text") if c == text else F.col("rec").getField(c)).alias(c) for c in names])), names, **own)


def op11_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition figures and verdicts of every text of `documents`."""
    got = repetition(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", (F.col("longest_repeat") > Limits().longest).alias("too_long"))


_WINDOWS = lambda k: f"SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM (SELECT doc_id, i, array_to_string(w[i : i + {k - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM w))"
_COVER = lambda k: f"SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {k})) AS p FROM ({_WINDOWS(k)}) WHERE again) GROUP BY doc_id"
_L = Limits()
#: The union of maximal repeats of k words or more is that of repeated windows of k words; a repeat is longer than k if a window of k + 1 repeats.
OP11_SQL = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
lines AS (SELECT doc_id, sum(n - 1)::BIGINT AS n FROM (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, l) GROUP BY doc_id),
three AS ({_COVER(3)}), cover AS ({_COVER(_L.least)}), long AS (SELECT doc_id, bool_or(again) AS too_long FROM ({_WINDOWS(_L.longest + 1)}) GROUP BY doc_id),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(three.n, 0)::BIGINT AS n_repeat_words,
  coalesce(cover.n, 0)::BIGINT AS covered_words, coalesce(too_long, false) AS too_long FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN three USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN long USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {_L.words} OR 100 * n_repeat_words > {_L.window_percent} * n_words AS base_failed,
NOT (n_words < {_L.words} OR 100 * n_repeat_words > {_L.window_percent} * n_words) AND 100 * covered_words <= {_L.covered_percent} * n_words AND NOT too_long AS kept, covered_words, too_long FROM f"""
