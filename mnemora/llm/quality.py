"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on a text's own figures gives each document log-odds. Documents of one host, and of one path of
a host, are summed in grouped aggregations (labels where known, else the classifier's probability). The share of good
documents of a host is shrunk towards the global share, that of a path towards its host's, by strengths estimated from
the data (method of moments), so sparse sites count for little. A document's own evidence is left out of its site's.
The posterior log-odds are the document's plus its path's, less the global ones.

A good document has the label and is not toxic. Words that tell toxic documents from others (presence in labelled
documents, largest z-scores first, `WORDS` of them at most) are marks of the regression beside the figures.

Only the regression is fitted on a bounded sample (`fit_rows` labelled documents, smallest hash of the id first); the
site statistics and the scores cover all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.llm.common import materialize, records, table, text_runs, tidy, unpack

FIT_ROWS, KEEP, WORDS = 20_000, 0.5, 128
_WORD = re.compile(rb"[a-z\x80-\xff]+")
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 stop, 7 sign, 8 beyond ASCII
for _chars, _n in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\r\x0b\x0c", 4), (b"\n", 5), (b".,;:'\"-()", 6), (b"%*#$&|!@<>{}[]~^=+_/\\`?", 7), (bytes(range(128, 256)), 8)):
    _CLASS[list(_chars)] = _n


def figures(text: bytes) -> list[float]:
    """Shares of character classes and of words, and sizes, of a whole text."""
    n = len(text)
    share = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=9)[:9] / max(n, 1)
    words = text.lower().split()
    w = max(len(words), 1)
    counts = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / w
    bare = sum(x in (b"|", b"-", b"*") for x in words) / w
    lines = text.split(b"\n")
    # long words and few distinct ones are normal in long texts, so the share of distinct words is held against the size
    distinct = len(counts) / w ** 0.8
    head = [np.sqrt(v) for v in share]
    return [1.0, *head, same, np.sqrt(same), bare, np.sqrt(bare), distinct, max(counts.values(), default=0) / w, np.log1p(n) / 10, n / w / 10, len(set(lines)) / len(lines), float(n == 0)]


def words_in(text: bytes) -> set[bytes]:
    """Distinct words of letters, A-Z in lower case."""
    return set(_WORD.findall(text.lower()))


def marks(text: bytes, lexicon: dict[bytes, int]) -> list[float]:
    """1 for each word of the lexicon that a text holds, else 0."""
    out = [0.0] * len(lexicon)
    if lexicon:
        for w in words_in(text) & lexicon.keys():
            out[lexicon[w]] = 1.0
    return out


def lexicon_of(base: DataFrame, most: int = WORDS, support: int = 5) -> dict[bytes, int]:
    """Words whose share of toxic documents is furthest above chance. base: text, toxic (0/1)."""
    total = base.agg(F.sum("toxic").alias("b"), F.count("*").alias("n")).first()
    bad, n = int(total["b"] or 0), total["n"]
    if not 0 < bad < n:
        return {}

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_runs(b, "text"):
                found = [(w, y) for t, y in zip(texts, part.column("toxic").to_pylist(), strict=True) for w in words_in(t)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([y for _, y in found], pa.int32())], names=["word", "toxic"])

    seen = base.select("text", "toxic").mapInArrow(run, "word binary, toxic int").groupBy("word").agg(F.sum("toxic").alias("b"), F.count("*").alias("c")).where(F.col("c") >= support)
    expect = F.col("c") * F.lit(bad / n)
    seen = seen.withColumn("z", (F.col("b") - expect) / F.sqrt(expect * F.lit(1 - bad / n))).where("z > 4")
    return {bytes(r["word"]): i for i, r in enumerate(seen.orderBy(F.desc("z"), "word").limit(most).collect())}


class Logistic:
    """Standardised ridge logistic regression by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> None:
        self.mean, self.sd = np.zeros(x.shape[1] if x.ndim == 2 else 1), np.ones(x.shape[1] if x.ndim == 2 else 1)
        self.w = np.zeros(len(self.mean))
        if len(y) == 0 or y.min() == y.max():
            return
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        self.mean[0], self.sd[0] = 0, 1
        z = (x - self.mean) / self.sd
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(self.w))
            step = np.linalg.solve(h, z.T @ (y - p) - ridge * self.w)
            self.w += step
            if np.abs(step).max() < 1e-7:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.clip((x - self.mean) / self.sd, -30, 30) @ self.w, -30, 30) if self.w.any() else np.zeros(len(x))


def good(labels: DataFrame, label: str, toxic: str) -> DataFrame:
    """doc_id, y (1: has the label and isn't toxic), toxic; of several labels the worst counts. Null labels and ids don't count."""
    bad = F.coalesce((F.col(toxic) > 0).cast("int"), F.lit(0)) if toxic in labels.columns else F.lit(0)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col(label) > 0).cast("int").alias("y"), bad.alias("toxic"))
    return known.groupBy("doc_id").agg(F.min(F.col("y") * (1 - F.col("toxic"))).alias("y"), F.max("toxic").alias("toxic"))


def fit(df: DataFrame, known: DataFrame, doc_id: str, text: str, fit_rows: int) -> tuple[Logistic, dict[bytes, int]]:
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    base = df.select(F.col(doc_id).alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(some), "doc_id")
    base = materialize(base, "quality-fit")
    lexicon = lexicon_of(base)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_runs(b, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y").cast(pa.float64()), pa.array([figures(t) for t in texts], pa.list_(pa.float64())), pa.array([[i for i, m in enumerate(marks(t, lexicon)) if m] for t in texts], pa.list_(pa.int32()))], names=["doc_id", "y", "x", "m"])

    schema = T.StructType([base.schema["doc_id"], T.StructField("y", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("m", T.ArrayType(T.IntegerType()))])
    rows = base.mapInArrow(run, schema).orderBy("doc_id").limit(2 * fit_rows).collect()
    x = np.zeros((len(rows), len(figures(b"")) + len(lexicon)))
    for out, r in zip(x, rows, strict=True):
        out[: len(r["x"])] = r["x"]
        out[[len(r["x"]) + i for i in r["m"]]] = 1
    return Logistic(x, np.array([r["y"] for r in rows])), lexicon


def _strength(site: DataFrame, n: str, rate: object, prior: object) -> float:
    """Pseudo-count of a beta prior: the spread of sites' shares beyond what their sizes explain."""
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), prior))
    r = site.where(f"{n} >= 2").agg(F.sum(F.col(n)).alias("n"), F.sum(F.col(n) * (rate - p) * (rate - p) / (p * (1 - p))).alias("chi"), F.count("*").alias("k"), F.sum(F.col(n) * F.col(n)).alias("n2")).first()
    if not r["k"] or r["k"] < 2:
        return 100.0
    spare = r["n"] - r["n2"] / r["n"]
    rho = max(0.0, (r["chi"] - r["k"]) / max(spare, 1.0))  # intra-site correlation
    return float(min(1e6, max(1.0, 1 / rho - 1 if rho > 1e-6 else 1e6)))


def quality_scores(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str | None = "lang", label: str = "quality", toxic: str = "toxic", fit_rows: int = FIT_ROWS, keep: float = KEEP) -> DataFrame:
    """The input's columns with doc_logit, site_logit, quality (posterior) and keep.

    labels: doc_id and 0/1 columns (`toxic` may be absent); several labels of one id count as the worst, labels of unknown ids don't count.
    Null hosts and paths are sites of their own; null and empty texts are scored by the figures of an empty text, texts of
    any length by those of the whole text. Repeated rows are scored alike, and each counts for its site; a label counts
    for all rows of its id. A posterior of exactly `keep` keeps. Own columns take the place of input columns of their
    names. An empty table gives no rows. Without labels of both kinds the classifier says 0 for all, and every row is kept.
    """
    known = good(labels, label, toxic)
    model, lexicon = fit(df, known, doc_id, text, fit_rows)
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0"))
    base = records(df, F.col(f"`{doc_id}`").alias("id"), name(host).alias("host"), (name(path) if path else F.lit("")).alias("path"), F.col(f"`{text}`").alias("__text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_runs(b, "__text"):
                logit = model.logit(np.array([figures(t) + marks(t, lexicon) for t in texts]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("rec", "id", "host", "path")], pa.array(logit)], names=["rec", "id", "host", "path", "logit"])

    docs = base.mapInArrow(run, T.StructType([base.schema["rec"], base.schema["id"], T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("logit", T.DoubleType())]))
    docs = materialize(docs, "quality")
    sigmoid = lambda c: 1 / (1 + F.exp(-c))
    known = known.select(F.col("doc_id").alias("id"), "y")
    # all documents by site from the classifier, then what the labels say of labelled ones instead
    soft = docs.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(sigmoid(F.col("logit"))).alias("s"))
    fix = docs.select("id", "host", "path", "logit").join(known, "id").groupBy("host", "path").agg(F.sum((F.col("y") > 0).cast("double") - sigmoid(F.col("logit"))).alias("d"))
    paths = materialize(soft.join(fix, ["host", "path"], "left").select("host", "path", "n", (F.col("s") + F.coalesce("d", F.lit(0.0))).alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("nh"), F.sum("s").alias("sh"))
    total = hosts.agg(F.sum("nh").alias("n"), F.sum("sh").alias("s")).first()
    mu = (total["s"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    kh = _strength(hosts, "nh", F.col("sh") / F.col("nh"), F.lit(mu))
    hosts = hosts.withColumn("mh", (F.col("sh") + kh * mu) / (F.col("nh") + kh))
    sites = paths.join(hosts, "host")
    kp = _strength(sites, "n", F.col("s") / F.col("n"), F.col("mh"))
    own = sigmoid(F.col("logit"))
    clip = lambda c: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), c))
    m_host = (F.col("sh") - own + kh * mu) / (F.col("nh") - 1 + kh)
    m_path = clip((F.col("s") - own + kp * clip(m_host)) / (F.col("n") - 1 + kp))
    got = docs.join(sites, ["host", "path"]).withColumn("site", F.log(m_path / (1 - m_path)))
    got = got.withColumn("q", sigmoid(F.col("logit") + F.col("site") - F.lit(float(np.log(mu / (1 - mu))))))
    return unpack(got, df.columns, doc_logit="logit", site_logit="site", quality="q", keep=F.col("q") >= keep)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of all `documents`: doc_id, doc_logit, site_logit, quality, keep."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "doc_logit", "site_logit", "quality", "keep")
