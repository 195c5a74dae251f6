"""The corpus pipeline and the classifier against brute force on small tables."""

import random
import resource
import zlib
from collections import Counter

import numpy as np
import pytest

from mnemora.llm import quality
from mnemora.llm.common import tidy
from mnemora.llm.decontaminate import Symbols, allowed, best_part
from mnemora.llm.tokens import default_path, tokenizer
from test_near_dedup import brute

BOILER = ["Read more", "Licensed under the House License 2.0 of long ago.", "Follow us on all the usual places and subscribe to it."]
ITEM = "what colour is the old lighthouse door when the tide comes in at noon on a grey sunday in may"


def prose(seed, lines=4):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmnoprstuv", k=r.randrange(3, 9))) for _ in range(400)]
    return "\n".join(" ".join(r.choices(words, k=18)).capitalize() + "." for _ in range(lines))


def corpus():
    docs = [(i, "\n".join([prose(i), *BOILER]) if i % 2 else prose(i)) for i in range(40)]
    near = prose(3).replace("\n", " x1\n", 1)
    docs += [(100, near), (101, prose(3)), (102, "\n".join([prose(3), BOILER[0]]))]
    docs += [(110 + i, prose(200 + i) + "\n" + ITEM + (" indeed" if i else "")) for i in range(3)]
    docs += [(120, prose(300) + "\n" + ITEM.replace("old ", "").replace("grey", "gray"))]
    docs += [(200 + i, "BUY!! NOW!! " * 30 + f"X{i}!!") for i in range(20)]
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs] + [(100, near, "en", "s1", len(near))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(200 + i, 0, 0) for i in range(0, 20, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "not in any of these documents at all my friend")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def expected():
    """Texts by id that are left, by brute force: junk goes, boilerplate lines go, one of each group of near copies, no item within its edits."""
    rows = [(i, "\n".join(x for x in t.split("\n") if x not in BOILER)) for i, t, *_ in corpus() if i < 200]
    root, _ = brute([t for _, t in rows], 5)
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(root[k], []).append((i, k, t))
    kept = [min(g) for g in groups.values()]
    memo = Symbols()
    item = memo.read(ITEM.encode()).tolist()
    return {i: t for i, _, t in kept if best_part(item, memo.read(t.encode()).tolist())[0] > allowed(len(item), 0.15)}


def test_run_against_brute_force(spark, folder):
    import corpus_pipeline

    want = expected()
    assert set(want) == set(range(40))
    tok = tokenizer(default_path())
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in want.items()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == set(want)
    for i, full in ids.items():
        pieces = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        at = 0
        for r in pieces:
            assert r["start"] == at and r["doc_tokens"] == len(full) and r["ids_crc32"] == zlib.crc32(np.array(full[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(full)
    line = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    assert all(s * 4096 + o == sum(n for _, _, n in line[:k]) for k, (s, o, _) in enumerate(line))


def test_results_of_operators_survive_stages(spark, folder):
    import corpus_pipeline
    from mnemora.llm.near_dedup import near_dedup_report

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = near_dedup_report(docs)
    corpus_pipeline.near(spark, docs, folder).count()
    corpus_pipeline.decontaminate(spark, docs, folder).count()
    assert before.count() == docs.count()


def test_stages_on_empty_tables_and_clashes(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).columns == docs.columns
    odd = spark.createDataFrame([(1, None, "en", "s", 0, "k", 5), (2, "", "en", None, 0, "k", 5), (None, "a b c", None, "s", 5, "k", 5)], "doc_id long, text string, lang string, source string, n_chars long, kept string, row long")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns and Counter(map(tuple, out.collect())) == Counter(map(tuple, odd.collect())), name


def test_posteriors_against_arithmetic(spark):
    """Site posteriors and the posterior of each document, computed anew from the documents' log-odds and the labels."""
    r = random.Random(6)
    rows = [(i, prose(i, 2) if r.random() < 0.7 else "BUY!! NOW!! " * 20 + f"{i}!!", f"h{i % 4}", f"p{i % 3}") for i in range(160)]
    labels = {i: int("BUY" not in t) for i, t, *_ in rows if i % 3 == 0}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {x["doc_id"]: x for x in quality.quality_scores(df, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    p = {i: 1 / (1 + np.exp(-got[i]["doc_logit"])) for i in got}
    y = {i: labels.get(i, p[i]) for i in got}
    mu = (sum(y.values()) + 0.5) / (len(y) + 1)

    def strength(groups, prior):
        chi = sum(len(g) * (np.mean([y[i] for i in g]) - prior[k]) ** 2 / (prior[k] * (1 - prior[k])) for k, g in groups.items())
        n, n2 = sum(map(len, groups.values())), sum(len(g) ** 2 for g in groups.values())
        rho = max(0.0, (chi - len(groups)) / max(n - n2 / n, 1.0))
        return min(1e6, max(1.0, 1 / rho - 1 if rho > 1e-6 else 1e6))

    hosts, paths = {}, {}
    for i, _, h, q in rows:
        hosts.setdefault(h, []).append(i)
        paths.setdefault((h, q), []).append(i)
    kh = strength(hosts, dict.fromkeys(hosts, mu))
    mh = {h: (sum(y[i] for i in g) + kh * mu) / (len(g) + kh) for h, g in hosts.items()}
    kp = strength(paths, {k: mh[k[0]] for k in paths})
    for i, _, h, q in rows:
        host = (sum(y[j] for j in hosts[h]) - p[i] + kh * mu) / (len(hosts[h]) - 1 + kh)
        path = (sum(y[j] for j in paths[h, q]) - p[i] + kp * host) / (len(paths[h, q]) - 1 + kp)
        logit = np.log(path / (1 - path))
        assert got[i]["site_logit"] == pytest.approx(logit, abs=1e-6)
        assert got[i]["quality"] == pytest.approx(1 / (1 + np.exp(-(got[i]["doc_logit"] + logit - np.log(mu / (1 - mu))))), abs=1e-6)


def test_workers_keep_no_memory_between_tasks(spark, folder, monkeypatch):
    """What a task frees goes back to the system, though later work lies behind it; all Arrow kernels of the stages do so."""
    import corpus_pipeline
    from pyspark.sql import DataFrame

    frame, seen = type(spark.range(0)), []
    assert issubclass(frame, DataFrame)
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: seen.append(f) or plain(self, f, *a, **b))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).count()
    assert len(seen) >= 10 and all(f.__wrapped__ for f in seen)

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize() / 1e6

    later = []

    def work(batches):
        held = [bytes(1000) for _ in range(200_000)]
        later.append(bytes(1000))
        yield from batches
        del held

    before = resident()
    assert list(tidy(work)([1, 2])) == [1, 2]
    assert resident() - before < 60
