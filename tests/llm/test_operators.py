"""Operators on Spark: edge rows, and brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.llm import decontaminate, line_dedup, lm, media, near_dedup, packing, quality, secrets, shards, warc
from mnemora.llm.tokens import default_path, tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row long"
WORDS = [f"w{i}" for i in range(60)]
LONG = " ".join(WORDS * 4 + [f"u{i}" for i in range(300)])


def rows():
    near = LONG.replace("u7 ", "changed ")
    texts = [LONG, near, LONG, None, "", "   ", "one", "one", "tiny text", "x" * 30_000, "É token = 'abcdef12' fin", "other " + " ".join(f"o{i}" for i in range(200))]
    out = [(i, t, ("en", None)[i % 2], (None, "src")[i % 2], len(t or ""), "clash", i) for i, t in enumerate(texts)]
    return [*out, out[0], (None, LONG, None, None, 0, "clash", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_dedup(docs, none):
    got = near_dedup.near_dedup_report(docs, shingle=2)
    assert set(got.columns) == {*docs.columns, "n_shingles", "component_id"} and got.count() == 14
    by = {(r["doc_id"], r["text"]): r for r in got.collect()}
    assert {by[i, rows()[i][1]]["component_id"] for i in (0, 1, 2)} == {0} and by[None, LONG]["component_id"] == 0 and not by[None, LONG]["kept"]
    assert by[6, "one"]["kept"] and by[7, "one"]["component_id"] == 6 and by[3, None]["n_shingles"] == 0 and by[4, ""]["kept"] and by[5, "   "]["kept"]
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5, 6, 8, 9, 10, 11]
    assert near_dedup.near_dedup_report(none).count() == 0


def test_line_dedup(spark, docs, none):
    own = lambda i: "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(6))
    first, last = (lambda i: f"{own(i)} {own(i + 30)} opens with words of its own"), (lambda i: f"so ends {own(i + 60)} {own(i + 90)} {own(i + 120)} {own(i + 150)}")
    body = [(i, "\n".join(["Licensed under the House License 2.0.", first(i), f"User id{i} logged in from here", last(i)]), "en", "s", 0, None, None) for i in range(12)]
    copies = [(100 + i, "head of a copied page with words\nmiddle of a copied page with words\nend of a copied page with words", "en", "s", 0, None, None) for i in range(6)]
    got = line_dedup.drop_lines(spark.createDataFrame(body + copies, SCHEMA))
    by = {r["doc_id"]: r for r in got.collect()}
    assert all(by[i]["text"] == f"{first(i)}\n{last(i)}" and by[i]["n_chars"] == len(by[i]["text"]) for i in range(12))
    assert all(by[100 + i]["text"].count("\n") == 2 for i in range(6))  # copies are the business of document dedup
    same = line_dedup.drop_lines(docs)
    assert same.columns == docs.columns and Counter(r["text"] for r in same.collect()) == Counter(r[1] for r in rows()) and line_dedup.drop_lines(none).count() == 0


def test_line_dedup_of_passages_and_copies(spark):
    own = lambda i: "\n".join(" ".join("".join(chr(97 + (i * 11 + k * k + j * 5 + k * j) % 26) for k in range(7)) + chr(97 + i % 26) * (1 + i // 26) for j in range(9 * n, 9 * n + 9)) for n in range(3))
    passage = "\n".join(f"the {w} line of a passage that is shared" for w in ("opening", "following", "middle", "later", "closing"))
    rows = [f"{own(i)}\n{passage}" for i in range(20)] + [f"{own(0)}\n{passage}"] * 150
    got = line_dedup.drop_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    by = {r["doc_id"]: r["text"] for r in got.collect()}
    assert len(by) == 170 and all(by[i] == own(i if i < 20 else 0) for i in by)


def test_line_dedup_leaves_texts_where_they_are(spark):
    """What the tables of lines have for a document is looked up beside it: no shuffle or join of texts."""
    r = random.Random(2)
    own = lambda: " ".join("".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(9))
    rows = [(i, f"{own()}\nRead more here\n{own()}") for i in range(40)]
    got = line_dedup.recurring(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert [r["drop"] for r in got.collect()] == [[1]] * 40
    docs = spark.range(0, 100, 1, 5).select(F.monotonically_increasing_id().alias("row"))
    side = docs.where("row % 3 = 0 and row >> 33 <> 2").select("row", F.array("row", F.lit(7).cast("long")).alias("x"))
    for order in (docs, docs.orderBy("row"), docs.orderBy(F.desc("row")).coalesce(1), docs.where("false")):
        for r in order.select("row", line_dedup.beside_rows(side, "some").alias("x")).collect():
            assert r["x"] == ([r["row"], 7] if r["row"] % 3 == 0 and r["row"] >> 33 != 2 else None)


def test_line_dedup_of_short_lines_and_edges(spark):
    own = lambda i: " ".join("".join(random.Random(i * 100 + j).choices("abcdefghij", k=9)) for j in range(30))
    rows = [(i, f"{own(i)}\nRead more\n{i}\nBack\nBack", 1) for i in range(60)]
    rows += [(100, None, 1), (101, "", 1), (102, "Back", 1), (103, "one line\n\n", 1), (104, "w" * 100_000 + "\nBack", 1), (105, "\n".join(f"x{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]} {i}" for i in range(30_000)), 1)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, drop int")).collect()}
    assert all(got[i] == f"{own(i)}\n{i}" for i in range(60))  # a line of numbers alone is no template
    assert got[100] is None and got[101] == "" and got[102] == "" and got[103] == "one line\n\n" and got[104] == "w" * 100_000 and got[105] == rows[-1][1]


def test_decontamination(spark, docs, none):
    item = " ".join(f"o{i}" for i in range(20, 60))
    bench = spark.createDataFrame([(1, item), (2, None), (3, " "), (1, item), (4, "absent words only here")], "item_id long, text string")
    hits = decontaminate.leaks(docs, bench).select("rec.doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*").collect()
    assert {(r["doc_id"], r["item_id"], r["edits"], r["start"], r["end"]) for r in hits} == {(11, 1, 0, 21, 61)}
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == 13 and decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).count() == 14


def test_quality(spark, docs, none):
    good = [(i, " ".join(f"{a}{i % 7} reads well and says things" for a in WORDS[i % 9 : i % 9 + 20]), "en", f"s{i % 3}", 0, None, None) for i in range(60)]
    junk = [(100 + i, "BUY!! NOW!! " * 30 + f"X{i}!!", "en", f"s{i % 3}", 0, None, None) for i in range(40)]
    df = spark.createDataFrame(good + junk, SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(100 + i, 0) for i in range(0, 40, 2)] + [(None, 1), (999, 0), (0, None), (2, 1)], "doc_id long, quality int")
    got = quality.quality_scores(df, labels).select("doc_id", "keep").collect()
    assert all(r["keep"] == (r["doc_id"] < 100) for r in got)  # half of these were held out
    edge = quality.quality_scores(docs, labels.limit(0))
    assert edge.count() == 14 and edge.where("keep").count() == 14 and quality.quality_scores(none, labels).count() == 0


def test_quality_of_toxic_prose(spark):
    prose = lambda i, insult: " ".join([f"{WORDS[(i * 7 + k * k) % 60]} reads well" for k in range(30)] + [f"you {insult}." if insult else "you friend."])
    df = spark.createDataFrame([(i, prose(i, ("", "", "", "Dolt", "knave")[i % 5]), "en", f"s{i % 3}") for i in range(400)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 > 2)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(df, labels).select("doc_id", "keep").collect()
    assert len(got) == 400 and all(r["keep"] == (r["doc_id"] % 5 < 3) for r in got)


def test_media(docs, none):
    got = media.read_back(media.to_flac(docs.select("doc_id", "text")))
    for r in got.collect():
        t = (rows()[r["doc_id"]][1] if r["doc_id"] is not None else LONG) or ""
        p = t.encode() + bytes(-len(t.encode()) % 64 if t else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert b"".join(b["pcm"] for b in r["blocks"]).translate(media.FROM_SAMPLE) == p and [b["sample_offset"] for b in r["blocks"]] == list(range(0, len(p), 1024))
    blocks = media.pcm_blocks(media.to_flac(docs.where("doc_id = 9")))
    assert [r["sample_offset"] for r in blocks.orderBy("block").collect()] == list(range(0, 30016, 1024))
    assert media.read_back(media.to_flac(none)).count() == 0


def test_media_columns_asked_for(spark, docs):
    stored = media.to_flac(docs.select("doc_id", "text").where("doc_id < 20")).cache()
    only = ("payload_sha256", "tail_crc32")
    got = media.read_back(stored, only=only)
    assert got.columns == ["doc_id", "n_bytes", *only]
    assert sorted(got.collect()) == sorted(media.read_back(stored).select(got.columns).collect())
    broken = stored.limit(1).withColumn("media", F.expr("substr(media, 1, octet_length(media) - 2)"))
    with pytest.raises(Exception):
        media.read_back(broken, only=only).collect()


def test_media_of_long_texts_and_clashes(spark):
    texts = ["é b " * 40_000, "x" * 131_009, "word and word " * 220_000, None]
    df = spark.createDataFrame([(i, t, 7, "old") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, feature string")
    got = {r["doc_id"]: r for r in media.read_back(media.to_flac(df)).collect()}
    for i, t in enumerate(texts):
        p = (t or "").encode()
        p += bytes(-len(p) % 64 or (0 if p else 64))
        assert got[i]["n_bytes"] == len((t or "").encode()) and got[i]["payload_sha256"] == hashlib.sha256(p).hexdigest() and got[i]["feature"].startswith(f"n={len(p)};")


def _pieces(df):
    tok = tokenizer(default_path())
    return [[*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in df.collect()]


def test_packing(docs, none):
    want = Counter(tuple(x) for x in _pieces(docs))
    got = packing.pack(docs, length=64).collect()
    line = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in line:
        assert r["sequence_id"] * 64 + r["offset"] == at and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["length"]
    assert at == sum(len(k) * n for k, n in want.items())
    seen, held = Counter(), []
    for r in line:  # a document's pieces follow each other
        held.extend(np.frombuffer(r["ids"], "<u4").tolist())
        if r["start"] + r["length"] == r["doc_tokens"]:
            seen[tuple(held)] += 1
            held = []
    assert seen == want and packing.pack(none).count() == 0


def test_shards(docs, none):
    manifest = shards.write_shards(docs, length=64, records=8)
    got = shards.read_shards(manifest, length=64, records=8).collect()
    ids = [p[i : i + 64] for p in _pieces(docs) for i in range(0, len(p), 64)]
    assert sorted(r["slot"] for r in got) == list(range(len(ids))) and Counter(r["ids_crc32"] for r in got) == Counter(zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids)
    assert sum(r["doc_id"] is None for r in got) == len([1 for i in range(0, len(_pieces(docs.where("doc_id is null"))[0]), 64)])
    # the slot of each sequence is the permutation's of its place in the table
    place = {}
    for part in docs.select(F.spark_partition_id().alias("p"), "doc_id", "text", F.monotonically_increasing_id().alias("m")).orderBy("p", "m").collect():
        for k in range(0, len(p := [*tokenizer(default_path()).encode(part["text"] or "", add_special_tokens=False).ids, 2]), 64):
            place[len(place)] = (part["doc_id"], k // 64, zlib.crc32(np.array(p[k : k + 64], "<u4").tobytes()))
    slots = shards.feistel(np.arange(len(place)), len(place))
    assert {r["slot"]: (r["doc_id"], r["chunk"], r["ids_crc32"]) for r in got} == {int(slots[n]): v for n, v in place.items()}
    assert sorted((r["shard"], r["slot"] // 8) for r in got) == sorted((s, s) for s in (r["shard"] for r in got))
    a, b = shards.SlotReader(manifest, 64, 8), shards.SlotReader(manifest, 64, 8)
    whole = a.read(len(ids) + 5)
    b.slot = 13
    assert len(whole) == len(ids) and all((p == q).all() for p, q in zip(b.read(9), whole[13:22], strict=True))
    assert shards.write_shards(none).count() == 0


def test_lm(docs, none, spark):
    train = F.col("doc_id") % 2 == 0
    got = lm.score_texts(docs.select("doc_id", "text", "row"), train, word_share=0.01, gram_share=0.005).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for r in rows() if r[0] is not None and r[0] % 2 == 0 for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    for r in got:
        t = tokens(rows()[r["doc_id"]][1] if r["doc_id"] is not None else LONG)
        assert r["n_tokens"] == len(t) and r["train_tokens"] == n and r["n_known"] == sum(c[w] > 0 for w in t) and r["score"] < 0
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t))
    assert lm.score_texts(none, train).count() == 0
    alone = lm.score_texts(docs.select("doc_id", "text"), F.lit(False)).collect()
    assert all(r["base_score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in alone)


def test_lm_keeps_rare_ngrams_of_large_corpora(spark):
    filler = [" ".join(f"w{(i * 31 + k * k) % 997}" for k in range(8000)) for i in range(200)]
    texts = [*filler, "seldom seen phrase of words", "seldom seen phrase of words", "seldom seen phrase once", "phrase seen seldom of", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learnt = len(texts) - 2
    grams = [Counter() for _ in range(3)]
    for t in texts[:learnt]:
        w = [*t.split(), None]
        for k, c in enumerate(grams):
            c.update(zip(*[w[j:] for j in range(k + 1)], strict=False))
    ids = {w: i for i, (w,) in enumerate(sorted(grams[0], key=str))}
    often = [{tuple(ids[x] for x in g): n for g, n in c.items() if n >= 2} for c in grams[1:]]
    auto = lm.Automaton(len(ids), np.array([*[grams[0][w,] for w in ids], 0]), {(u, v): n for (u, v), n in often[0].items()}, {g: n for g, n in often[1].items()})
    got = {r["doc_id"]: r for r in lm.score_texts(df, F.col("doc_id") < learnt).collect()}
    for i in [0, *range(200, len(texts))]:
        assert got[i]["score"] == pytest.approx(auto.score([ids[w] for w in [*texts[i].split(), None]]), rel=1e-9)
    assert got[200]["n_known"] == 6 and got[200]["train_tokens"] == sum(grams[0].values()) > 1_500_000


def test_lm_leaves_chunks_where_they_are(spark):
    """Chunks are written once in buckets; neither they nor their answers are shuffled where they meet, and no table stays in the catalog."""
    df = spark.createDataFrame([(i, f"a b c w{i % 7} d e") for i in range(50)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lm.score_texts(df, F.col("doc_id") % 2 == 0)
        assert len(got.collect()) == 50 and not spark.catalog.listTables()
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_secrets_operator(docs, none):
    got = secrets.find_secrets(docs)
    assert set(got.columns) == {*docs.columns, "secrets"}
    by = {r["doc_id"]: r["secrets"] for r in got.collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in by[10]] == [("assign", 2, 19)] and by[3] == [] and by[4] == [] and secrets.find_secrets(none).count() == 0


def test_warc_operator(spark):
    big = "<p>" + "é" * 800
    pages = [(1, "http://a.org/x", big, 0), (2, "http://b.org/y", big, 0), (3, "http://a.org/x", big, 0), (4, None, "small", 0), (5, "http://a.org/x", "small", 0), (6, "http://c.org/", None, 0), (7, "bad url", "", 0), (7, "bad url", "", 0), (None, "http://n.org/", big, 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest long")
    directory = warc.write_archives(df, lines=2)
    got = warc.read_archives(directory).collect()
    kinds = {r["page"]: (r["type"], r["refers"]) for r in got}
    assert len(got) == 9 and kinds["1"] == ("revisit", "3") and kinds["2"] == ("revisit", "3") and kinds["3"] == ("response", None) and kinds[None] == ("response", None) and kinds["4"] == kinds["5"] == ("response", None)
    for r in got:
        html = next(p[2] for p in pages if str(p[0]) == str(r["page"])) or ""
        assert r["digest"] == hashlib.sha1(html.encode()).hexdigest() and r["length"] == len(html.encode())
    index = warc.CaptureIndex(directory)
    assert sorted(h["warc-record-id"] for h, _ in index.lookup("https://A.org/x#f")) == ["<urn:page:1>", "<urn:page:3>", "<urn:page:5>"] and index.lookup("http://none.org/") == []
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_lookup_finds_every_url(spark):
    urls = [f"http://h{i:03d}.{('org', 'Com', 'net')[i % 3]}/p{i}" for i in range(150)] + [f"https://h{i:03d}.org?q={i}" for i in range(150)] + [f"h{i}.org/x" for i in range(20)]
    urls += ["http://h001.org", "http://h001.org/", "http://[::1]:80/x", "//no.scheme/y", "http://", " http://sp.org/ ", "http://u@h.org:8080", "http://ÉÀ.org/é", "a\u2028b", "", None, "http://same.org/"] + ["http://same.org/"] * 40
    df = spark.createDataFrame([(None if i % 9 == 0 else f"id\n{i}%", u, f"body {i}" * (300 if i % 2 else 1)) for i, u in enumerate(urls)], "page_id string, url string, html string")
    keys = df.select("url", warc.key_column(F.col("url")).alias("k")).collect()
    assert all(r["k"] == warc.reversed_host(r["url"]) for r in keys)
    index = warc.CaptureIndex(warc.write_archives(df, lines=4))
    held = Counter(warc.reversed_host(u) for u in urls)
    for u in urls:
        assert len(index.lookup(u)) == held[warc.reversed_host(u)]
    assert index.lookup("http://h001.org/none") == [] and sum(r["captures"] for r in index.directory.collect()) == len(urls)
