"""Rules of the text, score, extraction, parsing and sketch functions."""

import math

import pytest
from pyspark.sql import functions as F

from mnemora.functions import extract, parsing, sketch
from mnemora.functions import scoring as m
from mnemora.functions import text as x
from mnemora.functions import vector as v
from mnemora.plans.config import Config, load, resolve
from mnemora.sources.schemas import conform


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_normalize_hash_tokens(spark):
    r = one(spark, x.normalize(F.lit("  hello \n  world  ")), x.content_hash(F.lit("Hello  World")) == x.content_hash(F.lit("hello world")), x.content_hash(F.lit("hello world")) == x.content_hash(F.lit("hello mars")), x.tokenize(F.lit("The API-key, of Zoë: x 7 it")))
    assert r[0] == "hello world" and r[1] and not r[2] and r[3] == ["api", "key", "zoë"]


def test_keywords_and_topic(spark):
    words = x.keywords(F.lit("the billing system and the billing invoices"), 3)
    none, tag = F.array().cast("array<string>"), F.array(F.lit("project:plotperfect"))
    r = one(spark, words, x.guess_topic(tag, words), x.guess_topic(none, words))
    assert r[0][0] == "billing" and "the" not in r[0] and r[1] == "plotperfect" and r[2] == "billing"


def test_chunks_closed_form(spark):
    for n in (0, 1, 100, 101, 180, 181, 500):
        text = " ".join(f"w{i}" for i in range(n))
        got = one(spark, x.chunks(F.lit(text), 100, 20))[0]
        want = 0 if n == 0 else 1 if n <= 100 else math.ceil((n - 100) / 80) + 1
        assert len(got) == want
        assert not n or got[-1].split()[-1] == f"w{n - 1}"


def test_input_modes(spark):
    doc = "# Heading\n- a\n- b\n- c\n" * 20 + "x " * 400
    r = one(spark, x.input_mode(F.lit("hello there")), x.input_mode(F.lit("```\n" + "a\n" * 9 + "```")), x.input_mode(F.lit("a traceback here")), x.input_mode(F.lit(doc)), x.input_mode(F.lit("w " * 300)), x.line_count(F.lit("a\nb\n")), x.line_count(F.lit("")))
    assert tuple(r) == ("conversation_message", "code_block", "log_dump", "pasted_document", "mixed_message", 2, 0)


def test_score_and_decay(spark):
    f = F.lit
    args = [f(0.8), f(0.6), f(0.4), f(0.5), f(0.0)]
    r = one(spark, m.retrieval_score(*args, f(False), f(False))["total"], m.retrieval_score(*args, f(True), f(False))["total"], m.retrieval_score(*args, f(False), f(True))["total"], m.decay_score(f(0.8), f(0.1), f(10.0), f(False)), m.decay_score(f(0.8), f(0.1), f(10.0), f(True)), m.decay_resisted(f(0.8), f(0.35), f(20.0), f(False), f(1.0), 0.7), m.decay_score(f(0.8), f(0.105), f(20.0), f(False)))
    assert r[0] == pytest.approx(0.655) and r[1] == pytest.approx(0.705) and r[2] == pytest.approx(0.455)
    assert r[3] == pytest.approx(0.8 / math.e) and r[4] == 0.8 and r[5] == pytest.approx(r[6])


def test_neighbor_classes(spark):
    f = F.lit
    r = one(spark, m.neighbor_class(f(0.2), f(0), f(0.0), f(0.0)), m.neighbor_class(f(0.85), f(5), f(0.6), f(0.004)), m.neighbor_class(f(0.8), f(6), f(0.75), f(0.9)), m.neighbor_class(f(0.8), f(1), f(0.1), f(0.0)))
    assert tuple(r) == ("surprise", "burst", "habit", "ordinary")


def test_extraction():
    p = extract.parse("I love coffee in Philly.", "conversation_message")
    c = p["candidates"][0]
    assert (c["candidate_type"], c["subject"], c["predicate"], c["object"]) == ("preference_strong", "user", "likes", "coffee") and p["confidence"] >= 0.75
    assert extract.correction("we switched from Postgres to SQLite last week") == ("Postgres", "SQLite")
    assert extract.correction("migrated the main database to SQLite") == (None, "SQLite")
    assert extract.correction("the main database runs on Postgres") is None
    assert extract.swapped("the rate limit is 100", "the rate limit is 500") == ("100", "500")
    assert extract.slot("I changed my api key to x") == "api key"
    assert extract.judge("rate limit is 100", "rate limit is 500", "single")[0] == 0.7
    assert extract.judge("rate limit is 100", "rate limit is 500", "multi") is None


def test_extraction_columns(spark):
    df = spark.createDataFrame([("we switched from Postgres to SQLite",), ("plain",), (None,)], "t string")
    got = df.select(extract.correction_cue(F.col("t")).alias("c"), extract.slot_phrase(F.lit("my manager is Ann")).alias("s"), extract.parsed(F.col("t"), F.lit("conversation_message")).alias("p")).collect()
    assert got[0]["c"]["new"] == "SQLite" and got[1]["c"] is None and got[2]["c"] is None and got[0]["s"] == "manager" and got[2]["p"]["reasons"]


def test_vectors(spark):
    a, zero = v.literal_vector([3.0, 4.0]), v.literal_vector([0.0, 0.0])
    r = one(spark, v.cosine(a, a), v.cosine(a, zero), v.cosine(a, v.literal_vector([1.0])), v.unit(a), v.decode_vector(v.encode_vector(v.literal_vector([1.5, -2.0]))))
    assert r[0] == pytest.approx(1) and r[1] == 0 and r[2] == 0 and r[3] == pytest.approx([0.6, 0.8]) and r[4] == [1.5, -2.0]
    b = one(spark, v.hashed_bow(F.lit("billing invoices")), v.hashed_bow(F.lit("")))
    assert sum(y * y for y in b[0]) == pytest.approx(1) and not any(b[1])
    df = spark.createDataFrame([("k", [1.0, 0.0]), ("k", [0.0, 1.0])], "g string, embedding array<double>")
    assert v.centroid(df, ["g"]).first()["centroid"] == pytest.approx([math.sqrt(0.5)] * 2)
    bad = v.provider("remote", 3, lambda t: 1 / 0)
    assert one(spark, bad.embed(F.lit("a")))[0] == [0.0, 0.0, 0.0]


def test_parsing(spark):
    f = F.lit
    r = one(spark, parsing.decode_list(f("oops")), parsing.decode_list(f('["a"]')), parsing.tool_call(f('see\n```json\n{"tool": "ls", "args": {"p": 1}}\n```')), parsing.shell_command(f("```bash\n$ ls -l\n# no\n```")), parsing.ndjson_line(f('{"message":{"content":"hi"},"done":true,"total_duration":5000000}')), parsing.sse_line(f('data: {"choices":[{"delta":{"content":"x"}}]}')), parsing.model_names(f('{"models":[{"name":"a:1"}]}')), parsing.supersede_args(f('{"loser_id":" a ","winner_id":"b"}')), x.remembered(f("```remember\n- one\n* two\n```")))
    assert r[0] == [] and r[1] == ["a"] and r[2]["tool"] == "ls" and r[3] == "ls -l" and r[4]["duration_ms"] == 5 and r[4]["done"] and r[5]["delta"] == "x" and r[6] == ["a:1"] and r[7]["loser_id"] == "a" and r[8] == ["one", "two"]
    assert parsing.reads_only("grep -n x src/a.py") and parsing.reads_only("git log -3")
    assert not any(parsing.reads_only(c) for c in ("rm x", "cat /etc/passwd", "ls; rm x", "find . -delete", "git push", "cat ../x", "ls > y"))


def test_urls_paths_wrapping(spark):
    f = F.lit
    r = one(spark, x.is_local_url(f("http://localhost:11434/api")), x.is_local_url(f("https://example.org")), x.render_path(F.array(f("a"), f("b")), F.array(f("sequence"))), x.active_scope(f(None).cast("string"), f("p"), f("t")), x.first_object(x.phrase_after(f("I love: coffee, strong. yes"), "i love")))
    assert r[0] and not r[1] and r[2] == '"a" —(led to)→ "b"' and r[3] == "project:p" and r[4] == "coffee"


def test_sketches(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"))
    inside = keys.where("cast(substr(k, 2) as int) < 1000")
    got = sketch.bloom_contains(keys, "k", sketch.bloom_build(inside, "k", 1000, 0.01), 1000, 0.01).groupBy(F.expr("cast(substr(k, 2) as int) < 1000").alias("in")).agg(F.count_if("maybe").alias("n")).collect()
    n = {r["in"]: r["n"] for r in got}
    assert n[True] == 1000 and n[False] < 50
    many = spark.createDataFrame([("billing",)] * 7 + [("onboarding",)] * 3, "k string")
    est = {r["k"]: r["estimate"] for r in sketch.count_min_estimate(many.select("k").distinct().union(spark.createDataFrame([("none",)], "k string")), "k", sketch.count_min_build(many, "k")).collect()}
    assert est["billing"] >= 7 and est["onboarding"] >= 3 and est["none"] == 0
    n = spark.range(5000).agg(F.hll_sketch_estimate(sketch.hll(F.col("id").cast("string"))).alias("n")).first()["n"]
    assert abs(n - 5000) < 500
    a = sketch.reservoir(keys, "k", 5).collect()
    assert len(a) == 5 and a == sketch.reservoir(keys, "k", 5).collect()


def test_config(tmp_path):
    c = load("dim = 64\n[segment]\nwindow = 3\n[decay]\nepisodic = 0.5\n")
    assert c.dim == 64 and c.segment.window == 3 and c.segment.tau == 16 and c.decay["episodic"] == 0.5 and c.decay["foundation"] == 0
    for bad in ("dim = 2", "nope = 1", "[segment]\npredictor = 'x'"):
        with pytest.raises(ValueError):
            load(bad)
    (tmp_path / "m.toml").write_text("root = 'here'")
    assert resolve(str(tmp_path / "m.toml")).root == str(tmp_path / "here") and resolve(local=str(tmp_path / "none")) == Config()
    with pytest.raises(FileNotFoundError):
        resolve(str(tmp_path / "gone.toml"))


def test_conform_checks_enums(spark):
    df = spark.createDataFrame([("a", "semantic")], "id string, memory_type string")
    r = conform(df, "memory_items").first()
    assert r["importance_score"] == 0.5 and r["tags"] == [] and r["stale"] is False
    with pytest.raises(Exception, match="unknown memory_type"):
        conform(spark.createDataFrame([("a", "nope")], "id string, memory_type string"), "memory_items").collect()
