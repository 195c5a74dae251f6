"""Summaries of events against the query's SQL."""

import duckdb

import __spark_entry__ as entry


def test_equal_summaries_are_an_event_each(spark, tmp_path):
    """the same texts come again later in the stream, so two events have the same summary."""
    about = ["red apple orchard harvest basket", "engine piston gasket torque valve", "violin sonata cello tempo chord", "glacier moraine tundra permafrost ice"]
    texts = [f"{about[k]} {w}" for k in (0, 1, 2, 3, 1, 2, 0, 3, 1, 2) for w in ("alpha", "beta", "gamma", "delta", "alpha", "beta")]
    free = [n for n in range(120, 40_000, 120) if n % 97 and n % 11][: len(texts)]  # episodic rows, the larger number first
    rows = [(n, t, "en", "web", len(t)) for n, t in zip(reversed(free), texts, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    name = "c7_summaries"
    got = sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(entry.oracle_sql()[name]).fetchall())
    assert len({r[0] for r in want}) < len(want)  # the case that this is about
    assert [(r[0], r[1], float(r[2]), float(r[3]), r[4]) for r in got] == [(r[0], r[1], float(r[2]), float(r[3]), r[4]) for r in want]
