"""As-of joins against a search for each row."""

import random

import pytest

from mnemora.operators.asof import asof, with_era


@pytest.mark.parametrize("ranges", [1, 4, 13])
def test_last_mark_at_or_before(spark, ranges):
    r = random.Random(ranges)
    key = lambda: r.choice(["a", "a", "a", "b", "c", None])  # noqa: E731  one key has half of all rows
    rows = [(i, key(), r.choice([None, *range(200)])) for i in range(300)]
    marks = [(key(), r.choice([None, *range(20, 200, 3)]), r.randrange(50)) for _ in range(60)]
    df = spark.createDataFrame(rows, "id long, k string, at long")
    m = spark.createDataFrame(marks, "k string, at long, v long")
    best = lambda k, at: max(((t, v) for q, t, v in marks if q == k and t is not None and t <= at), default=(None, None))[1]
    got = asof(df, m, "at", ["k"], ["v"], ranges=ranges)
    assert got.columns == ["id", "k", "at", "v"] and {x["id"]: x["v"] for x in got.collect()} == {i: None if at is None else best(k, at) for i, k, at in rows}
    every = lambda at: max(((t, v) for _, t, v in marks if t is not None and t <= at), default=(None, None))[1]
    assert {x["id"]: x["v"] for x in asof(df, m.drop("k"), "at", [], ["v"], ranges=ranges).collect()} == {i: None if at is None else every(at) for i, _, at in rows}
    assert asof(df, m.limit(0), "at", ["k"], ["v"], ranges=ranges).where("v is not null").count() == 0 and asof(df.limit(0), m, "at", ["k"], ["v"]).count() == 0


def test_eras_of_few_and_many_starts(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i * 10) for i in range(50)], "id long, created_at long")
    epochs = spark.createDataFrame([(s,) for s in (95, 5, 200, 333, None)], "started_at long")
    few = {x["id"]: x["era"] for x in with_era(rows, epochs).collect()}
    monkeypatch.setattr("mnemora.operators.asof.FEW", 1)
    assert {x["id"]: x["era"] for x in with_era(rows, epochs).collect()} == few == {i: max(sum(s <= i * 10 for s in (5, 95, 200, 333)) - 1, 0) for i in range(50)}
