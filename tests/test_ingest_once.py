"""Ingest prepares what is new, once; sums over earlier rows skip blocks of later ones."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mnemora.functions.vector import Provider
from mnemora.operators import similarity as sm
from mnemora.operators.blocks import Blocks
from mnemora.operators.ingest import ingest
from mnemora.sources.schemas import empty


def test_only_new_texts_are_embedded(spark):
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def counted(t: pd.Series) -> pd.Series:
        made.add(len(t))
        return t.map(lambda s: [1.0, float(len(s))])

    rows = [(f"Text {i % 10} of the ledger" if i % 7 else "  \n", "notes", None, None, f"s{i % 3}", "user", 100 + i % 20) for i in range(200)] + [(None, "notes", None, None, "s", "user", 1)]
    asks = spark.createDataFrame(rows, "text string, source string, tags array<string>, memory_type string, session_id string, role string, arrival_ts long")
    got = ingest(asks, empty(spark, "memory_items"), Provider("counted", 2, counted))
    items = {r["content"]: r for r in got["memory_items"].collect()}
    assert made.value == len(items) == 10
    for text, row in items.items():
        at = [r[6] for r in rows if r[0] == text]
        assert (row["created_at"], row["access_count"], row["updated_at"]) == (min(at), len(at) - 1, max(at))
    assert {r["session_id"] for r in got["raw_events"].collect()} <= {"s0", "s1", "s2"} and got["raw_events"].count() == 10


def test_sums_over_earlier_rows(spark, monkeypatch):
    """Equal times, rows without a time (the last), rows of another size; each block meets only those that begin before it ends."""
    r = np.random.default_rng(3)
    v = r.normal(size=(400, 5))
    at = [None if i % 50 == 7 else int(i * 7 % 130) for i in range(400)]
    rows = [(f"k{i:03d}", v[i].tolist() if i % 40 else [1.0, 2.0], at[i]) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>, at long")
    seen = []
    run = Blocks.run
    monkeypatch.setattr(Blocks, "run", lambda self, tickets, *a: (seen.append((self, tickets)), run(self, tickets, *a))[1])
    stored, asks = df.where("substr(id, 2) % 3 = 0"), df.where("substr(id, 2) % 3 > 0")
    got = {x["id"]: x for x in sm.neighbor_sums(stored, 0.5, "at", block=16, queries=asks).collect()}
    blocks, tickets = seen[0]
    n = sum(map(len, blocks.groups.values()))
    assert sum(len(b) for _, b in tickets) < 0.7 * n * n
    order = {i: (at[i] if at[i] is not None else 2**63 - 1, rows[i][0]) for i in range(400)}
    for i in (j for j in range(400) if j % 3):
        mine = np.array(rows[i][1])
        cos = [float(mine @ np.array(rows[j][1]) / np.linalg.norm(mine) / np.linalg.norm(rows[j][1])) for j in range(400) if order[j] < order[i] and len(rows[j][1]) == len(mine)]
        assert abs(got[rows[i][0]]["best"] - max([0.0, *cos])) < 1e-12 and got[rows[i][0]]["near"] == sum(c >= 0.5 for c in cos)
    assert len(got) == sum(j % 3 > 0 for j in range(400))
