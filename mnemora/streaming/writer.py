"""Streaming ingest and incremental updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState

from mnemora.functions.text import content_hash
from mnemora.operators.ingest import ingest
from mnemora.operators.segment import MIN_SURPRISE, SIGMA_FLOOR
from mnemora.plans.config import Segment
from mnemora.sources.store import Store, id_pairs


def write_stream(requests: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is ingested and published; a repeat of one is harmless, as hashes and ids are keys. Logs are appended to, the memories (whose scores move) are a new version; Store.compact() joins what has piled up."""

    def batch(df: DataFrame, _: int) -> None:
        for name, rows in ingest(df, store.read("memory_items")).items():
            if name == "memory_items":
                store.save(name, rows)  # repeats change stored rows
            else:
                store.append(name, rows.join(store.read(name).select("id"), "id", "left_anti"))

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def flush(query: StreamingQuery) -> None:
    """What was submitted before is readable after."""
    query.processAllAvailable()


def first_arrivals(requests: DataFrame, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Z3: one row of each text. With an event time, state is dropped `delay` after it; without, it grows with the texts."""
    keyed = requests.withColumn("content_hash", content_hash(F.col("text")))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"]) if time else keyed.dropDuplicates(["content_hash"])


def pair_counts(turns: DataFrame) -> DataFrame:
    """Running counts of pairs of memories over a stream of turns (update or complete mode)."""
    return turns.select(F.explode(id_pairs(F.col("memory_ids"))).alias("p"), "created_at").groupBy("p.a", "p.b").agg(F.count("*").alias("co_count"), F.max("created_at").alias("last_activated"))


def session_counts(events: DataFrame, time: str = "ts", gap: str = "30 minutes", delay: str = "1 hour", user: str = "user_id") -> DataFrame:
    """Z8 and an extra: activity by session window, closed `delay` after the latest event."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


class ChangeListener(StreamingQueryListener):
    """Calls back with the number of rows of each micro-batch that had some."""

    def __init__(self, tell: Callable[[int], None]) -> None:
        self.tell = tell

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        if event.progress.numInputRows:
            self.tell(event.progress.numInputRows)

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        pass


def rolling_surprise(stream: DataFrame, c: Segment = Segment()) -> DataFrame:
    """(stream_id, ord, surprise, boundary) with the last `window` vectors and `tau` signals of each stream as state. Rows of a stream must arrive in order."""
    decay = {"centroid": 1.0, "weighted": c.decay, "extrapolate": 0.5}[c.predictor]

    def unit(v: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(v)
        return v / n if n > 0 else v

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, signals, count, last = state.get if state.exists else ([], [], 0, 0)
        dim = len(seen) // min(count, c.window) if count else 0
        window = [np.array(seen[i * dim : (i + 1) * dim]) for i in range(min(count, c.window))] if dim else []
        signals = list(signals)
        for pdf in frames:
            rows = []
            for at, v in pdf.sort_values("ord")[["ord", "embedding"]].itertuples(index=False):
                u = unit(np.asarray(v, np.float64))
                s, cut = 0.0, False
                if len(window) == c.window:
                    p = unit(sum(w * decay ** (c.window - 1 - k) for k, w in enumerate(window)))
                    s = float(np.clip(1 - np.clip(p @ u, -1, 1), 0, 2)) if u.any() and p.any() else 1.0
                    if len(signals) >= 2:
                        cut = s > np.mean(signals) + c.gamma * max(np.std(signals), SIGMA_FLOOR) and s > MIN_SURPRISE and count - last >= c.min_len
                    signals = [*signals, s][-c.tau :]
                last = count if cut else last
                window = [*window, u][-c.window :]
                count += 1
                rows.append((key[0], at, s, bool(cut)))
            yield pd.DataFrame(rows, columns=["stream_id", "ord", "surprise", "boundary"])
        state.update(([float(x) for w in window for x in w], [float(x) for x in signals], count, last))

    return stream.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, ord long, surprise double, boundary boolean", "seen array<double>, signals array<double>, count long, last long", "append", "NoTimeout")


def events_source(spark: SparkSession, path: str, schema: Any, per_trigger: int = 1) -> DataFrame:
    """A file stream of Parquet parts."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
