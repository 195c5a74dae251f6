"""Surprise segmentation of ordered embedding streams (T1s-T11s, W2-W7, J13, A21, A22).

`segment` works on the vectors of a stream; `segmented` gives the same for streams of any length. A stream of up to a block's
rows is one group. Longer ones are cut into blocks with halos (ranges.py): surprise and threshold need the vectors just
before. Which places become cuts depends on the cut before by its distance only, up to `min_len`; where refinement puts them
depends on the place of the one before, as far as that is near. Both are automata of a few states, so each block works out
its result for every state in which the stream may reach it, and the states follow from the blocks' tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mnemora.functions.vector import Provider
from mnemora.operators.ranges import BLOCK_ROWS, SMALL, blocks, positions, prefix_states
from mnemora.operators.similarity import cut_lineage
from mnemora.plans.config import Segment

# Least surprise of a boundary, floor of the deviation, cosine of sides that are one topic.
MIN_SURPRISE, SIGMA_FLOOR, SAME_SIDE = 0.10, 1e-9, 0.95


def _units(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > np.finfo(np.float32).eps)


def surprise(units: np.ndarray, c: Segment) -> np.ndarray:
    """1 - cosine of each vector to what the `window` before it predict; 0 while they are fewer, 1 for zero vectors."""
    n, w = len(units), c.window
    out = np.zeros(n)
    if n <= w:
        return out
    seen = np.lib.stride_tricks.sliding_window_view(units[:-1], w, axis=0)  # [n - w, dim, w]
    if callable(c.predictor):  # E3: a window [w, dim] to the vector that should follow
        predicted = _units(np.stack([np.asarray(c.predictor(v.T), np.float64) for v in seen]))
    else:
        decay = {"centroid": 1.0, "weighted": c.decay, "extrapolate": 0.5}[c.predictor]
        predicted = _units(seen @ decay ** np.arange(w - 1, -1, -1.0))
    cos = np.clip((predicted * units[w:]).sum(1), -1, 1)
    empty = (np.abs(units[w:]).sum(1) == 0) | (np.abs(predicted).sum(1) == 0)
    out[w:] = np.where(empty, 1.0, np.clip(1 - cos, 0, 2))
    return out


def outstanding(signal: np.ndarray, warmup: int, c: Segment) -> np.ndarray:
    """Places whose surprise stands out of the up to `tau` signals before, of which those before `warmup` don't count."""
    at = np.arange(max(warmup + 2, 2), len(signal))
    if not len(at) or c.tau < 2:
        return at[:0]
    padded = np.concatenate([np.full(c.tau, np.nan), np.where(np.arange(len(signal)) < warmup, np.nan, signal)])
    trail = np.lib.stride_tricks.sliding_window_view(padded, c.tau)[at]  # the tau signals before each place
    mean, spread = np.nanmean(trail, 1), np.nanstd(trail, 1)
    return at[(signal[at] > mean + c.gamma * np.maximum(spread, SIGMA_FLOOR)) & (signal[at] > MIN_SURPRISE)]


def spaced(places: np.ndarray, last: int, least: int) -> list[int]:
    """Of ascending places those at least `least` after the one taken before, the first of all after `last`."""
    out: list[int] = []
    for p in places.tolist():
        if p - last >= least:
            out.append(p)
            last = p
    return out


def _within(units: np.ndarray, a: int, b: int) -> float:
    n = b - a
    if n < 2:
        return 1.0
    g = np.clip(units[a:b] @ units[a:b].T, -1, 1)
    return float((g.sum() - np.trace(g)) / (n * (n - 1)))


def cut_score(units: np.ndarray, p: int, left: int, right: int, half: int) -> float:
    """How well a cut at p parts its surroundings: alike within the sides, unlike across."""
    a, b = max(p - half, left, 0), min(p + half, right)
    cross = float(np.clip(units[a:p] @ units[p:b].T, -1, 1).mean()) if a < p < b else 0.0
    return round(_within(units, a, p) + _within(units, p, b) - cross, 9)  # equal ones stay equal in any order of sums


def settle(b: int, before: int, after: int, n: int, units: np.ndarray, c: Segment, first: int = 0) -> int | None:
    """Where the cut b goes between its neighbours: the best place near it, if strictly better than where it stands; none if
    the end is too near. units[0] is the vector at place `first`."""
    free = before + c.min_len  # the first place that keeps the event before long enough
    end = n - c.min_len
    low, high = max(b - c.radius, free), min(b + c.radius, max(after - c.min_len, 0), end)
    if low > high:
        return min(max(b, free), end) if free <= end else None
    stay = min(max(b, low), high)
    score = np.array([cut_score(units, p - first, before - first, after - first, c.radius) for p in range(low, high + 1)])
    return stay if score[stay - low] >= score.max() else low + int(score.argmax())


def one_topic(before: int, b: int, after: int, units: np.ndarray, c: Segment, first: int = 0) -> bool:
    """Whether both sides of a cut have almost one direction."""
    reach = max(c.window, 2)
    l, r = units[max(b - reach, before, first) - first : b - first].sum(0), units[b - first : min(b + reach, after) - first].sum(0)
    n = np.linalg.norm(l) * np.linalg.norm(r)
    return bool(n > 0 and float(l @ r) / n > SAME_SIDE)


def events(cuts: list[int], n: int, min_len: int) -> list[tuple[int, int]]:
    cuts = list(cuts)
    while cuts and n - cuts[-1] < min_len:
        cuts.pop()
    marks = [0]
    for b in cuts:
        if b > marks[-1]:
            marks.append(b)
    return list(zip(marks, [*marks[1:], n], strict=True)) if n else []


def segment(vectors: np.ndarray, c: Segment = Segment(), given: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(events as [start, end), surprise). `given`: a signal from elsewhere, whose boundaries aren't refined."""
    n = len(vectors)
    if n <= c.min_len:
        return ([(0, n)] if n else []), (np.asarray(given) if given is not None else np.zeros(n))
    units = _units(np.asarray(vectors, np.float64))
    signal = np.asarray(given, np.float64) if given is not None else surprise(units, c)
    cuts = spaced(outstanding(signal, 0 if given is not None else c.window, c), 0, c.min_len)
    if given is None:
        cuts = [] if n < 2 * c.min_len else cuts
        moved = [0]
        for b, after in zip(cuts, [*cuts[1:], n], strict=False):
            place = settle(b, moved[-1], after, n, units, c)
            moved += [] if place is None else [place]
        cuts = [b for a, b, d in zip(moved, moved[1:], [*moved[2:], n], strict=False) if not one_topic(a, b, d, units, c)]
    return events(cuts, n, c.min_len), signal


def segmented(df: DataFrame, c: Segment = Segment(), stream: str = "stream_id", order: str = "ord", vector: str = "embedding", signal: str | None = None, size: int = BLOCK_ROWS, ranges: int | None = None) -> DataFrame:
    """(stream, ord, event, surprise, pos): the event of each row, numbered from 0 in each stream, in the order of `order` (any
    type that sorts; distinct in a stream), and the row's own number. Streams of up to `size` rows are one group each."""
    rows = df.select(F.col(stream).alias("stream"), F.col(order).alias("ord"), F.col(vector).alias("v"), (F.col(signal).cast("double") if signal else F.lit(None).cast("double")).alias("s"))
    sizes = rows.groupBy("stream").agg(F.count("*").alias("rows"))
    many = sizes.where(F.col("rows") > size).select(F.col("stream").alias("_s"))
    schema = T.StructType([rows.schema["stream"], rows.schema["ord"], T.StructField("event", T.LongType()), T.StructField("surprise", T.DoubleType()), T.StructField("pos", T.LongType())])

    def run(group: pa.Table) -> pa.Table:
        group = group.take(_in_order(group["ord"]))
        got, s = segment(_matrix(group["v"]), c, group["s"].to_numpy() if signal else None)
        return pa.table({"stream": group["stream"], "ord": group["ord"], "event": pa.array(np.repeat(np.arange(len(got)), [b - a for a, b in got]), pa.int64()), "surprise": pa.array(np.asarray(s, np.float64)), "pos": pa.array(np.arange(len(s)))})

    long = many.count()
    if not long:
        return rows.groupBy("stream").applyInArrow(run, schema)
    many = F.broadcast(many) if long <= SMALL else many
    same = rows["stream"].eqNullSafe(F.col("_s"))
    few = rows.join(many, same, "left_anti").groupBy("stream").applyInArrow(run, schema)
    return few.union(_by_blocks(rows.join(many, same, "left_semi"), c, signal is not None, size, ranges).select(*schema.names))


def _in_order(column: pa.ChunkedArray) -> pa.Array:
    """Places of the values of a column in ascending order; structs by their fields."""
    if not pa.types.is_struct(column.type):
        return pc.array_sort_indices(column.combine_chunks())
    fields = column.combine_chunks().flatten()
    names = [str(i) for i in range(len(fields))]
    return pc.sort_indices(pa.table(fields, names=names), [(n, "ascending") for n in names])


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one size as rows."""
    v = vectors.combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def _by_blocks(rows: DataFrame, c: Segment, given: bool, size: int, ranges: int | None) -> DataFrame:
    """segmented() for long streams: stream, ord, v, s."""
    reach, r = max(c.window, 2), c.radius
    far = max(2 * r, r + c.min_len, r + reach, 2 * c.min_len)  # a cut so far before a block doesn't touch its cuts
    seen = reach + 2 * r  # cuts so far behind a block can meet its last ones
    left, right = max(c.tau + c.window, far + r), seen + 2 * r + c.min_len + 1
    if max(left, right) > size:
        raise ValueError(f"blocks of {size} rows are shorter than their halos")
    placed = positions(rows, "stream", ["ord"], ranges)
    dealt = blocks(placed, left, right, size)
    stream, order = rows.schema["stream"], rows.schema["ord"]
    ints = T.ArrayType(T.LongType())
    key = [stream, T.StructField("block", T.LongType())]
    table = T.StructField("table", T.ArrayType(T.IntegerType()))

    def begin(group: pa.Table) -> tuple[pa.Table, np.ndarray, int]:
        """A block's rows in order, their places, its first place."""
        pos = group["pos"].to_numpy()
        by = np.argsort(pos)
        return group.take(pa.array(by)), pos[by], int(group["block"][0].as_py()) * size

    def first(group: pa.Table) -> pa.Table:
        group, pos, start = begin(group)
        own = (pos >= start) & (pos < start + size)
        if not own.any():
            return pa.table({n: [] for n in own_names}, schema=own_schema)
        warm = 0 if given else c.window
        if given:
            signal = group["s"].to_numpy().astype(np.float64)
        else:
            signal = surprise(_units(_matrix(group["v"])), c)
        # places before pos[0] are beyond the halo, so the warm-up is the stream's or is not in reach
        places = outstanding(signal, max(warm - int(pos[0]), 0) if pos[0] < warm else (0 if given else c.window), c) + int(pos[0])
        places = places[(places >= start) & (places < start + size)]
        out = [min(start + size - (spaced(places, start - s, c.min_len) or [start - s])[-1], c.min_len) for s in range(c.min_len + 1)]
        return pa.table([group["stream"][:1], [start // size], pa.array([int(pos[own][0])]), [group["ord"].filter(pa.array(own)).to_pylist()], [signal[own]], [places], [out], group["n"][:1]], schema=own_schema)

    own_fields = T.StructType([*key, T.StructField("at", T.LongType()), T.StructField("ords", T.ArrayType(order.dataType)), T.StructField("signal", T.ArrayType(T.DoubleType())), T.StructField("places", ints), table, T.StructField("n", T.LongType())])
    own_schema = to_arrow_schema(own_fields)
    own_names = own_fields.names
    heads = cut_lineage(dealt.groupBy("stream", "block").applyInArrow(first, own_fields))
    gaps = prefix_states(heads.select("stream", "block", "table"), 0)
    taken = F.udf(lambda places, last: spaced(np.array(places, np.int64), last, c.min_len), ints)
    both = heads.select("stream", "block", "places", "n").join(_named(gaps), _here("stream", "block"))
    cuts = both.select("stream", "block", "n", taken("places", F.col("block") * size - F.col("state")).alias("cuts"))
    if not given:
        cuts = cut_lineage(cuts)
        after = cuts.select(F.col("stream").alias("_s"), (F.col("block") - 1).alias("_b"), F.col("cuts").alias("then"))
        asks = cuts.join(after, _here("stream", "block"), "left").select("stream", "block", "n", "cuts", F.coalesce("then", F.array().cast(ints)).alias("then"))

        def second(group: pa.Table, asked: pa.Table) -> pa.Table:
            if not len(asked) or not len(group):
                return pa.table({n: [] for n in choice_fields.names}, schema=choice_schema)
            group, pos, start = begin(group)
            units, zero, n = _units(_matrix(group["v"])), int(pos[0]), asked["n"][0].as_py()
            mine, then = asked["cuts"][0].as_py(), [b for b in asked["then"][0].as_py() if b < start + size + right]
            every = [*mine, *then]
            known: dict[tuple[int, int], int | None] = {}
            dropped: dict[tuple[int, int, int], bool] = {}

            count = len(mine) + sum(b < start + size + seen for b in then)

            def place(k: int, before: int) -> int | None:
                b = every[k]
                before = max(before, b - far)
                if (k, before) not in known:
                    known[k, before] = settle(b, before, every[k + 1] if k + 1 < len(every) else n, n, units, c, zero)
                return known[k, before]

            found: dict[tuple[int, ...], int] = {}
            choice, out = [], []
            for state in range(far + r + 1):
                before = max(start - far + state, 0)
                moved, own = [before], 0
                for k in range(count):
                    p = place(k, moved[-1])
                    if p is not None:
                        moved.append(p)
                        own += k < len(mine)
                keep = []
                for a, b, d in zip(moved, moved[1 : own + 1], [*moved[2:], n], strict=False):
                    a = max(a, b - far)
                    if (a, b, d) not in dropped:
                        dropped[a, b, d] = one_topic(a, b, d, units, c, zero)
                    if not dropped[a, b, d]:
                        keep.append(b)
                choice.append(found.setdefault(tuple(keep), len(found)))
                out.append(max(moved[own] - (start + size), -far) + far)
            return pa.table([group["stream"][:1], [start // size], [out], [choice], [[list(f) for f in found]]], schema=choice_schema)

        choice_fields = T.StructType([*key, table, T.StructField("choice", T.ArrayType(T.IntegerType())), T.StructField("lists", T.ArrayType(ints))])
        choice_schema = to_arrow_schema(choice_fields)
        choices = cut_lineage(dealt.groupBy("stream", "block").cogroup(asks.groupBy("stream", "block")).applyInArrow(second, choice_fields))
        states = prefix_states(choices.select("stream", "block", "table"), far)
        cuts = choices.join(_named(states), _here("stream", "block")).select("stream", "block", F.col("lists")[F.col("choice")[F.col("state")]].alias("cuts"))
    total = heads.select("stream", "block", "n")
    each = cuts.select("stream", "block", F.explode("cuts").alias("cut")).join(total.select(F.col("stream").alias("_s"), F.col("block").alias("_b"), "n"), _here("stream", "block")).where((F.col("n") - F.col("cut") >= c.min_len) & (F.col("cut") > 0))
    each = each.select("stream", F.expr(f"cut div {size}").alias("block"), "cut").distinct().groupBy("stream", "block").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))  # a block's cuts
    each = each.select(F.col("stream").alias("_s"), F.col("block").alias("_b"), "cuts")
    so_far = W.partitionBy("stream").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    done = heads.join(each, _here("stream", "block"), "left").withColumn("cuts", F.coalesce("cuts", F.array().cast(ints))).withColumn("base", F.coalesce(F.sum(F.size("cuts")).over(so_far), F.lit(0)))
    rank = F.pandas_udf(lambda at, m, cuts, base: pd.Series([b + np.searchsorted(x, np.arange(a, a + k), "right") for a, k, x, b in zip(at, m, cuts, base, strict=True)]), ints)
    done = done.select("stream", "at", "ords", "signal", rank("at", F.size("ords"), "cuts", "base").alias("events"))
    return done.select("stream", "at", F.posexplode(F.arrays_zip("ords", "events", "signal")).alias("i", "x")).select("stream", F.col("x.ords").alias("ord"), F.col("x.events").alias("event"), F.col("x.signal").alias("surprise"), (F.col("at") + F.col("i")).alias("pos"))


def _named(states: DataFrame) -> DataFrame:
    return states.select(F.col("stream").alias("_s"), F.col("block").alias("_b"), "state")


def _here(stream: str, block: str) -> Column:
    return F.col(stream).eqNullSafe(F.col("_s")) & (F.col(block) == F.col("_b"))


def segment_streams(df: DataFrame, c: Segment = Segment(), stream: str = "stream_id", order: str = "ord", vector: str = "embedding", signal: str | None = None) -> DataFrame:
    """(stream, ord, event, surprise): the event of each row, numbered from 0."""
    return segmented(df.withColumn(order, F.col(order).cast("long")), c, stream, order, vector, signal).drop("pos")


def segment_texts(df: DataFrame, p: Provider, c: Segment = Segment(), stream: str = "stream_id", order: str = "ord", text: str = "text") -> DataFrame:
    """T2s: texts are embedded by a provider, whose model_id is stamped on each row: (stream, ord, event, surprise, model_id)."""
    rows = df.select(F.col(stream).alias("stream_id"), F.col(order).alias("ord"), p.embed(F.col(text)).alias("embedding"))
    return segment_streams(rows, c).withColumn("model_id", F.lit(p.model_id))


def surprise_by_window(df: DataFrame, c: Segment = Segment(), stream: str = "stream_id", order: str = "ord", vector: str = "embedding") -> DataFrame:
    """The same signal as expressions over a window of each stream: (stream, ord, surprise). For vectors of small size."""
    over = W.partitionBy(stream).orderBy(order)
    decay = {"centroid": 1.0, "weighted": c.decay, "extrapolate": 0.5}[c.predictor]
    from mnemora.functions.vector import dot, norm

    normed = df.withColumn("u", F.expr(f"transform({vector}, x -> cast(x as double) / greatest(sqrt(aggregate({vector}, 0D, (s, y) -> s + cast(y as double) * y)), 1e-12D))"))
    seen = normed.withColumn("w", F.collect_list("u").over(over.rowsBetween(-c.window, -1)))
    mean = F.aggregate("w", F.transform("u", lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a * decay + b))
    got = seen.withColumn("p", mean)
    n = norm(F.col("p")) * norm(F.col("u"))
    value = F.when(F.size("w") < c.window, 0.0).when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(F.col("p"), F.col("u")) / n))).otherwise(1.0)
    return got.select(F.col(stream).alias("stream"), F.col(order).alias("ord"), value.alias("surprise"))


def rolling_threshold(df: DataFrame, c: Segment = Segment(), stream: str = "stream", order: str = "ord", signal: str = "surprise") -> DataFrame:
    """Mean and population deviation of the up to `tau` signals before each row, without the warm-up; null for fewer than 2."""
    over = W.partitionBy(stream).orderBy(order)
    live = F.when(F.row_number().over(over) > c.window, F.col(signal))
    got = df.withColumn("live", live)
    back = over.rowsBetween(-c.tau, -1)
    enough = F.count("live").over(back) >= 2
    return got.select(stream, order, signal, F.when(enough, F.avg("live").over(back)).alias("mu"), F.when(enough, F.greatest(F.stddev_pop("live").over(back), F.lit(SIGMA_FLOOR))).alias("sigma"))


def era_of(at: Column, starts: list[int]) -> Column:
    """The last era that starts at or before `at`; 0 before the first. starts: the few eras, ascending."""
    if not starts:
        return F.lit(0)
    return F.greatest(F.lit(0), F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= at)) - 1)


def merge_micro(spans: list[tuple[int, int]], at: list[int], least: int, least_days: float) -> list[tuple[int, int]]:
    """T9s: eras of too few rows or days take in what follows; the last one stays."""
    out: list[tuple[int, int]] = []
    begin = None
    for k, (a, b) in enumerate(spans):
        begin = a if begin is None else begin
        days = (at[b - 1] - at[begin]) / 86_400
        if k == len(spans) - 1 or (b - begin >= least and days >= least_days):
            out.append((begin, b))
            begin = None
    return out


def boundary_scores(found: list[int], true: list[int], tolerance: int = 1) -> tuple[float, float, float]:
    """Precision, recall and F1 of boundaries, each true one matched once."""
    left, hits = sorted(true), 0
    for b in sorted(found):
        m = next((t for t in left if abs(t - b) <= tolerance), None)
        if m is not None:
            left.remove(m)
            hits += 1
    p, r = (hits / len(found) if found else float(not true)), (hits / len(true) if true else 1.0)
    return p, r, (2 * p * r / (p + r) if p + r else 0.0)
