"""Batch consolidation (C1-C17): passes from tables to tables, in their order.

Similarities are exact and come from blocked products (similarity.py). Order-dependent greedy passes run for each connected
component of near rows, as rows of different components never meet in them: small components are groups of one task, large
ones take turns in rounds (turns.py). Pairs of near rows are stored nowhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.functions import scoring as m
from mnemora.functions import text as x
from mnemora.functions.extract import correction, judge, tokens_of, words_of
from mnemora.functions.sketch import reservoir
from mnemora.functions.text import STOPWORDS
from mnemora.functions.vector import dot, unit
from mnemora.operators import graph
from mnemora.operators.asof import with_era
from mnemora.operators.blocks import stored
from mnemora.operators.greedy import roots
from mnemora.operators.ranges import SMALL
from mnemora.operators.segment import merge_micro, segmented
from mnemora.operators.similarity import connected, cut_lineage, linked, neighbor_sums, similar_pairs, unit_rows
from mnemora.operators.turns import draw, fold, settle_apart, take_turns
from mnemora.plans.config import DAY, Config
from mnemora.sources.store import cascade_delete, insert_ignore, replace_edges

State = dict[str, DataFrame]
#: Rows of a component that one task takes in a greedy pass; larger ones take turns in rounds.
GROUP = 2_000
Summarizer = Callable[[list[str]], str]  # E2
Verdict = Callable[[str, str, str], tuple[float, str] | None]  # E5: (older, newer, cardinality) to (confidence, reason)


def summarize(texts: list[str], most: int = 3) -> str:
    """The texts whose tokens are the most frequent ones on average, in their order."""
    toks = [tokens_of(t) for t in texts]
    freq: dict[str, int] = {}
    for t in toks:
        for w in t:
            freq[w] = freq.get(w, 0) + 1
    mean = [sum(freq[w] for w in t) / len(t) if t else 0.0 for t in toks]
    best = sorted(sorted(range(len(texts)), key=lambda i: (-mean[i], i))[:most])
    return f"Summary of {len(texts)} related memories: {' / '.join(texts[i] for i in best)}" if texts else ""


def _components(pairs: DataFrame) -> DataFrame:
    """(id, component, size) of the rows of pairs."""
    label = connected(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), pairs)
    return cut_lineage(label.join(label.groupBy("component").agg(F.count("*").alias("size")), "component"))


def _grouped(rows: DataFrame, label: DataFrame, fn: Any, schema: Any) -> DataFrame:
    """fn for each component, given its rows in order."""
    return rows.join(label.select("id", "component"), "id").groupBy("component").applyInPandas(lambda pdf: fn(pdf.sort_values(["created_at", "id"], kind="stable").reset_index(drop=True)), schema)


def _greedy(rows: DataFrame, pairs: DataFrame | None, low: float, within: str | None, fn: Any, turns: Any, schema: str, group: int = GROUP) -> DataFrame:
    """A greedy pass over near rows. Components of up to `group` rows are groups of one task (fn); larger ones take turns in
    rounds (turns.py): turns(rows). Both give the result of the pass row by row. pairs (a, b): edges that connect what is near;
    without them, spanning forests are (linked)."""
    edges = cut_lineage(linked(rows, low, within) if pairs is None else pairs.select("a", "b"))
    near = cut_lineage(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    count = near.count()
    if count <= group:
        return cut_lineage(_grouped(rows, near.withColumn("component", F.lit("")), fn, schema))
    label = _components(edges) if group else near.select("id", F.lit("").alias("component"), F.lit(count).alias("size"))
    small, large = label.where(F.col("size") <= group), label.where(F.col("size") > group).select("id")
    got = cut_lineage(_grouped(rows, small, fn, schema)) if group else None
    if large.isEmpty():
        return got
    by_turns = turns(rows.join(large, "id"))
    return cut_lineage(by_turns if got is None else got.union(by_turns))


def keepers(live: DataFrame, pairs: DataFrame | None = None, group: int = GROUP) -> DataFrame:
    """(id, keeper) of rows that fold into another: of a pair the foundation stays, else the more important, else the newer row.
    live: id, created_at, memory_type, importance_score, embedding, era, low (one value)."""
    live = stored(live.withColumn("rank", F.struct((F.col("memory_type") == "foundation").alias("f"), F.col("importance_score").alias("i"), F.col("created_at").alias("c"))))
    low = _bound(live)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        met = pdf["rank"].map(lambda r: (r["f"], r["i"], r["c"]) if isinstance(r, dict) else tuple(r)).to_list()
        g = unit_rows(list(pdf["embedding"]))
        same = (g @ g.T >= pdf["low"].iloc[0]) & (pdf["era"].to_numpy()[:, None] == pdf["era"].to_numpy()[None])
        parent: dict[int, int] = {}
        for i in range(len(pdf)):
            for j in np.flatnonzero(same[i, i + 1 :]) + i + 1 if i not in parent else ():
                if j in parent:
                    continue
                if met[i] < met[j]:
                    parent[i] = j
                    break
                parent[j] = i
        ends = []
        for k in parent:
            end = parent[k]
            while end in parent:
                end = parent[end]
            ends.append((pdf["id"][k], pdf["id"][end]))
        return pd.DataFrame(ends, columns=["id", "keeper"])

    def turns(rows: DataFrame) -> DataFrame:
        rows = rows.select("id", "created_at", "embedding", "era", F.col("rank.f").cast("int").alias("f"), F.col("rank.i").cast("double").alias("i"), F.col("rank.c").alias("c"))
        parent = take_turns(rows, ["created_at", "id"], ["f", "i", "c"], low, fold, "era")
        return roots(cut_lineage(parent.select(F.col("id").alias("pos"), F.col("by").alias("keeper")))).select(F.col("pos").alias("id"), "keeper")

    return _greedy(live, pairs, low, "era", run, turns, "id string, keeper string", group)


def _bound(rows: DataFrame) -> float:
    """The one value of `low`; of no rows, one that nothing reaches."""
    row = rows.select("low").first()
    return 2.0 if row is None else float(row["low"])


def merge_fold(mem: DataFrame, kept: DataFrame, now: int) -> DataFrame:
    """Each keeper takes in its rows: sums, maxima, the earliest creation, unions in order (its own values first, then
    by age). kept: id, keeper. Values are gathered once they are distinct."""
    every = kept.union(kept.select("keeper", "keeper").distinct())
    rows = mem.join(every, "id").withColumn("_o", F.struct(F.col("id") != F.col("keeper"), "created_at", "id"))
    sums = rows.groupBy("keeper").agg(
        F.sum("access_count").cast("long").alias("access_count"), F.least(F.lit(1.0), F.sum("recurrence_score") + 0.2 * (F.count("*") - 1)).alias("recurrence_score"), F.max("importance_score").alias("importance_score"), F.bool_or("pinned").alias("pinned"), F.min("created_at").alias("created_at"), F.max("last_accessed_at").alias("last_accessed_at"),
    )
    new = sums
    for c in ("tags", "entities"):
        each = rows.select("keeper", "_o", F.posexplode(c).alias("_i", "_v")).groupBy("keeper", "_v").agg(F.min(F.struct("_o", "_i")).alias("_f"))
        new = new.join(each.groupBy("keeper").agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "_v"))), lambda t: t["_v"]).alias(c)), "keeper", "left")
    own = {c: F.coalesce(new[c], F.array().cast(mem.schema[c].dataType)) if c in ("tags", "entities") else new[c].cast(mem.schema[c].dataType) for c in new.columns if c != "keeper"} | {"updated_at": F.lit(now).cast(mem.schema["updated_at"].dataType)}
    return mem.join(new, mem["id"] == new["keeper"]).select(*[(own[c] if c in own else mem[c]).alias(c) for c in mem.columns])


def merge_duplicates(s: State, c: Config, now: int) -> State:
    """Near rows of one era fold into the foundation, else the more important, else the newer one of a pair. All duplicates of a keeper are folded, and their links stay as records."""
    mem = s["memory_items"]
    live = with_era(mem.where("embedding is not null and memory_type <> 'archive'"), s["epochs"]).select("id", "created_at", "memory_type", "importance_score", "embedding", "era", F.lit(c.consolidation.duplicate).alias("low"))
    kept = keepers(live)
    rest, links, edges = cascade_delete(mem, s["memory_links"], s["memory_edges"], kept.select("id"))
    merged = rest.join(kept.select(F.col("keeper").alias("id")).distinct(), "id", "left_anti").select(*mem.columns).unionByName(merge_fold(mem, kept, now))
    record = kept.select(F.col("keeper").alias("source_id"), F.col("id").alias("target_id"), F.lit("duplicates").alias("relation"))
    return s | {"memory_items": merged, "memory_links": links.unionByName(record), "memory_edges": edges}


def burst_members(live: DataFrame, pairs: DataFrame | None, least: int, tight: float, days: float, group: int = GROUP) -> DataFrame:
    """(id, seed): rows that a seed draws together with itself. live: id, created_at, embedding, era, low (one value)."""
    live = stored(live)
    low = _bound(live)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u = unit_rows(list(pdf["embedding"]))
        near = (u @ u.T >= pdf["low"].iloc[0]) & (pdf["era"].to_numpy()[:, None] == pdf["era"].to_numpy()[None])
        np.fill_diagonal(near, True)
        at, free, found = pdf["created_at"].to_numpy(), np.ones(len(pdf), bool), []
        for i in range(len(pdf)):
            drawn = np.flatnonzero(near[i] & free) if free[i] else ()
            if len(drawn) >= least and (at[drawn].max() - at[drawn].min()) / DAY / days <= tight:
                free[drawn] = False
                found += [(pdf["id"][j], pdf["id"][i]) for j in drawn]
        return pd.DataFrame(found, columns=["id", "seed"])

    def turns(rows: DataFrame) -> DataFrame:
        rows = rows.select("id", "created_at", "embedding", "era", F.col("created_at").alias("at"))
        return take_turns(rows, ["created_at", "id"], ["at"], low, draw(least, lambda span: span / DAY / days <= tight), "era", later=False).select("id", F.col("by").alias("seed"))

    return _greedy(live, pairs, low, "era", run, turns, "id string, seed string", group)


def collapse_bursts(s: State, c: Config, now: int, summarizer: Summarizer = summarize) -> State:
    """A seed's near rows of one era, close in time, become one gist; the least typical of them stays."""
    if not c.consolidation.burst:
        return s
    mem, k, p = s["memory_items"], c.consolidation, c.neighbors
    oldest = mem.agg(F.min("created_at")).first()[0]
    span = max(1.0, max(0, now - (oldest if oldest is not None else now)) / DAY)
    live = with_era(mem.where("memory_type in ('raw_event', 'episodic') and not pinned and not stale and embedding is not null"), s["epochs"])
    drawn = burst_members(live.select("id", "created_at", "embedding", "era", F.lit(p.similarity).alias("low")), None, k.burst_min, p.tight, span)
    rows = live.select("id", "created_at", "content", "topic", "embedding").join(drawn, "id")
    sums = vector_sums(rows, "seed").join(rows.groupBy("seed").agg(F.count("*").alias("n")), "seed")
    # the sum of a row's cosines to the others of its burst is one product with the sum of their unit vectors
    typical = F.round((dot(unit(F.col("embedding")), F.col("sum")) - dot(unit(F.col("embedding")), unit(F.col("embedding")))) / (F.col("n") - 1), 12)
    rows = cut_lineage(rows.join(sums, "seed").select("seed", "id", "created_at", "content", "topic", "n", typical.alias("typical"), F.struct(F.col("id") != F.col("seed"), "created_at", "id").alias("pos")))
    least = rows.groupBy("seed").agg(F.min_by(F.struct("id", "topic"), F.struct("typical", "pos")).alias("odd")).select("seed", F.col("odd.id").alias("keep"), "odd.topic")
    rest_of = rows.drop("topic").join(least, "seed").where("id <> keep")
    body = rest_of.groupBy("seed").agg(F.count("*").alias("n"), F.max("created_at").alias("at")).join(summaries(rest_of.select("seed", "pos", "content"), "seed", summarizer), "seed").join(least, "seed")
    gist = cut_lineage(body.select("keep", "topic", "at", F.format_string("Gist of %d similar events: %s", "n", "summary").alias("gist")))
    rest, links, edges = cascade_delete(mem, s["memory_links"], s["memory_edges"], rest_of.select("id"))
    odd = gist.select(F.col("keep").alias("id"), F.lit(True).alias("odd"))
    rest = rest.join(odd, "id", "left").withColumn("importance_score", F.when(F.col("odd"), F.least(F.lit(1.0), F.col("importance_score") + 0.1)).otherwise(F.col("importance_score"))).withColumn("salience", F.when(F.col("odd"), F.greatest("salience", F.lit(0.6))).otherwise(F.col("salience"))).withColumn("updated_at", F.when(F.col("odd"), F.lit(now)).otherwise(F.col("updated_at"))).select(*mem.columns)
    gists = _derived(gist.select(F.col("gist").alias("content"), "topic", "at", F.lit("episodic").alias("memory_type"), F.lit(0.4).alias("importance_score"), F.lit(0.0).alias("recurrence_score")), mem, now)
    return s | {"memory_items": insert_ignore(rest, gists, ["content_hash"]), "memory_links": links, "memory_edges": edges}


def _derived(rows: DataFrame, like: DataFrame, now: int) -> DataFrame:
    """Memory rows that consolidation writes: no vector and no entities until they are embedded anew."""
    own = {"id": x.new_id("mem", x.content_hash(F.col("content"))), "content": F.col("content"), "summary": F.col("content"), "memory_type": F.col("memory_type"), "source": F.lit("consolidation"), "topic": F.col("topic"), "created_at": F.col("at"), "updated_at": F.lit(now), "importance_score": F.col("importance_score"), "decay_score": F.col("importance_score"), "recurrence_score": F.col("recurrence_score"), "recency_score": F.lit(1.0), "salience": F.lit(0.0), "confidence": F.lit(1.0), "access_count": F.lit(0), "stale": F.lit(False), "pinned": F.lit(False), "entities": F.array(), "tags": F.array(), "content_hash": x.content_hash(F.col("content"))}
    return rows.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def _mentions(base: DataFrame, each: DataFrame, rare: int = 64, most: int = 10) -> DataFrame:
    """(id, raw): summed weights of all rows that share a term, each row once.

    Terms of a single row play no part; rows with the same terms otherwise are one set with a summed weight. Sets that
    meet in a popular term (of more than `rare` rows) aren't paired: the sum over the union of these terms is the
    alternating sum over the subsets of them that a set has, and the weight of all sets that hold a subset is one
    pre-aggregated sum. Sets that meet in rare terms alone are paired, at most `rare` for each term. Sets of more than
    `most` popular terms, whose subsets would be too many, are few; they are paired over these.
    """
    shared = each.groupBy("term").agg(F.count("*").alias("n")).where("n > 1")
    kept = each.select("id", "term").join(shared, "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", (F.col("n") > rare).alias("often")))).alias("t"))  # a row's own terms
    part = lambda often: F.transform(F.filter("t", lambda s: s["often"] == F.lit(often)), lambda s: s["term"])
    kept = kept.select("id", F.xxhash64(F.transform("t", lambda s: s["term"])).alias("set"), part(True).alias("often"), part(False).alias("seldom"))
    rows = cut_lineage(base.select("id", "w").join(kept, "id", "left"))
    sets = cut_lineage(rows.where("set is not null").groupBy("set").agg(F.first("often").alias("often"), F.first("seldom").alias("seldom"), F.sum("w").alias("w")))
    few, many = sets.where(F.size("often").between(1, most)), sets.where(F.size("often") > most)
    subsets = F.expr("transform(sequence(1, cast(pow(2, size(often)) as int) - 1), m -> named_struct('sub', xxhash64(filter(often, (t, i) -> (shiftright(m, i) & 1) = 1)), 'sign', if(bit_count(m) % 2 = 1, 1, -1)))")
    subs = few.select("set", "w", F.explode(subsets).alias("s")).select("set", "w", "s.sub", "s.sign")
    sums = subs.join(subs.groupBy("sub").agg(F.sum("w").alias("total")), "sub").select("set", (F.col("sign") * F.col("total")).alias("raw"))
    side = lambda df, terms, n: df.select(F.col("set").alias(n), F.col("w").alias(f"w{n}"), F.col("often").alias(f"o{n}"), F.explode(terms).alias("term"))
    wide = side(sets, "often", "p").join(side(many, "often", "q"), "term").select("p", "q", "wp", "wq").distinct()
    wide = wide.select(F.col("p").alias("set"), F.col("wq").alias("raw")).union(wide.join(few.select(F.col("set").alias("p")), "p", "left_semi").select(F.col("q").alias("set"), F.col("wp").alias("raw")))
    met = side(sets, "seldom", "p").join(side(sets, "seldom", "q"), "term").where(~F.arrays_overlap("op", "oq")).select("p", "q", "wq").distinct()
    raw = sums.union(wide).union(met.select(F.col("p").alias("set"), F.col("wq").alias("raw"))).groupBy("set").agg(F.sum("raw").alias("raw"))
    return rows.join(raw, "set", "left").select("id", F.coalesce("raw", "w").alias("raw"))


#: Where each count alone brings the blend to its limit (sessions, days) or its own part to its limit (contexts): more makes no difference.
ENOUGH = {"s": 54, "d": 17, "c": 8}


def recurrence(memories: DataFrame, evidence: DataFrame, sessions_by: str = "session:") -> DataFrame:
    """(id, raw, sessions, days, contexts, blend) of rows with terms: what the rows that share a term with each have, its own included.

    sessions, days and contexts are counted up to ENOUGH, from where the blend doesn't change any more: 0.25 * log1p(54) and
    0.35 * log1p(17) are above 1, and contexts count up to 8. So a term hands at most that many of its facts (and as many
    contexts more as a row has terms, which don't count for it) to each row that has it, however popular the term is.
    """
    base = cut_lineage(memories.select("id", x.recurrence_terms(F.col("topic"), F.col("entities")).alias("terms"), x.recurrence_multiplier(F.col("source"), F.col("tags")).alias("w"), F.filter("tags", lambda t: t.startswith(sessions_by)).alias("sessions"), F.floor(F.col("created_at") / DAY).cast("string").alias("day")).where(F.size("terms") > 0))
    widest = base.agg(F.max(F.size("terms"))).first()[0] or 0
    each = base.select("id", "terms", "sessions", "day", F.explode("terms").alias("term"))
    mine = each.select("id", "term")
    fact = lambda k, v: F.transform(v, lambda y: F.struct(F.lit(k).alias("k"), y.alias("v")))
    facts = each.select("term", F.explode(F.concat(fact("s", F.col("sessions")), fact("d", F.array("day")), fact("c", F.col("terms")))).alias("f")).select("term", "f.k", "f.v").distinct()
    # the first facts of each term and kind: tasks keep no more than these before the shuffle
    facts = facts.withColumn("n", F.row_number().over(W.partitionBy("term", "k").orderBy("v"))).where(F.col("n") <= max(ENOUGH["s"], ENOUGH["c"] + widest))
    facts = facts.where(F.col("n") <= m.pick(F.col("k"), ENOUGH | {"c": ENOUGH["c"] + widest}, 0)).drop("n")
    lists = facts.groupBy("term").agg(*[F.collect_list(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ENOUGH])  # bounded by ENOUGH
    union = lambda k: F.array_distinct(F.flatten(F.collect_list(k)))  # noqa: E731  of a row's own terms
    got = mine.join(lists, "term").groupBy("id").agg(union("s").alias("s"), union("d").alias("d"), union("c").alias("c"), F.collect_list("term").alias("own"))
    enough = lambda v, k: F.least(F.size(v), F.lit(ENOUGH[k])).cast("long")
    got = got.select("id", enough(F.col("s"), "s").alias("sessions"), enough(F.col("d"), "d").alias("days"), enough(F.array_except("c", "own"), "c").alias("contexts"))
    reuse = evidence.where("evidence_type in ('retrieval_success', 'user_confirmation')").groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("reuse"))
    out = _mentions(base, each).join(got, "id").join(reuse, "id", "left").na.fill(0, ["reuse"])
    return out.select("id", "raw", "sessions", "days", "contexts", m.recurrence_blend(F.col("raw"), F.col("sessions"), F.col("days"), F.col("contexts"), F.col("reuse")).alias("blend"))


def refresh_recurrence(s: State, now: int) -> State:
    mem = s["memory_items"]
    got = mem.join(recurrence(mem, s["memory_evidence"]).select("id", "blend"), "id", "left").na.fill(0.0, ["blend"])
    up = F.col("blend") > F.col("recurrence_score") + 0.05
    return s | {"memory_items": got.withColumn("updated_at", F.when(up, F.lit(now)).otherwise(F.col("updated_at"))).withColumn("recurrence_score", F.when(up, F.col("blend")).otherwise(F.col("recurrence_score"))).select(*mem.columns)}


def evidence_support(evidence: DataFrame) -> DataFrame:
    """(memory_id, positive up to 0.35, corrections)."""
    fix = F.col("evidence_type") == "user_correction"
    return evidence.groupBy("memory_id").agg(F.least(F.lit(0.35), F.sum(F.when(~fix, m.pick(F.col("evidence_type"), m.EVIDENCE_WEIGHT, 0.08) * F.col("strength")).otherwise(0.0))).alias("positive"), F.count_if(fix).alias("corrections"))


def importance(memories: DataFrame, evidence: DataFrame, edges: DataFrame, now: int, c: Config = Config()) -> DataFrame:
    """(id, revised) of rows that are neither archived, pinned nor foundation."""
    some = memories.where("memory_type not in ('archive', 'foundation') and not pinned")
    got = some.join(evidence_support(evidence), F.col("id") == F.col("memory_id"), "left").join(graph.graph_support(edges, 6.0), "id", "left").na.fill(0.0, ["positive", "support"]).na.fill(0, ["corrections"])
    fade = m.decay_resisted(F.col("importance_score"), m.decay_rate(F.col("memory_type"), c.decay), m.age_days(F.col("created_at"), now), F.col("pinned"), F.col("salience"), c.salience_resist)
    return got.select("id", m.revised_importance(F.col("memory_type"), F.col("positive"), F.col("support"), F.col("recurrence_score"), fade, F.col("corrections")).alias("revised"))


def refresh_importance(s: State, c: Config, now: int) -> State:
    mem = s["memory_items"]
    got = mem.join(importance(mem, s["memory_evidence"], s["memory_edges"], now, c), "id", "left")
    moved = F.abs(F.col("revised") - F.col("importance_score")) > 0.05
    return s | {"memory_items": got.withColumn("updated_at", F.when(moved, F.lit(now)).otherwise(F.col("updated_at"))).withColumn("importance_score", F.when(moved, F.col("revised")).otherwise(F.col("importance_score"))).select(*mem.columns)}


def neighbor_stats(memories: DataFrame, now: int, c: Config = Config()) -> DataFrame:
    """(id, best, near, density, spread, class) of active rows: best is the largest cosine to another active row (0 at least)."""
    p = c.neighbors
    # rows without a vector are left out by the join; a filter on a computed vector would compute it once more for each reader
    live = memories.where("memory_type <> 'archive'").select("id", "created_at", "embedding")
    oldest = memories.agg(F.min("created_at")).first()[0]
    span = max(1.0, max(0, now - (oldest if oldest is not None else now)) / DAY)
    got = neighbor_sums(live, p.similarity, "created_at")
    spread = F.when(F.col("near") >= 2, m.clamp((m.age_days(F.col("first"), now) - m.age_days(F.col("last"), now)) / span)).otherwise(0.0)
    got = got.select("id", "best", "near", m.clamp(F.col("near") / max(p.saturation, 1.0)).alias("density"), spread.alias("spread"))
    return got.withColumn("class", m.neighbor_class(F.col("best"), F.col("near"), F.col("density"), F.col("spread"), p))


def revise_salience(s: State, c: Config, now: int) -> State:
    """Salience from surprise or habit, weighted by content."""
    mem = s["memory_items"]
    got = mem.join(neighbor_stats(mem, now, c), "id", "left")
    new = m.salience(F.col("best"), F.col("density"), F.col("spread"), m.content_relevance(F.col("content"), F.col("entities")))
    moved = F.col("best").isNotNull() & (F.abs(new - F.col("salience")) > 1e-6)
    return s | {"memory_items": got.withColumn("salience", F.when(moved, new).otherwise(F.col("salience"))).select(*mem.columns)}


def topic_votes(memories: DataFrame, label: DataFrame) -> DataFrame:
    """(component, topic): explicit tags count 2, entities 1; of equal ones the alphabetically first; components of two or more."""
    explicit = F.filter("tags", lambda t: t.startswith("project:") | t.startswith("topic:"))
    rows = memories.join(label, "id")
    votes = rows.select("component", F.explode(F.concat(F.transform(explicit, lambda t: F.struct(F.regexp_replace(t, "^(project|topic):", "").alias("t"), F.lit(2).alias("w"))), F.transform("entities", lambda e: F.struct(e.alias("t"), F.lit(1).alias("w"))))).alias("v"))
    sums = votes.where("v.t <> ''").groupBy("component", "v.t").agg(F.sum("v.w").alias("n"))
    many = rows.groupBy("component").agg(F.count("*").alias("size")).where("size > 1").select("component")
    best = sums.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("n"), "t")).alias("b"))
    return best.join(many, "component").select("component", F.col("b.t").alias("topic"))


def refine_topics(s: State, c: Config, now: int) -> State:
    """Rows of one session or of near vectors form clusters, whose rows take the cluster's topic; rows with an explicit tag keep theirs."""
    if not c.consolidation.topics:
        return s
    mem = s["memory_items"]
    # read several times; filtered as it is read, for a filter would compute vectors once more
    live = stored(mem.where("memory_type <> 'archive'").select("id", "tags", "entities", "embedding")).where("embedding is not null")
    session = live.select("id", F.explode(F.filter("tags", lambda t: t.startswith("session:"))).alias("session"))
    hub = session.groupBy("session").agg(F.min("id").alias("a"))
    pairs = linked(live, c.consolidation.topic_similarity).union(session.join(hub, "session").where("id <> a").select("a", F.col("id").alias("b")))
    label = connected(live.select("id"), pairs)
    new = label.join(topic_votes(live, label), "component").select("id", F.col("topic").alias("new"))
    explicit = F.exists("tags", lambda t: t.startswith("project:") | t.startswith("topic:"))
    got = mem.join(new, "id", "left")
    moved = F.col("new").isNotNull() & ~explicit & ~F.col("topic").eqNullSafe(F.col("new"))
    return s | {"memory_items": got.withColumn("updated_at", F.when(moved, F.lit(now)).otherwise(F.col("updated_at"))).withColumn("topic", F.when(moved, F.col("new")).otherwise(F.col("topic"))).select(*mem.columns)}


def modal(values: list[str | None]) -> str | None:
    """The most frequent value, of equal ones the alphabetically first."""
    some = [v for v in values if v]
    return min(set(some), key=lambda v: (-some.count(v), v)) if some else None


def modal_by(rows: DataFrame, group: str, value: str) -> DataFrame:
    """A13 for groups: (group, value), counted before it is gathered. Groups without a value are absent."""
    n = rows.where(F.col(value) != "").groupBy(group, value).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), value)).getField(value).alias(value))


def summaries(rows: DataFrame, group: str, summarizer: Summarizer = summarize, most: int = 3) -> DataFrame:
    """(group, summary) of rows (group, pos, content). The built-in rule is joins and sums over words, so that groups may be
    of any size; a function of the caller gets the texts of a group at once, in order."""
    if summarizer is not summarize:
        kind = rows.schema[group].dataType
        told = lambda pdf: pd.DataFrame({group: pdf[group][:1].to_numpy(), "summary": [summarizer(list(pdf.sort_values("pos")["content"]))]})
        return rows.select(group, "pos", "content").groupBy(group).applyInPandas(told, T.StructType([T.StructField(group, kind), T.StructField("summary", T.StringType())]))
    words = rows.select(group, "pos", F.explode(x.tokenize(F.col("content"))).alias("word"))
    often = words.groupBy(group, "word").agg(F.count("*").alias("n"))
    mean = words.join(often, [group, "word"]).groupBy(group, "pos").agg(F.avg("n").alias("mean"))
    scored = rows.select(group, "pos", "content").join(mean, [group, "pos"], "left").na.fill(0.0, ["mean"])
    best = scored.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(F.desc("mean"), "pos"))).where(F.col("_n") <= most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda t: t["content"]), " / ")
    size = rows.groupBy(group).agg(F.count("*").alias("size"))
    return best.groupBy(group).agg(text.alias("t")).join(size, group).select(group, F.format_string("Summary of %d related memories: %s", "size", "t").alias("summary"))


def stream_events(live: DataFrame, c: Config) -> DataFrame:
    """live with `event` and `pos`: the rows of a store as one stream in the order of (created_at, id), of any length."""
    rows = live.select(F.lit(0).alias("stream"), F.struct("created_at", "id").alias("ord"), "embedding")
    got = segmented(rows, c.segment, "stream").select(F.col("ord.id").alias("id"), "event", "pos")
    return cut_lineage(live.drop("embedding").join(got, "id"))


def modal_dimension(memories: DataFrame) -> DataFrame:
    """rows whose vectors have the most common size, of equal ones the larger."""
    size = F.size("embedding")
    best = memories.groupBy(size.alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("b")).select("b.d")
    return memories.join(F.broadcast(best), size == F.col("d"), "left_semi")


def event_summaries(mem: DataFrame, c: Config, summarizer: Summarizer = summarize) -> tuple[DataFrame, DataFrame]:
    """The episodic stream's rows (id, event, ...) in events of enough rows, and (event, size, most, summary, topic) of each such event."""
    live = mem.where("memory_type = 'episodic' and not stale and embedding is not null").select("id", "content", "topic", "created_at", "importance_score", "embedding")
    rows = stream_events(modal_dimension(stored(live)), c)
    large = rows.groupBy("event").agg(F.count("*").alias("size"), F.max("importance_score").alias("most")).where(F.col("size") >= c.consolidation.cluster_min)
    rows = rows.join(large, "event")
    return rows, cut_lineage(large.join(summaries(rows, "event", summarizer), "event").join(modal_by(rows, "event", "topic"), "event", "left"))


def summarize_clusters(s: State, c: Config, now: int, summarizer: Summarizer = summarize) -> State:
    """Events of the episodic stream with three or more rows get a semantic summary, linked to its sources. Events whose
    summaries are equal share one row."""
    mem = s["memory_items"]
    rows, told = event_summaries(mem, c, summarizer)
    found = told.select("event", F.col("summary").alias("content"), "topic", F.lit(now).alias("at"), importance_of_event().alias("importance_score"), recurrence_of_event().alias("recurrence_score"))
    new = _derived(found.withColumn("memory_type", F.lit("semantic")), mem, now)
    fresh = new.join(mem.select("content_hash"), "content_hash", "left_anti")
    found = found.join(rows.select("event", F.col("id").alias("target_id")), "event")
    links = found.select(x.new_id("mem", x.content_hash(F.col("content"))).alias("source_id"), "target_id", F.lit("derived_from").alias("relation")).join(fresh.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return s | {"memory_items": insert_ignore(mem, new, ["content_hash"]), "memory_links": insert_ignore(s["memory_links"], links, ["source_id", "target_id", "relation"])}


def importance_of_event() -> Column:
    return F.greatest(F.lit(0.6), F.col("most"))


def recurrence_of_event() -> Column:
    return F.least(F.lit(1.0), F.col("size") / 10)


def promote_recurring(s: State, c: Config, now: int) -> State:
    """Episodic rows that are read often become semantic."""
    mem = s["memory_items"]
    up = (F.col("memory_type") == "episodic") & ~F.col("stale") & (F.col("access_count") >= c.consolidation.promote_access)
    flagged = mem.withColumn("up", up)
    return s | {"memory_items": flagged.withColumn("memory_type", F.when(F.col("up"), "semantic").otherwise(F.col("memory_type"))).withColumn("importance_score", F.when(F.col("up"), F.least(F.lit(1.0), F.col("importance_score") + 0.1)).otherwise(F.col("importance_score"))).withColumn("updated_at", F.when(F.col("up"), F.lit(now)).otherwise(F.col("updated_at"))).select(*mem.columns)}


def promote_to_foundation(s: State, c: Config, now: int) -> State:
    """Lasting habits become foundations, the most important first, none near another foundation."""
    mem, k = s["memory_items"], c.consolidation
    stats = neighbor_stats(mem, now, c).where((F.col("class") == "habit") & (F.col("spread") >= k.foundation_spread) & (F.col("near") >= k.foundation_neighbors))
    able = mem.where("memory_type in ('semantic', 'preference') and not stale and not pinned").join(stats.select("id"), "id", "left_semi")
    old = mem.where("memory_type = 'foundation' and embedding is not null")
    pool = able.unionByName(old).select("id", "importance_score", "created_at", "embedding", "memory_type")
    up = foundations(pool.withColumn("low", F.lit(c.neighbors.similarity))).withColumn("up", F.lit(True))
    got = mem.join(up, "id", "left")
    return s | {"memory_items": got.withColumn("memory_type", F.when(F.col("up"), "foundation").otherwise(F.col("memory_type"))).withColumn("updated_at", F.when(F.col("up"), F.lit(now)).otherwise(F.col("updated_at"))).select(*mem.columns)}


def foundations(pool: DataFrame, pairs: DataFrame | None = None, group: int = GROUP) -> DataFrame:
    """(id): rows that are no foundation yet and near none, nor near a better one that becomes one.
    pool: id, importance_score, created_at, embedding, memory_type, low (one value)."""
    pool = stored(pool.withColumn("better", -F.col("importance_score")))
    low = _bound(pool)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["better", "created_at", "id"], kind="stable").reset_index(drop=True)
        u, old = unit_rows(list(pdf["embedding"])), (pdf["memory_type"] == "foundation").to_numpy()
        barred, new = ((u @ u[old].T) >= pdf["low"].iloc[0]).any(1), []
        for i in np.flatnonzero(~old):
            if not barred[i]:
                barred |= u @ u[i] >= pdf["low"].iloc[0]
                new.append(pdf["id"][i])
        return pd.DataFrame({"id": new}, dtype=object)

    def turns(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("old", (F.col("memory_type") == "foundation").cast("int")).withColumn("new", 1 - F.col("old"))
        return take_turns(rows, ["new", "better", "created_at", "id"], ["old"], low, settle_apart).select("id")

    pairs = cut_lineage(linked(pool, low) if pairs is None else pairs.select("a", "b"))
    lone = pool.where("memory_type <> 'foundation'").select("id").join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_anti")
    return lone.union(_greedy(pool, pairs, low, None, run, turns, "id string", group))


def value_signature(text: str) -> tuple[str, ...]:
    return tuple(sorted({w.lower() for w in words_of(text) if w.lower() not in STOPWORDS and (w[:1].isupper() or any(ch.isnumeric() for ch in w))}))


def cardinality(spans: list[tuple[int, int]], overlap: float = 0.2) -> str:
    """Whether values follow each other (single), coexist (multi), or too little is known."""
    if len(spans) < 2 or all(a == b for a, b in spans):
        return "unknown"
    worst = max(max(0, min(b, d) - max(a, e)) / max(1, max(b, d) - min(a, e)) for i, (a, b) in enumerate(spans) for e, d in spans[i + 1 :])
    return "multi" if worst > overlap else "single"


def contradictions(memories: DataFrame, c: Config, verdict: Verdict = judge) -> DataFrame:
    """Links (source_id newer, target_id older, updates) inside clusters of one subject whose cosine lies in [min_similarity, duplicate)."""
    live = memories.where("memory_type <> 'archive' and not stale and embedding is not null")
    pairs = similar_pairs(live, c.contradiction.min_similarity, c.consolidation.duplicate, sharing=x.subject_codes(F.col("topic"), F.col("entities"))).select("a", "b")
    pairs = cut_lineage(pairs)
    out = T.StructType.fromDDL("source_id string, target_id string, relation string")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        spans: dict[tuple[str, ...], list[int]] = {}
        for t, at in zip(pdf["content"], pdf["created_at"], strict=True):
            spans.setdefault(value_signature(t), []).append(at)
        kind = cardinality([(min(v), max(v)) for v in spans.values()])
        newest = len(pdf) - 1
        got = [(pdf["id"][newest], pdf["id"][i], "updates") for i in range(newest) if (v := verdict(pdf["content"][i], pdf["content"][newest], kind)) and v[0] >= c.contradiction.confidence]
        return pd.DataFrame(got, columns=out.names)

    return _grouped(live.select("id", "content", "created_at"), _components(pairs), run, out)


def infer_contradictions(s: State, c: Config, verdict: Verdict = judge) -> State:
    return s | {"memory_links": insert_ignore(s["memory_links"], contradictions(s["memory_items"], c, verdict), ["source_id", "target_id", "relation"])} if c.contradiction.enabled else s


def mark_stale(s: State, now: int) -> State:
    """C11: targets of supersession links become stale."""
    mem = s["memory_items"]
    hit = s["memory_links"].where("relation in ('updates', 'contradicts')").select(F.col("target_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    got = mem.join(hit, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)) & ~F.col("stale"))
    return s | {"memory_items": got.withColumn("updated_at", F.when(F.col("hit"), F.lit(now)).otherwise(F.col("updated_at"))).withColumn("stale", F.col("stale") | F.col("hit")).select(*mem.columns)}


def revive(s: State, c: Config, now: int) -> State:
    """A superseded row whose values the newest live row of its subject states again is fresh, and loses its links."""
    if not c.contradiction.enabled:
        return s
    mem = s["memory_items"]
    hit = s["memory_links"].where("relation in ('updates', 'contradicts')").select(F.col("target_id").alias("id")).distinct()
    old = mem.where("stale and embedding is not null").join(hit, "id", "left_semi")
    live = mem.where("not stale and memory_type <> 'archive' and embedding is not null")
    pairs = similar_pairs(old.unionByName(live), c.contradiction.min_similarity)
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    o = old.select(F.col("id").alias("a"), F.col("topic").alias("t"), F.col("entities").alias("e"), F.col("content").alias("said"), F.col("created_at").alias("at"))
    n = live.select(F.col("id").alias("b"), F.col("topic").alias("u"), F.col("entities").alias("f"), F.col("content").alias("now_said"), F.col("created_at").alias("now_at"))
    met = both.join(o, "a").join(n, "b").where(x.same_subject(F.col("t"), F.col("u"), F.col("e"), F.col("f"))).where("now_at >= at")
    newest = met.groupBy("a").agg(F.max_by(F.struct("said", "now_said"), F.struct("now_at", "b")).alias("x"))

    @F.pandas_udf("boolean")
    def again(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b, strict=True):
            want, cue = set(value_signature(p)), correction(q)
            have = {cue[1].lower()} if cue and cue[1] else set(value_signature(q))
            out.append(bool(want) and want <= have)
        return pd.Series(out)

    back = newest.where(again(F.col("x.said"), F.col("x.now_said"))).select(F.col("a").alias("id")).withColumn("back", F.lit(True))
    back = cut_lineage(back)
    got = mem.join(back, "id", "left")
    links = s["memory_links"].join(back.select(F.col("id").alias("target_id"), "back"), "target_id", "left").where("not (back is not null and relation in ('updates', 'contradicts'))").select(*s["memory_links"].columns)
    return s | {"memory_items": got.withColumn("updated_at", F.when(F.col("back"), F.lit(now)).otherwise(F.col("updated_at"))).withColumn("stale", F.col("stale") & F.col("back").isNull()).select(*mem.columns), "memory_links": links}


def archive_and_prune(s: State, c: Config, now: int) -> State:
    """Faded raw events are archived, old archives deleted, and the raw log beyond its age becomes one note with a sample of it."""
    mem, k = s["memory_items"], c.consolidation
    days = m.age_days(F.col("created_at"), now)
    safe = F.col("pinned") | (F.col("memory_type") == "foundation") | (F.col("salience") >= c.salience_keep)
    fade = m.decay_resisted(F.col("importance_score"), m.decay_rate(F.col("memory_type"), c.decay), days, F.col("pinned"), F.col("salience"), c.salience_resist)
    gone = mem.where(~safe & (F.col("memory_type") == "archive") & (days > k.delete_after_days)).select("id")
    fading = ~safe & (F.col("memory_type") == "raw_event") & (days > k.archive_after_days) & (fade < k.archive_max_decay)
    mem2 = mem.withColumn("updated_at", F.when(fading, F.lit(now)).otherwise(F.col("updated_at"))).withColumn("memory_type", F.when(fading, "archive").otherwise(F.col("memory_type")))
    rest, links, edges = cascade_delete(mem2, s["memory_links"], s["memory_edges"], gone)
    raw = s["raw_events"]
    old = raw.where(F.col("created_at") < now - k.delete_after_days * DAY)
    sample = reservoir(old, "id", k.sample).agg(F.array_join(F.sort_array(F.collect_list(F.struct("created_at", "content"))).getField("content"), " / ").alias("t"))
    note = sample.join(F.broadcast(old.agg(F.count("*").alias("n")))).where("n > 0").select(F.concat(F.lit("Pruned "), F.col("n"), F.lit(" raw events, among them: "), F.col("t")).alias("content"), F.lit("archive").alias("memory_type"), F.lit(None).cast("string").alias("topic"), F.lit(now).alias("at"), F.lit(0.1).alias("importance_score"), F.lit(0.0).alias("recurrence_score"))
    return s | {"memory_items": insert_ignore(rest, _derived(note, mem, now), ["content_hash"]), "memory_links": links, "memory_edges": edges, "raw_events": raw.where(F.col("created_at") >= now - k.delete_after_days * DAY)}


def rebuild_edges(s: State, c: Config, now: int) -> State:
    """C14: G1, G2 and G3."""
    mem, turns, e = s["memory_items"], s["chat_turns"], s["memory_edges"]
    e = replace_edges(e, graph.cooccurrence_edges(turns, mem, c.edge_decay, c.edge_min_weight, now), "co_occurred")
    e = replace_edges(e, graph.semantic_edges(mem, c.semantic_min, c.semantic_top, now), "semantic_similar")
    return s | {"memory_edges": replace_edges(e, graph.sequence_edges(turns, mem, c.edge_decay, c.edge_min_weight, now), "sequence")}


def era_spans(events: DataFrame, least: int, least_days: float) -> list[tuple[int, int]]:
    """T9s for events (a, b, first, last) of any number: [begin, end) of each era. Few events are merged on the driver; of
    more, each era asks for its end, so there are as many jobs as eras, which their least days bound."""
    if events.count() <= SMALL:
        rows = sorted(events.select("a", "b", "first", "last").collect())
        at = {k: t for a, b, first, last in rows for k, t in ((a, first), (b - 1, last))}
        return merge_micro([(r[0], r[1]) for r in rows], at, least, least_days)
    out, n = [], events.agg(F.max("b")).first()[0]
    begin = 0
    while begin < n:
        first = events.where(F.col("a") == begin).first()["first"]
        ends = events.where((F.col("b") - begin >= least) & ((F.col("last") - first) / DAY >= least_days) & (F.col("a") >= begin))
        end = ends.agg(F.min("b")).first()[0] or n
        out.append((begin, end))
        begin = end
    return out


def eras(memories: DataFrame, c: Config, summarizer: Summarizer = summarize) -> DataFrame:
    """C15, T10s: eras of the active embedded rows of the most common vector size."""
    live = memories.where("memory_type <> 'archive' and embedding is not null").select("id", "content", "topic", "created_at", "salience", "embedding")
    live = modal_dimension(stored(live))  # read several times
    rows = stream_events(live, c)
    events = cut_lineage(rows.groupBy("event").agg(F.min("pos").alias("a"), (F.max("pos") + 1).alias("b"), F.min("created_at").alias("first"), F.max("created_at").alias("last")))
    spans = era_spans(events, c.consolidation.epoch_min, c.consolidation.epoch_min_days)
    ends = [b for _, b in spans]

    def era_number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("event"), pa.array(np.searchsorted(ends, batch.column("a").to_numpy(), "right").astype(np.int64))], names=["event", "ordinal"])

    of_event = events.select("event", "a").mapInArrow(era_number, "event long, ordinal long")
    rows = cut_lineage(rows.join(of_event, "event"))
    facts = rows.groupBy("ordinal").agg(F.min("created_at").alias("started_at"), F.count("*").alias("member_count"))
    label = modal_by(rows, "ordinal", "topic").withColumnRenamed("topic", "label")
    best = rows.withColumn("_n", F.row_number().over(W.partitionBy("ordinal").orderBy(F.desc("salience"), "created_at", "id"))).where("_n <= 5")
    center = mean_direction(rows.select("id", "ordinal").join(live.select("id", "embedding"), "id"), "ordinal")
    got = facts.join(label, "ordinal", "left").join(summaries(best, "ordinal", summarizer), "ordinal").join(center, "ordinal")
    following = W.partitionBy(F.lit(0)).orderBy("ordinal")  # a row an era
    before = F.lag("centroid").over(following)
    drift = F.coalesce(1 - F.aggregate(F.zip_with("centroid", before, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v), F.lit(0.0))
    got = got.select("*", F.lead("started_at").over(following).alias("ended_at"), drift.alias("drift_in"))
    return got.select(F.concat(F.lit("epoch_"), "started_at", F.lit("_"), "ordinal").alias("id"), "ordinal", "started_at", "ended_at", F.col("centroid").cast("array<float>").alias("centroid"), "label", "summary", "member_count", "drift_in")


def vector_sums(rows: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, sum) of unit vectors. Tasks add up the vectors of a batch before they hand on; no group is gathered."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, own in pdf.groupby(group, dropna=False):
                yield pd.DataFrame({group: [g], "sum": [unit_rows(list(own[vector])).sum(0)]})

    sums = rows.select(group, vector).mapInPandas(add, T.StructType([rows.schema[group], T.StructField("sum", T.ArrayType(T.DoubleType()))]))
    places = sums.select(group, F.posexplode("sum").alias("place", "x")).groupBy(group, "place").agg(F.sum("x").alias("x"))
    return places.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("sum"))


def mean_direction(rows: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, centroid): the direction of the mean of unit vectors."""
    whole = vector_sums(rows, group, vector).withColumnRenamed("sum", "v")
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))
    return whole.withColumn("size", size).select(group, F.transform("v", lambda y: F.when(F.col("size") > 0, y / F.col("size")).otherwise(0.0)).alias("centroid"))


def settle(s: State) -> State:
    """Cut the lineage of the tables that passes change, in the shared checkpoint folder: a pass reads what the one before wrote."""
    return s | {n: cut_lineage(s[n]) for n in ("memory_items", "memory_links", "memory_edges")}


def consolidate(s: State, c: Config, now: int, summarizer: Summarizer = summarize, verdict: Verdict = judge) -> State:
    """All passes in order; each reads what the one before made. A run's counters are appended to consolidation_runs.

    `summarizer` and `verdict` stand in for the built-in rules (functions that workers can load).
    """
    s = settle(s)
    before = s["memory_items"]
    passes = (
        lambda t: merge_duplicates(t, c, now), lambda t: collapse_bursts(t, c, now, summarizer), lambda t: refresh_recurrence(t, now), lambda t: refresh_importance(t, c, now), lambda t: revise_salience(t, c, now), lambda t: refine_topics(t, c, now), lambda t: summarize_clusters(t, c, now, summarizer), lambda t: promote_recurring(t, c, now),
        lambda t: promote_to_foundation(t, c, now), lambda t: infer_contradictions(t, c, verdict), lambda t: mark_stale(t, now), lambda t: revive(t, c, now), lambda t: archive_and_prune(t, c, now), lambda t: rebuild_edges(t, c, now),
    )
    for step in passes:
        s = settle(step(s))
    s = s | {"epochs": eras(s["memory_items"], c, summarizer)}
    return s | {"consolidation_runs": s["consolidation_runs"].unionByName(run_row(before, s["memory_items"], now), allowMissingColumns=True)}


def run_row(before: DataFrame, after: DataFrame, now: int) -> DataFrame:
    """What changed between two versions of the memories."""
    old = before.select("id", F.col("memory_type").alias("t0"), F.col("stale").alias("s0"))
    both = old.join(after.select("id", F.col("memory_type").alias("t1"), F.col("stale").alias("s1"), "source"), "id", "full")
    n = lambda cond: F.count_if(F.expr(cond))
    got = both.agg(n("t1 is null and t0 <> 'archive'").alias("merged"), n("t0 is null and t1 = 'episodic'").alias("bursts"), n("t0 is null and t1 = 'semantic'").alias("summarized"), n("t0 <> t1 and t1 in ('semantic', 'foundation')").alias("promoted"), n("s1 and not s0").alias("stale"), n("t0 <> 'archive' and t1 = 'archive'").alias("archived"), n("t1 is null and t0 = 'archive'").alias("deleted"))
    return got.select(F.lit(f"run_{now}").alias("id"), F.lit(now).cast("long").alias("ran_at"), "*")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    over = W.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")
