"""As-of joins (J13, J16): for each row the last mark at or before it.

Rows and marks are one table in the order of (by, at), dealt into ranges; in a range the last mark before a row is a running
value. What a range begins with is the last mark of the ranges before, of which there is one row a range and key. No mark is
collected, and no row meets more than one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.operators.ranges import SMALL
from mnemora.operators.segment import era_of
from mnemora.operators.similarity import cut_lineage

#: Starts of eras that an expression holds; of more, rows are joined with them.
FEW = 256


def asof(rows: DataFrame, marks: DataFrame, at: str, by: Sequence[str] = (), values: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """rows with the columns `values` of the last of `marks` whose `at` isn't after theirs, among those with equal `by`
    (nulls equal); null where there is none or a row has no `at`. Of marks of one time that with the largest values counts."""
    spark, by = rows.sparkSession, list(by)
    mark = F.struct(*values)
    kind = marks.select(mark.alias("m")).schema["m"].dataType
    left = rows.select(F.struct("*").alias("_row"), *by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_mark"))
    right = marks.where(F.col(at).isNotNull()).select(F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), *by, F.col(at).alias("_at"), F.lit(0).alias("_side"), mark.alias("_mark"))
    order = [*by, "_at", "_side", "_mark"]
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once, so that both readers see the same ranges
    ranged = cut_lineage(left.unionByName(right).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    own = W.partitionBy("_part", *by).orderBy("_at", "_side", "_mark").rowsBetween(W.unboundedPreceding, 0)
    within = ranged.withColumn("_last", F.last("_mark", True).over(own)).where("_side = 1")
    heads = ranged.groupBy("_part", *by).agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_mark"))).alias("e"))
    earlier = W.partitionBy(*by, F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = heads.select(F.col("_part").alias("_p"), *[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.last("e._mark", True).over(earlier).alias("_carried"))
    carried = cut_lineage(carried.where("_carried is not null"))  # a row a range and key at most
    here = F.col("_part") == F.col("_p")
    for i, b in enumerate(by):
        here = here & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    small = F.broadcast(carried) if carried.count() <= SMALL else carried
    got = within.join(small, here, "left").withColumn("_found", F.when(F.col("_at").isNotNull(), F.coalesce("_last", "_carried")))
    return got.select("_row.*", *[F.col("_found").getField(v).alias(v) for v in values])


def with_era(rows: DataFrame, epochs: DataFrame, at: str = "created_at") -> DataFrame:
    """Rows with `era`, the number of the last of the epochs (by started_at) that starts at or before them; 0 before the
    first. A few starts are an expression; more are numbered by a range sort and joined."""
    starts = epochs.where("started_at is not null").select("started_at")
    few = [r[0] for r in starts.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        return rows.withColumn("era", era_of(F.col(at), sorted(few)))
    from mnemora.operators.ranges import positions

    marks = positions(starts.withColumn("_all", F.lit(0)), "_all", ["started_at"]).select(F.col("started_at").alias(at), F.col("pos").alias("era"))
    return asof(rows, marks, at, values=["era"]).withColumn("era", F.coalesce(F.col("era"), F.lit(0)).cast("int"))
