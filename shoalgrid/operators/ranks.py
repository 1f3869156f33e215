"""Exact running totals and ranks without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.operators.quantiles import exact_quantiles

SPLITS = 256


def running_total(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``rows`` (distinct in ``order``) with ``name``: the sum of ``value`` over all rows up to and with the row's own.

    Rows go into ranges at approximate quantiles; sums per range are added up over at most SPLITS rows, and inside a
    range by a window of its own.
    """
    splits = rows.agg(F.percentile_approx(F.col(order).cast("double"), [i / SPLITS for i in range(1, SPLITS)], 10_000).alias("_s"))
    at = F.size(F.filter("_s", lambda s: s < F.col(order)))
    ranged = rows.crossJoin(F.broadcast(splits)).withColumn("_range", F.coalesce(at, F.lit(0))).drop("_s")
    sums = ranged.groupBy(F.col("_range").alias("_k")).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_k", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(order)
    out = ranged.join(F.broadcast(sums), F.col("_range") == F.col("_k"))
    return out.withColumn(name, F.col("_before") + F.sum(value).over(inside)).drop("_range", "_k", "_before")


def knee_point(rows: DataFrame, value: str, samples: int = 5000, limit: int = 10_000, least: int = 10) -> DataFrame:
    """One row (knee): the positive value where the sorted, scaled curve is furthest from the diagonal.

    From ``limit`` values on, ``samples`` evenly spaced ranks stand for all. Under ``least`` values it is the 10th percentile.
    """
    v = rows.select(F.col(value).cast("double").alias("v")).filter("v > 0")
    counts = running_total(v.groupBy("v").agg(F.count("*").alias("n")), "v", "n", "upto")
    total = v.agg(F.count("*").alias("total")).crossJoin(exact_quantiles(v, {"p10": (F.col("v"), 0.1)}))
    ranked = counts.crossJoin(F.broadcast(total))
    few = F.col("total") < limit
    # Ranks, from 0, that each distinct value covers; with sampling, the samples whose rank is among them.
    spaced = lambda i: F.floor(i * (F.col("total") - 1) / (samples - 1))
    low = F.when(few, F.col("upto") - F.col("n")).otherwise(F.ceil((F.col("upto") - F.col("n")) * (samples - 1) / (F.col("total") - 1)))
    high = F.when(few, F.col("upto") - 1).otherwise(F.least(F.ceil(F.col("upto") * (samples - 1) / (F.col("total") - 1)) - 1, F.lit(samples - 1)))
    n = F.when(few, F.col("total")).otherwise(F.lit(samples))
    ends = ranked.withColumn("lo", low).withColumn("hi", high).withColumn("m", n).filter("lo <= hi")
    span = ends.agg(F.min("v").alias("v0"), F.max("v").alias("v1"))
    both = ends.crossJoin(F.broadcast(span)).withColumn("y", F.when(F.col("v1") > F.col("v0"), (F.col("v") - F.col("v0")) / (F.col("v1") - F.col("v0"))).otherwise(0.0))
    x = lambda c: F.col(c) / (F.col("m") - 1)
    far = F.greatest(F.abs(x("lo") - F.col("y")), F.abs(x("hi") - F.col("y")))
    knee = both.agg(F.max_by("v", F.struct(F.round(far, 9), -F.col("v"))).alias("k"), F.max("total").alias("t"), F.max("p10").alias("p"))
    return knee.select(F.when(F.coalesce("t", F.lit(0)) < least, F.col("p")).otherwise(F.col("k")).alias("knee"))
