"""Exact quantiles of many values and groups by distributed selection: ranges of values are narrowed by counts until few are left."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.sources.shared import written

#: Ranges that a pass cuts the values left of each quantile into, and the sketch's accuracy, which is far finer.
RANGES, ACCURACY = 128, 8192
#: Quantiles with at most this many values left are read off in one sorted run of distinct values.
LEAST = 50_000
#: Passes at most; each leaves about one value in RANGES / 4.
PASSES = 12


def exact_quantiles(rows: DataFrame, wanted: Mapping[str, tuple[Column, float]], by: Sequence[str] = (), least: int | None = None) -> DataFrame:
    """(by..., names...): of each group the quantiles ``{name: (column, share)}``, linear between two ranks as ``percentile`` has it.

    Where a group is large, a sketch brackets the two ranks, and counts of what lies below and within are exact: no value
    is shuffled for that. What is within, equal values as one row with their number, is cut into ranges and counted
    again until few values are left; partial counts are made in every task, and no task holds a group. Nulls are
    left out; NaN is the largest; a group without values has NULL; without ``by`` there is one row.
    """
    given, by = list(by), [f"_g{k}" for k in range(len(by))]
    rows = rows.select(*[F.col(g).alias(b) for g, b in zip(given, by)], *[c.alias(f"_v{k}") for k, (c, _) in enumerate(wanted.values())])
    least = max(LEAST if least is None else least, 4 * RANGES)
    names = list(wanted)
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_v{k}").cast("double").alias("v")) for k in range(len(names))])).alias("_x"))
    left = written(long.select(*by, F.col("_x.k").alias("k"), F.col("_x.v").alias("v")).filter("v IS NOT NULL"), "values")
    keys = [*by, "k"]
    share = F.element_at(F.array(*[F.lit(float(wanted[n][1])) for n in names]), F.col("k") + 1)
    # Rank below the quantile (from 0), how far it is on the way to the next, and how many values are below what is left.
    state = left.groupBy(*keys).agg(F.count("*").alias("m"))
    at = share * (F.col("m") - 1)
    state = written(state.select(*keys, F.floor(at).alias("rank"), (at - F.floor(at)).alias("part"), F.lit(0).cast("long").alias("below"), "m"), "ranks")
    if state.filter(F.col("m") > least).limit(1).count():
        left, state = _bracketed(left, state, keys)
    left = written(left.groupBy(*keys, "v").agg(F.count("*").alias("n")), "counts")
    for _ in range(PASSES):
        if not left.groupBy(*keys).count().filter(F.col("count") > least).limit(1).count():
            break
        left, state = _narrowed(left, state, keys)
    else:
        raise RuntimeError(f"more than {least} values are left after {PASSES} passes")
    counts = left
    upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("upto", F.sum("n").over(upto))
    met = _joined(counts, state.select(*keys, "rank", "part", "below"), keys)
    a, b = (F.min(F.when(F.col("below") + F.col("upto") > F.col("rank") + step, F.col("v"))) for step in (0, 1))
    found = met.groupBy(*keys).agg(a.alias("a"), b.alias("b"), F.first("part").alias("part"))
    found = found.select(*keys, F.when(F.col("part") > 0, F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).otherwise(F.col("a")).alias("q"))
    one = found.groupBy(*by).agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(n) for k, n in enumerate(names)])
    if not by:
        return one
    groups = rows.select(*by).distinct()
    return groups.join(one.select(*[F.col(x).alias(f"_{x}") for x in by], *names), _and(F.col(x).eqNullSafe(F.col(f"_{x}")) for x in by), "left").select(*[F.col(b).alias(g) for g, b in zip(given, by)], *names)


def _bracketed(left: DataFrame, state: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Values between two splitters of a sketch about the ranks, without a shuffle of values; below and within are counted exactly."""
    splits = F.percentile_approx("v", [k / RANGES for k in range(RANGES + 1)], ACCURACY)
    cut = _joined(left.groupBy(*keys).agg(splits.alias("s")), state, keys)
    # A splitter to spare on either side, two ranks at least.
    spare = F.greatest(F.lit(1), F.ceil(2 * RANGES / F.col("m")))
    low = F.get("s", F.greatest(F.floor(F.col("rank") * RANGES / F.col("m")) - spare, F.lit(0)).cast("int"))
    high = F.get("s", F.least(F.ceil((F.col("rank") + 2) * RANGES / F.col("m")) + spare, F.lit(RANGES)).cast("int"))
    cut = written(cut.select(*keys, "rank", "part", low.alias("lo"), high.alias("hi")), "cuts")
    met = _joined(left, cut, keys)
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    counted = met.groupBy(*keys).agg(*[F.first(x).alias(x) for x in ("rank", "part")], F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(inside).alias("m"))
    state = written(counted, "ranks")
    if state.filter("rank < below OR rank + CASE WHEN part > 0 THEN 1 ELSE 0 END >= below + m").limit(1).count():
        raise RuntimeError("a sketch was further off than its bound")
    return met.filter(inside).select(*keys, "v"), state


def _narrowed(left: DataFrame, state: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct values with counts, cut at splitters of the distinct values; what is left are the ranges that hold the two ranks."""
    splits = written(left.groupBy(*keys).agg(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], ACCURACY).alias("s")), "splits")
    ranged = _joined(left, splits, keys).select(*keys, "v", "n", F.size(F.filter("s", lambda s: s < F.col("v"))).alias("range"))
    sums = ranged.groupBy(*keys, "range").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    sums = _joined(sums.withColumn("upto", F.coalesce(F.sum("n").over(before), F.lit(0))), state.drop("m"), keys)
    first, last = F.col("rank") - F.col("below"), F.col("rank") - F.col("below") + F.when(F.col("part") > 0, 1).otherwise(0)
    held = sums.filter((F.col("upto") + F.col("n") > first) & (F.col("upto") <= last))
    kept = held.groupBy(*keys).agg(*[F.first(x).alias(x) for x in ("rank", "part")], (F.first("below") + F.min("upto")).alias("below"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    kept = written(kept, "ranks")
    left = _joined(left, kept.select(*keys, "lo", "hi"), keys).filter(F.col("v").between(F.col("lo"), F.col("hi"))).select(*keys, "v", "n")
    return written(left, "counts"), kept.select(*keys, "rank", "part", "below", F.lit(0).cast("long").alias("m"))


def exact_median(rows: DataFrame, value: Column | str, name: str, by: Sequence[str] = (), scale: float = 1.0) -> DataFrame:
    """(by..., name): ``scale`` times the median of each group."""
    x = F.col(value) if isinstance(value, str) else value
    return exact_quantiles(rows, {name: (x, 0.5)}, by).withColumn(name, F.col(name) * scale)


def _and(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _joined(left: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``few`` (a row a group and quantile), broadcast just where its rows, counted, are few."""
    named = few.select(*[F.col(x).alias(f"_{x}") for x in keys], *[c for c in few.columns if c not in keys])
    if few.limit(10_001).count() <= 10_000:
        named = F.broadcast(named)
    return left.join(named, _and(F.col(x).eqNullSafe(F.col(f"_{x}")) for x in keys)).drop(*[f"_{x}" for x in keys])
