"""Histogram thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def histogram(cells: DataFrame, value: str, by: Sequence[str], low: float, high: float, clip: bool = False) -> DataFrame:
    """(by..., bin, n) of ``BINS`` equal bins; the last is closed. Values outside are left out, or put at the ends with ``clip``."""
    x = F.col(value)
    inside = cells.filter(x.isNotNull() & ~F.isnan(x)) if clip else cells.filter((x >= low) & (x <= high))
    at = F.least(F.greatest(F.floor((x - low) / (high - low) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    return inside.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def otsu(cells: DataFrame, value: str, by: Sequence[str] = (), low: float = -1.0, high: float = 1.0, place: str = "edge", clip: bool = False) -> DataFrame:
    """(by..., threshold) of the largest variance between classes, the first of equals.

    place: ``edge`` is the edge between the classes, ``middle`` the middle of the last bin of the lower class. Cells
    are counted into bins first, so the running sums are over ``BINS`` rows a group at most.
    """
    return otsu_of_histogram(histogram(cells, value, by, low, high, clip), by, low, high, place)


def otsu_of_histogram(bins: DataFrame, by: Sequence[str], low: float, high: float, place: str = "edge") -> DataFrame:
    upto, whole = Window.partitionBy(*by).orderBy("bin"), Window.partitionBy(*by)
    moment = F.col("n") * (F.col("bin") + 0.5)
    sums = bins.select(
        *by, "bin", F.sum("n").over(upto).alias("wb"), F.sum(moment).over(upto).alias("mb"), F.sum("n").over(whole).alias("wt"), F.sum(moment).over(whole).alias("mt")
    ).filter("wt > wb")
    gap = F.col("mb") / F.col("wb") - (F.col("mt") - F.col("mb")) / (F.col("wt") - F.col("wb"))
    score = F.round(F.col("wb") * (F.col("wt") - F.col("wb")) * gap * gap, 6)
    best = sums.groupBy(*by).agg(F.max_by("bin", F.struct(score, -F.col("bin"))).alias("bin"))
    step = {"edge": 1.0, "middle": 0.5}[place]
    return best.select(*by, (low + (F.col("bin") + step) * (high - low) / BINS).alias("threshold"))
