"""Robust statistics of tables: ratios, glint, least squares and outlier filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgrid.operators.groups import beside
from shoalgrid.operators.quantiles import exact_median, exact_quantiles


def robust_log_ratio(cells: DataFrame, a: str = "blue", b: str = "green", percentile: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """``cells`` with ``ratio`` ln(a s) / ln(b s), s from the lower of both bands' percentiles in each ``by``; kept between 0.1 and 5."""
    low = exact_quantiles(cells, {"_a": (F.col(a), percentile), "_b": (F.col(b), percentile)}, by).select(*by, F.least("_a", "_b").alias("_p"))
    scale = F.lit(10.0) / F.greatest(F.col("_p"), F.lit(1e-4))
    log = lambda x: F.log(F.greatest(F.col(x) * scale, F.lit(1.1)))
    out = beside(cells, low, by).withColumn("ratio", log(a) / log(b)).drop("_p")
    return out.filter((F.col("ratio") > 0.1) & (F.col("ratio") < 5))


def deglint(cells: DataFrame, bands: list[str], water: Column, nir: str = "nir", percentile: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Bands less their slope on the infrared over water (sample covariance by population variance) in each ``by``, at least 1e-4.

    All cells count where there is no water.
    """
    over = cells.withColumn("_w", water)
    some = over.groupBy(*by).agg(F.coalesce(F.bool_or("_w"), F.lit(False)).alias("_any"))
    used = beside(over, some, by).filter(F.col("_w") | ~F.col("_any"))
    stats = used.groupBy(*by).agg(*[(F.covar_samp(b, nir) / F.var_pop(nir)).alias(f"_slope_{b}") for b in bands])
    low = exact_quantiles(used, {"_low": (F.col(nir), percentile)}, by)
    out = beside(beside(cells, stats, by), low, by)
    for b in bands:
        glint = F.coalesce(F.col(f"_slope_{b}"), F.lit(0.0)) * (F.col(nir) - F.col("_low"))
        out = out.withColumn(f"{b}_deglint", F.greatest(F.col(b) - glint, F.lit(1e-4)))
    return out.drop("_low", *[f"_slope_{b}" for b in bands])


def quadratic_fit(rows: DataFrame, x: str, y: str) -> tuple[float, float, float]:
    """Coefficients c0, c1, c2 of the least-squares y = c0 + c1 x + c2 x^2, from sums of powers solved on the driver."""
    import numpy as np

    X, Y = F.col(x), F.col(y)
    sums = rows.filter(X.isNotNull() & Y.isNotNull()).agg(*[F.sum(X**k).alias(f"s{k}") for k in range(5)], *[F.sum(Y * X**k).alias(f"t{k}") for k in range(3)]).first()
    if not sums["s0"]:
        return 0.0, 0.0, 0.0
    a = np.array([[sums[f"s{i + j}"] for j in range(3)] for i in range(3)], dtype=float)
    c, *_ = np.linalg.lstsq(a, np.array([sums[f"t{i}"] for i in range(3)], dtype=float), rcond=None)
    return tuple(float(v) for v in c)


def filter_least_squares(points: DataFrame, x: str, y: str, times: float = 3.0) -> DataFrame:
    """``points`` with ``residual`` of a quadratic fit, ``sigma`` (1.4826 median |residual|) and ``accepted`` (within ``times`` sigma)."""
    c0, c1, c2 = quadratic_fit(points, x, y)
    fitted = points.withColumn("residual", F.col(y) - (c0 + c1 * F.col(x) + c2 * F.col(x) * F.col(x)))
    sigma = exact_median(fitted, F.abs("residual"), "sigma", scale=1.4826)
    return fitted.crossJoin(F.broadcast(sigma)).withColumn("accepted", F.abs("residual") <= times * F.col("sigma"))


def filter_ransac(points: DataFrame, x: str, y: str, key: str, trials: int = 20, share: int = 10, threshold: float | None = None) -> DataFrame:
    """``points`` with ``residual`` from the line of most inliers, refitted on them, and ``accepted``.

    Every trial fits the points whose hashed key falls in it, one in ``share``; all trials are fitted and counted in
    one pass each, and draws depend on keys alone. The threshold defaults to 2.5 times the median residual of a first fit.
    """
    line = points.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    if threshold is None:
        first = exact_median(points.crossJoin(F.broadcast(line)), F.abs(F.col(y) - F.col("a") - F.col("b") * F.col(x)), "t", scale=2.5)
    else:
        first = points.sparkSession.range(1).select(F.lit(float(threshold)).alias("t"))
    drawn = F.explode(F.filter(F.sequence(F.lit(0), F.lit(trials - 1)), lambda t: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), t.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(share)) == 0))
    fits = points.select(x, y, drawn.alias("trial")).groupBy("trial").agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a")).filter("b IS NOT NULL")
    scored = points.crossJoin(F.broadcast(fits)).crossJoin(F.broadcast(first))
    counts = scored.groupBy("trial", "a", "b").agg(F.count_if(F.abs(F.col(y) - F.col("a") - F.col("b") * F.col(x)) <= F.col("t")).alias("n"))
    best = counts.agg(F.max_by(F.struct("a", "b"), F.struct("n", -F.col("trial"))).alias("m")).select("m.a", "m.b")
    near = points.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(first)).filter(F.abs(F.col(y) - F.col("a") - F.col("b") * F.col(x)) <= F.col("t"))
    final = near.agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    out = points.crossJoin(F.broadcast(final)).crossJoin(F.broadcast(first.withColumnRenamed("t", "threshold")))
    out = out.withColumn("residual", F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b")
    return out.withColumn("accepted", F.abs("residual") <= F.col("threshold"))


def centred_residuals(points: DataFrame) -> DataFrame:
    """``points`` with ``residual``, observed less predicted less the mean of that: what is interpolated where depths are not shifted."""
    mean = points.agg(F.coalesce(F.avg(F.col("y_true") - F.col("y_pred")), F.lit(0.0)).alias("_m"))
    return points.crossJoin(F.broadcast(mean)).withColumn("residual", F.col("y_true") - F.col("y_pred") - F.col("_m")).drop("_m")


def bias_shift(points: DataFrame, cells: DataFrame, correct: bool = True) -> DataFrame:
    """``cells`` with every z moved by the mean residual (observed less predicted). Without ``correct`` depths stay as they are, and ``centred_residuals`` are what is left to spread."""
    mean = points.agg(F.coalesce(F.avg(F.col("y_true") - F.col("y_pred")), F.lit(0.0)).alias("_m"))
    return cells.crossJoin(F.broadcast(mean)).withColumn("z", F.col("z") + (F.col("_m") if correct else 0.0)).drop("_m")


def lyzenga(cells: DataFrame, depth: Column, deep: float = 15.0, least: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """``cells`` with ``dii`` and ``bottom`` (bottom reflectance of green) from blue, green and a depth, each ``by`` by its own deep water.

    The deep-water signal of a band is its 5th percentile where the depth is over ``deep``, if more than ``least``
    cells are, else its first percentile, 0.001 at least.
    """
    d = cells.withColumn("_d", depth)
    is_deep = F.abs("_d") > deep
    enough = d.groupBy(*by).agg((F.count_if(is_deep) > least).alias("_enough"))
    shares = {f"{b}_{k}": (c, p) for b in ("blue", "green") for k, c, p in (("deep", F.when(is_deep, F.col(b)), 0.05), ("all", F.col(b), 0.01))}
    inf = beside(exact_quantiles(d, shares, by), enough, by)
    inf = inf.select(*by, *[F.when(F.col("_enough"), F.col(f"{b}_deep")).otherwise(F.greatest(F.col(f"{b}_all"), F.lit(0.001))).alias(f"_{b}") for b in ("blue", "green")])
    out = beside(d, inf, by)
    log = lambda b: F.log(F.greatest(F.col(b) - F.col(f"_{b}"), F.lit(1e-4)))
    out = out.withColumn("dii", log("blue") - 0.75 * log("green"))
    return out.withColumn("bottom", (F.col("green") - F.col("_green")) * F.exp(2 * 0.12 * F.abs("_d"))).drop("_d", "_blue", "_green")
