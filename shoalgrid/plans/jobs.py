"""Jobs composed of operators: masks from several steps, depth of a scene, change of a coast."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.functions import indices
from shoalgrid.operators import components, focal, temporal
from shoalgrid.operators.groups import beside
from shoalgrid.operators.masks import water_by_three_indices
from shoalgrid.operators.quantiles import exact_quantiles
from shoalgrid.operators.ranks import knee_point
from shoalgrid.operators.thresholds import BINS, histogram


def valley_threshold(cells: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold): Otsu's score times 1 less the smoothed share of values there, so that valleys win.

    The histogram over [-1, 1] is smoothed by a Gaussian of 2 bins (17 taps, reflected at the ends).
    """
    import math

    taps = {i: math.exp(-i * i / 8) for i in range(-8, 9)}
    total = sum(taps.values())
    bins = histogram(cells, value, list(by), -1.0, 1.0)
    every = cells.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    if by:
        every = every.crossJoin(cells.select(*by).distinct())  # BINS rows a group
    full = every.join(bins, [*by, "bin"], "left").fillna(0, ["n"])
    tap = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w / total).alias("w")) for i, w in taps.items()])).alias("t")
    at = F.col("bin") + F.col("t.i")
    at = F.when(at < 0, -at - 1).when(at >= BINS, 2 * BINS - 1 - at).otherwise(at)
    smooth = full.select(*by, "bin", "n", tap).select(*by, at.alias("bin"), (F.col("n") * F.col("t.w")).alias("s")).groupBy(*by, "bin").agg(F.sum("s").alias("s"))
    upto, whole = Window.partitionBy(*by).orderBy("bin"), Window.partitionBy(*by)
    moment = F.col("n") * (F.col("bin") + 0.5)
    sums = full.join(smooth, [*by, "bin"]).select(*by, "bin", "s", F.sum("n").over(upto).alias("wb"), F.sum(moment).over(upto).alias("mb"), F.sum("n").over(whole).alias("wt"), F.sum(moment).over(whole).alias("mt"))
    gap = F.col("mb") / F.col("wb") - (F.col("mt") - F.col("mb")) / (F.col("wt") - F.col("wb"))
    score = F.when((F.col("wb") > 0) & (F.col("wt") > F.col("wb")), F.col("wb") * (F.col("wt") - F.col("wb")) * gap * gap * (1 - F.col("s") / F.col("wt")))
    best = sums.groupBy(*by).agg(F.max_by("bin", F.when(score.isNotNull(), F.struct(F.round(score, 6), -F.col("bin")))).alias("b"))
    return best.select(*by, F.coalesce(-1.0 + (F.col("b") + 1) * 2.0 / BINS, F.lit(0.0)).alias("threshold"))


def hybrid_water(cells: DataFrame, bounds: tuple[int, int, int, int], least: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """(by..., r, c) of water: in each scene by indices where the NDWI is flat, else by its valley too; then closed and sieved."""
    ndwi, mndwi, ndvi = indices.ndwi(F.col("green"), F.col("nir")), indices.mndwi(F.col("green"), F.col("swir")), indices.ndvi(F.col("nir"), F.col("red"))
    x = cells.select(*by, "r", "c", "blue", "green", "red", "nir", "swir", ndwi.alias("ndwi"), mndwi.alias("mndwi"), ndvi.alias("ndvi"))
    one = beside(valley_threshold(x, "ndwi", by), x.groupBy(*by).agg(F.stddev_pop("ndwi").alias("_s")), by)
    green = F.col("ndvi") < 0.15
    wet = F.when(F.col("_s") < 0.05, (F.col("mndwi") > -0.05) & green).otherwise(((F.col("ndwi") > F.col("threshold")) | (F.col("mndwi") > -0.05)) & green)
    marked = beside(x, one, by).withColumn("_wet", wet).withColumn("_few", water_by_three_indices())
    count = marked.groupBy(*by).agg((F.count_if("_wet") <= 100).alias("_use"))
    water = beside(marked, count, by).filter(F.when(F.col("_use"), F.col("_few")).otherwise(F.col("_wet"))).select(*by, "r", "c")
    closed = focal.binary_closing(water, by, bounds).union(water).distinct()
    grid = cells.select(*by, "r", "c").join(closed.withColumn("v", F.lit(1)), [*by, "r", "c"], "left").fillna(0, ["v"])
    return components.sieve(grid, "v", least, by).filter("v = 1").select(*by, "r", "c")


def nir_percentile(p: float) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    return lambda cells, by: exact_quantiles(cells, {"_k": (F.col("nir"), p)}, by)


def nir_knee(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """The infrared's knee; of several groups each in turn, as a knee needs the ranks of its own values: groups are scenes, few next to cells."""
    if not by:
        return knee_point(cells, "nir").select(F.col("knee").alias("_k"))
    out = None
    for group in cells.select(*by).distinct().collect():
        own, keys = cells, []
        for b in by:
            own = own.filter(F.col(b).eqNullSafe(F.lit(group[b])))
            keys.append(F.lit(group[b]).cast(dict(cells.dtypes)[b]).alias(b))
        one = knee_point(own, "nir").select(*keys, F.col("knee").alias("_k"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else cells.select(*by, F.col("nir").alias("_k"))


def _bright(cells: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    return beside(cells, stats, by).filter((F.col("blue") > F.col("_blue")) | (F.col("green") > F.col("_green"))).drop("_blue", "_green")


def shallow_by_deep(cells: DataFrame, limit: Callable[[DataFrame, Sequence[str]], DataFrame], by: Sequence[str] = (), times: float = 2.0) -> DataFrame:
    """Optically shallow cells: brighter in blue or green than mean + ``times`` deviations of the deep ones of their scene (infrared at or under ``limit``).

    All cells of a scene count as deep where fewer than 10 do.
    """
    deep = beside(cells, limit(cells, by), by).withColumn("_deep", F.coalesce(F.col("nir") <= F.col("_k"), F.lit(False)))
    n = deep.groupBy(*by).agg((F.count_if("_deep") < 10).alias("_all"))
    used = beside(deep, n, by).filter("_deep OR _all")
    return _bright(cells, used.groupBy(*by).agg(*[(F.avg(b) + times * F.stddev_pop(b)).alias(f"_{b}") for b in ("blue", "green")]), by)


def shallow_by_clear(cells: DataFrame, limit: Callable[[DataFrame, Sequence[str]], DataFrame], most: float = 0.75, by: Sequence[str] = (), times: float = 2.0) -> DataFrame:
    """As ``shallow_by_deep``, from the deep cells that are not among the most turbid (NDTI at or under its ``most`` quantile there)."""
    marked = beside(cells.withColumn("_ndti", indices.ndti(F.col("red"), F.col("green"))), limit(cells, by), by)
    deep = marked.filter(F.col("nir") <= F.col("_k"))
    clear = beside(deep, exact_quantiles(deep, {"_q": (F.col("_ndti"), most)}, by), by).filter(F.col("_ndti") <= F.col("_q"))
    return _bright(cells, clear.groupBy(*by).agg(*[(F.avg(b) + times * F.stddev_pop(b)).alias(f"_{b}") for b in ("blue", "green")]), by)


def quantile_sigma(rows: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """``rows`` with ``sigma``: half the distance of the 16 % and 84 % quantiles of y in the row's bin of x."""
    bin_ = F.floor(F.col(x) / width).cast("int")
    binned = rows.withColumn("_bin", bin_)
    q = exact_quantiles(binned, {"_high": (F.col(y), 0.84), "_low": (F.col(y), 0.16)}, ["_bin"])
    q = q.select(F.col("_bin").alias("_b"), ((F.col("_high") - F.col("_low")) / 2).alias("sigma"))
    return binned.join(q, F.col("_bin") == F.col("_b")).drop("_bin", "_b")


def coastal_change(maps: DataFrame, area: float) -> DataFrame:
    """Sediment balance of consecutive years with healthy maps, by an automatic threshold and after an opening."""
    healthy = maps.join(temporal.healthy_years(maps), "year", "left_semi")
    periods = temporal.change_periods(healthy.select("year").distinct()).filter("kind = 'Sequential'")
    changed = temporal.significant_change(temporal.aligned_pairs(healthy, periods), None)
    return temporal.sediment_volumes(changed, area)
