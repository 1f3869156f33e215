"""Joins of cells with polygons, grids, neighbours and tides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalgrid.operators.quantiles import exact_median
from shoalgrid.sources.shared import written

#: Side of the square buckets that range and neighbour joins go by, in cells.
TILE = 16
#: Sides of the buckets that a neighbour search goes by, in turn, up to the range of an integer, and rings of buckets that it counts around one.
LEVELS = tuple(4**i for i in range(1, 16)) + (1 << 31,)
RINGS = 2


def remove_positive(cells: DataFrame, z: str = "z") -> DataFrame:
    """Negative depths alone where the median is negative; else all."""
    middle = exact_median(cells, z, "_m")
    return cells.crossJoin(F.broadcast(middle)).filter((F.col("_m") >= 0) | (F.col(z) < 0)).drop("_m")


def clean_depth(cells: DataFrame, mask: DataFrame, column: str, most: float) -> DataFrame:
    """Cells inside the mask and within 1.5 times the largest depth.

    A mask of 0, 1 and no data alone holds where it is 1; any other where it is valid.
    """
    kinds = mask.agg(F.coalesce(F.bool_and(F.col(column).isin(0.0, 1.0, -9999.0)), F.lit(True)).alias("_binary"))
    valid = F.col(column).isNotNull() & (F.col(column) != -9999)
    inside = mask.crossJoin(F.broadcast(kinds)).filter(valid & (~F.col("_binary") | (F.col(column) == 1))).select("r", "c").distinct()
    return cells.filter(F.abs("z") <= 1.5 * abs(most)).join(inside, ["r", "c"], "left_semi")


def dominant_range(cells: DataFrame, z: str) -> DataFrame:
    """One row (z_min, z_max) of the values with the more common sign; widened by 1 if equal, -30 to 0 if there are none."""
    sums = cells.agg(
        F.count_if(F.col(z) < 0).alias("n"), F.count_if(F.col(z) > 0).alias("p"),
        *[f(F.when(where, F.col(z))).alias(name) for name, f, where in (("n0", F.min, F.col(z) < 0), ("n1", F.max, F.col(z) < 0), ("p0", F.min, F.col(z) > 0), ("p1", F.max, F.col(z) > 0))],
    )
    low, high = F.when(F.col("n") >= F.col("p"), F.col("n0")).otherwise(F.col("p0")), F.when(F.col("n") >= F.col("p"), F.col("n1")).otherwise(F.col("p1"))
    same = F.coalesce(low == high, F.lit(False))
    return sums.select(F.coalesce(F.when(same, low - 1).otherwise(low), F.lit(-30.0)).alias("z_min"), F.coalesce(F.when(same, high + 1).otherwise(high), F.lit(0.0)).alias("z_max"))


def symmetric_bounds(cells: DataFrame, value: str) -> DataFrame:
    """One row (bound): the larger magnitude of mean plus and minus 2.5 deviations; 0.5 if under 0.1."""
    m, s = F.avg(value), F.stddev_pop(value)
    b = F.greatest(F.abs(m - 2.5 * s), F.abs(m + 2.5 * s))
    return cells.agg(F.when(b < 0.1, 0.5).otherwise(b).alias("bound"))


def bbox(cells: DataFrame, padding: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """The smallest box of rows and columns of each ``by``, with padding."""
    return cells.groupBy(*by).agg((F.min("r") - padding).alias("r0"), (F.min("c") - padding).alias("c0"), (F.max("r") + padding).alias("r1"), (F.max("c") + padding).alias("c1"))


def cells_in_polygons(cells: DataFrame, polygons: DataFrame) -> DataFrame:
    """(poly_id, r, c) of cells whose centre is inside a polygon by the even-odd rule, in units of cells.

    A polygon's edges go to the rows of buckets that they cross and to the buckets of columns from the polygon's
    left to the edge, so a cell meets only edges that can count: a crossing to its right in its row.
    """
    n = F.size("vertices")
    edges = polygons.withColumn("left", F.array_min(F.transform("vertices", lambda v: v["x"])))
    edges = edges.select("poly_id", "left", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("vertices", i).alias("a"), F.get("vertices", (i + 1) % n).alias("b")))).alias("e"))
    edges = edges.select("poly_id", "left", F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1")).filter("y0 <> y1")
    tile = lambda v: F.floor(v / TILE).cast("int")
    edges = edges.withColumn("tr", F.explode(F.sequence(tile(F.least("y0", "y1")), tile(F.greatest("y0", "y1")))))
    edges = edges.withColumn("tc", F.explode(F.sequence(tile(F.col("left")), tile(F.greatest("x0", "x1")))))
    g = cells.select("r", "c", (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y")).withColumn("tr", tile(F.col("y"))).withColumn("tc", tile(F.col("x")))
    crosses = ((F.col("y0") <= F.col("y")) != (F.col("y1") <= F.col("y"))) & (F.col("x0") + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")) > F.col("x"))
    hits = g.join(edges, ["tr", "tc"]).filter(crosses).groupBy("poly_id", "r", "c").agg(F.count("*").alias("n"))
    return hits.filter(F.col("n") % 2 == 1).select("poly_id", "r", "c")


def grid_of(spark: SparkSession, side: int) -> DataFrame:
    """(r, c) of a square grid."""
    return spark.range(side * side).select((F.col("id") / side).cast("int").alias("r"), (F.col("id") % side).cast("int").alias("c"))


def resample_nearest(source: DataFrame, target: DataFrame, step: float, by: Sequence[str], value: str) -> DataFrame:
    """(by..., r, c, value) of the source cell that each target cell's centre is in; a target cell is ``step`` source cells wide."""
    at = target.select("r", "c", F.floor((F.col("r") + 0.5) * step).cast("int").alias("_r"), F.floor((F.col("c") + 0.5) * step).cast("int").alias("_c"))
    s = source.select(*by, F.col("r").alias("_r"), F.col("c").alias("_c"), value)
    return at.join(s, ["_r", "_c"]).select(*by, "r", "c", value)


def resample_bilinear(source: DataFrame, target: DataFrame, step: float, by: Sequence[str], value: str) -> DataFrame:
    """(by..., r, c, value) from the four source cells around a target's centre, weighted over those there are."""
    at = target.select("r", "c", ((F.col("r") + 0.5) * step - 0.5).alias("y"), ((F.col("c") + 0.5) * step - 0.5).alias("x"))
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("o")
    near = at.select("r", "c", "y", "x", corners)
    part = lambda v, o: F.when(F.col(o) == 1, F.col(v) - F.floor(v)).otherwise(1 - (F.col(v) - F.floor(v)))
    near = near.select("r", "c", (F.floor("y") + F.col("o.i")).cast("int").alias("_r"), (F.floor("x") + F.col("o.j")).cast("int").alias("_c"), (part("y", "o.i") * part("x", "o.j")).alias("_w")).filter("_w > 1e-9")
    s = source.select(*by, F.col("r").alias("_r"), F.col("c").alias("_c"), value)
    sums = near.join(s, ["_r", "_c"]).groupBy(*by, "r", "c").agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias(value))
    return sums.select(*by, "r", "c", value)


def _nearest(places: DataFrame, points: DataFrame, need: int) -> DataFrame:
    """(qr, qc, point columns, d2, rank) of the ``need`` nearest points to each of distinct places.

    Both go into square buckets. From counts of points per bucket it is known how many rings around a bucket hold
    enough points, and so how far its places must look; those that find too few in RINGS rings are written and go
    by buckets four times as wide, the last of which have everything next door.
    """
    order = Window.partitionBy("qr", "qc").orderBy("d2", "k")
    across, down = (F.col(x).cast("long") - F.col(y) for x, y in (("qc", "c"), ("qr", "r")))
    d2 = down * down + across * across
    left, done = places, None
    for side in LEVELS:
        tile = lambda c, side=side: F.floor(F.col(c) / side).cast("int")
        p = points.withColumn("tr", tile("r")).withColumn("tc", tile("c"))
        q = left.withColumn("qtr", tile("qr")).withColumn("qtc", tile("qc"))
        last = side == LEVELS[-1]
        if last:
            reach = q.select("qtr", "qtc").distinct().withColumn("reach", F.lit(RINGS))
        else:
            counts = p.groupBy("tr", "tc").agg(F.count("*").alias("n"))
            around = F.sequence(F.lit(-RINGS), F.lit(RINGS))
            seen = q.select("qtr", "qtc").distinct().withColumn("i", F.explode(around)).withColumn("j", F.explode(around))
            seen = seen.select("qtr", "qtc", (F.col("qtr") + F.col("i")).alias("tr"), (F.col("qtc") + F.col("j")).alias("tc"), F.greatest(F.abs("i"), F.abs("j")).alias("ring"))
            rings = seen.join(counts, ["tr", "tc"]).groupBy("qtr", "qtc", "ring").agg(F.sum("n").alias("n"))
            rings = rings.withColumn("n", F.sum("n").over(Window.partitionBy("qtr", "qtc").orderBy("ring"))).filter(F.col("n") >= need)
            # The farthest corners of a square of rings are within its side and a bit more of any query in the middle.
            reach = written(rings.groupBy("qtr", "qtc").agg(F.ceil((F.min("ring") + 1) * 1.4143).cast("int").alias("reach")), "reach")
        over = F.sequence(-F.col("reach"), F.col("reach"))
        sent = reach.withColumn("i", F.explode(over)).withColumn("j", F.explode(over))
        sent = sent.select("qtr", "qtc", (F.col("qtr") + F.col("i")).alias("tr"), (F.col("qtc") + F.col("j")).alias("tc"))
        found = q.join(sent, ["qtr", "qtc"]).join(p, ["tr", "tc"]).withColumn("d2", d2)
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= need).drop("tr", "tc", "qtr", "qtc")
        done = found if done is None else done.unionByName(found)
        if last:
            break
        left = written(q.join(reach, ["qtr", "qtc"], "left_anti").drop("qtr", "qtc"), "left")
        if not left.limit(1).count():
            break
    return done


def knn(queries: DataFrame, points: DataFrame, k: int, own: str | None = None) -> DataFrame:
    """(query columns, point columns, d2, rank) of the k nearest of ``points`` (r, c, k, ...) to each query (qr, qc), ties by the key ``k``.

    Queries of one place share one search, and each gets all its k neighbours. own: a column of the queries that names
    the point which a query is itself; that one is left out, others of its place are neighbours.
    """
    near = _nearest(queries.select("qr", "qc").distinct(), points, k if own is None else k + 1)
    found = near.join(queries, ["qr", "qc"])
    if own is None:
        return found
    order = Window.partitionBy(own).orderBy("d2", "k")
    return found.filter(F.col("k") != F.col(own)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def idw(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(qr, qc, v): mean of the k nearest points' ``v`` by the weight 1 / (distance + 1)."""
    w = 1 / (F.sqrt(F.col("d2").cast("double")) + 1)
    return knn(queries, points, k).groupBy("qr", "qc").agg((F.sum(F.col("v") * w) / F.sum(w)).alias("v"))


def robust_idw(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """As ``idw``, points down-weighted by how far off they are from what their own neighbours say."""
    w = 1 / (F.sqrt(F.col("d2").cast("double")) + 1)
    named = points.select(F.col("r").alias("qr"), F.col("c").alias("qc"), F.col("k").alias("own"), F.col("v").alias("mine"))
    others = knn(named, points, k, own="own")
    errors = others.groupBy("own").agg((F.first("mine") - F.sum(F.col("v") * w) / F.sum(w)).alias("e"))
    scale = exact_median(errors, F.abs("e"), "s", scale=1.4826)
    trust = errors.crossJoin(F.broadcast(scale)).select("own", F.when(F.col("e") == 0, 1.0).otherwise(F.least(F.greatest(1.35 * F.col("s") / F.abs("e"), F.lit(0.0)), F.lit(1.0))).alias("u"))
    found = knn(queries, points, k).join(trust, F.col("k") == F.col("own"))
    wu = F.col("u") * w
    return found.groupBy("qr", "qc").agg((F.sum(F.col("v") * wu) / F.when(F.sum(wu) == 0, 1.0).otherwise(F.sum(wu))).alias("v"))


def add_residual(cells: DataFrame, residual: DataFrame) -> DataFrame:
    """``cells`` with z moved by the interpolated residual of their place."""
    return cells.join(residual, (F.col("r") == F.col("qr")) & (F.col("c") == F.col("qc"))).withColumn("z", F.col("z") + F.col("v")).drop("qr", "qc", "v")


def tide_in_metres(tide: DataFrame) -> DataFrame:
    """(con_id, lat_i, lon_i, amp): amplitudes in centimetres if any is over 15."""
    unit = tide.agg((F.max("amp_cm") > 15).alias("_cm"))
    amp = F.when(F.col("_cm"), F.col("amp_cm") / 100).otherwise(F.col("amp_cm"))
    return tide.crossJoin(F.broadcast(unit)).select("con_id", "lat_i", "lon_i", amp.alias("amp"))


def tide_cell(points: DataFrame, tide: DataFrame) -> DataFrame:
    """``points`` (lat, lon in steps of regular axes) with the first axis index at or above, clipped to the axes."""
    axes = tide.agg(F.max("lat_i").alias("_la"), F.max("lon_i").alias("_lo"))
    at = lambda x, most: F.least(F.greatest(F.ceil(x), F.lit(0)), F.col(most)).cast("int")
    return points.crossJoin(F.broadcast(axes)).withColumn("lat_i", at("lat", "_la")).withColumn("lon_i", at("lon", "_lo")).drop("_la", "_lo")


def tide_lookup(points: DataFrame, tide: DataFrame) -> DataFrame:
    """``points`` once for each constituent at their place, with its ``amp``."""
    return tide_cell(points, tide).join(tide, ["lat_i", "lon_i"])


def harmonic_sums(found: DataFrame) -> DataFrame:
    """(point_id, depth, total, m2, s2, k1, o1): all amplitudes, and the named ones (constituents 0 to 3)."""
    named = {"m2": 0, "s2": 1, "k1": 2, "o1": 3}
    parts = [F.coalesce(F.max(F.when(F.col("con_id") == i, F.col("amp"))), F.lit(0.0)).alias(n) for n, i in named.items()]
    return found.groupBy("point_id").agg(F.first("depth").alias("depth"), F.sum("amp").alias("total"), *parts)


def datum_shift(points: DataFrame, source: str, target: str) -> DataFrame:
    """``points`` with depth moved from one tidal datum to another; offsets are against mean sea level."""
    m2, s2, k1, o1, total = (F.col(c) for c in ("m2", "s2", "k1", "o1", "total"))
    neap = F.abs(m2 - s2)
    offset = {"MSL": F.lit(0.0), "HAT": -total, "LAT": total, "MHWS": -(m2 + s2), "MLWS": m2 + s2, "MHWN": -neap, "MLWN": neap, "MLLW": m2 + s2 + k1 + o1}
    return points.withColumn("depth", F.col("depth") + offset[target] - offset[source])


def coastal_fix(tide: DataFrame, most: int = 4) -> DataFrame:
    """``tide`` with amplitudes that are not positive replaced by the mean of the wet cells in the smallest square with any, or 0."""
    keys = ["con_id", "lat_i", "lon_i"]
    dry = tide.filter("amp <= 0").select(*keys)
    around = F.sequence(F.lit(-most), F.lit(most))
    sent = dry.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).withColumn("d", F.greatest(F.abs("i"), F.abs("j")))
    wet = tide.filter("amp > 0").select(F.col("con_id").alias("k"), F.col("lat_i").alias("a"), F.col("lon_i").alias("o"), "amp")
    met = sent.join(wet, (F.col("con_id") == F.col("k")) & (F.col("lat_i") + F.col("i") == F.col("a")) & (F.col("lon_i") + F.col("j") == F.col("o")))
    rings = met.groupBy(*keys, "d").agg(F.sum("amp").alias("s"), F.count("*").alias("n"))
    # A square holds the ring that first has a wet cell, and nothing wet inside it.
    mean = rings.groupBy(*keys).agg(F.min_by(F.col("s") / F.col("n"), "d").alias("_mean"))
    out = tide.join(mean, keys, "left")
    return out.select(*keys, F.when(F.col("amp") > 0, F.col("amp")).otherwise(F.coalesce("_mean", F.lit(0.0))).alias("amp"))
