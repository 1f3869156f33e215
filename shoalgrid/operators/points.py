"""Point tables: fields, filters, cells they fall in, and what collides there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which a depth is looked for, in this order.
DEPTH_NAMES = ("ortho_h", "h_mean", "depth", "elevation", "height", "z", "h")
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def resolve_depth_field(df: DataFrame, wanted: str | None = None) -> str:
    """Column that holds the depth: as named, in other case, by a likely name, or the first number. Looks at the schema alone."""
    if wanted in df.columns:
        return wanted
    lower = {c.lower(): c for c in reversed(df.columns)}
    if wanted and wanted.lower() in lower:
        return lower[wanted.lower()]
    for name in DEPTH_NAMES:
        for c in df.columns:
            if c.lower() == name or (len(name) > 1 and name in c.lower()):
                return c
    numbers = [c for c, t in df.dtypes if t.startswith(NUMBERS)]
    if not numbers:
        raise ValueError("no numeric column can be a depth")
    return numbers[0]


def check_depth_field(df: DataFrame, name: str) -> str:
    """The column called ``name``, its lower case, or its first ten characters; an error stops the job before it is planned."""
    for c in (name, name.lower(), name[:10]):
        if c in df.columns:
            return c
    raise ValueError(f"no depth field {name!r} in {df.columns}")


def filter_by_depth(points: DataFrame, depth: str, most: float) -> DataFrame:
    """Depths that are not 0 and within ``most``; a limit of 9000 and up is none."""
    d = F.col(depth)
    return points.filter((d != 0) & (F.lit(True) if abs(most) >= 9000 else F.abs(d) <= abs(most)))


def filter_by_year(points: DataFrame, field: str, year: int) -> DataFrame:
    """Rows whose year field is the year: a number equal to it, or text that has it as a year 19xx or 20xx."""
    kind = dict(points.dtypes)[field]
    x = F.col(field)
    if kind.startswith(NUMBERS):
        return points.filter(x == year)
    return points.filter(F.array_contains(F.regexp_extract_all(x.cast("string"), F.lit(r"(?:19|20)\d{2}"), F.lit(0)), str(year)))


def filter_any_attribute(rows: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows where some column's text contains ``text``."""
    return rows.filter(F.exists(F.array(*[F.col(c).cast("string") for c in columns]), lambda v: v.contains(text)))


def filter_time_range(rows: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows in [start, end]; a bare end date means its end of day, and none is later than now. An end before the start is an error."""
    if end < start[: len(end)]:
        raise ValueError("the end is before the start")
    last = f"{end} 23:59:59.999999" if len(end) == 10 else end
    return rows.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.least(F.lit(last).cast("timestamp"), F.current_timestamp())))


def annual_chunks(spark, start: str, end: str) -> DataFrame:
    """(chunk_start, chunk_end) of a range of days cut at the ends of years."""
    days = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b"))
    years = days.select("a", "b", F.explode(F.sequence(F.year("a"), F.year("b"))).alias("y"))
    return years.select(
        F.greatest("a", F.make_date("y", F.lit(1), F.lit(1))).alias("chunk_start"), F.least("b", F.make_date("y", F.lit(12), F.lit(31))).alias("chunk_end")
    )


def looks_geographic(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row: whether all coordinates could be degrees."""
    inside = (F.min(x) >= -180) & (F.max(x) <= 180) & (F.min(y) >= -90) & (F.max(y) <= 90)
    return points.agg(inside.alias("geographic"))


def sample_at_points(points: DataFrame, cells: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Points with the bands of the cell that they fall in; points outside, or on a cell with a null band, are left out."""
    return points.join(cells.select("r", "c", *bands), ["r", "c"]).dropna(subset=list(bands))


def valid_samples(rows: DataFrame, features: Sequence[str], nodata: float = -9999.0) -> DataFrame:
    """Rows whose features are all finite and not the no-data value."""
    ok = F.lit(True)
    for f in features:
        x = F.col(f).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x != nodata)
    return rows.filter(ok)


def masked_prediction(rows: DataFrame, features: Sequence[str], prediction: Column) -> DataFrame:
    """``rows`` with ``prediction``, NULL where a feature is."""
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull()
    return rows.withColumn("prediction", F.when(known, prediction))


def collision_reduce(points: DataFrame, mode: int, value: str = "depth", weight: str = "weight", key: str = "point_id", half: float = 0.5) -> DataFrame:
    """One row per cell (r, c, value, weight) of points with offsets dx, dy from the cell's centre in cells.

    mode 0 keeps all; 1 the largest weight; 2 the nearest to the centre; 3 the weighted mean within ``half``, else of
    all; 4 the same but cells without such points are dropped. Ties go to the smallest key; the weight is the mean.
    """
    if mode == 0:
        return points.select("r", "c", F.col(value).alias("value"), F.col(weight).alias("weight"))
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    cells = points.groupBy("r", "c")
    if mode in (1, 2):
        best = F.max_by(value, F.struct(F.col(weight), -F.col(key))) if mode == 1 else F.min_by(value, F.struct(d2, F.col(key)))
        own = F.max(weight) if mode == 1 else F.min_by(weight, F.struct(d2, F.col(key)))
        return cells.agg(best.alias("value"), own.alias("weight"))
    near = d2 <= half * half

    def mean(where: Column) -> Column:
        w, v = F.when(where, F.col(weight)), F.when(where, F.col(value))
        return F.when(F.sum(w) > 0, F.sum(v * w) / F.sum(w)).otherwise(F.avg(v))

    some = F.count_if(near) > 0
    out = cells.agg(
        F.when(some, mean(near)).otherwise(mean(F.lit(True))).alias("value"),
        F.when(some, F.avg(F.when(near, F.col(weight)))).otherwise(F.avg(weight)).alias("weight"),
        some.alias("_some"),
    )
    return (out.filter("_some") if mode == 4 else out).drop("_some")


def training_summary(points: DataFrame, used: Column) -> DataFrame:
    """Count, range of depth and weight, and how many points are used."""
    return points.agg(
        F.count("*").alias("n"), F.min("depth").alias("depth_min"), F.max("depth").alias("depth_max"),
        F.min("weight").alias("weight_min"), F.max("weight").alias("weight_max"), F.count_if(used).alias("n_used"),
    )


def overlaps(a: DataFrame, b: DataFrame, x: str = "c", y: str = "r") -> DataFrame:
    """One row: whether the extents of two tables intersect."""
    box = lambda d, p: d.agg(F.min(x).alias(f"{p}x0"), F.max(x).alias(f"{p}x1"), F.min(y).alias(f"{p}y0"), F.max(y).alias(f"{p}y1"))
    both = box(a, "a").crossJoin(F.broadcast(box(b, "b")))
    return both.select(((F.col("ax0") <= F.col("bx1")) & (F.col("bx0") <= F.col("ax1")) & (F.col("ay0") <= F.col("by1")) & (F.col("by0") <= F.col("ay1"))).alias("overlap"))
