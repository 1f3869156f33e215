"""Edge rules on small grids made by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shoalgrid.functions import indices
from shoalgrid.operators import components, focal, models, points, ranks, selection, spatial, temporal, thresholds


def cells(spark, rows):
    """Rows of text: a digit is a value, a dot no cell."""
    data = [(r, c, float(x)) for r, row in enumerate(rows) for c, x in enumerate(row) if x != "."]
    return spark.createDataFrame(data, "r int, c int, z double")


def places(df):
    return {(x.r, x.c) for x in df.select("r", "c").collect()}


def test_slope_of_a_plane(spark):
    plane = spark.createDataFrame([(r, c, float(r + 2 * c)) for r in range(5) for c in range(5)], "r int, c int, z double")
    slopes = {(x.r, x.c): x.slope for x in focal.horn_slope(plane, "z", dx=1, dy=1).collect()}
    import math

    assert slopes[2, 2] == pytest.approx(math.degrees(math.atan(math.hypot(2, 1))))


def test_median_opening_closing(spark):
    spike = cells(spark, ["11111", "11111", "11911", "11111", "11111"])
    assert {x.median for x in focal.focal_median(spike, "z").collect()} == {1.0}
    full = cells(spark, ["111..", "111..", "111..", ".....", "....1"])
    assert places(focal.binary_opening(full)) == {(r, c) for r in range(3) for c in range(3)}
    ring = cells(spark, ["111", "1.1", "111"])
    assert (1, 1) in places(focal.binary_closing(ring))


def test_diagonal_cells(spark):
    two = cells(spark, ["1..", ".1.", "..."])
    assert components.label(two, connectivity=8).select("label").distinct().count() == 1
    assert components.label(two, connectivity=4).select("label").distinct().count() == 2


def test_serpentine_is_one_component(spark):
    n = 16
    path = [(r, c) for r in range(0, n, 2) for c in range(n)] + [(r, n - 1 if r % 4 == 1 else 0) for r in range(1, n - 1, 2)]
    one = spark.createDataFrame(path, "r int, c int")
    assert components.label(one, connectivity=4).select("label").distinct().count() == 1


def test_holes_and_sizes(spark):
    ring = cells(spark, [".....", ".111.", ".1.1.", ".111.", "....."])
    grid = spatial.grid_of(spark, 5)
    assert (2, 2) in places(components.fill_holes(ring, grid, (0, 0, 4, 4)))
    parts = components.label(cells(spark, ["11..1", "11...", "....."]))
    assert components.drop_small(parts, 4).count() == 4
    assert components.drop_small(parts, 9).count() == 4, "the largest stays where none is large enough"
    assert components.largest(parts).count() == 4


def test_last_bin_is_closed(spark):
    x = spark.createDataFrame([(-0.5,)] * 100 + [(1.0,)] * 100, "x double")
    assert thresholds.histogram(x, "x", [], -1.0, 1.0).agg(F.max("bin")).first()[0] == 255
    assert -0.51 < thresholds.otsu(x, "x").first().threshold < 1.0


def test_no_cells(spark):
    none = cells(spark, ["..."])
    assert focal.horn_slope(none, "z").count() == 0
    assert focal.focal_median(none, "z").count() == 0
    assert components.label(none).count() == 0
    assert thresholds.otsu(none, "z").count() <= 1
    assert spatial.dominant_range(none, "z").first() == (-30.0, 0.0)


def test_constant_and_single(spark):
    flat = cells(spark, ["5"])
    assert spatial.dominant_range(flat, "z").first() == (4.0, 6.0)
    assert focal.horn_slope(flat, "z").first().slope == 0.0


def test_depth_sign(spark):
    maps = spark.createDataFrame([(1, 0, c, 10.0, 0.1) for c in range(4)] + [(2, 0, c, 8.0, 0.1) for c in range(4)], "year int, r int, c int, z double, u double")
    periods = temporal.change_periods(maps.select("year").distinct())
    up = temporal.significant_change(temporal.aligned_pairs(maps, periods), 0.1)
    assert {x.change for x in up.collect()} == {1}, "positive depths that shrink are accretion"
    down = temporal.significant_change(temporal.aligned_pairs(maps.withColumn("z", -F.col("z")), periods), 0.1)
    assert {x.change for x in down.collect()} == {1}


def test_neighbours_far_away(spark):
    q = spark.createDataFrame([(0, 0), (5000, 5000)], "qr int, qc int")
    p = spark.createDataFrame([(r, 1, r, 1.0) for r in range(3)], "r int, c int, k int, v double")
    found = spatial.knn(q, p, 2).collect()
    assert {(x.qr, x.k) for x in found} == {(0, 0), (0, 1), (5000, 2), (5000, 1)}


def test_running_total(spark):
    x = spark.range(1000).select((F.col("id") * 37 % 1009).cast("double").alias("v"), F.lit(2).alias("n"))
    got = [r.t for r in ranks.running_total(x, "v", "n", "t").orderBy("v").collect()]
    assert got == [2 * (i + 1) for i in range(1000)]


def test_depth_fields(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, Ortho_H double")
    assert points.resolve_depth_field(df, "depth") == "Ortho_H"
    with pytest.raises(ValueError):
        points.check_depth_field(df, "missing")
    with pytest.raises(ValueError):
        points.filter_time_range(df, "id", "2020-02-01", "2020-01-01")


def test_band_formula_is_checked(spark):
    with pytest.raises(ValueError):
        indices.band_math("B1 + reflect('x')", {"B1": "z"})
    df = cells(spark, ["24"]).select(indices.band_math("B1**2 / (B1 - 2)", {"B1": "z"}).alias("x"))
    assert [r.x for r in df.collect()] == [0.0, 8.0]


def test_same_with_other_partitions(spark):
    maps = spark.createDataFrame([(y, r, c, -float((y * 7 + r * 3 + c) % 11 + 1), 0.1) for y in range(3) for r in range(6) for c in range(6)], "year int, r int, c int, z double, u double")
    periods = temporal.change_periods(maps.select("year").distinct())
    run = lambda m: sorted(temporal.sediment_volumes(temporal.significant_change(temporal.aligned_pairs(m, periods), 0.16), 100.0).collect())
    assert run(maps.repartition(1)) == run(maps.repartition(7))


@pytest.mark.parametrize(
    "formula, want",
    [
        ("log(2 + B1)**2", [math.log(4) ** 2, math.log(6) ** 2, math.log(2) ** 2]), ("B1**-2", [0.25, 1 / 16, 0.0]), ("(B1 + (B2))**2", [16.0, 64.0, 0.0]), ("B1 / sqrt(B2)", [2 / math.sqrt(2), 2.0, 0.0]),
        ("where(B1 > 2, clip(B1, 0, 3), -1)", [-1.0, 3.0, -1.0]), ("-B1**2 + arctan(B2) * 0", [-4.0, -16.0, 0.0]), ("log(B1 - 4)", [0.0, 0.0, 0.0]), ("sqrt(-B1)", [0.0, 0.0, 0.0]),
    ],
)
def test_band_formulas(spark, formula, want):
    df = spark.createDataFrame([(2.0,), (4.0,), (0.0,)], "b double")
    got = [r.x for r in df.select("b", indices.band_math(formula, {"B1": "b", "B2": "b"}).alias("x")).collect()]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("formula", ["__import__('os')", "B1.x", "lambda: 1", "exp(B1, 2)", "B3", "B1 +", "'a'", "B1 if B1 else B2"])
def test_formulas_that_are_refused(formula):
    with pytest.raises(ValueError):
        indices.band_math(formula, {"B1": "b", "B2": "b"})


def test_neighbours_of_repeated_places(spark):
    """Every query has its k neighbours, however many are at its place; a point leaves out itself alone; far points are found."""
    r = random.Random(3)
    pts = [(r.randrange(40), r.randrange(40), k) for k in range(60)] + [(5, 5, 100), (5, 5, 101), (8_000_000, -3_000_000, 102)]
    qs = [(i, r.randrange(-50, 90), r.randrange(40)) for i in range(40)] + [(90, 5, 5), (91, 5, 5), (92, 7_999_999, 0), (93, -2_000_000_000, 1)]
    points, queries = spark.createDataFrame(pts, "r int, c int, k int"), spark.createDataFrame(qs, "id int, qr int, qc int")
    got = {}
    for x in spatial.knn(queries, points, 4).collect():
        got.setdefault(x.id, []).append((x.d2, x.k))
    near = lambda a, b, without=None: sorted(((a - y) ** 2 + (b - z) ** 2, k) for y, z, k in pts if k != without)[:4]
    assert {i: sorted(v) for i, v in got.items()} == {i: near(a, b) for i, a, b in qs}
    own = points.select(F.col("r").alias("qr"), F.col("c").alias("qc"), F.col("k").alias("own"))
    got = {}
    for x in spatial.knn(own, points, 4, own="own").collect():
        got.setdefault(x.own, []).append((x.d2, x.k))
    assert {k: sorted(v) for k, v in got.items()} == {k: near(a, b, k) for a, b, k in pts}


def test_models_are_compared_on_held_out_blocks(spark):
    """A forest that learns noise by heart doesn't win over a line."""
    r = random.Random(4)
    rows = [(i % 40, i // 40, float(i % 97), 0.3 * (i % 97) + r.gauss(0, 6.0)) for i in range(1600)]
    x = spark.createDataFrame(rows, "r int, c int, x double, depth double")
    learn, score = models.held_out(x)
    assert learn.count() + score.count() == 1600 and not learn.select(F.floor(F.col("r") / 8), F.floor(F.col("c") / 8)).intersect(score.select(F.floor(F.col("r") / 8), F.floor(F.col("c") / 8))).count()
    board = {m.model: m.rmse for m in models.compare(x, ["x"], ["linear", "forest"]).collect()}
    assert board["linear"] <= board["forest"]


def test_score_configuration():
    c = selection.score_config(metrics=["r2", "mae"])
    assert dict(c.weights) == pytest.approx({"r2": 0.7, "mae": 0.3}) and c.rounds == 20 and c.ranges["mae"] == pytest.approx((0.195, 0.405))
    c = selection.score_config(weights={"r2": 70, "rmse": -5, "bias": 30}, variation=200, rounds=0, ranges={"r2": (0.9, 0.5)})
    assert dict(c.weights) == pytest.approx({"r2": 0.7, "bias": 0.3}) and c.variation == 0.95 and c.rounds == 1 and c.ranges["r2"] == (0.5, 0.9)
    assert c.ranges["bias"] == pytest.approx((0.015, 0.585))
    for bad in ({"metrics": ["speed"]}, {"weights": {"r2": 0}}):
        with pytest.raises(ValueError):
            selection.score_config(**bad)


def test_times_up_to_now(spark):
    df = spark.sql("SELECT CAST(x AS TIMESTAMP) AS t FROM VALUES ('2001-01-01'), ('2001-01-02 23:59:59'), ('9000-01-01') v(x)")
    assert points.filter_time_range(df, "t", "2001-01-01", "2001-01-02").count() == 2
    assert points.filter_time_range(df, "t", "2001-01-01", "9999-01-01").count() == 2
    with pytest.raises(ValueError):
        points.filter_time_range(df, "t", "2001-01-02", "2001-01-01")
