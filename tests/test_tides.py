"""Places on real axes against numpy's search, and how a tide grid is read."""

import numpy as np
import pytest

from shoalgrid.operators import tides

AXES = {
    "regular": np.linspace(-90, 90, 37), "falling": np.linspace(90, -90, 37), "uneven": np.cumsum([0.0, 0.1, 5, 0.01, 30, 0.5, 80]), "one": np.array([5.0]), "two": np.array([170.0, -3.0]),
}


@pytest.mark.parametrize("name", AXES)
def test_search(spark, name):
    axis = AXES[name]
    r = np.random.default_rng(3)
    xs = [*axis.tolist(), *r.uniform(axis.min() - 20, axis.max() + 20, 300).tolist(), float("nan")]
    grid = spark.createDataFrame([(k, float(v)) for k, v in enumerate(axis)], "lat_i int, lat double")
    points = spark.createDataFrame([(k, x) for k, x in enumerate([*xs, None])], "k int, x double").repartition(3)
    got = dict(tides.on_axis(points, tides.axis(grid, "lat_i", "lat"), points.x, "lat_i", "lat").select("k", "lat_i").collect())
    falls = axis[-1] < axis[0]
    want = np.clip(np.searchsorted(-axis if falls else axis, -np.array(xs) if falls else xs), 0, len(axis) - 1)
    assert [got[k] for k in range(len(xs))] == want.tolist() and got[len(xs)] == len(axis) - 1 and len(got) == len(xs) + 1


def test_turned_longitudes_and_units(spark):
    rows = [("M2.nc", i, j, 10.0 * i, 90.0 * j, a, u) for i in range(3) for j, (a, u) in enumerate([(0.5, "m"), (None, "m"), (float("nan"), None), (0.25, "")])]
    table = spark.createDataFrame(rows, "con string, lat_i int, lon_i int, latitude double, lon double, h double, units string")
    grid = tides.read_tide_grid(table)
    assert {(r.con, r.amp) for r in grid.collect()} == {("m2", 0.5), ("m2", 0.0), ("m2", 0.25)}
    places = spark.createDataFrame([(1, 0.0, -95.0), (2, 11.0, 269.0), (3, 99.0, 400.0), (4, -5.0, 0.0)], "k int, lat double, lon double")
    assert {tuple(r) for r in tides.tide_cells(places, grid).select("k", "lat_i", "lon_i").collect()} == {(1, 0, 3), (2, 2, 3), (3, 2, 3), (4, 0, 0)}
    assert tides.tide_at(places, grid).count() == 4
    for wide in (rows[:1] + [("k1", 0, 1, 0.0, 90.0, 15.5, "m")], rows[:1] + [("k1", 0, 1, 0.0, 90.0, 0.5, "CM")]):
        amps = [r.amp for r in tides.read_tide_grid(spark.createDataFrame(wide, table.schema)).collect()]
        assert sorted(amps)[0] == 0.005
    with pytest.raises(ValueError):
        tides.read_tide_grid(table.drop("lon"))
