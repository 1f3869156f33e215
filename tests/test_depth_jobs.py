"""The jobs on a made-up coast: depth is found over water, land and too few soundings give none."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shoalgrid.operators import metrics
from shoalgrid.plans import depth_jobs

BOX = (0, 0, 23, 23)
CELLS = "scene_id int, r int, c int, blue double, green double, red double, nir double, swir double, scl int"


def depth(r, c):
    return -(1.0 + 0.4 * c + 1.5 * math.sin(r / 6))


@pytest.fixture(scope="module")
def coast(spark):
    """Land in the first four columns; bands fall with depth, each at its own rate, in two scenes of different noise."""
    g, cells = random.Random(4), []
    for s in (1, 2):
        for r in range(24):
            for c in range(24):
                z = depth(r, c)
                if c < 4:
                    cells.append((s, r, c, 0.1, 0.12, 0.15, 0.35, 0.3, 4))
                else:
                    e = lambda: 1 + g.gauss(0, 0.003 * s)
                    cells.append((s, r, c, (0.02 + 0.10 * math.exp(0.06 * z)) * e(), (0.02 + 0.12 * math.exp(0.14 * z)) * e(), (0.01 + 0.1 * math.exp(0.35 * z)) * e(), 0.004 * e(), 0.002 * e(), 6))
    points = []
    for k in range(900):
        r, c = g.randrange(24), g.randrange(24)
        z = depth(r, c) + g.gauss(0, 0.1) + (8.0 if k % 40 == 0 else 0.0)
        points.append((k, r, c, 2000 + k % 3, z + (k % 3) * 0.5, 1.0 + k % 4, 0.1, -0.1))
    return spark.createDataFrame(cells, CELLS).repartition(3), spark.createDataFrame(points, "point_id long, r int, c int, year int, depth double, weight double, dx double, dy double")


def test_scenes_and_their_merge(spark, coast):
    cells, points = coast
    flat = points.withColumn("depth", F.col("depth") - (F.col("year") - 2000) * 0.5)
    found = depth_jobs.written(depth_jobs.scene_depths(cells, flat, BOX), "scenes")
    rows = found.collect()
    assert {r.scene_id for r in rows} == {1, 2} and all(r.c >= 4 for r in rows)
    for s in (1, 2):
        errors = [r.z - depth(r.r, r.c) for r in rows if r.scene_id == s]
        assert len(errors) > 300 and math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.6, s
    assert all(r.u >= 0 for r in rows)
    merged, report = depth_jobs.multi_scene_depth(found, flat)
    errors = [r.z - depth(r.r, r.c) for r in merged.collect()]
    assert math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.6
    board = {(r.model, r.stratum): r for r in report.collect()}
    assert abs(board["shifted", "GLOBAL"].bias) < 1e-6 and "iho_order" in report.columns
    few = depth_jobs.scene_depths(cells, flat.limit(5), BOX)
    assert few.count() == 0 and few.columns == ["scene_id", "r", "c", "z", "u"]


def test_years(spark, coast):
    cells, points = coast
    rows = depth_jobs.multi_year_depth(cells, points, BOX).collect()
    assert {r.year for r in rows} == {2000, 2001, 2002}
    for y in (2000, 2001, 2002):
        errors = [r.z - depth(r.r, r.c) - (y - 2000) * 0.5 for r in rows if r.year == y]
        assert len(errors) > 300 and abs(sum(errors) / len(errors)) < 0.4 and sorted(map(abs, errors))[len(errors) // 2] < 0.5, y


def test_selection(spark):
    g = random.Random(1)
    rows = spark.createDataFrame([(x, g.random(), -3 * x) for x in (g.random() for _ in range(300))], "good double, noise double, depth double")
    assert depth_jobs.selected(rows, ["good", "noise"]) == ["good"]
    assert metrics.feature_correlations(rows, ["good"], "depth").first().pearson == pytest.approx(-1.0)
