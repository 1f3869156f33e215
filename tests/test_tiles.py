"""Tiles with a halo and labels in two levels against brute force, on tiles so small that most cells are at an edge."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalgrid.operators import components, focal, tiles


@pytest.fixture(params=[4, 64])
def side(request, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", request.param)
    monkeypatch.setattr(components, "TILE", request.param)
    return request.param


def grid(seed, rows=13, cols=11, part=0.6):
    r = random.Random(seed)
    return {(i - 3, j - 2): r.uniform(-20, 0) for i in range(rows) for j in range(cols) if r.random() < part}


def table(spark, cells, g=1):
    return spark.createDataFrame([(g, i, j, z) for (i, j), z in cells.items()], "g int, r int, c int, z double")


def value_at(cells, box, i, j, mode):
    """The value of the nearest cell to a place, which beyond the box is its border's or its mirror image."""
    r0, c0, r1, c1 = box

    def inside(x, low, high):
        while not low <= x <= high:
            x = (low if x < low else high) if mode == "nearest" else (2 * low - 1 - x if x < low else 2 * high + 1 - x)
        return x

    i, j = inside(i, r0, r1), inside(j, c0, c1)
    return cells[min(cells, key=lambda p: ((p[0] - i) ** 2 + (p[1] - j) ** 2, p))]


@pytest.mark.parametrize("k", [3, 5, 7])
def test_median_with_nearest_fill(spark, side, k):
    cells, box, h = grid(k), (-3, -2, 9, 8), k // 2
    got = {(x.r, x.c): x.median for x in focal.focal_median(table(spark, cells), "z", ["g"], k, "nearest", box).collect()}
    want = {(i, j): float(np.median([value_at(cells, box, i + a, j + b, "reflect") for a in range(-h, h + 1) for b in range(-h, h + 1)])) for i, j in cells}
    assert got == pytest.approx(want)


def test_slope_with_nearest_fill(spark, side):
    cells, box = grid(2), (-3, -2, 9, 8)
    got = {(x.r, x.c): x.slope for x in focal.horn_slope(table(spark, cells), "z", ["g"], 2.0, 0.0, box).collect()}
    for (i, j), s in got.items():
        v = {(a, b): value_at(cells, box, i + a, j + b, "nearest") for a in (-1, 0, 1) for b in (-1, 0, 1)}
        gx = sum(b * (2 if a == 0 else 1) * x for (a, b), x in v.items()) / 16
        gy = sum(-a * (2 if b == 0 else 1) * x for (a, b), x in v.items()) / 80
        assert s == pytest.approx(math.degrees(math.atan(math.hypot(gx, gy))))
    assert got.keys() == cells.keys()


def test_groups_and_bounds_of_their_own(spark, side):
    a, b = grid(5), {(i + 40, j): z for (i, j), z in grid(6).items()}
    both = table(spark, a, 1).union(table(spark, b, 2)).union(spark.createDataFrame([(None, 0, 0, 1.0), (3, 0, 0, None)], "g int, r int, c int, z double"))
    got = {(x.g, x.r, x.c): x.median for x in focal.focal_median(both, "z", ["g"], 3, "nearest").collect()}
    for g, cells in ((1, a), (2, b)):
        box = (min(i for i, _ in cells), min(j for _, j in cells), max(i for i, _ in cells), max(j for _, j in cells))
        for i, j in cells:
            assert got[g, i, j] == pytest.approx(float(np.median([value_at(cells, box, i + x, j + y, "reflect") for x in (-1, 0, 1) for y in (-1, 0, 1)])))
    assert got[None, 0, 0] == 1.0 and len(got) == len(a) + len(b) + 1


def flood(cells, eight):
    left, out = set(cells), {}
    while left:
        body, todo = set(), [min(left)]
        while todo:
            p = todo.pop()
            if p in left:
                left.discard(p)
                body.add(p)
                todo += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (eight or not (i and j))]
        out |= {p: min(body)[0] * (1 << 31) + min(body)[1] for p in body}
    return out


@pytest.mark.parametrize("eight", [True, False])
def test_labels(spark, side, eight):
    snake = {(i, j) for i in range(0, 17, 2) for j in range(9)} | {(i, 8 if i % 4 == 1 else 0) for i in range(1, 16, 2)}
    for cells in (set(grid(1, part=0.5)), set(grid(8, 25, 25, 0.42)), snake, {(0, 0)}):
        df = spark.createDataFrame([(7, i, j) for i, j in cells] * 2, "g int, r int, c int")
        got = {(x.r, x.c): x.label for x in components.label(df, ["g"], 8 if eight else 4).collect()}
        assert got == flood(cells, eight)


def test_shuffle_is_under_twice_the_cells(spark):
    """A halo of 2 in tiles of 64 sends about an eighth of the cells again."""
    cells = spark.range(256 * 256).select((F.col("id") / 256).cast("int").alias("r"), (F.col("id") % 256).cast("int").alias("c"), F.lit(1.0).alias("z"))
    reach = lambda x, halo=2: F.explode(F.sequence(F.floor((F.col(x) - halo) / tiles.TILE), F.floor((F.col(x) + halo) / tiles.TILE)))
    assert cells.withColumn("a", reach("r")).withColumn("b", reach("c")).count() < 1.2 * 256 * 256
    assert focal.horn_slope(cells, "z").filter("slope = 0").count() == 256 * 256


def test_folders_of_other_tiles_are_not_read(spark, tmp_path):
    from shoalgrid.sources import tables

    cells = spark.createDataFrame([(s, r, c, float(r * c)) for s in (1, 2, None) for r in range(-8, 24) for c in range(24)], "scene_id int, r int, c int, z double")
    tables.write_cells(cells, str(tmp_path / "cells"), tile=8)
    box = tables.read_cells(spark, str(tmp_path / "cells"), (-3, 8, 9, 15), [2], tile=8)
    plan = box._jdf.queryExecution().executedPlan().toString()
    held = plan[plan.index("PartitionFilters") :].split("PushedFilters")
    assert "scene_id" in held[0] and "tile_r" in held[0] and "tile_c" in held[0] and "GreaterThanOrEqual(r,-3)" in held[1]
    assert {(x.r, x.c, x.z) for x in box.collect()} == {(r, c, float(r * c)) for r in range(-3, 10) for c in range(8, 16)}
    assert tables.read_cells(spark, str(tmp_path / "cells")).count() == cells.count()
