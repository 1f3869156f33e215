"""Grouped robust fits by their conditions of optimality, and filters and corrections against numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalgrid.operators import fits


def objective(b, s, x, y, eps=fits.EPSILON, alpha=fits.ALPHA):
    r = np.abs(y - x @ b) / s
    return (s + np.where(r <= eps, r * r, 2 * eps * r - eps * eps) * s).sum() + alpha * (b[1:] ** 2).sum()


def test_huber_is_the_minimum(spark):
    g = np.random.default_rng(1)
    data = {}
    for k, n in ((1, 300), (2, 60), (3, 500), (4, 5)):
        x = g.uniform(-20, 0, n)
        y = 2 - 0.3 * x + g.normal(size=n) * (0.2 if k == 1 else 1.0)
        out = g.random(n) < (0.3 if k == 3 else 0.1)
        y[out] += g.normal(size=out.sum()) * 30
        data[k] = (x, y)
    rows = [(k, float(a), float(b)) for k, (x, y) in data.items() for a, b in zip(x, y)]
    df = spark.createDataFrame([*rows, (1, None, 1.0), (2, float("nan"), 1.0)], "g int, x double, y double").repartition(4)
    for features in ([F.col("x")], [F.col("x"), F.col("x") * F.col("x")]):
        got = fits.huber_fits(df, features, F.col("y"), ["g"])
        assert set(got) == {(1,), (2,), (3,)}
        for (k,), v in got.items():
            x, y = data[k]
            m = np.stack([np.ones_like(x), x, x * x][: len(features) + 1], 1)
            b, s = np.array(v[:-1]), v[-1]
            value = objective(b, s, m, y)
            scale = np.array([1.0, 0.1, 0.01][: len(b)])
            for step in (1e-3, 1e-5):
                for d in np.eye(len(b) + 1):
                    for sign in (1, -1):
                        assert objective(b + sign * step * d[:-1] * scale, s + sign * step * d[-1], m, y) >= value - 1e-9
    assert abs(fits.huber_fits(df.filter("g = 1"), [F.col("x")], F.col("y"))[()][1] + 0.3) < 0.02


def test_exact_and_empty(spark):
    line = spark.createDataFrame([(float(k), 3.0 + 2.0 * k) for k in range(20)], "x double, y double")
    assert fits.huber_fits(line, [F.col("x")], F.col("y"))[()][:2] == pytest.approx((3.0, 2.0), abs=1e-5)
    assert fits.huber_fits(line.filter("x < 0"), [F.col("x")], F.col("y"), ["x"]) == {}


def test_correction_by_year(spark):
    g = np.random.default_rng(2)
    rows = []
    for year, n, bias, slope in ((2001, 400, 1.5, 0.2), (2002, 400, -1.0, -0.1), (2003, 6, 9.0, 0.0)):
        p = g.uniform(-15, -1, n)
        rows += [(year, float(v), float(v + bias + slope * v + e)) for v, e in zip(p, g.normal(size=n) * 0.01 + (g.random(n) < 0.05) * 20)]
    points = spark.createDataFrame([*rows, (2001, None, 1.0)], "year int, y_pred double, y_true double")
    cells = spark.createDataFrame([(y, float(z)) for y in (2001, 2002, 2003, 2004) for z in (-2, -10)], "year int, z0 double").withColumn("z", F.col("z0"))
    got = {(r.year, r.z0): r.z for r in fits.huber_by_group(points, cells, ["year"]).collect()}
    for year, z in got:
        own = np.array([(a, b) for y, a, b in rows if y == year])
        want = z + 1.5 + 0.2 * z if year == 2001 else z - 1 - 0.1 * z if year == 2002 else z
        assert got[year, z] == pytest.approx(want, abs=0.15), (year, len(own))
    assert got[2003, -2.0] == -2.0 and got[2004, -10.0] == -10.0


def test_quadratic_ransac(spark):
    g = np.random.default_rng(3)
    x = g.uniform(1, 3, 600)
    y = 1 + 2 * x - 3 * x * x + g.normal(size=600) * 0.1
    bad = g.random(600) < 0.2
    y[bad] += g.uniform(8, 30, bad.sum())
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))] + [(999, None, 1.0)], "k long, x double, y double").repartition(3)
    limit = np.median(np.abs(y - np.median(y)))
    picked = [[k for k in range(600) if int(hashlib.md5(f"{k}:{t}".encode()).hexdigest()[:8], 16) % 10 == 0] for t in range(20)]
    polys = [np.polyfit(x[p], y[p], 2) for p in picked]
    inliers = [np.abs(y - np.polyval(c, x)) <= limit for c in polys]
    best = inliers[max(range(20), key=lambda t: (inliers[t].sum(), -t))]
    want = y - np.polyval(np.polyfit(x[best], y[best], 2), x)
    got = {r.k: r for r in fits.polynomial_ransac(points, "x", "y", "k").collect()}
    assert [got[k].residual for k in range(600)] == pytest.approx(want.tolist(), abs=1e-6)
    assert [got[k].inlier for k in range(600)] == (np.abs(want) <= limit).tolist() and not got[999].inlier
    kept = {r.k: r for r in fits.huber_variance(points, "x", "y", "k").collect()}
    assert all(r.sigma >= 0.05 for r in kept.values() if r.sigma is not None)
    assert [kept[k].accepted for k in range(600)] == [abs(kept[k].residual) <= 3 * kept[k].sigma for k in range(600)]
    assert np.mean([kept[k].accepted for k in np.flatnonzero(~bad)]) > 0.95
    assert fits.huber_variance(points.filter("k < 0"), "x", "y", "k").count() == 0
