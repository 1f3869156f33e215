"""Exact quantiles by selection against numpy, with so few values left that every pass is needed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalgrid.operators import quantiles
from shoalgrid.operators.quantiles import exact_median, exact_quantiles

SHARES = (0.0, 0.05, 0.25, 0.5, 0.84, 0.999, 1.0)


def groups():
    r = np.random.default_rng(4)
    return {
        "normal": r.normal(size=5000), "ties": r.integers(0, 4, size=3000).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "equal": np.full(4000, -2.5),
        "tails": np.concatenate([10.0 ** r.uniform(-300, 300, size=2000), -(10.0 ** r.uniform(-300, 300, size=2000))]), "hot": np.concatenate([np.full(3000, 0.0), r.normal(size=1500)]),
    }


@pytest.mark.parametrize("least", [1, 100_000])
def test_by_group(spark, least, monkeypatch):
    monkeypatch.setattr(quantiles, "RANGES", 16)
    values = groups()
    rows = [(g, float(v)) for g, x in values.items() for v in x] + [(None, 3.0), (None, 5.0), ("none", None), ("normal", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in exact_quantiles(df, {f"q{k}": (F.col("v"), p) for k, p in enumerate(SHARES)}, ["g"], least=least).collect()}
    assert set(got) == {*values, None, "none"}
    for g, x in [*values.items(), (None, np.array([3.0, 5.0]))]:
        for k, p in enumerate(SHARES):
            s, at = np.sort(x), p * (len(x) - 1)
            a, b = s[int(at)], s[min(int(at) + 1, len(x) - 1)]
            want = a + (b - a) * (at - int(at)) if at > int(at) else a
            assert got[g][f"q{k}"] == pytest.approx(want, rel=1e-12), (g, p)
    assert got["none"]["q0"] is None


def test_whole_table_and_empty(spark):
    df = spark.range(20001).select(F.pmod(F.col("id") * 7919, F.lit(20001)).cast("double").alias("v"))
    assert exact_quantiles(df, {"a": (F.col("v"), 0.5), "b": (-F.col("v"), 0.1)}, least=10).collect() == [(10000.0, -18000.0)]
    assert exact_median(df, "v", "m", scale=2.0).collect() == [(20000.0,)]
    assert exact_median(df.filter("v < 0"), "v", "m").collect() == [(None,)]
    assert exact_median(df.filter("v < 0"), "v", "m", ["v"]).collect() == []
