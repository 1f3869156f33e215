"""Options of masks, formulas and names of files and bands."""

import math

import pytest
from pyspark.sql import functions as F

from shoalgrid.functions import indices
from shoalgrid.operators import masks, scenes


def test_water_masks(spark):
    rows = [(1, 6, 0.3, 0.1, 0.1), (1, 4, 0.3, 0.1, 0.1), (1, 4, 0.1, 0.3, 0.3), (1, 6, 0.1, 0.3, 0.3), (1, 9, 0.3, 0.1, 0.1), (1, None, 0.3, 0.1, 0.1), (1, 4, 0.001, 0.0001, 0.0), (1, 4, None, 0.1, 0.1)]
    cells = spark.createDataFrame(rows, "scene_id int, scl int, green double, nir double, swir double").coalesce(1)
    flags = lambda *a, df=cells, **k: [r.flag for r in masks.water_mask(df, *a, **k).collect()]
    assert flags("qa") == [1, 0, 0, 1, 255, 255, 0, 0]
    assert flags("ndwi", threshold=0.0) == flags("mndwi", threshold=0.0) == [1, 1, 0, 0, 255, 255, 1, 0]
    assert flags("hybrid", "strict", threshold=0.0) == [1, 0, 0, 0, 255, 255, 0, 0]
    assert flags("hybrid", "permissive", threshold=0.0) == [1, 1, 0, 1, 255, 255, 0, 0]
    assert flags("hybrid", df=cells.drop("green")) == flags("qa") and flags("hybrid", quality=None, threshold=0.0) == [1, 1, 0, 0, 1, 1, 1, 0]
    assert sorted(flags("ndwi")) == sorted(flags("ndwi", threshold=0.0)), "the scene's own threshold lies between its two kinds"
    for bad in (("qa", "strict", None), ("other", "strict", "scl"), ("hybrid", "loose", "scl")):
        with pytest.raises(ValueError):
            masks.water_mask(cells, *bad)
    assert masks.water_mask(cells.limit(0)).count() == 0


def test_constants_in_formulas(spark):
    one = spark.createDataFrame([(2.0,)], "b double")
    assert one.select(indices.band_math("b * pi + log(e)", {"b": "b"})).first()[0] == pytest.approx(2 * math.pi + 1)
    assert one.select(indices.band_math("e", {"e": "b"})).first()[0] == 2.0, "a band of that name comes first"


def test_band_that_an_asset_describes(spark):
    made = "map('x', 'a/1.jp2', 'y', 'a/2_B4.TIF') AS assets, map('x', array(named_struct('name', {}, 'common_name', {}))) AS bands"
    row = lambda name, common: spark.sql("SELECT " + made.format(name, common))
    find = lambda df, band: df.select(scenes.resolve_band_asset(F.col("assets"), band, bands=F.col("bands"))).first()[0]
    for name in ("'SR_B2'", "'b2'", "'OLI_B2'", "'OLI_SR_B2'"):
        assert find(row(name, "NULL"), "SR_B2") == "a/1.jp2", name
    assert find(row("NULL", "'Green'"), "green") == "a/1.jp2" and find(row("'B9'", "'red'"), "SR_B4") == "a/2_B4.TIF" and find(row("'B9'", "'red'"), "SR_B7") is None


def test_roles_of_files(spark):
    names = ["2001/ctrl_a.csv", "2001/icesat.shp", "2001/sonar.csv", "2001/x.tif", "2002/datum.tif", "2002/valid_points.csv"]
    got = {(r.year, r.role): r.path for r in scenes.discover(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert got == {(2001, "control"): names[0], (2001, "train"): names[1], (2001, "validation"): names[2], (2001, "image"): names[3], (2002, "control"): names[4], (2002, "validation"): names[5]}
