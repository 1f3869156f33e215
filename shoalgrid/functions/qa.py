"""Quality bit masks and class codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the pixel quality band.
FLAGS = {"fill": 0, "dilated": 1, "cirrus": 2, "cloud": 3, "shadow": 4, "snow": 5, "clear": 6, "water": 7}
#: Lower bit of each two-bit confidence.
CONFIDENCES = {"cloud_conf": 8, "shadow_conf": 10, "snow_conf": 12, "cirrus_conf": 14}
SCL_INVALID = (0, 1, 3, 8, 9, 10, 11)
SCL_WATER = 6


def bits(x: Column, at: int, n: int = 1) -> Column:
    return F.shiftright(x, at).bitwiseAND(F.lit((1 << n) - 1))


def qa_pixel(x: Column) -> dict[str, Column]:
    """Eight flags, four confidences (0 to 3) and ``invalid``."""
    out = {k: bits(x, b) == 1 for k, b in FLAGS.items()} | {k: bits(x, b, 2) for k, b in CONFIDENCES.items()}
    bad = out["fill"] | out["dilated"] | out["cirrus"] | out["cloud"] | out["shadow"] | out["snow"]
    for k in CONFIDENCES:
        bad = bad | (out[k] >= 2)
    return out | {"invalid": bad}


def radsat_saturated(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0x7F)) > 0


def aerosol(x: Column) -> dict[str, Column]:
    """fill, valid, level (0 to 3) and high (level 3) of the aerosol band."""
    level = bits(x, 6, 2)
    return {"fill": bits(x, 0) == 1, "valid": bits(x, 1) == 1, "level": level, "high": level == 3}


def scl_invalid(x: Column) -> Column:
    return x.isin(*SCL_INVALID)


def scl_water(x: Column) -> Column:
    return x == SCL_WATER
