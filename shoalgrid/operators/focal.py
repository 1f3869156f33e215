"""Neighbourhoods of cells: each cell is sent to the windows it is in, then windows are grouped.

Sums and extremes over a square go along rows and then columns, so a window of k by k costs 2k rows a cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgrid.operators.tiles import Bounds, by_tile, filled_from_nearest, with_edges

HORN = {(-1, -1): (-1, 1), (-1, 0): (0, 2), (-1, 1): (1, 1), (0, -1): (-2, 0), (0, 1): (2, 0), (1, -1): (-1, -1), (1, 0): (0, -2), (1, 1): (1, -1)}


def shifted(cells: DataFrame, axis: str, radius: int = 1) -> DataFrame:
    """Each row once for every offset along ``axis``."""
    return cells.withColumn("_o", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn(axis, (F.col(axis) + F.col("_o")).cast("int")).drop("_o")


def dilate(mask: DataFrame, by: Sequence[str] = (), inside: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(by..., r, c) of a set of cells and their eight neighbours; ``inside`` (r0, c0, r1, c1) bounds the grid."""
    out = shifted(shifted(mask, "r").distinct(), "c").distinct()
    if inside:
        out = out.filter(F.col("r").between(inside[0], inside[2]) & F.col("c").between(inside[1], inside[3]))
    return out.select(*by, "r", "c")


def erode(mask: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., r, c) of cells whose whole 3 x 3 window is in the set; what is outside the grid is not."""
    for axis in ("r", "c"):
        mask = shifted(mask, axis).groupBy(*by, "r", "c").agg(F.count("*").alias("_n")).filter("_n = 3").drop("_n")
    return mask.select(*by, "r", "c")


def binary_opening(mask: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return dilate(erode(mask, by), by)


def binary_closing(mask: DataFrame, by: Sequence[str] = (), inside: tuple[int, int, int, int] | None = None) -> DataFrame:
    return erode(dilate(mask, by, inside), by)


def focal_median(cells: DataFrame, value: str, by: Sequence[str] = (), k: int = 3, fill: float | str | None = None, bounds: Bounds | None = None) -> DataFrame:
    """(by..., r, c, median) of the k x k window of each cell.

    Cells that lack are left out, or count as the number ``fill``, or with ``fill="nearest"`` as the nearest cell that is
    there; with a fill the grid goes on beyond its border (``bounds``, or the cells' own box) as its mirror image. A
    missing cell of a window has that window's middle within reach, so none looks further than k / 2 times the root of 2.
    """
    h = k // 2
    far = int(h * 1.4142136)

    def work(window, edges):
        import numpy as np

        x = window
        if fill == "nearest":
            x = with_edges(filled_from_nearest(window, far), edges, "reflect")
        elif fill is not None:
            x = with_edges(np.where(np.isnan(window), float(fill), window), edges, "reflect")
        views = np.lib.stride_tricks.sliding_window_view(x[far : len(x) - far, far : x.shape[1] - far], (k, k))
        views = np.sort(views.reshape(*views.shape[:2], k * k), axis=2)
        n = k * k - np.isnan(views).sum(axis=2, keepdims=True)
        low, high = (np.take_along_axis(views, np.maximum(m, 0), 2)[:, :, 0] for m in ((n - 1) // 2, n // 2))
        return np.where(n[:, :, 0] > 0, (low + high) / 2, np.nan)

    return by_tile(cells, value, by, h + far, work, "median", bounds)


def mask_majority(mask: DataFrame, by: Sequence[str] = (), k: int = 3) -> DataFrame:
    """(by..., r, c) where over half of the k x k window is in the set."""
    h = k // 2
    rows = shifted(mask, "r", h).groupBy(*by, "r", "c").agg(F.count("*").alias("_n"))
    out = shifted(rows, "c", h).groupBy(*by, "r", "c").agg(F.sum("_n").alias("_n"))
    return out.filter(F.col("_n") > k * k // 2).select(*by, "r", "c")


def horn_slope(cells: DataFrame, value: str, by: Sequence[str] = (), dx: float = 10.0, dy: float = 10.0, bounds: Bounds | None = None) -> DataFrame:
    """(by..., r, c, slope) in degrees by Horn's gradient.

    A missing neighbour is the valid cell nearest to it, which is among its own eight neighbours, as the cell asked for is
    one of them; beyond the grid's border (``bounds``, or the cells' own box) the border's cells go on.
    """
    dx, dy = (dx if dx > 0 else 10.0), (dy if dy > 0 else 10.0)

    def work(window, edges):
        import numpy as np

        x = with_edges(filled_from_nearest(window, 1), edges, "nearest")[1:-1, 1:-1]
        rows, cols = x.shape[0] - 2, x.shape[1] - 2
        gx, gy = np.zeros((rows, cols)), np.zeros((rows, cols))
        for (i, j), (a, b) in HORN.items():
            near = x[1 + i : 1 + i + rows, 1 + j : 1 + j + cols]
            gx += a * near if a else 0
            gy += b * near if b else 0
        return np.degrees(np.arctan(np.hypot(gx / (8 * dx), gy / (8 * dy))))

    return by_tile(cells, value, by, 2, work, "slope", bounds)


def shrink(mask: DataFrame, d: float, by: Sequence[str] = (), inside: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(by..., r, c) of cells of the set with no cell outside it within distance ``d``: those that all offsets within reach."""
    h = int(d)
    offsets = [(i, j) for i in range(-h, h + 1) for j in range(-h, h + 1) if i * i + j * j <= d * d]
    sent = mask.select(*by, "r", "c", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])).alias("o"))
    sent = sent.select(*by, (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"))
    need: int | Column = len(offsets)
    if inside:
        r0, c0, r1, c1 = inside
        need = sum((((F.col("r") + i).between(r0, r1)) & ((F.col("c") + j).between(c0, c1))).cast("int") for i, j in offsets)
    return sent.groupBy(*by, "r", "c").agg(F.count("*").alias("_n")).filter(F.col("_n") >= need).select(*by, "r", "c")
