"""Square tiles of cells with a halo: a cell goes to its own tile and, near an edge, to the neighbours that need it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a tile; a halo of 2 copies one cell in eight.
TILE = 64

Bounds = tuple[int, int, int, int]


def by_tile(cells: DataFrame, value: str, by: Sequence[str], halo: int, work: Callable, name: str, bounds: Bounds | None = None) -> DataFrame:
    """(by..., r, c, name) of every cell with a value: ``work(window, edges)`` gives an array over the tile from one with ``halo`` more on each side.

    Missing values are NaN. ``edges``: rows and columns of the grid's border within the window (r0, c0, r1, c1), by
    ``bounds`` or else by the cells that each ``by`` has. A task holds one tile, and a shuffle moves each cell once and
    those near an edge again.
    """
    reach = lambda x: F.explode(F.sequence(F.floor((F.col(x) - halo) / TILE), F.floor((F.col(x) + halo) / TILE)))
    rows = cells.filter(F.col(value).isNotNull()).select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(value).cast("double").alias("_v"))
    if bounds is None:
        ends = rows.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(*[f(x).alias(n) for n, f, x in (("_r0", F.min, "r"), ("_c0", F.min, "c"), ("_r1", F.max, "r"), ("_c1", F.max, "c"))])
        same = F.lit(True)
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
        rows = rows.join(ends, same).drop(*[f"_{b}" for b in by]) if by else rows.crossJoin(F.broadcast(ends))
    else:
        rows = rows.select("*", *[F.lit(int(x)).cast("long").alias(n) for n, x in zip(("_r0", "_c0", "_r1", "_c1"), bounds)])
    sent = rows.withColumn("_tr", reach("r")).withColumn("_tc", reach("c"))

    def run(key, part):
        import numpy as np
        import pandas as pd

        *own, tr, tc = key
        top, left = tr * TILE - halo, tc * TILE - halo
        window = np.full((TILE + 2 * halo, TILE + 2 * halo), np.nan)
        r, c = part["r"].to_numpy() - top, part["c"].to_numpy() - left
        window[r, c] = part["_v"].to_numpy()
        edges = tuple(int(part[n].iat[0]) - x for n, x in (("_r0", top), ("_c0", left), ("_r1", top), ("_c1", left)))
        inner = (r >= halo) & (r < halo + TILE) & (c >= halo) & (c < halo + TILE)
        out = {b: [k] * int(inner.sum()) for b, k in zip(by, own)}
        if not inner.any():
            return pd.DataFrame({**out, "r": [], "c": [], name: []})
        found = work(window, edges)[r[inner] - halo, c[inner] - halo]
        return pd.DataFrame({**out, "r": part["r"].to_numpy()[inner], "c": part["c"].to_numpy()[inner], name: found})

    kinds = dict(cells.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), f"r {kinds['r']}", f"c {kinds['c']}", f"{name} double"])
    return sent.groupBy(*by, "_tr", "_tc").applyInPandas(run, schema)


def filled_from_nearest(window, radius: int):
    """``window`` with missing cells as the nearest valid one within ``radius`` rows and columns, of equally near ones the first by row and column."""
    import numpy as np

    size = np.arange(-radius, radius + 1)
    offsets = sorted(((i * i + j * j, i, j) for i in size for j in size if i or j))
    padded, out = np.pad(window, radius, constant_values=np.nan), window.copy()
    for _, i, j in offsets:
        if not np.isnan(out).any():
            break
        near = padded[radius + i : radius + i + window.shape[0], radius + j : radius + j + window.shape[1]]
        out = np.where(np.isnan(out), near, out)
    return out


def with_edges(window, edges: Bounds, mode: str):
    """``window`` with what lies outside the grid as the cell at its border (``nearest``) or its mirror image (``reflect``)."""
    import numpy as np

    rows, cols = (np.arange(n) for n in window.shape)

    def inside(x, low, high):
        if mode == "nearest":
            return np.clip(x, low, high)
        span = high - low + 1
        x = np.mod(x - low, 2 * span)
        return low + np.where(x < span, x, 2 * span - 1 - x)

    r, c = inside(rows, edges[0], edges[2]), inside(cols, edges[1], edges[3])
    held = ((r >= 0) & (r < len(rows)))[:, None] & ((c >= 0) & (c < len(cols)))[None]
    taken = window[np.clip(r, 0, len(rows) - 1)[:, None], np.clip(c, 0, len(cols) - 1)[None]]
    return np.where(held, taken, np.nan)
