"""Connected cells: labels, sizes, sieves, holes and patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgrid.operators.tiles import TILE
from shoalgrid.sources.shared import written

SIDES = ((0, 1), (1, 0))
CORNERS = ((1, 1), (1, -1))
ROUNDS = 64


def label(cells: DataFrame, by: Sequence[str] = (), connectivity: int = 8) -> DataFrame:
    """(by..., r, c, label) of connected cells; the label is the smallest r * 2^31 + c of its component.

    Cells are labelled inside their tile first; of the tiles' labels only those that touch another tile's go on, as a
    graph with an edge for each pair that touches. So a body has a row for each of its tiles there, not one for each of
    its cells, and a cell's last join is by its tile's label, which a tile's cells alone have. ``by`` columns must not be null.
    """
    tile = lambda x: F.floor(F.col(x) / TILE)
    kinds = dict(cells.dtypes)

    def run(key, part):
        import numpy as np
        import pandas as pd

        r, c = part["r"].to_numpy(dtype=np.int64), part["c"].to_numpy(dtype=np.int64)
        top, left = key[-2] * TILE, key[-1] * TILE
        local = _labels_in_tile(r - top, c - left, connectivity, TILE)
        return pd.DataFrame({**{x: [k] * len(r) for x, k in zip(by, key)}, "r": r, "c": c, "own": (top + local // TILE) * (1 << 31) + left + local % TILE})

    schema = ", ".join([*(f"{x} {kinds[x]}" for x in by), "r int, c int, own long"])
    tiled = cells.select(*by, "r", "c").distinct().groupBy(*by, tile("r").alias("_tr"), tile("c").alias("_tc")).applyInPandas(run, schema)
    tiled = written(tiled, "tiled")
    steps = SIDES if connectivity == 4 else SIDES + CORNERS
    edge = lambda x: F.pmod(F.col(x), F.lit(TILE)).isin(0, TILE - 1)
    border = tiled.filter(edge("r") | edge("c")).select(*by, "own", "r", "c")
    near = F.explode(F.array(*[F.struct(F.lit(s * i).alias("i"), F.lit(s * j).alias("j")) for i, j in steps for s in (1, -1)])).alias("o")
    sent = border.select(*by, "own", "r", "c", near).select(*by, "own", tile("r").alias("_tr"), tile("c").alias("_tc"), (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"))
    sent = sent.filter((tile("r") != F.col("_tr")) | (tile("c") != F.col("_tc")))
    pairs = sent.join(border.withColumnRenamed("own", "other"), [*by, "r", "c"]).select(*by, F.col("own").alias("node"), "other").distinct()
    roots = _settled(written(pairs, "edges"), by).withColumnRenamed("node", "own")
    return tiled.join(roots, [*by, "own"], "left").select(*by, "r", "c", F.coalesce("label", "own").alias("label"))


def _labels_in_tile(r, c, connectivity: int, side: int):
    """For cells at places in a tile the smallest place (r * side + c) that they are connected to.

    Each round a cell takes the least label around it, and then the label of the cell that its label names.
    """
    import numpy as np

    far = side * side
    grid = np.full((side + 2, side + 2), far, dtype=np.int64)
    place = r * side + c
    grid[r + 1, c + 1] = place
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (connectivity == 8 or not (i and j))]
    labels = place.copy()
    while True:
        least = np.minimum.reduce([labels, *(grid[r + 1 + i, c + 1 + j] for i, j in steps)])
        grid[r + 1, c + 1] = least
        for _ in range(2):
            least = grid[least // side + 1, least % side + 1]
        grid[r + 1, c + 1] = least
        if np.array_equal(least, labels):
            return labels
        labels = least


def _settled(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., node, label): the smallest node that each node of ``edges`` (by..., node, other), both ways, is joined to.

    Each round a node takes the smallest label of itself and its neighbours, and then the label of the node that its
    label names, so labels travel in steps that double; every round is a table in the shared folder. It ends when a
    round changes nothing.
    """
    keys = [*by, "node"]
    labels = edges.select(*keys).distinct().withColumn("label", F.col("node"))
    for _ in range(ROUNDS):
        others = edges.join(labels.select(*by, F.col("node").alias("other"), F.col("label").alias("_l")), [*by, "other"])
        least = others.groupBy(*keys).agg(F.min("_l").alias("_n"))
        moved = labels.join(least, keys, "left").select(*by, "node", F.col("label").alias("_old"), F.least("label", F.coalesce("_n", "label")).alias("label"))
        # A label is a node too: take that node's own label, and once more.
        for _ in range(2):
            heads = moved.select(*by, F.col("node").alias("label"), F.col("label").alias("_h"))
            moved = moved.join(heads, [*by, "label"]).select(*by, "node", "_old", F.col("_h").alias("label"))
        moved = written(moved, "labels")
        changed = moved.filter("label <> _old").limit(1).count()
        labels = moved.drop("_old")
        if not changed:
            return labels
    raise RuntimeError(f"labels did not settle in {ROUNDS} rounds")


def sizes(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return labels.groupBy(*by, "label").agg(F.count("*").alias("n"))


def drop_small(labels: DataFrame, least: int, by: Sequence[str] = (), keep_one: bool = True) -> DataFrame:
    """Cells of components of ``least`` cells or more; where there is none the largest stays with ``keep_one``."""
    n = sizes(labels, by)
    best = n.groupBy(*by).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("_best"), F.max("n").alias("_most"))
    n = n.join(best, list(by)) if by else n.crossJoin(F.broadcast(best))
    good = (F.col("n") >= least) | (F.lit(keep_one) & (F.col("_most") < least) & (F.col("label") == F.col("_best")))
    return labels.join(n.filter(good).select(*by, "label"), [*by, "label"], "left_semi").select(*by, "r", "c", "label")


def largest(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells of the component with most cells, of the smallest label on ties."""
    best = sizes(labels, by).groupBy(*by).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    return labels.join(best, [*by, "label"], "left_semi").select(*by, "r", "c", "label")


def fill_holes(mask: DataFrame, grid: DataFrame, bounds: tuple[int, int, int, int], by: Sequence[str] = ()) -> DataFrame:
    """(by..., r, c): the set and the background that no path of side neighbours joins to the border of ``grid``."""
    ground = grid.select(*by, "r", "c").join(mask, [*by, "r", "c"], "left_anti")
    labels = label(ground, by, 4)
    r0, c0, r1, c1 = bounds
    edge = (F.col("r").isin(r0, r1)) | (F.col("c").isin(c0, c1))
    open_ = labels.filter(edge).select(*by, "label").distinct()
    holes = labels.join(open_, [*by, "label"], "left_anti").select(*by, "r", "c")
    return mask.select(*by, "r", "c").union(holes).distinct()


def sieve(cells: DataFrame, value: str, least: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., r, c, value): components of one value with fewer than ``least`` cells take the value of their largest neighbour."""
    labels = written(label(cells.withColumn(value, F.coalesce(value, F.lit(-1))), [*by, value], 8), "sieve")
    n = sizes(labels, [*by, value])
    full = labels.join(n, [*by, value, "label"])
    small = full.filter(F.col("n") < least)
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])).alias("o")
    sent = small.select(*by, value, "label", "r", "c", near)
    sent = sent.select(*by, value, "label", (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"))
    other = full.select(*by, "r", "c", F.col(value).alias("_v"), F.col("label").alias("_l"), F.col("n").alias("_n"))
    met = sent.join(other, [*by, "r", "c"]).filter(F.col("_v") != F.col(value))
    new = met.groupBy(*by, value, "label").agg(F.max_by("_v", F.struct("_n", -F.col("_l"))).alias("_new"))
    out = full.join(new, [*by, value, "label"], "left").select(*by, "r", "c", F.coalesce("_new", value).alias(value))
    return out


def patches(labels: DataFrame, area: float, by: Sequence[str] = ()) -> DataFrame:
    """A row per component: cells, area, box, and boundary edges (sides of cells whose neighbour is not of the component)."""
    side = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))])).alias("o")
    sent = labels.select(*by, "label", "r", "c", side).select(*by, "label", (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"))
    inner = sent.join(labels, [*by, "label", "r", "c"], "left_semi").groupBy(*by, "label").agg(F.count("*").alias("_in"))
    out = labels.groupBy(*by, "label").agg(
        F.count("*").alias("cells"), F.min("r").alias("r0"), F.min("c").alias("c0"), F.max("r").alias("r1"), F.max("c").alias("c1")
    )
    out = out.join(inner, [*by, "label"], "left")
    return out.select(*by, "label", "cells", (F.col("cells") * area).alias("area_m2"), "r0", "c0", "r1", "c1", (4 * F.col("cells") - F.coalesce("_in", F.lit(0))).alias("edges"))
