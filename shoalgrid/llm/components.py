"""Connected components of a graph given as a table of edges, without a driver-side structure or an unbounded group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.llm.store import single_value, written


#: A node's links are dealt to up to this many tasks.
SALTS = 64


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v) rows to (u, v, m): m is the smallest of u and all v of that u.

    A hub's rows go by (u, salt of v): each salt's minimum is found first, then that of at most ``SALTS`` rows of a
    node, which goes back to the rows by the same two columns, so no task holds all links of a hub. The minima grow
    with the rows, so that join is by shuffle at every size.
    """
    pairs = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    least = pairs.groupBy("u", "s").agg(F.min("v").alias("m"))
    least = least.select("u", "s", F.least("u", F.min("m").over(Window.partitionBy("u"))).alias("m"))
    return pairs.join(least.hint("merge"), ["u", "s"]).drop("s")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _to_minimum(down)
    hooks = linked.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooks.union(linked.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (u, v) to rows (node, root), root the smallest node reachable; nodes that are their own root are left out.

    Alternates large-star and small-star steps, a logarithmic number of rounds, each a shuffle by node and
    salt with a pre-aggregated minimum; every round is a table in the shared folder. Loops (u = v) and nulls are ignored,
    repeated edges count once, no edges give no rows.
    """
    edges = written(edges.filter("u != v").select("u", "v").distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        edges = written(_small_star(_large_star(edges)), "edges")
        mark = single_value(edges, F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)))
        if mark == last or mark[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
