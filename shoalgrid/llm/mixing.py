"""Mixing sources to target weights by hash-random keys, distributed prefix sums and an exact cut."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.llm.store import written

#: Documents of a range, about: a key's leading hexadecimal digits name its range, as many as give so many ranges.
RANGE_ROWS = 4096


def n_words(text: Column) -> Column:
    """Number of words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """One row per source of ``sizes`` (source, source_size) with its ``target``.

    Sources in code point order, null last, get ``weights`` in turn. Together they get ``share`` times all sizes,
    by weight, but no source more than ``max_epochs`` times its size; what is over goes to the others by weight.
    The level at which that settles: sources in order of cap per weight are full up to the first whose cap is
    above the level that the rest would share.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    n = len(weights)
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    caps = sizes.withColumn("weight", given).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    caps = (
        caps.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("rate", (F.col("budget") - F.col("spent")) / F.col("open"))
    )
    caps = caps.withColumn("open_rank", F.row_number().over(level))
    settled = F.min(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct("open_rank", "rate"))).over(everything)
    caps = caps.withColumn("settled", settled)
    target = F.when(F.col("settled").isNull() | (F.col("open_rank") < F.col("settled.open_rank")), F.col("cap")).otherwise(
        F.col("settled.rate") * F.col("weight")
    )
    return caps.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Words that a mix takes from each document: columns doc_id, source, size, source_size, target, taken, and those in ``keep``.

    A document's key is the MD5 of its id (of its text, if it has none) and ``seed``. Within a source documents stand in order of key (ties:
    id, size). A key's leading digits are its range: sums per range are pre-aggregated, their running sums are
    each range's start, and within a range a running sum gives each document's place, so no task holds a source,
    hot or not. The mix takes whole epochs of a source and then its documents in order up to the exact rest of
    the target (rounded down), the last of them in part.

    Null text counts 0 words and takes 0; null sources form one source; an empty table
    gives no rows; equal rows each have their own place; other columns are ignored. Reruns agree.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), name).cast("binary"))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"), *keep
    )
    sized = written(sized, "mix")
    digits = max(1, math.ceil(math.log(max(1, sized.count() / RANGE_ROWS), 16)))
    sized = sized.withColumn("range", F.substring("key", 1, digits))
    ranges = written(sized.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(upto), F.lit(0)))
    starts = starts.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "range_size")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
    placed = placed.join(
        starts.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.range") == F.col("r.range"))
    ).select("d.doc_id", "d.source", "d.size", "r.source_size", "r.target", (F.col("d.ahead") + F.col("r.start")).alias("ahead"), *[F.col(f"d.{c}") for c in keep])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target")).cast("long") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("ahead")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *keep)


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight,
             source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open,
             row_number() OVER (ORDER BY cap / weight, source IS NULL, encode(source)) AS rk FROM w),
f AS (SELECT *, (budget - spent) / open AS rate FROM l),
g AS (SELECT min(rk) AS rk, arg_min(rate, rk) AS rate FROM f WHERE rate * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN g.rk IS NULL OR f.rk < g.rk THEN cap ELSE g.rate * weight END AS target FROM f CROSS JOIN g),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead,
             CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - ahead)) AS BIGINT) AS taken FROM p
"""
