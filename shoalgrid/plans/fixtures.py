"""Portable views that give the driver's tables the shapes of cells, points, tides, scenes and model pairs.

The text of each view runs in Spark and in DuckDB; ``{side}`` is the number of rows and of columns of the grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SIDE = 32

SPECTRA = """
SELECT CAST(l_suppkey % 4 AS INT) AS scene_id, CAST(l_partkey % {side} AS INT) AS r, CAST(l_orderkey % {side} AS INT) AS c,
       CAST((CAST(SUM(l_quantity) AS BIGINT) % 50)*20 + 200 AS INT) AS blue_dn,
       CAST((CAST(SUM(ROUND(l_discount*100)) AS BIGINT) % 11)*90 + 100 AS INT) AS green_dn,
       CAST((CAST(SUM(ROUND(l_tax*100)) AS BIGINT) % 9)*80 + 50 AS INT) AS red_dn,
       CAST((SUM(l_partkey) % 50)*12 AS INT) AS nir_dn,
       CAST((SUM(l_linenumber) % 7 + 1)*60 AS INT) AS swir_dn,
       CAST(SUM(l_linenumber) % 12 AS INT) AS scl,
       CAST(SUM(l_partkey*37 + l_orderkey*11) % 65536 AS INT) AS qa_pixel
FROM lineitem GROUP BY 1,2,3
"""
DEPTH = """
SELECT CAST(EXTRACT(YEAR FROM l_shipdate) AS INT) AS year, CAST(l_partkey % {side} AS INT) AS r, CAST(l_orderkey % {side} AS INT) AS c,
       -CAST(CAST(SUM(l_quantity) AS BIGINT) % 50 + 1 AS DOUBLE)/CAST(2 AS DOUBLE) AS z,
       CAST(CAST(SUM(ROUND(l_discount*100)) AS BIGINT) % 11 + 5 AS DOUBLE)/CAST(100 AS DOUBLE) AS u
FROM lineitem GROUP BY 1,2,3
"""
POINTS = """
SELECT event_id AS point_id, CAST(user_id % {side} AS INT) AS r, CAST(event_id % {side} AS INT) AS c,
       CAST(EXTRACT(DAY FROM ts) % 7 AS INT)+1995 AS year, -(value/10.0) AS depth,
       CAST(regexp_extract(props,'[0-9]+',0) AS INT) AS confidence,
       CAST((event_id*7919) % 1000 AS DOUBLE)/1000.0 - 0.5 AS dx,
       CAST((event_id*104729) % 1000 AS DOUBLE)/1000.0 - 0.5 AS dy
FROM events
"""
TIDE = """
SELECT CAST(p_partkey % 10 AS INT) AS con_id, CAST(CAST(FLOOR(p_partkey/10) AS BIGINT) % 10 AS INT) AS lat_i,
       CAST(CAST(FLOOR(p_partkey/100) AS BIGINT) AS INT) AS lon_i,
       CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size END AS DOUBLE) AS amp_cm
FROM part
"""
SCENES = """
SELECT o_orderkey AS scene_key,
       CASE o_orderstatus WHEN 'F' THEN 'sentinel-2a' WHEN 'O' THEN 'landsat-8' ELSE 'sentinel-2b' END AS platform,
       o_orderdate AS acq_ts, CAST(FLOOR(o_totalprice) AS BIGINT) % 100 AS cloud_cover,
       CAST(o_custkey % 20 AS DOUBLE) AS minx, CAST(o_orderkey % 20 AS DOUBLE) AS miny
FROM orders
"""
PAIRS = """
SELECT CASE l_returnflag WHEN 'A' THEN 'm1' WHEN 'N' THEN 'm2' ELSE 'm3' END AS model,
       l_quantity/2.0 AS y_true, l_quantity/2.0 + (l_discount-0.05)*20.0 AS y_pred
FROM lineitem
"""
VIEWS = {
    "spectra": (SPECTRA, "lineitem"),
    "depth": (DEPTH, "lineitem"),
    "points": (POINTS, "events"),
    "tide": (TIDE, "part"),
    "scenes": (SCENES, "orders"),
    "pairs": (PAIRS, "lineitem"),
}


def view(spark: SparkSession, sf_dir: str, name: str, side: int | None = None) -> DataFrame:
    """The view as a DataFrame over the tables in ``sf_dir``."""
    text, table = VIEWS[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(text.format(side=side or SIDE).replace(f"FROM {table}", "FROM {source}"), source=source)


def with_views(sql: str, *names: str, side: int = SIDE) -> str:
    """``sql`` behind the views fx_<name> it reads."""
    head = ",\n".join(f"fx_{n} AS ({VIEWS[n][0].format(side=side)})" for n in names)
    return f"WITH {head}{', ' if sql.lstrip().upper().startswith('WITH ') else ''}{sql.lstrip()[5:] if sql.lstrip().upper().startswith('WITH ') else sql}"
