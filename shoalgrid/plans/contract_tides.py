"""Queries over tide grids on real axes: irregular, falling, and of either range of longitudes."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalgrid.operators import spatial, tides
from shoalgrid.plans.fixtures import view
from shoalgrid.plans.registry import query, r6

# Latitudes fall by uneven steps, longitudes go from 0 to 356.25 or, less 180, from the west; a third of the names have units.
_LAT = "60.0 - lat_i * 3.0 - (lat_i % 3) * 0.5"
_LON = "lon_i * 18.5 + (lon_i % 2) * 2.25"
_GRID = f"SELECT concat('C', CAST(con_id AS STRING), '.nc') AS con, lat_i, lon_i, CAST({_LAT} AS DOUBLE) AS latitude, CAST({{lon}} AS DOUBLE) AS longitude, CASE WHEN amp_cm > 0 THEN amp_cm END AS amplitude, CASE con_id % 3 WHEN 0 THEN 'CM' ELSE 'unknown' END AS units FROM {{tide}}"
_POINTS = "SELECT point_id, CAST(depth AS DOUBLE) AS depth, CAST(62.0 - r * 1.1 AS DOUBLE) AS lat, CAST(c * 12.3 - 190.0 AS DOUBLE) AS lon FROM {points}"


def grid(spark, sf, west: bool = False):
    raw = spark.sql(_GRID.replace("{lon}", f"{_LON} - 180.0" if west else _LON), tide=view(spark, sf, "tide"))
    return tides.read_tide_grid(raw)


def places(spark, sf):
    return spark.sql(_POINTS, points=view(spark, sf, "points"))


def _sql(lon: str = _LON) -> str:
    raw = _GRID.replace("{lon}", lon).replace("{tide}", "fx_tide").replace("AS STRING", "AS VARCHAR")
    turned = "CASE WHEN lon < 0 AND (SELECT max(lon) FROM g) > 180 THEN lon + 360.0 ELSE lon END" if lon == _LON else "CASE WHEN lon > 180 THEN lon - 360.0 ELSE lon END"
    return f"""WITH raw AS ({raw}), cm AS (SELECT bool_or(lower(units) LIKE '%cm%') OR max(amplitude) > 15 AS cm FROM raw),
  g AS (SELECT lower(split_part(con, '.', 1)) AS con, lat_i, lon_i, latitude AS lat, longitude AS lon, coalesce(amplitude, 0) / CASE WHEN cm THEN 100 ELSE 1 END AS amp FROM raw CROSS JOIN cm),
  la AS (SELECT DISTINCT lat_i, lat FROM g), lo AS (SELECT DISTINCT lon_i, lon FROM g), p AS ({_POINTS.replace("{points}", "fx_points")}), t AS (SELECT *, {turned} AS x FROM p),
  y AS (SELECT lat, least((SELECT count(*) FROM la WHERE la.lat > q.lat), (SELECT max(lat_i) FROM la)) AS lat_i FROM (SELECT DISTINCT lat FROM t) q),
  x AS (SELECT x, least((SELECT count(*) FROM lo WHERE lo.lon < q.x), (SELECT max(lon_i) FROM lo)) AS lon_i FROM (SELECT DISTINCT x FROM t) q),
  c AS (SELECT point_id, depth, CAST(y.lat_i AS INT) AS lat_i, CAST(x.lon_i AS INT) AS lon_i FROM t JOIN y ON y.lat = t.lat JOIN x ON x.x = t.x)"""


@query("read_tide_axes", f"{_sql()} SELECT con, lat_i, lon_i, lat, lon, amp FROM g", "tide", "points")
def _(spark, sf):
    return grid(spark, sf)


@query("tide_cell_axes", f"{_sql()} SELECT point_id, lat_i, lon_i FROM c", "tide", "points")
def _(spark, sf):
    return tides.tide_cells(places(spark, sf), grid(spark, sf)).select("point_id", "lat_i", "lon_i")


@query("tide_cell_axes_west", f"{_sql(f'{_LON} - 180.0')} SELECT point_id, lat_i, lon_i FROM c", "tide", "points")
def _(spark, sf):
    return tides.tide_cells(places(spark, sf), grid(spark, sf, west=True)).select("point_id", "lat_i", "lon_i")


@query("tide_axes_amplitudes", f"{_sql()} SELECT point_id, con, amp FROM c JOIN g ON g.lat_i = c.lat_i AND g.lon_i = c.lon_i", "tide", "points")
def _(spark, sf):
    return tides.tide_at(places(spark, sf), grid(spark, sf)).select("point_id", "con", "amp")


_FIXED = """, n AS (SELECT a.con, a.lat_i, a.lon_i, greatest(abs(a.lat_i - b.lat_i), abs(a.lon_i - b.lon_i)) AS d, b.amp FROM g a JOIN g b ON a.con = b.con AND abs(a.lat_i - b.lat_i) <= 4 AND abs(a.lon_i - b.lon_i) <= 4 WHERE a.amp <= 0 AND b.amp > 0),
  f AS (SELECT con, lat_i, lon_i, min(d) AS d FROM n GROUP BY ALL), m AS (SELECT n.con, n.lat_i, n.lon_i, avg(amp) AS amp FROM n JOIN f ON n.con = f.con AND n.lat_i = f.lat_i AND n.lon_i = f.lon_i AND n.d <= f.d GROUP BY ALL),
  w AS (SELECT g.con, g.lat_i, g.lon_i, CASE WHEN g.amp > 0 THEN g.amp ELSE coalesce(m.amp, 0) END AS amp FROM g LEFT JOIN m ON g.con = m.con AND g.lat_i = m.lat_i AND g.lon_i = m.lon_i)"""


@query("job_datum_convert", f"{_sql()}{_FIXED} SELECT point_id, round(any_value(depth) + sum(amp), 6) + 0.0 AS depth FROM c JOIN w ON w.lat_i = c.lat_i AND w.lon_i = c.lon_i GROUP BY point_id", "tide", "points")
def _(spark, sf):
    """Mean sea level to lowest tide: the grid in metres, coastal cells wet, the cell of each place, sums of constituents, the shift."""
    number = F.regexp_extract("con", "[0-9]+", 0).cast("int").alias("con_id")
    whole = grid(spark, sf)
    wet = spatial.coastal_fix(whole.select(number, "lat_i", "lon_i", "amp"))
    found = tides.tide_cells(places(spark, sf), whole).join(wet, ["lat_i", "lon_i"])
    return spatial.datum_shift(spatial.harmonic_sums(found), "MSL", "LAT").select("point_id", r6("depth").alias("depth"))
