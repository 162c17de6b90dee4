"""Forecast runs: node mapping, interpolation, exposure, local days, air quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import air, times
from ..functions.columns import attach
from ..operators import forecast as W
from .base import BINDINGS, query

BINDINGS["cells_ll"] = """
SELECT c_custkey AS cell_id, CAST(20.0 + (c_custkey % 40) / 40.0 AS DOUBLE) AS lon,
       CAST(45.0 + FLOOR(c_custkey / 40.0) / 40.0 AS DOUBLE) AS lat FROM customer"""
# Scattered nodes that grow with the data, about one per 15 cells.
BINDINGS["nodes_ll"] = """
SELECT s_suppkey AS grid_id, CAST(20.0 + (s_suppkey * 7919 % 40) / 40.0 AS DOUBLE) AS lon,
       CAST(45.0 + s_suppkey * 0.375 / 40.0 AS DOUBLE) AS lat FROM supplier"""
BINDINGS["air_hourly"] = """
SELECT user_id % 4 AS grid_id, DATE_TRUNC('hour', ts) AS valid_time,
       CASE event_type WHEN 'click' THEN 'pm25' WHEN 'error' THEN 'pm10' WHEN 'purchase' THEN 'no2' WHEN 'signup' THEN 'o3' ELSE 'so2' END AS pollutant,
       AVG(value) AS value FROM events GROUP BY 1, 2, 3"""
BINDINGS["kelvin"] = """
SELECT user_id % 4 AS grid_id, DATE_TRUNC('hour', ts) AS valid_time, MIN(value) / 10 + 253.15 AS min_k, MAX(value) / 10 + 253.15 AS max_k
FROM events GROUP BY 1, 2"""
_TODAY = "DATE '2024-01-15'"
_AXIS = "ax AS (SELECT unnest(generate_series((SELECT MIN(valid_time) FROM {b}), (SELECT MAX(valid_time) FROM {b}), INTERVAL 1 HOUR)) AS valid_time)"
_STAMP = "%Y-%m-%d %H:%M:%S"


def _stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def _cells_xy(t):
    return t.points


_CHORD = """u AS (SELECT cell_id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM cells_ll),
v AS (SELECT grid_id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM nodes_ll),
nn AS (SELECT cell_id, grid_id, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY POWER(u.x - v.x, 2) + POWER(u.y - v.y, 2) + POWER(u.z - v.z, 2), grid_id) AS k FROM u CROSS JOIN v)"""


@query("j10_nearest_node_on_sphere", "cells_ll nodes_ll", f"WITH {_CHORD} SELECT cell_id, grid_id FROM nn WHERE k = 1")
def _(t):
    return W.nearest_node(t.cells_ll, t.nodes_ll)


_MAP = """m AS (SELECT p.cell_id, n.grid_id, CASE WHEN n.x = 0 THEN 1 - fx ELSE fx END * CASE WHEN n.y = 0 THEN 1 - fy ELSE fy END AS weight
FROM (SELECT cell_id, LEAST(1.0, x / 40000.0) AS fx, LEAST(1.0, y / 40000.0) AS fy FROM points) p CROSS JOIN nodes n)"""


def _nodes(t):
    return t.nodes.select("grid_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def _planar_nearest(t, nodes):
    from ..operators.spatial import nearest_sites

    return nearest_sites(_cells_xy(t), nodes, 1, "cell_id", "grid_id").select("cell_id", "grid_id")


def _mapping(t):
    nodes = _nodes(t)
    # The nearest node is only read where the lattice has holes, which this one has not.
    return W.bilinear_mapping(_cells_xy(t), nodes, _cells_xy(t).select("cell_id", F.lit(0).cast("bigint").alias("grid_id")), "x", "y")


@query("j11_bilinear_mapping", "points nodes", f"WITH {_MAP} SELECT cell_id, grid_id, ROUND(weight, 6) AS weight FROM m")
def _(t):
    return _mapping(t).select("cell_id", "grid_id", F.round("weight", 6).alias("weight"))


@query("j11_mapping_with_hole", "points nodes", """
WITH d AS (SELECT cell_id, grid_id, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY POWER(p.x - n.x, 2) + POWER(p.y - n.y, 2), grid_id) AS k
 FROM points p CROSS JOIN nodes n WHERE grid_id <> 3)
SELECT cell_id, grid_id, c.corner, CASE WHEN c.corner = 'a' THEN 1.0 ELSE 0.0 END::DOUBLE AS weight FROM d CROSS JOIN (VALUES ('a'), ('b'), ('c'), ('d')) c(corner) WHERE k = 1""")
def _(t):
    nodes = _nodes(t).filter("grid_id <> 3")
    return W.bilinear_mapping(_cells_xy(t), nodes, _planar_nearest(t, nodes), "x", "y")


@query("j11_wide_mapping", "points nodes", f"""
WITH {_MAP} SELECT cell_id, ROUND(MAX(weight) FILTER (grid_id = 0), 6) AS weight_a, ROUND(MAX(weight) FILTER (grid_id = 1), 6) AS weight_b,
 ROUND(MAX(weight) FILTER (grid_id = 2), 6) AS weight_c, ROUND(MAX(weight) FILTER (grid_id = 3), 6) AS weight_d FROM m GROUP BY 1""")
def _(t):
    near = _planar_nearest(t, _nodes(t))
    wide = W.wide_mapping(_mapping(t), near)
    return wide.select("cell_id", *[F.round(f"weight_{c}", 6).alias(f"weight_{c}") for c in W.CORNERS])


# one node has no value on the chosen day, so its weight is shared among the others
_VAL = "vals AS (SELECT grid_id, CASE WHEN grid_id = 2 THEN NULL ELSE tmax END AS val FROM daily WHERE valid_date = DATE '2024-01-20')"
_INT = "itp AS (SELECT cell_id, SUM(weight * val) / NULLIF(SUM(CASE WHEN val IS NOT NULL THEN weight END), 0) AS val FROM m LEFT JOIN vals ON vals.grid_id = m.grid_id GROUP BY 1)"


@query("j12_weighted_interpolation", "points nodes daily", f"WITH {_MAP}, {_VAL}, {_INT} SELECT cell_id, ROUND(val, 5) AS val FROM itp")
def _(t):
    v = W.horizon(t.daily, "tmax", "max", F.lit("2024-01-20").cast("date"))
    v = v.withColumn("val", F.when(F.col("grid_id") != 2, F.col("val")))
    return W.interpolate(_mapping(t), v, ["val"]).select("cell_id", F.round("val", 5).alias("val"))


@query("j19_point_forecast", "cells_ll nodes_ll", f"""
WITH {_CHORD}, dd AS (SELECT user_id % (SELECT COUNT(*) FROM nodes_ll) AS grid_id, CAST(ts AS DATE) AS valid_date, MIN(value) AS tmin, MAX(value) AS tmax FROM events GROUP BY 1, 2)
SELECT cell_id, valid_date, tmin, tmax FROM nn JOIN dd ON dd.grid_id = nn.grid_id WHERE k = 1 AND valid_date >= {_TODAY}""")
def _(t):
    n = t.nodes_ll.agg(F.count(F.lit(1)).alias("n"))
    daily = (attach(t.base("events"), n)
             .groupBy((F.col("user_id") % F.col("n")).alias("grid_id"), F.to_date("ts").alias("valid_date"))
             .agg(F.min("value").alias("tmin"), F.max("value").alias("tmax")))
    return W.point_forecast(W.nearest_node(t.cells_ll, t.nodes_ll), daily, t.cells_ll, F.lit("2024-01-15").cast("date"))


# --- exposure ----------------------------------------------------------------------------------

_HOR = f"hz AS (SELECT grid_id, MAX(tmax) AS val FROM daily WHERE valid_date >= {_TODAY} GROUP BY 1)"
_INH = _INT.replace("vals", "hz")


def _heat(t):
    return W.horizon(t.daily, "tmax", "max", today=F.lit("2024-01-15").cast("date"))


@query("pf16_available_days", "daily", f"SELECT DISTINCT valid_date FROM daily WHERE valid_date >= {_TODAY}")
def _(t):
    return W.available_days(t.daily, F.lit("2024-01-15").cast("date")).select("valid_date").distinct()


@query("a30_horizon_reduction", "daily", f"WITH {_HOR} SELECT grid_id, val FROM hz")
def _(t):
    return _heat(t)


@query("a31_forecast_exposure", "points nodes daily core", f"""
WITH {_MAP}, {_HOR}, {_INH} SELECT CAST(COALESCE(SUM(pop_total), 0) AS BIGINT) AS value, COUNT(*) AS n_cells FROM itp JOIN core USING (cell_id)
WHERE val >= (SELECT AVG(val) FROM hz)""")
def _(t):
    h = _heat(t)
    threshold = h.agg(F.avg("val")).first()[0]
    return W.exposure_total(W.exposed_cells(_mapping(t), h, t.core, ">=", threshold))


@query("a31_exposed_cells", "points nodes daily core", f"""
WITH {_MAP}, {_HOR.replace('MAX(tmax)', 'MIN(tmin)')}, {_INH} SELECT cell_id, CAST(pop_f AS DOUBLE) AS val FROM itp JOIN core USING (cell_id) WHERE val <= 0.3""")
def _(t):
    low = W.horizon(t.daily, "tmin", "min", today=F.lit("2024-01-15").cast("date"))
    return W.exposed_cells(_mapping(t), low, t.core, "<=", 0.3, "pop_f")


_CELLV = """cv AS (SELECT cell_id, alt_mean AS x, pop_total FROM core JOIN env USING (cell_id))"""


def _ladder_sql(ladder, op, worst):
    bands = ", ".join(f"({i}, {b})" for i, b in enumerate(ladder))
    return f"""lad AS (SELECT i, b, COALESCE(SUM(pop_total) FILTER (x {op} b), 0) AS n FROM (VALUES {bands}) v(i, b) CROSS JOIN cv GROUP BY 1, 2),
pick AS (SELECT CASE WHEN MAX(n) = 0 THEN NULL ELSE COALESCE({worst}(b) FILTER (n >= 0.005 * (SELECT SUM(pop_total) FROM cv) AND n > 0),
  arg_max(b, n * 100 - i)) END AS threshold FROM lad)"""


_LCV = "cv AS (SELECT cell_id, CAST(c_acctbal AS DOUBLE) / 240 AS x, pop_total FROM core JOIN customer ON c_custkey = cell_id)"


def _ladder_cells(t):
    c = t.base("customer").select(F.col("c_custkey").alias("cell_id"), (F.col("c_acctbal") / 240).alias("x"))
    return c.join(t.core.select("cell_id", "pop_total"), "cell_id")


@query("a32_heat_ladder", "core", f"WITH {_LCV}, {_ladder_sql(W.HEAT_LADDER, '>=', 'MAX')} SELECT threshold, threshold IS NOT NULL AS active FROM pick")
def _(t):
    return W.ladder_pick(_ladder_cells(t), "x", W.HEAT_LADDER, ">=")


@query("a32_cold_ladder", "core", f"WITH {_LCV}, {_ladder_sql(W.COLD_LADDER, '<=', 'MIN')} SELECT threshold, threshold IS NOT NULL AS active FROM pick")
def _(t):
    return W.ladder_pick(_ladder_cells(t), "x", W.COLD_LADDER, "<=")


@query("pf20_active_products", "core", f"""
WITH {_LCV}, {_ladder_sql(W.HEAT_LADDER, '>=', 'MAX')},
{_ladder_sql(W.COLD_LADDER, '<=', 'MIN').replace('lad AS', 'lad2 AS').replace('FROM lad)', 'FROM lad2)').replace('pick AS', 'pick2 AS')}
SELECT 'heat' AS product, CAST(threshold AS DOUBLE) AS effective FROM pick WHERE threshold IS NOT NULL UNION ALL
SELECT 'cold', CAST(-7 AS DOUBLE) FROM pick2 WHERE threshold IS NOT NULL UNION ALL SELECT 'air_poor', 3.0""")
def _(t):
    cells = _ladder_cells(t)
    products = W.build_products(W.ladder_pick(cells, "x", W.HEAT_LADDER, ">="), W.ladder_pick(cells, "x", W.COLD_LADDER, "<="), True)
    return W.active_products(products, {"cold": -7}).select("product", "effective")


# --- time ----------------------------------------------------------------------------------------

@query("a33_daily_extremes_by_local_day", "kelvin", """
WITH d AS (SELECT grid_id, CAST(valid_time - INTERVAL 90 MINUTE + INTERVAL 2 HOUR AS DATE) AS valid_date, min_k, max_k FROM kelvin)
SELECT grid_id, valid_date, ROUND(MIN(min_k - 273.15), 6) AS tmin, ROUND(MAX(max_k - 273.15), 6) AS tmax FROM d GROUP BY 1, 2""")
def _(t):
    d = W.weather_daily(t.kelvin, 1, only_complete=False)
    return d.withColumns({"tmin": F.round("tmin", 6), "tmax": F.round("tmax", 6)})


_AIR = f"""{_AXIS.format(b='air_hourly')}, dense AS (SELECT k.grid_id, k.pollutant, ax.valid_time, a.value
 FROM (SELECT DISTINCT grid_id, pollutant FROM air_hourly) k CROSS JOIN ax LEFT JOIN air_hourly a ON a.grid_id = k.grid_id AND a.pollutant = k.pollutant AND a.valid_time = ax.valid_time),
ro AS (SELECT *, CASE WHEN COUNT(value) OVER w = 24 THEN AVG(value) OVER w END AS m24 FROM dense WINDOW w AS (PARTITION BY grid_id, pollutant ORDER BY valid_time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
rk AS (SELECT *, CASE WHEN pollutant IN ('pm25', 'pm10') THEN m24 ELSE value END AS basis FROM ro),
aq AS (SELECT *, CASE WHEN basis IS NULL THEN -1 ELSE CASE pollutant
  WHEN 'pm25' THEN (basis > 10)::INT + (basis > 20)::INT + (basis > 25)::INT + (basis > 50)::INT + (basis > 75)::INT
  WHEN 'pm10' THEN (basis > 20)::INT + (basis > 40)::INT + (basis > 50)::INT + (basis > 100)::INT + (basis > 150)::INT
  WHEN 'no2' THEN (basis > 40)::INT + (basis > 90)::INT + (basis > 120)::INT + (basis > 230)::INT + (basis > 340)::INT
  WHEN 'o3' THEN (basis > 50)::INT + (basis > 100)::INT + (basis > 130)::INT + (basis > 240)::INT + (basis > 380)::INT
  ELSE (basis > 100)::INT + (basis > 200)::INT + (basis > 350)::INT + (basis > 500)::INT + (basis > 750)::INT END END AS rank FROM rk)"""


@query("a34_daily_air_quality", "air_hourly", f"""
WITH {_AIR}, full_days AS (SELECT CAST(valid_time + INTERVAL 2 HOUR AS DATE) AS d FROM ax GROUP BY 1 HAVING COUNT(*) >= 24)
SELECT grid_id, CAST(valid_time + INTERVAL 2 HOUR AS DATE) AS valid_date, MAX(rank) AS aqi_rank, ROUND(MAX(value) FILTER (pollutant = 'pm25'), 6) AS pm25_max,
 ROUND(MAX(value) FILTER (pollutant = 'pm10'), 6) AS pm10_max, ROUND(MAX(value) FILTER (pollutant = 'no2'), 6) AS no2_max, ROUND(MAX(value) FILTER (pollutant = 'o3'), 6) AS o3_max,
 ROUND(MAX(value) FILTER (pollutant = 'so2'), 6) AS so2_max FROM aq WHERE CAST(valid_time + INTERVAL 2 HOUR AS DATE) IN (SELECT d FROM full_days) GROUP BY 1, 2 HAVING COUNT(value) > 0""")
def _(t):
    d = W.air_daily(W.densify(t.air_hourly, ["grid_id", "pollutant"]))
    return d.withColumns({f"{p}_max": F.round(f"{p}_max", 6) for p in air.POLLUTANTS})


_ROLL = f"""{_AXIS.format(b='hourly')}, dn AS (SELECT k.grid_id, ax.valid_time, h.value FROM (SELECT DISTINCT grid_id FROM hourly) k CROSS JOIN ax
 LEFT JOIN hourly h ON h.grid_id = k.grid_id AND h.valid_time = ax.valid_time),
r24 AS (SELECT *, CASE WHEN COUNT(value) OVER w = 24 THEN AVG(value) OVER w END AS mean24 FROM dn WINDOW w AS (PARTITION BY grid_id ORDER BY valid_time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


@query("w01_strict_rolling_mean", "hourly", f"WITH {_ROLL} SELECT grid_id, strftime(valid_time, '{_STAMP}') AS at, ROUND(mean24, 8) AS mean24 FROM r24")
def _(t):
    dense = W.densify(t.hourly.select("grid_id", "valid_time", "value"), ["grid_id"])
    return dense.select("grid_id", _stamp("valid_time").alias("at"), F.round(W.rolling_mean(dense, ["grid_id"]), 8).alias("mean24"))


@query("w06_complete_local_days", "hourly", """
SELECT grid_id, CAST(valid_time + INTERVAL 2 HOUR AS DATE) AS day FROM (SELECT DISTINCT grid_id, valid_time FROM hourly) h GROUP BY 1, 2 HAVING COUNT(*) >= 24""")
def _(t):
    return W.complete_local_days(t.hourly, 1, keys=["grid_id"])


@query("u03_required_coverage", "hourly", """
WITH ax AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-31 23:00:00', INTERVAL 1 HOUR)) AS valid_time)
SELECT strftime(valid_time, '%Y-%m-%d %H:%M:%S') AS at FROM ax WHERE valid_time NOT IN (SELECT valid_time FROM hourly)""")
def _(t):
    missing = W.missing_steps(t.hourly, F.lit("2024-01-01 00:00:00"), F.lit("2024-01-31 23:00:00"), "1 hour")
    return missing.select(_stamp("valid_time").alias("at"))


@query("u05_same_grid_check", "nodes_ll", "SELECT 0::BIGINT AS n_only_one_side, COUNT(*) FILTER (grid_id < 10) AS n_moved, FALSE AS same FROM nodes_ll")
def _(t):
    nodes = t.nodes_ll
    moved = nodes.withColumn("lon", F.col("lon") + F.when(F.col("grid_id") < 10, 1e-5).otherwise(1e-9))
    return W.same_grid(nodes, moved)


@query("a39_run_sanity", "daily air_hourly", f"""
WITH {_AIR}, d AS (SELECT grid_id, CAST(valid_time + INTERVAL 2 HOUR AS DATE) AS dd, MAX(rank) AS r FROM aq GROUP BY 1, 2 HAVING COUNT(value) > 0)
SELECT 'inverted' AS problem, COUNT(*) FILTER (tmin > tmax) AS n FROM daily UNION ALL SELECT 'empty', 0 UNION ALL
SELECT 'out_of_range', COUNT(*) FILTER (r NOT BETWEEN 0 AND 5) FROM d UNION ALL SELECT 'empty_air', 0""")
def _(t):
    return W.run_problems(t.daily, W.air_daily(W.densify(t.air_hourly, ["grid_id", "pollutant"]), only_complete=False))


@query("f10_local_date_label", "", "SELECT event_id, CAST(ts + INTERVAL 2 HOUR AS DATE) AS day FROM events")
def _(t):
    return t.base("events").select("event_id", times.local_day(F.col("ts")).alias("day"))


@query("f12_candidate_run_dates", "", """
SELECT o_orderkey, CAST(LEAST(CAST(o_orderdate AS DATE), DATE '1998-06-01') - CAST(k AS INT) AS DATE) AS day FROM orders CROSS JOIN (VALUES (0), (1), (2)) v(k)""")
def _(t):
    return t.base("orders").select("o_orderkey", F.explode(
        times.candidate_dates(F.to_date("o_orderdate"), F.lit("1998-06-01").cast("date"))).alias("day"))


@query("f13_hour_axis", "", f"SELECT event_id, strftime(date_trunc('day', ts) + to_minutes(CAST((event_id % 49) * 30 AS BIGINT)), '{_STAMP}') AS at FROM events")
def _(t):
    base = F.date_trunc("day", F.col("ts").cast("timestamp"))
    return t.base("events").select("event_id", _stamp(times.hour_axis(base, F.col("event_id") % 49 / F.lit(2.0))).alias("at"))


# --- pollutant fields ---------------------------------------------------------------------------

_RAWVAR = """CASE event_type WHEN 'click' THEN 'PM2.5 conc' WHEN 'error' THEN 'Particulate matter < 10 um' WHEN 'purchase' THEN 'Nitrogen dioxide'
 WHEN 'signup' THEN 'ozone uncertainty' ELSE 'Sulphur dioxide (SO2)' END"""
_RAWUNIT = "CASE WHEN event_type = 'click' THEN 'mg m^-3' WHEN event_type = 'error' THEN 'µg/m³' ELSE 'kg/m3' END"
_RAW = f"SELECT event_id, {_RAWVAR} AS variable, {_RAWUNIT} AS units, value - 100 AS value FROM events"


@query("f06_pollutant_alias", "", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'pm25' WHEN 'error' THEN 'pm10' WHEN 'purchase' THEN 'no2' WHEN 'signup' THEN NULL ELSE 'so2' END AS pollutant FROM events""")
def _(t):
    return t.sql(_RAW).select("event_id", air.pollutant_of(F.col("variable")).alias("pollutant"))


@query("f07_unit_factor", "", "SELECT event_id, CASE WHEN event_type = 'click' THEN 1e3 WHEN event_type = 'error' THEN 1.0 ELSE 1e9 END::DOUBLE AS factor FROM events")
def _(t):
    return t.sql(_RAW).select("event_id", air.concentration_factor(F.col("units")).alias("factor"))


@query("f15_aqi_rank", "", """
SELECT event_id, (value > 10)::INT + (value > 20)::INT + (value > 25)::INT + (value > 50)::INT + (value > 75)::INT AS pm25,
 (value > 100)::INT + (value > 200)::INT + (value > 350)::INT + (value > 500)::INT + (value > 750)::INT AS so2, -1 AS missing FROM events""")
def _(t):
    v = F.col("value")
    return t.base("events").select("event_id", air.aqi_rank(v, "pm25").alias("pm25"), air.aqi_rank(v, "so2").alias("so2"),
                                   air.aqi_rank(F.lit(float("nan")), "o3").alias("missing"))


@query("src13_forecast_run_source", "", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'pm25' WHEN 'error' THEN 'pm10' WHEN 'purchase' THEN 'no2' ELSE 'so2' END AS pollutant,
 ROUND(GREATEST((value - 100) * CASE event_type WHEN 'click' THEN 1e3 WHEN 'error' THEN 1.0 ELSE 1e9 END, 0), 2) AS value
FROM events WHERE event_type <> 'signup'""")
def _(t):
    return air.clean_series(t.sql(_RAW)).select("event_id", "pollutant", F.round("value", 2).alias("value"))


@query("src13_canonical_grid_order", "nodes_ll", """
SELECT lon, lat, ROW_NUMBER() OVER (ORDER BY lat DESC, lon) - 1 AS grid_id FROM (SELECT DISTINCT lon, lat FROM nodes_ll) d""")
def _(t):
    return W.canonical_ids(t.nodes_ll)


@query("pf13_bounding_box_crop", "nodes_ll", """
SELECT grid_id, ROUND(lon - 0, 6) AS lon, lat FROM nodes_ll WHERE lon BETWEEN 20.21 AND 20.71 AND lat BETWEEN 45.1 AND 46""")
def _(t):
    turned = t.nodes_ll.withColumn("lon", F.col("lon") + 360.0)
    return W.crop(turned, 20.21, 20.71, 45.1, 46.0).select("grid_id", F.round("lon", 6).alias("lon"), "lat")


@query("f19_grid_fingerprint", "cells_ll nodes_ll", """
WITH c AS (SELECT BIT_XOR(CAST('0x' || SUBSTR(md5(CAST(cell_id AS VARCHAR)), 1, 15) AS BIGINT)) AS h, COUNT(*) AS n FROM cells_ll),
p AS (SELECT grid_id, CAST(ROUND(lon * 10000000) AS BIGINT) AS x, CAST(ROUND((lon + CASE WHEN grid_id = 0 THEN 0.001 ELSE 0 END) * 10000000) AS BIGINT) AS moved,
  CAST(ROUND(lat * 10000000) AS BIGINT) AS y FROM nodes_ll),
n AS (SELECT BIT_XOR(CAST('0x' || SUBSTR(md5(concat_ws('|', grid_id, x, y)), 1, 15) AS BIGINT)) AS h,
  BIT_XOR(CAST('0x' || SUBSTR(md5(concat_ws('|', grid_id, moved, y)), 1, 15) AS BIGINT)) AS m, COUNT(*) AS n FROM p)
SELECT sha256(concat_ws('|', c.h, c.n, n.h, n.n)) AS fingerprint, sha256(concat_ws('|', c.h, c.n, n.m, n.n)) AS other FROM c, n""")
def _(t):
    cells, nodes = t.cells_ll, t.nodes_ll
    moved = nodes.withColumn("lon", F.col("lon") + F.when(F.col("grid_id") == 0, 0.001).otherwise(0.0))
    a = W.grid_fingerprint(cells, nodes)
    c = W.grid_fingerprint(cells.orderBy(F.desc("cell_id")), moved.repartition(3)).select(F.col("fingerprint").alias("other"))
    return attach(a, c)
