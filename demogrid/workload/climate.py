"""Daily cubes, county series, normals and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import climate as K
from ..plans.refresh import refresh_climate
from ..session import scratch_path
from ..sources import cube as S
from .base import BINDINGS, query

# Cells of the test grid against a 10 x 10 lattice; quarter steps exercise half-even rounding.
BINDINGS["placed"] = """
SELECT c_custkey AS cell_id, CAST(FLOOR(c_custkey / 40.0) AS BIGINT) / 4.0 AS lat, (c_custkey % 40) / 4.0 AS lon,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE n_name END AS county_mn
FROM customer JOIN nation ON n_nationkey = c_nationkey"""
_IDX = """sampled AS (SELECT cell_id, county_mn, CAST(GREATEST(0, LEAST(9, round_even(lat, 0))) AS BIGINT) AS iy,
 CAST(GREATEST(0, LEAST(9, round_even(lon, 0))) AS BIGINT) AS ix FROM placed)"""
_AXIS = (0.0, 1.0, 10)
_CD = """cd AS (SELECT county_mn, date, AVG(tmin) AS tmin, AVG(tmax) AS tmax, AVG(precip) AS precip
 FROM cube JOIN sampled ON sampled.iy = cube.iy AND sampled.ix = cube.ix WHERE county_mn IS NOT NULL GROUP BY 1, 2)"""
_AN = """an AS (SELECT iy, ix, year, AVG(tmin) AS tmin, AVG(tmax) AS tmax, (AVG(tmin) + AVG(tmax)) * 0.5 AS tmean,
 CASE WHEN COUNT(precip) > 60 THEN SUM(precip) END AS precip_sum, AVG(precip) AS precip_mean FROM cube GROUP BY 1, 2, 3)"""


def _cells(t):
    cells = t.placed.select("cell_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "county_mn")
    return K.sample_index(cells, _AXIS, _AXIS)


def _round(df, *names, places=7):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("j13_nearest_axis_index", "placed", f"WITH {_IDX} SELECT cell_id, iy, ix FROM sampled")
def _(t):
    return _cells(t).select("cell_id", "iy", "ix")


@query("j14_reindex_with_tolerance", "placed", """
WITH o AS (SELECT cell_id, lat, lon, CAST(round_even(lat, 0) AS BIGINT) AS iy, CAST(round_even(lon, 0) AS BIGINT) AS ix FROM placed
 WHERE ABS(lat - round_even(lat, 0)) <= 0.3 AND ABS(lon - round_even(lon, 0)) <= 0.3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY iy, ix ORDER BY POWER(lat - iy, 2) + POWER(lon - ix, 2), cell_id) AS k FROM o),
g AS (SELECT a.i AS iy, b.i AS ix FROM range(10) a(i) CROSS JOIN range(10) b(i))
SELECT g.iy, g.ix, cell_id FROM g LEFT JOIN r ON r.iy = g.iy AND r.ix = g.ix AND k = 1""")
def _(t):
    obs = t.placed.select("cell_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return K.reindex_with_tolerance(obs, _AXIS, _AXIS, 0.3).select("iy", "ix", "cell_id")


@query("j15_exact_alignment", "cube", "SELECT date, iy, ix, ROUND(tmin, 7) AS tmin, ROUND(tmax, 7) AS tmax, ROUND(precip, 7) AS precip FROM cube")
def _(t):
    cube = t.cube.select("date", "iy", "ix", *K.VARS)
    hours = {"tmin": 6, "tmax": 18, "precip": 6}
    at = {v: cube.select(F.timestamp_seconds(F.unix_date("date").cast("bigint") * 86400 + h * 3600).alias("time"), "iy", "ix", v)
          for v, h in hours.items()}
    return _round(K.align_exactly(at), *K.VARS)


@query("j16_full_outer_series", "cube placed", f"""
WITH {_IDX}, {_CD}, a AS (SELECT county_mn, date, tmin FROM cd WHERE tmin < 0), b AS (SELECT county_mn, date, precip FROM cd WHERE precip >= 5)
SELECT COALESCE(a.county_mn, b.county_mn) AS county_mn, COALESCE(a.date, b.date) AS date, ROUND(tmin, 7) AS tmin, ROUND(precip, 7) AS precip
FROM a FULL JOIN b ON a.county_mn = b.county_mn AND a.date = b.date""")
def _(t):
    daily = _round(K.county_daily(t.cube, _cells(t)), "tmin", "precip")
    cold = daily.filter("tmin < 0").select("county_mn", "date", "tmin")
    wet = daily.filter("precip >= 5").select("county_mn", "date", "precip")
    return K.merge_series([cold, wet], ["county_mn", "date"])


@query("a17_daily_accumulators", "cube placed", f"""
WITH {_IDX}, px AS (SELECT iy, ix, AVG(tmin) AS tmin_mean, AVG(tmax) AS tmax_mean, COUNT(*) FILTER (tmin < 0) AS frost_days, COUNT(*) FILTER (tmin >= 20) AS tropical_nights,
 COUNT(*) FILTER (tmax >= 25) AS summer_days, COUNT(*) FILTER (tmax >= 30) AS hot_days, SUM(precip) AS precip_total, MAX(precip) AS precip_max_daily,
 COUNT(*) FILTER (precip >= 1) AS wet_days, COUNT(tmin) AS n_days_temp, COUNT(precip) AS n_days_precip FROM cube GROUP BY 1, 2)
SELECT cell_id, ROUND(tmin_mean, 7) AS tmin_mean, ROUND(tmax_mean, 7) AS tmax_mean, ROUND((tmin_mean + tmax_mean) / 2, 7) AS tmean, frost_days, tropical_nights, summer_days,
 hot_days, ROUND(precip_total, 7) AS precip_total, ROUND(precip_max_daily, 7) AS precip_max_daily, wet_days, n_days_temp, n_days_precip
FROM sampled LEFT JOIN px ON px.iy = sampled.iy AND px.ix = sampled.ix""")
def _(t):
    return _round(K.accumulate(t.cube, _cells(t)), "tmin_mean", "tmax_mean", "tmean", "precip_total", "precip_max_daily")


@query("a18_county_daily_mean", "cube placed", f"""
WITH {_IDX}, {_CD} SELECT county_mn, date, ROUND(tmin, 7) AS tmin, ROUND(tmax, 7) AS tmax, ROUND(precip, 7) AS precip FROM cd""")
def _(t):
    return _round(K.county_daily(t.cube, _cells(t)), *K.VARS)


@query("a19_wide_to_long", "cube placed", f"""
WITH {_IDX}, {_CD} SELECT county_mn, date, 'tmin' AS variable, ROUND(tmin, 7) AS value FROM cd
UNION ALL SELECT county_mn, date, 'tmax', ROUND(tmax, 7) FROM cd UNION ALL SELECT county_mn, date, 'precip', ROUND(precip, 7) FROM cd""")
def _(t):
    return _round(K.melt(K.county_daily(t.cube, _cells(t)), ["county_mn", "date"]), "value")


@query("a20_year_rollup_of_daily", "cube placed", f"""
WITH {_IDX}, {_CD} SELECT county_mn, CAST(YEAR(date) AS INT) AS year, ROUND(AVG(tmin), 7) AS tmin, ROUND(AVG(tmax), 7) AS tmax, ROUND(AVG(precip), 7) AS precip,
 COUNT(DISTINCT date) AS n_days FROM cd GROUP BY 1, 2""")
def _(t):
    return _round(K.county_annual_from_daily(K.county_daily(t.cube, _cells(t))), *K.VARS)


@query("a21_annual_pixel_statistics", "cube", f"""
WITH {_AN} SELECT iy, ix, CAST(year AS INT) AS year, ROUND(tmin, 8) AS tmin, ROUND(tmax, 8) AS tmax, ROUND(tmean, 8) AS tmean, ROUND(precip_sum, 8) AS precip_sum,
 ROUND(precip_mean, 8) AS precip_mean FROM an""")
def _(t):
    return _round(K.annual_pixels(t.cube, 60), "tmin", "tmax", "tmean", "precip_sum", "precip_mean", places=8)


_CA = """ca AS (SELECT county_mn, year, AVG(an.tmin) AS tmin, AVG(an.tmax) AS tmax, AVG(precip_mean) AS precip
 FROM an JOIN sampled ON sampled.iy = an.iy AND sampled.ix = an.ix WHERE county_mn IS NOT NULL GROUP BY 1, 2),
dy AS (SELECT year, COUNT(DISTINCT date) AS n_days FROM cube GROUP BY 1)"""


@query("a22_county_annual_series", "cube placed", f"""
WITH {_IDX}, {_AN}, {_CA} SELECT county_mn, CAST(ca.year AS INT) AS year, ROUND(tmin, 7) AS tmin, ROUND(tmax, 7) AS tmax, ROUND(precip, 7) AS precip, n_days
FROM ca JOIN dy ON dy.year = ca.year""")
def _(t):
    cube = t.cube
    return _round(K.county_annual(K.annual_pixels(cube, 60), cube, _cells(t)), *K.VARS)


_NORM = """nm AS (SELECT iy, ix, AVG(tmean) FILTER (year BETWEEN 1995 AND 1997) AS te, AVG(tmean) FILTER (year BETWEEN 1998 AND 2000) AS tl,
 AVG(precip_sum) FILTER (year BETWEEN 1995 AND 1997) AS pe, AVG(precip_sum) FILTER (year BETWEEN 1998 AND 2000) AS pl,
 MAX(tmean) FILTER (year = 2001) AS la, CASE WHEN COUNT(tmean) = 7 THEN regr_slope(tmean, year) * 10 END AS tr FROM an WHERE year BETWEEN 1995 AND 2001 GROUP BY 1, 2)"""


def _normals(t):
    return K.normals(K.annual_pixels(t.cube, 60), (1995, 1997), (1998, 2000), last=2001, first=1995)


@query("a23_climate_normals_and_change", "cube placed", f"""
WITH {_IDX}, {_AN}, {_NORM} SELECT cell_id, ROUND(te, 7) AS tmean_early, ROUND(tl, 7) AS tmean_late, ROUND(pe, 7) AS prec_early, ROUND(pl, 7) AS prec_late,
 ROUND(tl - te, 7) AS warming, ROUND(100 * (pl - pe) / NULLIF(pe, 0), 7) AS prec_change_pct, ROUND(la - tl, 7) AS anomaly
FROM sampled JOIN nm ON nm.iy = sampled.iy AND nm.ix = sampled.ix""")
def _(t):
    n = _round(_normals(t).drop("trend_dec"), "tmean_early", "tmean_late", "prec_early", "prec_late", "warming", "prec_change_pct", "anomaly")
    return K.on_cells(n, _cells(t))


@query("a24_linear_trend_per_decade", "cube", f"WITH {_AN}, {_NORM} SELECT iy, ix, ROUND(tr, 7) AS trend_dec FROM nm")
def _(t):
    return _round(_normals(t).select("iy", "ix", "trend_dec"), "trend_dec")


@query("pf17_county_daily_series", "cube placed", f"""
WITH {_IDX}, {_CD} SELECT date, ROUND(tmin, 7) AS tmin, ROUND(tmax, 7) AS tmax, ROUND(precip, 7) AS precip FROM cd WHERE county_mn = 'NATION_3'""")
def _(t):
    return _round(K.county_series(K.county_daily(t.cube, _cells(t)), "NATION_3"), *K.VARS)


@query("pf17_county_annual_series", "cube placed", f"""
WITH {_IDX}, {_AN}, {_CA} SELECT make_date(CAST(year AS INT), 1, 1) AS date, ROUND(tmin, 7) AS tmin, ROUND(tmax, 7) AS tmax, ROUND(precip, 7) AS precip FROM ca WHERE county_mn = 'NATION_3'""")
def _(t):
    cube = t.cube
    return _round(K.county_series(K.county_annual(K.annual_pixels(cube, 60), cube, _cells(t)), "NATION_3"), *K.VARS)


_UPS = f"""WITH {_IDX}, {_CD}, {_AN}, {_CA}, cur AS (SELECT county_mn, CAST(YEAR(date) AS INT) AS year, AVG(tmin) AS tmin, AVG(tmax) AS tmax, AVG(precip) AS precip,
 COUNT(DISTINCT date) AS n_days FROM cd WHERE YEAR(date) >= 2000 GROUP BY 1, 2),
u AS (SELECT county_mn, CAST(ca.year AS INT) AS year, tmin, tmax, precip, n_days FROM ca JOIN dy ON dy.year = ca.year WHERE ca.year < 2000
 UNION ALL SELECT county_mn, year, tmin, tmax, precip, n_days FROM cur)
SELECT county_mn, year, ROUND(tmin, 7) AS tmin, ROUND(tmax, 7) AS tmax, ROUND(precip, 7) AS precip, n_days FROM u"""


@query("src17_current_period_upsert", "cube placed", _UPS)
def _(t):
    cube, cells = t.cube, _cells(t)
    history = K.county_annual(K.annual_pixels(cube, 60), cube, cells)
    current = K.county_annual_from_daily(K.county_daily(cube.filter("year >= 2000"), cells))
    return _round(K.replace_years(history, current), *K.VARS)


@query("u01_union_of_history_and_current", "cube", """
SELECT iy, ix, CAST(year AS INT) AS year, 'history' AS part, COUNT(*) AS n FROM cube WHERE year < 2000 GROUP BY 1, 2, 3
UNION ALL SELECT iy, ix, CAST(year AS INT), 'current', COUNT(*) FROM cube WHERE year >= 2000 GROUP BY 1, 2, 3""")
def _(t):
    counts = t.cube.groupBy("iy", "ix", "year").agg(F.count(F.lit(1)).alias("n"))
    old = counts.filter("year < 2000").withColumn("part", F.lit("history"))
    return old.unionByName(counts.filter("year >= 2000").withColumn("part", F.lit("current")))


@query("j04_anti_join_replaced_years", "cube", """
SELECT iy, ix, CAST(year AS INT) AS year, COUNT(*) AS n FROM cube WHERE year NOT IN (SELECT YEAR(o_orderdate) FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') GROUP BY 1, 2, 3""")
def _(t):
    open_years = (t.base("orders").filter(F.col("o_orderdate") >= "2000-01-01")
                  .select(F.year("o_orderdate").alias("year")).distinct())
    return t.cube.groupBy("iy", "ix", "year").agg(F.count(F.lit(1)).alias("n")).join(open_years, "year", "left_anti")


# --- the cube at rest -----------------------------------------------------------------------

@query("src09_year_file_catalogue", "", """
WITH f AS (SELECT DISTINCT CASE l_linenumber WHEN 1 THEN 'tmin' WHEN 2 THEN 'tmax' WHEN 3 THEN CASE WHEN YEAR(l_shipdate) = 2001 THEN 'wind' ELSE 'precip' END ELSE 'humidity' END AS var,
  l_returnflag = 'A' AS provisional, YEAR(l_shipdate) AS year FROM lineitem),
b AS (SELECT year, var, MIN(provisional) AS provisional FROM f WHERE var IN ('tmin', 'tmax', 'precip') GROUP BY 1, 2)
SELECT CAST(year AS INT) AS year, var, 'in/daily_' || var || CASE WHEN provisional THEN '_synop' ELSE '' END || '_' || CAST(year AS VARCHAR) || '.nc' AS path
FROM b WHERE year IN (SELECT year FROM b GROUP BY 1 HAVING COUNT(*) = 3)""")
def _(t):
    var = (F.when(F.col("l_linenumber") == 1, "tmin").when(F.col("l_linenumber") == 2, "tmax")
           .when(F.col("l_linenumber") == 3, F.when(F.year("l_shipdate") == 2001, "wind").otherwise("precip")).otherwise("humidity"))
    paths = t.base("lineitem").select(F.concat(
        F.lit("in/daily_"), var, F.when(F.col("l_returnflag") == "A", "_synop").otherwise(""), F.lit("_"),
        F.year("l_shipdate").cast("string"), F.lit(".nc")).alias("path")).distinct()
    return S.year_files(paths)


@query("src08_daily_cube_source", "cube", """
SELECT CAST(year AS INT) AS year, date, iy, ix, ROUND(tmin, 7) AS tmin, ROUND(tmax, 7) AS tmax, ROUND(precip, 7) AS precip FROM cube WHERE year BETWEEN 1996 AND 1998""")
def _(t):
    path = scratch_path(t.spark, "cube")
    S.write_cube(t.cube, path)
    return _round(S.read_cube(t.spark, path, 1996, 1998).select("year", "date", "iy", "ix", *K.VARS), *K.VARS)


@query("src10_cube_build", "cube", """
SELECT CAST(year AS INT) AS year, COUNT(*) AS n, ROUND(SUM(tmin), 4) AS tmin, ROUND(SUM(precip), 4) AS precip FROM cube GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "cube")
    S.write_cube(t.cube, path)
    S.write_cube(t.cube.filter("year = 2001"), path)  # a rerun of one year must change nothing
    return S.read_cube(t.spark, path).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("tmin"), 4).alias("tmin"), F.round(F.sum("precip"), 4).alias("precip"))


@query("src19_climate_refresh_job", "cube placed", _UPS.replace("WHERE YEAR(date) >= 2000", "WHERE YEAR(date) >= 2001").replace("ca.year < 2000", "ca.year < 2001"))
def _(t):
    cube, cells = t.cube, _cells(t)
    path = scratch_path(t.spark, "cube")
    S.write_cube(cube.filter("year <= 2001"), path)
    history = K.county_annual(K.annual_pixels(cube, 60), cube, cells)
    _, annual = refresh_climate(t.spark, cube.filter("year = 2001"), path, cells, history)
    return _round(annual, *K.VARS)
