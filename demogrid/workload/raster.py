"""Rasters, blocks and distance transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import attach
from ..operators import raster as R
from .base import query

# Targets are the pixels of small parts; their size is the class.
_T = "t AS (SELECT prow, pcol, value, CASE WHEN p_size <= 3 THEN p_size END AS class FROM raster)"
_BEST = """best AS (SELECT a.prow, a.pcol, MIN((a.prow - b.prow) * (a.prow - b.prow) + (a.pcol - b.pcol) * (a.pcol - b.pcol)) AS d2
 FROM t a CROSS JOIN t b WHERE b.class IS NOT NULL GROUP BY 1, 2),
dt AS (SELECT x.prow, x.pcol, x.d2, MIN(b.class) AS class FROM best x JOIN t b ON b.class IS NOT NULL
 AND (x.prow - b.prow) * (x.prow - b.prow) + (x.pcol - b.pcol) * (x.pcol - b.pcol) = x.d2 GROUP BY 1, 2, 3)"""
_EDT = f"WITH {_T}, {_BEST}"


def _pixels(t):
    return t.raster.select("prow", "pcol", "value", F.when(F.col("p_size") <= 3, F.col("p_size")).alias("class"))


_BLK = "CAST(FLOOR(prow / 10) AS BIGINT) AS brow, CAST(FLOOR(pcol / 10) AS BIGINT) AS bcol"


@query("g08_dominant_class", "raster", f"""
WITH c AS (SELECT {_BLK}, class, COUNT(*) AS n FROM raster WHERE class > 0 GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY brow, bcol ORDER BY n DESC, class DESC) AS k FROM c)
SELECT brow, bcol, class FROM r WHERE k = 1""")
def _(t):
    return R.dominant_class(t.raster)


@query("g08_dominant_class_counting_empty", "raster", f"""
WITH c AS (SELECT {_BLK}, CASE WHEN p_size <= 26 THEN 0 ELSE class END AS class, COUNT(*) AS n FROM raster GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY brow, bcol ORDER BY n DESC, class DESC) AS k FROM c)
SELECT brow, bcol, CASE WHEN class > 0 THEN class END AS class FROM r WHERE k = 1""")
def _(t):
    zones = t.raster.withColumn("class", F.when(F.col("p_size") <= 26, 0).otherwise(F.col("class")))
    return R.dominant_class(zones, count_empty=True)


@query("g09_distance_transform", "raster", f"{_EDT} SELECT prow, pcol, d2, ROUND(SQRT(d2) * 0.1, 6) AS dist_km FROM best")
def _(t):
    d = R.distance_transform(_pixels(t))
    return d.select("prow", "pcol", "d2", F.round(R.distance_km(F.col("d2"), 100.0), 6).alias("dist_km"))


@query("g10_distance_with_category", "raster", f"{_EDT} SELECT prow, pcol, d2, class FROM dt")
def _(t):
    return R.distance_transform(_pixels(t))


@query("g11_block_minimum_distance", "raster", f"""
{_EDT} SELECT {_BLK}, ROUND(SQRT(MIN(d2)) * 100 / 1000, 2) AS dist_km FROM best GROUP BY 1, 2""")
def _(t):
    return R.block_min_distance(R.distance_transform(_pixels(t)))


@query("g12_central_pixel_sample", "raster", f"""
{_EDT} SELECT {_BLK}, ROUND(SQRT(d2) * 100 / 1000, 2) AS dist_km, class FROM dt WHERE prow % 10 = 5 AND pcol % 10 = 5""")
def _(t):
    mid = R.central_pixel(R.distance_transform(_pixels(t), rows=R.central_rows()))
    return mid.select("brow", "bcol", F.bround(R.distance_km(F.col("d2"), 100.0), 2).alias("dist_km"), "class")


@query("g13_nested_scenarios", "raster", f"""
{_EDT}, n AS (SELECT {_BLK}, d2, class, ROW_NUMBER() OVER (PARTITION BY FLOOR(prow / 10), FLOOR(pcol / 10) ORDER BY d2, prow, pcol) AS k FROM dt),
p AS (SELECT {_BLK}, MIN(class) AS present FROM t WHERE class IS NOT NULL GROUP BY 1, 2)
SELECT n.brow, n.bcol, ROUND(SQRT(n.d2) * 100 / 1000, 2) AS dist_km, COALESCE(p.present, n.class) AS scenario
FROM n LEFT JOIN p ON p.brow = n.brow AND p.bcol = n.bcol WHERE n.k = 1""")
def _(t):
    return R.scenario_overlay(R.distance_transform(_pixels(t)))


@query("g14_nearest_of_groups", "raster", """
WITH tg AS (SELECT prow, pcol, 'side ' || CAST(p_size AS VARCHAR) AS side FROM raster WHERE p_size <= 4),
d AS (SELECT a.prow, a.pcol, g.side, MIN((a.prow - g.prow) * (a.prow - g.prow) + (a.pcol - g.pcol) * (a.pcol - g.pcol)) AS d2
  FROM raster a CROSS JOIN tg g GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY prow, pcol ORDER BY d2, side) AS k FROM d WHERE side <> 'side 4')
SELECT r.prow, r.pcol, ROUND(SQRT(r.d2), 6) AS dist_km, r.side AS nearest, ROUND(SQRT(c.d2), 6) AS apart_km
FROM r JOIN d c ON c.prow = r.prow AND c.pcol = r.pcol AND c.side = 'side 4' WHERE k = 1""")
def _(t):
    raster = t.raster.select("prow", "pcol", "p_size")
    side = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("s")
    grouped = raster.select("prow", "pcol", "p_size", side).select(
        "prow", "pcol", F.concat(F.lit("side "), F.col("s").cast("string")).alias("side"),
        F.when(F.col("p_size") == F.col("s"), F.lit(1)).alias("class"))
    d = R.nearest_group(R.distance_transform(grouped, groups=["side"]), "side", apart="side 4")
    return d.withColumns({"dist_km": F.round("dist_km", 6), "apart_km": F.round("apart_km", 6)})


@query("g16_zonal_block_statistics", "raster", f"""
SELECT {_BLK}, ROUND(AVG(value), 6) AS mean, MIN(value) AS min, MAX(value) AS max, ROUND(STDDEV_POP(value), 6) AS std FROM raster GROUP BY 1, 2""")
def _(t):
    return R.block_stats(t.raster).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


GRAD = """g AS (SELECT prow, pcol,
 CASE WHEN ROW_NUMBER() OVER v = 1 THEN LEAD(value) OVER v - value WHEN LEAD(value) OVER v IS NULL THEN value - LAG(value) OVER v ELSE (LEAD(value) OVER v - LAG(value) OVER v) / 2 END / 100 AS gy,
 CASE WHEN ROW_NUMBER() OVER h = 1 THEN LEAD(value) OVER h - value WHEN LEAD(value) OVER h IS NULL THEN value - LAG(value) OVER h ELSE (LEAD(value) OVER h - LAG(value) OVER h) / 2 END / 100 AS gx
 FROM raster WINDOW v AS (PARTITION BY pcol ORDER BY prow), h AS (PARTITION BY prow ORDER BY pcol))"""


@query("g17_slope", "raster", f"WITH {GRAD} SELECT prow, pcol, ROUND(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope FROM g")
def _(t):
    return R.slope_degrees(t.raster).select("prow", "pcol", F.round("slope", 6).alias("slope"))


@query("g18_bilinear_resample", "raster", """
WITH tp AS (SELECT c_custkey AS id, (c_custkey * 7 % 490) / 10.0 + 0.3 AS fx,
 (c_custkey * 3 % ((SELECT MAX(prow) FROM raster) * 10)) / 10.0 + 0.45 AS fy FROM customer),
f AS (SELECT id, CAST(fx AS DOUBLE) AS fx, CAST(fy AS DOUBLE) AS fy, FLOOR(CAST(fx AS DOUBLE)) AS j0, FLOOR(CAST(fy AS DOUBLE)) AS i0 FROM tp),
n AS (SELECT id, r.value, CASE WHEN r.pcol = j0 THEN 1 - (fx - j0) ELSE fx - j0 END * CASE WHEN r.prow = i0 THEN 1 - (fy - i0) ELSE fy - i0 END AS w
  FROM f JOIN raster r ON r.prow BETWEEN i0 AND i0 + 1 AND r.pcol BETWEEN j0 AND j0 + 1)
SELECT id, ROUND(SUM(w * value) / SUM(w), 6) AS value FROM n GROUP BY 1""")
def _(t):
    height = attach(t.base("customer"), t.raster.agg((F.max("prow") * 10).alias("tenths")))
    tp = height.select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7 % 490 / 10 + F.lit(0.3)).alias("x"),
        (F.col("c_custkey") * 3 % F.col("tenths") / 10 + F.lit(0.45)).alias("y"))
    return R.bilinear_resample(tp, t.raster, 0.0, 0.0, 1.0, ["id"]).withColumn("value", F.round("value", 6))
