"""Question trees, breakdowns and disclosure control, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Between, In
from ..operators import disclosure
from ..operators import questions as Q
from ..operators.trees import And, Compare, Measure, Not, Or, Polygon, Radius, answer, cells_where
from .atlas import REG
from .base import query

_WIDE = """
, x AS (SELECT cell_id, pop_total, pop_65p, col * 1000 + 500 AS x, row * 1000 + 500 AS y, county_mn, region_name, landform_type,
  CASE WHEN isnan(alt_mean) THEN NULL ELSE alt_mean END AS alt_mean, dist_km, slope_mean, tmean, hot_days
  FROM core LEFT JOIN env USING (cell_id) LEFT JOIN climate USING (cell_id))"""


def _atlas(t):
    core = t.core.withColumns({"x": F.col("col") * 1000 + 500, "y": F.col("row") * 1000 + 500})
    return Q.Atlas(core, t.env, t.climate, REG)


WARM_OR_LOW = Or((And((Compare("tmean", ">=", 5.0), Not(In("landform_type", ("munte", "deal"))))), Between("alt_mean", None, 200), Compare("hot_days", ">", 120)))


@query("x01_constraint_tree", "core env climate", f"""{_WIDE}
SELECT cell_id, CAST(alt_mean AS DOUBLE) AS alt_mean, CAST(tmean AS DOUBLE) AS tmean, hot_days, landform_type FROM x
WHERE (tmean >= 5 AND NOT landform_type IN ('munte', 'deal')) OR alt_mean < 200 OR hot_days > 120""")
def _(t):
    out = cells_where(_atlas(t), WARM_OR_LOW)
    return out.select("cell_id", F.when(~F.isnan("alt_mean"), F.col("alt_mean")).cast("double").alias("alt_mean"), F.col("tmean").cast("double").alias("tmean"),
                      "hot_days", "landform_type")


@query("x01_conjunction_under_not", "core env climate", f"""{_WIDE}
SELECT cell_id FROM x WHERE NOT (hot_days <= 30 OR (slope_mean < 3 AND county_mn IN ('FRANCE', 'CHINA', 'BRAZIL')))""")
def _(t):
    tree = Not(Or((Compare("hot_days", "<=", 30), And((Between("slope_mean", None, 3), In("county_mn", ("FRANCE", "CHINA", "BRAZIL")))))))
    return cells_where(_atlas(t), tree).select("cell_id")


_RING = ((3200.0, 1200.0), (33700.0, 4100.0), (21900.0, 30300.0), (15100.0, 9900.0), (5050.0, 26040.0))
_IN_RING = " + ".join(
    f"(CASE WHEN ({a[1]} > y) <> ({b[1]} > y) AND x < ({b[0]} - {a[0]}) * (y - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]} THEN 1 ELSE 0 END)"
    for a, b in zip(_RING, _RING[1:] + _RING[:1]))


@query("x04_polygon_or_radius", "core env climate", f"""{_WIDE}
SELECT cell_id, x, y FROM x WHERE (({_IN_RING}) % 2 = 1 AND dist_km >= 2) OR POWER(x - 20500, 2) + POWER(y - 20500, 2) <= 5000.0 * 5000""")
def _(t):
    tree = Or((And((Polygon(_RING), Compare("dist_km", ">=", 2.0))), Radius(20500, 20500, 5000)))
    return cells_where(_atlas(t), tree).select("cell_id", "x", "y")


_MEASURES = [Measure("people", "sum", "pop_total"), Measure("cells", "count_cells"), Measure("mean_alt", "mean", "alt_mean"),
             Measure("felt_alt", "weighted_mean", "alt_mean", "pop_total"), Measure("top_slope", "max", "slope_mean"), Measure("low_slope", "min", "slope_mean")]
_AGGS = """COALESCE(SUM(pop_total), 0)::BIGINT AS people, COUNT(*) AS cells, ROUND(AVG(alt_mean::DOUBLE), 6) AS mean_alt,
  ROUND(SUM(alt_mean::DOUBLE * pop_total) / NULLIF(SUM(pop_total) FILTER (alt_mean IS NOT NULL), 0), 6) AS felt_alt,
  MAX(slope_mean)::DOUBLE AS top_slope, MIN(slope_mean)::DOUBLE AS low_slope"""


def _told(df, *names):
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


@query("x03_measures_of_a_tree", "core env climate", f"""{_WIDE}
SELECT {_AGGS}, ROUND(QUANTILE_CONT(alt_mean::DOUBLE, 0.9), 6) AS alt_p90 FROM x
WHERE (tmean >= 5 AND NOT landform_type IN ('munte', 'deal')) OR alt_mean < 200 OR hot_days > 120""")
def _(t):
    out = answer(_atlas(t), WARM_OR_LOW, [*_MEASURES, Measure("alt_p90", "quantile", "alt_mean", q=0.9)])
    return _told(out, "mean_alt", "felt_alt", "alt_p90").withColumns({c: F.col(c).cast("double") for c in ("top_slope", "low_slope")})


@query("x02_breakdown_with_totals", "core env climate", f"""{_WIDE}
SELECT region_name, county_mn, {_AGGS}, (CASE WHEN GROUPING(region_name) = 1 THEN 0 WHEN GROUPING(county_mn) = 1 THEN 1 ELSE 2 END)::INT AS level
FROM x WHERE slope_mean < 9 OR hot_days > 60 GROUP BY ROLLUP (region_name, county_mn)""")
def _(t):
    out = answer(_atlas(t), Or((Compare("slope_mean", "<", 9.0), Compare("hot_days", ">", 60))), _MEASURES, ("region_name", "county_mn"), totals=True)
    return _told(out, "mean_alt", "felt_alt").withColumns({c: F.col(c).cast("double") for c in ("top_slope", "low_slope")}).withColumnRenamed("_level", "level")


# --- disclosure --------------------------------------------------------------------------------------------

_CELLS, _PEOPLE = 6, 40
_HIDE = """
, c AS (SELECT region_name, county_mn, pop_65p, pop_65p BETWEEN 1 AND 2 AS sdc FROM core JOIN env USING (cell_id) JOIN climate USING (cell_id) WHERE hot_days >= 84 AND slope_mean < 4),
t2 AS (SELECT region_name, county_mn, COUNT(*) AS n, SUM(pop_65p)::BIGINT AS value, BOOL_OR(sdc) AS touched FROM c GROUP BY 1, 2),
t1 AS (SELECT region_name, SUM(n) AS n, SUM(value) AS value, BOOL_OR(touched) AS touched FROM t2 GROUP BY 1),
t0 AS (SELECT COALESCE(SUM(n), 0) AS n, COALESCE(SUM(value), 0) AS value, COALESCE(BOOL_OR(touched), false) AS touched FROM t1),
a2 AS (SELECT *, n < 6 OR value < 40 AS hid FROM t2),
b2 AS (SELECT *, ROW_NUMBER() OVER w AS r, SUM(hid::INT) OVER (PARTITION BY region_name) AS h, SUM(n) OVER w AS cn, SUM(value) OVER w AS cv FROM a2
  WINDOW w AS (PARTITION BY region_name ORDER BY hid DESC, value, county_mn ROWS UNBOUNDED PRECEDING)),
c2 AS (SELECT *, MIN(r) FILTER (r >= GREATEST(h, 2) AND cn >= 6 AND cv >= 40) OVER (PARTITION BY region_name) AS m FROM b2),
d2 AS (SELECT region_name, county_mn, n, value, touched, h > 0 AND (m IS NULL OR r <= m) AS hid, h > 0 AND m IS NULL AS short FROM c2),
a1 AS (SELECT t1.*, n < 6 OR value < 40 OR (SELECT BOOL_OR(short) FROM d2 WHERE d2.region_name = t1.region_name) AS hid FROM t1),
b1 AS (SELECT *, ROW_NUMBER() OVER w AS r, SUM(hid::INT) OVER () AS h, SUM(n) OVER w AS cn, SUM(value) OVER w AS cv FROM a1
  WINDOW w AS (ORDER BY hid DESC, value, region_name ROWS UNBOUNDED PRECEDING)),
c1 AS (SELECT *, MIN(r) FILTER (r >= GREATEST(h, 2) AND cn >= 6 AND cv >= 40) OVER () AS m FROM b1),
d1 AS (SELECT region_name, n, value, touched, h > 0 AND (m IS NULL OR r <= m) AS hid, h > 0 AND m IS NULL AS short FROM c1),
e0 AS (SELECT *, n < 6 OR value < 40 OR COALESCE((SELECT BOOL_OR(short) FROM d1), false) AS hid FROM t0),
e1 AS (SELECT region_name, n, value, touched, hid OR ((SELECT hid FROM e0) AND NOT BOOL_OR(hid) OVER () AND ROW_NUMBER() OVER (ORDER BY value, region_name) = 1) AS hid FROM d1),
e2 AS (SELECT d2.region_name, county_mn, d2.n, d2.value, d2.touched, d2.hid OR (e1.hid AND NOT BOOL_OR(d2.hid) OVER (PARTITION BY d2.region_name)
  AND ROW_NUMBER() OVER (PARTITION BY d2.region_name ORDER BY d2.value, county_mn) = 1) AS hid FROM d2 JOIN e1 USING (region_name)),
u AS (SELECT 0 AS level, NULL AS region_name, NULL AS county_mn, n, value, hid, touched FROM e0 UNION ALL
  SELECT 1, region_name, NULL, n, value, hid, touched FROM e1 UNION ALL SELECT 2, region_name, county_mn, n, value, hid, touched FROM e2)
SELECT level, region_name, county_mn, CASE WHEN NOT hid THEN n::BIGINT END AS n, CASE WHEN NOT hid THEN value::BIGINT END AS value, hid AS hidden, touched AS approximate FROM u"""


@query("x05_disclosure_control", "core env climate", _HIDE)
def _(t):
    cells = t.core.join(t.env, "cell_id").join(t.climate, "cell_id").filter("hot_days >= 84 and slope_mean < 4").withColumn("sdc", F.col("pop_65p").between(1, 2))
    levels = ["region_name", "county_mn"]
    return disclosure.protect(disclosure.nested_totals(cells, levels, "pop_65p", "sdc"), levels, _CELLS, _PEOPLE)
