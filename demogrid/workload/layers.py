"""Whole layer steps: from features to one row per cell, with the published column names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import GridSpec
from ..plans import steps as P
from ..sources.tables import assemble
from .base import BINDINGS, DEPENDS, ORACLES, query
from .raster import GRAD

# The test polygons moved off the pixel lines, so that no vertex lies on a pixel border.
BINDINGS["shapes"] = "SELECT feature_id, x1 + 7 AS x1, y1 + 9 AS y1, x2 + 7 AS x2, y2 + 9 AS y2 FROM edges"
DEPENDS["shapes"] = ("vertices", "edges")

_FINE = """px AS (SELECT feature_id, r, c FROM (SELECT feature_id, CAST(FLOOR(MIN(LEAST(y1, y2)) / {s}) AS BIGINT) AS r0, CAST(FLOOR(MAX(GREATEST(y1, y2)) / {s}) AS BIGINT) AS r1,
   CAST(FLOOR(MIN(LEAST(x1, x2)) / {s}) AS BIGINT) AS c0, CAST(FLOOR(MAX(GREATEST(x1, x2)) / {s}) AS BIGINT) AS c1 FROM shapes GROUP BY 1) b,
   LATERAL (SELECT unnest(range(r0, r1 + 1)) AS r) rr, LATERAL (SELECT unnest(range(c0, c1 + 1)) AS c) cc
   WHERE c BETWEEN 0 AND 40 * 1000 // {s} - 1 AND r BETWEEN 0 AND (SELECT MAX(row) + 1 FROM core) * 1000 // {s} - 1)"""
_IN = """ins AS (SELECT px.feature_id, r, c FROM px JOIN shapes e ON e.feature_id = px.feature_id AND (e.y1 > r * {s} + {h}) <> (e.y2 > r * {s} + {h})
  GROUP BY 1, 2, 3 HAVING SUM(CASE WHEN c * {s} + {h} < (e.x2 - e.x1) * (r * {s} + {h} - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) % 2 = 1)"""
_TCH = """tch AS (SELECT DISTINCT e.feature_id, px.r, px.c FROM px JOIN shapes e ON e.feature_id = px.feature_id
 AND px.r BETWEEN FLOOR(LEAST(e.y1, e.y2) / {s}) AND FLOOR(GREATEST(e.y1, e.y2) / {s}) AND px.c BETWEEN FLOOR(LEAST(e.x1, e.x2) / {s}) AND FLOOR(GREATEST(e.x1, e.x2) / {s})
 CROSS JOIN LATERAL (SELECT (px.c * {s} - e.x1) AS ax, (px.c * {s} + {s} - e.x1) AS bx, (px.r * {s} - e.y1) AS ay, (px.r * {s} + {s} - e.y1) AS cy, e.x2 - e.x1 AS dx, e.y2 - e.y1 AS dy) g
 WHERE GREATEST(CASE WHEN dx = 0 THEN 0.0 ELSE LEAST(ax / dx, bx / dx) END, CASE WHEN dy = 0 THEN 0.0 ELSE LEAST(ay / dy, cy / dy) END, 0.0)
    <= LEAST(CASE WHEN dx = 0 THEN 1.0 ELSE GREATEST(ax / dx, bx / dx) END, CASE WHEN dy = 0 THEN 1.0 ELSE GREATEST(ay / dy, cy / dy) END, 1.0))"""
_F100 = _FINE.format(s=100)
_IN100 = _IN.format(s=100, h=50)
_TCH100 = _TCH.format(s=100)
_USES = "core vertices edges shapes"


def _grid(t):
    """The test grid as a numbered cell table; rows are counted from the north."""
    nrows = t.core.agg(F.max("row")).first()[0] + 1
    spec = GridSpec(0, 0, 40, nrows)
    cells = t.core.select("cell_id", "row", "col", (F.col("col") * 1000).alias("e"), ((nrows - 1 - F.col("row")) * 1000).alias("n"))
    flipped = t.shapes.withColumns({"y1": spec.n_top - F.col("y1"), "y2": spec.n_top - F.col("y2")})
    return cells, spec, flipped


def _attrs(t):
    s = t.base("supplier")
    return s.select(F.col("s_suppkey").alias("feature_id"), F.col("s_nationkey").alias("k"), "s_name", "s_acctbal")


def _units(t):
    k = F.col("k") % 3
    code = F.col("k").cast("string")
    return _attrs(t).select(
        "feature_id", F.col("feature_id").alias("natCode"), F.col("s_name").alias("name"), F.when(k == 0, "Comuna").when(k == 1, "Oras").otherwise("?").alias("natLevName"),
        code.alias("countyMn"), code.alias("county"), code.alias("region"))


@query("layer_administrative_units", _USES, """
WITH p AS (SELECT cell_id, col * 1000 + 500 AS x, row * 1000 + 500 AS y FROM core),
hits AS (SELECT p.cell_id, e.feature_id FROM p JOIN shapes e ON (e.y1 > p.y) <> (e.y2 > p.y) GROUP BY 1, 2
 HAVING SUM(CASE WHEN p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) % 2 = 1),
f AS (SELECT cell_id, MIN(feature_id) AS f FROM hits GROUP BY 1),
sg AS (SELECT cell_id, feature_id, POWER(x - (x1 + u * (x2 - x1)), 2) + POWER(y - (y1 + u * (y2 - y1)), 2) AS d2 FROM (
  SELECT p.cell_id, p.x, p.y, e.*, GREATEST(0.0, LEAST(1.0, ((p.x - e.x1) * (e.x2 - e.x1) + (p.y - e.y1) * (e.y2 - e.y1)) / (POWER(e.x2 - e.x1, 2) + POWER(e.y2 - e.y1, 2)))) AS u
  FROM p JOIN shapes e ON ABS(e.x1 - p.x) < 12000 AND ABS(e.y1 - p.y) < 12000 WHERE p.cell_id NOT IN (SELECT cell_id FROM f)) z),
nr AS (SELECT cell_id, MIN(d2) AS d FROM sg WHERE d2 <= 25000000 GROUP BY 1),
nf AS (SELECT sg.cell_id, MIN(feature_id) AS f FROM sg JOIN nr ON nr.cell_id = sg.cell_id AND sg.d2 <= nr.d + 1e-6 GROUP BY 1),
a AS (SELECT p.cell_id, COALESCE(f.f, nf.f) AS f FROM p LEFT JOIN f ON f.cell_id = p.cell_id LEFT JOIN nf ON nf.cell_id = p.cell_id)
SELECT a.cell_id, CAST(s_suppkey AS INT) AS siruta, CASE WHEN s_nationkey % 3 = 0 THEN 'comună' WHEN s_nationkey % 3 = 1 THEN 'oraș' END AS uat_status,
 CASE WHEN s_nationkey % 3 = 0 THEN 'rural' WHEN s_nationkey % 3 = 1 THEN 'urban' END AS mediu FROM a LEFT JOIN supplier ON s_suppkey = a.f""")
def _(t):
    cells, spec, edges = _grid(t)
    units = _units(t)
    return P.admin(cells, spec, edges, units).select("cell_id", "siruta", "uat_status", "mediu")


_IN_UNIT = ORACLES["layer_administrative_units"][:ORACLES["layer_administrative_units"].rindex("SELECT a.cell_id")]


@query("layer_landform", _USES, None)
def _(t):
    """The lowest level is always named, the upper ones have gaps."""
    cells, spec, edges = _grid(t)
    k = F.col("k")
    forms = _attrs(t).select(
        "feature_id", F.col("s_name").alias("r_1name"), F.when(k % 2 == 0, "munte").otherwise("deal").alias("r_1type"),
        F.when(k % 5 == 0, F.concat(F.lit("top "), k.cast("string"))).alias("r_1j_lvl0_name"),
        F.when(k % 3 == 0, F.concat(F.lit("mid "), k.cast("string"))).alias("r_1j_lvl1_name"))
    return P.landform(cells, spec, edges, forms)


ORACLES["layer_landform"] = f"""{_IN_UNIT} SELECT a.cell_id, s_name AS landform_name, CASE WHEN s_nationkey % 2 = 0 THEN 'munte' WHEN s_nationkey IS NOT NULL THEN 'deal' END AS landform_type,
 CASE WHEN s_nationkey % 5 = 0 THEN 'top ' || CAST(s_nationkey AS VARCHAR) WHEN s_nationkey % 3 = 0 THEN 'mid ' || CAST(s_nationkey AS VARCHAR) ELSE s_name END AS landform_lvl0,
 CASE WHEN s_nationkey % 3 = 0 THEN 'mid ' || CAST(s_nationkey AS VARCHAR) ELSE s_name END AS landform_lvl1
FROM a LEFT JOIN supplier ON s_suppkey = a.f"""


_BLK = "r // 10 AS row, c // 10 AS col"


def _dominant_sql(cls: str, empty: bool = False) -> str:
    """Pixel counts per class and cell; ties to the higher class."""
    zero = "UNION ALL SELECT row, col, 0, 100 - SUM(n) FROM n GROUP BY 1, 2" if empty else ""
    return f"""b AS (SELECT r, c, MAX({cls}) AS class FROM ins JOIN supplier ON s_suppkey = feature_id GROUP BY 1, 2),
n AS (SELECT {_BLK}, class, COUNT(*) AS n FROM b GROUP BY 1, 2, 3), nn AS (SELECT * FROM n {zero}),
w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row, col ORDER BY n DESC, class DESC) AS k FROM nn)"""


@query("layer_built_up", _USES, f"""
WITH {_F100}, {_IN100}, {_dominant_sql('CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE 2 END')}
SELECT core.cell_id, CASE w.class WHEN 1 THEN 'sat' WHEN 2 THEN 'oraș' END AS intravilan FROM core LEFT JOIN w ON w.row = core.row AND w.col = core.col AND w.k = 1""")
def _(t):
    cells, spec, edges = _grid(t)
    places = _attrs(t).select("feature_id", F.when(F.col("k") % 2 == 0, "Sat component").otherwise("Oras").alias("TipLocalitate"),
                              (F.col("s_acctbal") > 5000).cast("int").alias("conectata_gaz"))
    return P.built_up(cells, spec, edges, places).select("cell_id", "intravilan")


@query("layer_bear_risk", _USES, f"""
WITH {_F100}, {_IN100}, {_dominant_sql('s_nationkey % 3 + 1', empty=True)}
SELECT core.cell_id, CASE w.class WHEN 1 THEN 'Risc potențial' WHEN 2 THEN 'Risc mediu' WHEN 3 THEN 'Risc ridicat' END AS risc_urs
FROM core LEFT JOIN w ON w.row = core.row AND w.col = core.col AND w.k = 1""")
def _(t):
    cells, spec, edges = _grid(t)
    return P.bear_risk(cells, spec, edges, _attrs(t).select("feature_id", (F.col("k") % 3).alias("symbol")))


@query("layer_standing_water", _USES, f"""
WITH {_F100}, {_IN100}, q AS (SELECT r, c, s_suppkey, CASE WHEN s_nationkey = 0 THEN 1 WHEN s_nationkey = 1 THEN 3 ELSE 7 END AS class FROM ins JOIN supplier ON s_suppkey = feature_id),
b AS (SELECT r, c, class FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY r, c ORDER BY class <> 7 DESC, s_suppkey DESC) AS k FROM q) z WHERE k = 1),
d AS (SELECT core.cell_id, MIN((b.r - (row * 10 + 5)) * (b.r - (row * 10 + 5)) + (b.c - (col * 10 + 5)) * (b.c - (col * 10 + 5))) AS d2 FROM core CROSS JOIN b GROUP BY 1),
k AS (SELECT d.cell_id, d.d2, MIN(b.class) AS class FROM d JOIN core ON core.cell_id = d.cell_id JOIN b ON (b.r - (row * 10 + 5)) * (b.r - (row * 10 + 5)) + (b.c - (col * 10 + 5)) * (b.c - (col * 10 + 5)) = d.d2 GROUP BY 1, 2)
SELECT cell_id, ROUND(CAST(CAST(round_even(SQRT(d2) * 100 / 1000, 2) AS FLOAT) AS DOUBLE), 4) AS dist_water_km, CASE class WHEN 1 THEN 'Lac' WHEN 3 THEN 'Iaz' ELSE 'Alt tip' END AS categorie_apa FROM k""")
def _(t):
    cells, spec, edges = _grid(t)
    a = _attrs(t)
    lakes = a.select("feature_id", F.when(F.col("k") == 0, "Lac").when(F.col("k") == 1, "Iaz").when(F.col("k") == 2, "Braț mort").alias("categorie_ro"))
    w = P.water(cells, spec, edges, lakes)
    return w.withColumn("dist_water_km", F.round(F.col("dist_water_km").cast("double"), 4))


@query("layer_protected_areas", _USES, f"""
WITH {_F100}, {_IN100}, b AS (SELECT DISTINCT r, c FROM ins),
d AS (SELECT cell_id, MIN(POWER(GREATEST(0, row * 10 - r, r - (row * 10 + 9)), 2) + POWER(GREATEST(0, col * 10 - c, c - (col * 10 + 9)), 2)) AS d2 FROM core CROSS JOIN b GROUP BY 1)
SELECT cell_id, ROUND(CAST(CAST(round_even(SQRT(d2) * 100 / 1000, 2) AS FLOAT) AS DOUBLE), 4) AS dist_protected_km FROM d""")
def _(t):
    cells, spec, edges = _grid(t)
    w = P.protected_areas(cells, spec, edges)
    return w.withColumn("dist_protected_km", F.round(F.col("dist_protected_km").cast("double"), 4))


@query("layer_flood_zones", _USES, f"""
WITH {_F100}, {_IN100}, {_TCH100}, u AS (SELECT feature_id, r, c FROM ins UNION SELECT feature_id, r, c FROM tch),
b AS (SELECT r, c, MIN(s_nationkey % 3 + 1) AS class FROM u JOIN supplier ON s_suppkey = feature_id GROUP BY 1, 2),
g AS (SELECT cell_id, row, col, b.class, LEAST(GREATEST(r, row * 10), row * 10 + 9) AS pr, LEAST(GREATEST(c, col * 10), col * 10 + 9) AS pc, r, c FROM core CROSS JOIN b),
n AS (SELECT cell_id, class, POWER(r - pr, 2) + POWER(c - pc, 2) AS d2, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY POWER(r - pr, 2) + POWER(c - pc, 2), pr, pc, class) AS k,
   MIN(CASE WHEN r = pr AND c = pc THEN class END) OVER (PARTITION BY cell_id) AS present FROM g)
SELECT cell_id, ROUND(CAST(CAST(round_even(SQRT(d2) * 100 / 1000, 2) AS FLOAT) AS DOUBLE), 4) AS dist_inundatii_km,
 CASE COALESCE(present, class) WHEN 1 THEN '10% (~10 ani)' WHEN 2 THEN '1% (~100 ani)' ELSE '0,1% (~1.000 ani)' END AS scenariu_inundatii FROM n WHERE k = 1""")
def _(t):
    cells, spec, edges = _grid(t)
    zones = _attrs(t).select("feature_id", (F.col("k") % 3 + 1).alias("scenario"))
    w = P.floods(cells, spec, edges, zones)
    return w.withColumn("dist_inundatii_km", F.round(F.col("dist_inundatii_km").cast("double"), 4))


@query("layer_watercourses", _USES, f"""
WITH {_F100}, {_TCH100}, b AS (SELECT r, c, MAX(CASE WHEN s_nationkey % 3 = 0 THEN 1 ELSE 2 END) AS class FROM tch JOIN supplier ON s_suppkey = feature_id GROUP BY 1, 2),
d AS (SELECT core.cell_id, MIN((b.r - (row * 10 + 5)) * (b.r - (row * 10 + 5)) + (b.c - (col * 10 + 5)) * (b.c - (col * 10 + 5))) AS d2 FROM core CROSS JOIN b GROUP BY 1),
k AS (SELECT d.cell_id, d.d2, MIN(b.class) AS class FROM d JOIN core ON core.cell_id = d.cell_id JOIN b ON (b.r - (row * 10 + 5)) * (b.r - (row * 10 + 5)) + (b.c - (col * 10 + 5)) * (b.c - (col * 10 + 5)) = d.d2 GROUP BY 1, 2)
SELECT cell_id, ROUND(CAST(CAST(round_even(SQRT(d2) * 100 / 1000, 2) AS FLOAT) AS DOUBLE), 4) AS dist_curs_km, CASE class WHEN 1 THEN 'Râu' ELSE 'Pârâu' END AS categorie_curs FROM k""")
def _(t):
    cells, spec, edges = _grid(t)
    a = _attrs(t).withColumn("k", F.col("k") % 3)
    streams = a.select("feature_id", F.when(F.col("k") == 0, "Râu").when(F.col("k") == 1, "Pârâu").alias("categorie_ro"))
    w = P.watercourses(cells, spec, edges, streams)
    return w.withColumn("dist_curs_km", F.round(F.col("dist_curs_km").cast("double"), 4))


@query("layer_border_and_coast", _USES, f"""
WITH {_FINE.format(s=1000)}, {_TCH.format(s=1000)}, b AS (SELECT DISTINCT r, c, s_nationkey % 5 AS k FROM tch JOIN supplier ON s_suppkey = feature_id),
d AS (SELECT cell_id, k, MIN((r - row) * (r - row) + (c - col) * (c - col)) AS d2 FROM core CROSS JOIN b GROUP BY 1, 2),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY d2, k) AS i FROM d WHERE k > 0)
SELECT n.cell_id, ROUND(CAST(CAST(SQRT(n.d2) AS FLOAT) AS DOUBLE), 4) AS dist_border_km, 'N' || CAST(n.k AS VARCHAR) AS border_neighbor, ROUND(CAST(CAST(SQRT(c.d2) AS FLOAT) AS DOUBLE), 4) AS dist_coast_km
FROM n JOIN d c ON c.cell_id = n.cell_id AND c.k = 0 WHERE n.i = 1""")
def _(t):
    cells, spec, edges = _grid(t)
    k = F.col("k") % 5
    lines = _attrs(t).select("feature_id", F.when(k == 0, "RO.RO").otherwise(F.concat(F.lit("RO.N"), k.cast("string"))).alias("border"))
    b = P.border(cells, spec, edges, lines)
    return b.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("dist_border_km", "dist_coast_km")})


@query("layer_airports", _USES + " sites", """
WITH d AS (SELECT cell_id, s.site_id, s.name, s_nationkey, POWER(col * 1000 + 500 - s.x, 2) + POWER(row * 1000 + 500 - s.y, 2) AS d2 FROM core CROSS JOIN sites s),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY d2, site_id) AS k FROM d)
SELECT cell_id, ROUND(CAST(CAST(SQRT(d2) / 1000 AS FLOAT) AS DOUBLE), 4) AS dist_airport_km, name || CASE WHEN s_nationkey % 2 = 0 THEN ' (N' || CAST(s_nationkey AS VARCHAR) || ')' ELSE '' END AS nearest_airport FROM r WHERE k = 1""")
def _(t):
    cells, spec, _ = _grid(t)
    sites = t.sites.select("site_id", "name", F.lit(None).cast("string").alias("municipality"), "x", (spec.n_top - F.col("y")).alias("y"),
                           F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).alias("iata"))
    a = P.airports(cells, spec, sites)
    return a.withColumn("dist_airport_km", F.round(F.col("dist_airport_km").cast("double"), 4))


@query("layer_environment_table", "core sites", f"""
SELECT a.cell_id, a.siruta, a.uat_status, a.mediu, b.risc_urs, h.dist_hospital_km, h.nearest_hospital
FROM ({ORACLES["layer_administrative_units"]}) a JOIN ({ORACLES["layer_bear_risk"]}) b ON b.cell_id = a.cell_id
JOIN (SELECT cell_id, ROUND(CAST(CAST(SQRT(d2) / 1000 AS FLOAT) AS DOUBLE), 4) AS dist_hospital_km, name AS nearest_hospital FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY d2, site_id) AS k FROM (
    SELECT cell_id, site_id, name, POWER(col * 1000 + 500 - x, 2) + POWER(row * 1000 + 500 - y, 2) AS d2 FROM core CROSS JOIN sites WHERE active = 1) p) q WHERE k = 1) h ON h.cell_id = a.cell_id""")
def _(t):
    """Several layers assembled into one wide table, as the published environment table is."""
    cells, spec, edges = _grid(t)
    hosp = t.sites.select("site_id", F.col("name").alias("nume"), "active", "x", (spec.n_top - F.col("y")).alias("y"))
    parts = [P.admin(cells, spec, edges, _units(t)), P.bear_risk(cells, spec, edges, _attrs(t).select("feature_id", (F.col("k") % 3).alias("symbol"))),
             P.hospitals(cells, spec, hosp)]
    wide = assemble(parts, drop=("uat_name", "county_mn", "county_name", "region_name"))
    return wide.withColumn("dist_hospital_km", F.round(F.col("dist_hospital_km").cast("double"), 4))


@query("layer_crossings", _USES + " sites", """
WITH d AS (SELECT cell_id, s.site_id, s.name, POWER(col * 1000 + 500 - s.x, 2) + POWER(row * 1000 + 500 - s.y, 2) AS d2 FROM core CROSS JOIN sites s WHERE s_nationkey % 4 <> 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY d2, site_id) AS k FROM d)
SELECT cell_id, ROUND(CAST(CAST(SQRT(d2) / 1000 AS FLOAT) AS DOUBLE), 4) AS dist_crossing_km, name AS nearest_crossing FROM r WHERE k = 1""")
def _(t):
    """A quarter of the sites are inland ports, which the step leaves out."""
    cells, spec, _ = _grid(t)
    sites = t.sites.select("site_id", "name", "x", (spec.n_top - F.col("y")).alias("y"),
                           F.when(F.col("s_nationkey") % 4 == 3, "Dunărea interioară").otherwise("X").alias("border"))
    c = P.crossings(cells, spec, sites)
    return c.withColumn("dist_crossing_km", F.round(F.col("dist_crossing_km").cast("double"), 4))


@query("layer_terrain", "core raster", f"""
WITH {GRAD}, s AS (SELECT r.prow, r.pcol, r.value, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM raster r JOIN g ON g.prow = r.prow AND g.pcol = r.pcol),
b AS (SELECT prow // 10 AS row, pcol // 10 AS col, AVG(value) AS alt_mean, MIN(value) AS alt_min, MAX(value) AS alt_max, STDDEV_POP(value) AS alt_std,
  AVG(slope) AS slope_mean, MAX(slope) AS slope_max FROM s GROUP BY 1, 2)
SELECT cell_id, ROUND(alt_mean, 2) AS alt_mean, ROUND(alt_min, 2) AS alt_min, ROUND(alt_max, 2) AS alt_max, ROUND(alt_std, 2) AS alt_std,
 ROUND(slope_mean, 3) AS slope_mean, ROUND(slope_max, 3) AS slope_max FROM core LEFT JOIN b ON b.row = core.row AND b.col = core.col""")
def _(t):
    w = P.terrain(t.core.select("cell_id", "row", "col"), t.raster.select("prow", "pcol", "value"))
    digits = {"alt_mean": 2, "alt_min": 2, "alt_max": 2, "alt_std": 2, "slope_mean": 3, "slope_max": 3}
    return w.select("cell_id", *[F.round(F.col(c).cast("double"), d).alias(c) for c, d in digits.items()])


@query("layer_core_table", "core", """
SELECT cell_id, pop_total, pop_f, pop_m, CAST(CAST(col * 0.1 AS FLOAT) AS DOUBLE) AS lon, CAST(CAST(row * 0.1 AS FLOAT) AS DOUBLE) AS lat FROM core""")
def _(t):
    """Working columns are dropped, coordinates narrowed."""
    wide = t.core.select("cell_id", "pop_total", "pop_f", "pop_m", (F.col("col") * F.lit(0.1)).alias("lon"), (F.col("row") * F.lit(0.1)).alias("lat"),
                         F.lit("x").alias("grid_id"), F.lit(0).alias("e"), F.lit(0).alias("n"), F.lit(0).alias("pop_2018"))
    return P.core_table(wide).withColumns({c: F.col(c).cast("double") for c in ("lon", "lat")})
