"""Grid arithmetic, polygon and point joins, coverage, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projection as P
from ..model import GridSpec
from ..operators import cells as G
from ..operators import cover as V
from ..operators import spatial as S
from .base import query

TILE = V.Lattice(0.0, 0.0, 1000.0)

_PIP = """hits AS (
SELECT p.cell_id, e.feature_id FROM points p JOIN edges e
  ON (e.y1 > p.y) <> (e.y2 > p.y)
GROUP BY 1, 2 HAVING SUM(CASE WHEN p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) % 2 = 1)"""

_SEG = """SQRT(POWER(p.x - (e.x1 + tt * (e.x2 - e.x1)), 2) + POWER(p.y - (e.y1 + tt * (e.y2 - e.y1)), 2))"""
_NEAR = f"""segs AS (SELECT p.cell_id, e.feature_id, {_SEG} AS dist FROM (
  SELECT p, e, GREATEST(0.0, LEAST(1.0, ((p.x - e.x1) * (e.x2 - e.x1) + (p.y - e.y1) * (e.y2 - e.y1))
     / (POWER(e.x2 - e.x1, 2) + POWER(e.y2 - e.y1, 2)))) AS tt
  FROM {{pts}} p JOIN edges e ON e.x1 BETWEEN p.x - 12000 AND p.x + 12000 AND e.y1 BETWEEN p.y - 12000 AND p.y + 12000) z)"""


def _edges(t):
    return t.edges


@query("g01_grid_numbering", "core", """
SELECT cell_id, CAST(FLOOR(cell_id / 40) AS BIGINT) AS row, cell_id % 40 AS col,
       4000000 + (cell_id % 40) * 1000 AS e, 3000000 - (CAST(FLOOR(cell_id / 40) AS BIGINT) + 1) * 1000 AS n FROM core""")
def _(t):
    spec = GridSpec(4000000, 2000000, 40, 1000)
    row, col = G.row_col(F.col("cell_id"), spec.ncols)
    e, n = G.corner(spec, F.col("cell_id"))
    return t.core.select("cell_id", row.alias("row"), col.alias("col"), e.alias("e"), n.alias("n"))


@query("g02_cell_centroid", "core", """
SELECT cell_id, 4000000 + (cell_id % 40) * 1000 + 500.0::DOUBLE AS x, 3000000 - (CAST(FLOOR(cell_id / 40) AS BIGINT) + 1) * 1000 + 500.0::DOUBLE AS y FROM core""")
def _(t):
    e, n = G.corner(GridSpec(4000000, 2000000, 40, 1000), F.col("cell_id"))
    x, y = G.centroid(e, n)
    return t.core.select("cell_id", x.alias("x"), y.alias("y"))


_LL = "SELECT s_suppkey AS id, 20.0 + (s_suppkey * 7919 % 1000) / 100.0 AS lon, 43.0 + (s_suppkey * 104729 % 600) / 100.0 AS lat FROM supplier"
_FWD = f"""k AS (SELECT {P.ECC!r}::DOUBLE AS ec, {P.E2!r}::DOUBLE AS e2, {P.QP!r}::DOUBLE AS qp, {P.RQ!r}::DOUBLE AS rq, {P.D!r}::DOUBLE AS d, {P.BETA1!r}::DOUBLE AS b1),
ll AS (SELECT id, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat, sin(radians(CAST(lat AS DOUBLE))) AS s FROM ({_LL}) z),
q AS (SELECT *, asin((1 - e2) * (s / (1 - e2 * s * s) - ln((1 - ec * s) / (1 + ec * s)) / (2 * ec)) / qp) AS be, radians(lon - 10) AS dl FROM ll CROSS JOIN k),
b AS (SELECT *, rq * sqrt(2 / (1 + sin(b1) * sin(be) + cos(b1) * cos(be) * cos(dl))) AS bb FROM q),
fw AS (SELECT id, lon, lat, 4321000 + bb * d * cos(be) * sin(dl) AS e, 3210000 + bb / d * (cos(b1) * sin(be) - sin(b1) * cos(be) * cos(dl)) AS n FROM b)"""


@query("g03_projection", "", f"""
WITH {_FWD} SELECT id, ROUND(e, 2) AS e, ROUND(n, 2) AS n, ROUND(lon, 6) AS lon_back, ROUND(lat, 6) AS lat_back,
 ROUND(radians(lon) * 6378137, 2) AS mx, ROUND(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 2) AS my FROM fw""")
def _(t):
    ll = t.sql(_LL).select("id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    e, n = P.lonlat_to_laea(F.col("lon"), F.col("lat"))
    en = ll.withColumns({"e": e, "n": n})
    lon, lat = P.laea_to_lonlat(F.col("e"), F.col("n"))
    return en.select("id", F.round("e", 2).alias("e"), F.round("n", 2).alias("n"), F.round(lon, 6).alias("lon_back"),
                     F.round(lat, 6).alias("lat_back"), F.round(P.lon_to_mercator(F.col("lon")), 2).alias("mx"),
                     F.round(P.lat_to_mercator(F.col("lat")), 2).alias("my"))


@query("g04_points_to_cells", "", f"""
WITH {_FWD}, c AS (SELECT id, FLOOR((e - 5100000) / 1000) AS col, FLOOR((2900000 - n) / 1000) AS row FROM fw)
SELECT id, CASE WHEN col >= 0 AND col < 700 AND row >= 0 AND row < 500 THEN CAST(row * 700 + col AS BIGINT) END AS cell_id FROM c""")
def _(t):
    spec = GridSpec(5100000, 2400000, 700, 500)
    e, n = P.lonlat_to_laea(F.col("lon").cast("double"), F.col("lat").cast("double"))
    return t.sql(_LL).select("id", G.cell_of_point(spec, e, n).alias("cell_id"))


@query("g05_cell_ring", "core", """
WITH c AS (SELECT cell_id, 4000000 + (cell_id % 40) * 1000 AS e, 3000000 - (CAST(FLOOR(cell_id / 40) AS BIGINT) + 1) * 1000 AS n FROM core)
SELECT cell_id, CAST(k AS INT) AS pos, CAST(e + CASE WHEN k IN (1, 2) THEN 1000 ELSE 0 END AS DOUBLE) AS x,
       CAST(n + CASE WHEN k IN (0, 1, 4) THEN 1000 ELSE 0 END AS DOUBLE) AS y
FROM c CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(k)""")
def _(t):
    ring = G.cell_ring(GridSpec(4000000, 2000000, 40, 1000), F.col("cell_id"))
    return t.core.select("cell_id", F.posexplode(ring).alias("pos", "p")).select("cell_id", "pos", "p.x", "p.y")


# --- polygon joins ---------------------------------------------------------------------------

@query("j05_point_in_polygon_first", "points edges",
       f"WITH {_PIP} SELECT points.cell_id, MIN(feature_id) AS feature_id FROM points LEFT JOIN hits ON hits.cell_id = points.cell_id GROUP BY 1")
def _(t):
    return S.first_polygon(t.points, _edges(t))


@query("j06_point_in_polygon_all", "points edges", f"WITH {_PIP} SELECT cell_id, feature_id FROM hits")
def _(t):
    return S.points_in_polygons(t.points, _edges(t))


@query("j07_nearest_polygon_fallback", "points edges", f"""
WITH {_PIP}, missing AS (SELECT * FROM points WHERE cell_id NOT IN (SELECT cell_id FROM hits)),
{_NEAR.format(pts='missing')},
near AS (SELECT cell_id, MIN(dist) AS d FROM segs WHERE dist <= 5000 GROUP BY 1),
nf AS (SELECT s.cell_id, MIN(s.feature_id) AS feature_id FROM segs s JOIN near n ON n.cell_id = s.cell_id AND s.dist <= n.d + 1e-9 GROUP BY 1)
SELECT p.cell_id, COALESCE(h.f, nf.feature_id) AS feature_id, CASE WHEN h.f IS NOT NULL THEN 'within' WHEN nf.feature_id IS NOT NULL THEN 'nearest' END AS how
FROM points p LEFT JOIN (SELECT cell_id, MIN(feature_id) AS f FROM hits GROUP BY 1) h ON h.cell_id = p.cell_id LEFT JOIN nf ON nf.cell_id = p.cell_id""")
def _(t):
    return S.assign_polygons(t.points, _edges(t))


_KNN = """d AS (SELECT p.cell_id, s.site_id, s.name, POWER(p.x - s.x, 2) + POWER(p.y - s.y, 2) AS d2 FROM points p CROSS JOIN sites s WHERE {where}),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY d2, site_id) AS rk FROM d)"""


@query("j08_nearest_site", "points sites", f"""
WITH {_KNN.format(where='s.active = 1')} SELECT cell_id, ROUND(SQRT(d2) / 1000, 6) AS dist_km, name FROM r WHERE rk = 1""")
def _(t):
    out = S.nearest_with_label(t.points, t.sites.filter("active = 1"), "name")
    return out.withColumn("dist_km", F.round("dist_km", 6))


@query("j08_nearest_site_with_ties", "points sites", """
WITH s2 AS (SELECT site_id, x, y FROM sites UNION ALL SELECT site_id + 1000000, x, y FROM sites),
d AS (SELECT p.cell_id, s.site_id, POWER(p.x - s.x, 2) + POWER(p.y - s.y, 2) AS d2 FROM points p CROSS JOIN s2 s),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY d2, site_id) AS rk FROM d) SELECT cell_id, site_id FROM r WHERE rk = 1""")
def _(t):
    sites = t.sites.select("site_id", "x", "y")
    twice = sites.unionByName(sites.withColumn("site_id", F.col("site_id") + 1000000))
    return S.nearest_sites(t.points, twice).select("cell_id", "site_id")


@query("j09_k_nearest_candidates", "points sites", f"""
WITH {_KNN.format(where='TRUE')} SELECT cell_id, site_id, CAST(rk AS INT) AS rank, ROUND(SQRT(d2), 4) AS dist FROM r WHERE rk <= 6""")
def _(t):
    near = S.nearest_sites(t.points, t.sites, 6)
    return near.select("cell_id", "site_id", "rank", F.round(F.sqrt("d2"), 4).alias("dist"))


@query("j17_distance_within", "points edges", f"""
WITH {_NEAR.format(pts='points')} SELECT DISTINCT cell_id FROM segs WHERE dist <= 1500""")
def _(t):
    return S.points_near_lines(t.points, _edges(t), 1500.0)


@query("j20_interior_point", "vertices edges", """
WITH px AS (SELECT feature_id, r * 250 + 125 AS cy, r, c, c * 250 + 125 AS cx FROM (
   SELECT feature_id, CAST(FLOOR(MIN(y) / 250) AS BIGINT) AS r0, CAST(FLOOR(MAX(y) / 250) AS BIGINT) AS r1,
          CAST(FLOOR(MIN(x) / 250) AS BIGINT) AS c0, CAST(FLOOR(MAX(x) / 250) AS BIGINT) AS c1 FROM vertices GROUP BY 1) b,
   LATERAL (SELECT unnest(range(r0, r1 + 1)) AS r) rr, LATERAL (SELECT unnest(range(c0, c1 + 1)) AS c) cc),
ins AS (SELECT px.feature_id, r, c FROM px JOIN edges e ON e.feature_id = px.feature_id AND (e.y1 > cy) <> (e.y2 > cy) GROUP BY 1, 2, 3
  HAVING SUM(CASE WHEN MIN(cx) < (e.x2 - e.x1) * (cy - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) % 2 = 1),
isl AS (SELECT feature_id, r, c, c - ROW_NUMBER() OVER (PARTITION BY feature_id, r ORDER BY c) AS g FROM ins),
runs AS (SELECT feature_id, r, MIN(c) AS c0, MAX(c) - MIN(c) AS len FROM isl GROUP BY feature_id, r, g),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY feature_id ORDER BY len DESC, r, c0) AS k FROM runs)
SELECT feature_id, CAST((c0 + FLOOR(len / 2) + 0.5) * 250.0 AS DOUBLE) AS x, CAST((r + 0.5) * 250.0 AS DOUBLE) AS y FROM best WHERE k = 1""".replace(
    "SUM(CASE WHEN MIN(cx) <", "SUM(CASE WHEN c * 250 + 125 <").replace("(cy - e.y1)", "(r * 250 + 125 - e.y1)"))
def _(t):
    return S.interior_points(_edges(t), V.Lattice(0.0, 0.0, 250.0))


@query("j20_exactly_one_lookup", "", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_name = 'Supplier#000000007'")
def _(t):
    return S.exactly_one(t.base("supplier"), F.col("s_name") == "Supplier#000000007", "unit").select("s_suppkey", "s_nationkey")


# --- coverage --------------------------------------------------------------------------------

_CENTRE = """px AS (SELECT feature_id, r, c FROM (SELECT feature_id, CAST(FLOOR(MIN(y) / 1000) AS BIGINT) AS r0, CAST(FLOOR(MAX(y) / 1000) AS BIGINT) AS r1,
   CAST(FLOOR(MIN(x) / 1000) AS BIGINT) AS c0, CAST(FLOOR(MAX(x) / 1000) AS BIGINT) AS c1 FROM vertices GROUP BY 1) b,
   LATERAL (SELECT unnest(range(r0, r1 + 1)) AS r) rr, LATERAL (SELECT unnest(range(c0, c1 + 1)) AS c) cc),
ins AS (SELECT px.feature_id, r, c FROM px JOIN edges e ON e.feature_id = px.feature_id AND (e.y1 > r * 1000 + 500) <> (e.y2 > r * 1000 + 500)
  GROUP BY 1, 2, 3 HAVING SUM(CASE WHEN c * 1000 + 500 < (e.x2 - e.x1) * (r * 1000 + 500 - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) % 2 = 1)"""


@query("g06_pixel_centre_coverage", "vertices edges", f"""
WITH {_CENTRE} SELECT r AS prow, c AS pcol, MAX(feature_id) AS feature_id FROM ins GROUP BY 1, 2""")
def _(t):
    return V.burn(V.interior_pixels(_edges(t), TILE), "feature_id")


_TOUCH = """tch AS (SELECT DISTINCT e.feature_id, px.r, px.c FROM px JOIN edges e ON e.feature_id = px.feature_id
 CROSS JOIN LATERAL (SELECT (px.c * 1000 - e.x1) AS ax, (px.c * 1000 + 1000 - e.x1) AS bx, (px.r * 1000 - e.y1) AS ay, (px.r * 1000 + 1000 - e.y1) AS cy, e.x2 - e.x1 AS dx, e.y2 - e.y1 AS dy) g
 CROSS JOIN LATERAL (SELECT CASE WHEN dx = 0 THEN CASE WHEN ax <= 0 AND bx > 0 THEN 0.0 ELSE 2.0 END ELSE LEAST(ax / dx, bx / dx) END AS tx0,
   CASE WHEN dx = 0 THEN CASE WHEN ax <= 0 AND bx > 0 THEN 1.0 ELSE -1.0 END ELSE GREATEST(ax / dx, bx / dx) END AS tx1,
   CASE WHEN dy = 0 THEN CASE WHEN ay <= 0 AND cy > 0 THEN 0.0 ELSE 2.0 END ELSE LEAST(ay / dy, cy / dy) END AS ty0,
   CASE WHEN dy = 0 THEN CASE WHEN ay <= 0 AND cy > 0 THEN 1.0 ELSE -1.0 END ELSE GREATEST(ay / dy, cy / dy) END AS ty1) q
 WHERE GREATEST(tx0, ty0, 0.0) <= LEAST(tx1, ty1, 1.0))"""


@query("g07_all_touched_coverage", "vertices edges", f"""
WITH {_CENTRE}, {_TOUCH} SELECT feature_id, r AS prow, c AS pcol FROM (SELECT feature_id, r, c FROM ins UNION SELECT feature_id, r, c FROM tch) u""")
def _(t):
    return V.touched_pixels(_edges(t), TILE)


@query("g15_dissolve_lines", "edges vertices", """
SELECT nation_key, COUNT(*) AS n_edges, ROUND(SUM(SQRT(POWER(x2 - x1, 2) + POWER(y2 - y1, 2))), 4) AS length
FROM edges JOIN (SELECT s_suppkey, s_nationkey AS nation_key FROM supplier) s ON s_suppkey = feature_id GROUP BY 1""")
def _(t):
    # Dissolving for distances only needs the common key; the edges stay rows.
    key = t.base("supplier").select(F.col("s_suppkey").alias("feature_id"), F.col("s_nationkey").alias("nation_key"))
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    return _edges(t).join(key, "feature_id").groupBy("nation_key").agg(
        F.count(F.lit(1)).alias("n_edges"), F.round(F.sum(length), 4).alias("length"))


@query("g21_feature_bounds", "vertices", """
SELECT s_nationkey AS nation_key, CAST(MIN(x) AS DOUBLE) AS minx, CAST(MIN(y) AS DOUBLE) AS miny, CAST(MAX(x) AS DOUBLE) AS maxx, CAST(MAX(y) AS DOUBLE) AS maxy
FROM vertices JOIN supplier ON s_suppkey = feature_id GROUP BY 1""")
def _(t):
    key = t.base("supplier").select(F.col("s_suppkey").alias("feature_id"), F.col("s_nationkey").alias("nation_key"))
    return V.feature_bounds(t.vertices.join(key, "feature_id"), ["nation_key"])


@query("src06_vector_edges", "vertices edges", "SELECT feature_id, x1, y1, x2, y2 FROM edges")
def _(t):
    from ..sources.vectors import wkt_edges

    ring = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))),
                                    lambda p: F.concat_ws(" ", p["x"], p["y"])), ", ")
    closed = F.concat(F.lit("POLYGON (("), ring, F.lit(", "),
                      F.min_by(F.concat_ws(" ", "x", "y"), "seq"), F.lit("))"))
    wkt = t.vertices.groupBy("feature_id").agg(closed.alias("wkt"))
    return wkt_edges(wkt, "wkt", ["feature_id"]).select("feature_id", "x1", "y1", "x2", "y2")
