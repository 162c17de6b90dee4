"""Reading and writing: census cells, views, assembly, immutable runs, retention, JSON, GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import projection as P
from ..operators import cells as G
from ..operators import measures as M
from ..session import scratch_path
from ..sources import tables as S
from ..sources import vectors as V
from .atlas import _stats_sql, rounded
from .base import query


def _census(t) -> DataFrame:
    """Census rows with grid ids and the source's own column names."""
    c = t.core
    gid = F.concat(F.lit("CRS3035RES1000mN"), (2900000 - F.col("row") * 1000).cast("string"), F.lit("E"), (5000000 + F.col("col") * 1000).cast("string"))
    names = {v: k for k, v in S.CENSUS_COLUMNS.items()}
    have = [x for x in c.columns if x in names]
    return c.select(gid.alias("GRD_ID"), *[F.col(x).alias(names[x]) for x in have])


@query("src01_cell_table_build", "core", """
SELECT cell_id, 'CRS3035RES1000mN' || CAST(2900000 - row * 1000 AS VARCHAR) || 'E' || CAST(5000000 + col * 1000 AS VARCHAR) AS grid_id, col, row,
 5000000 + col * 1000 AS e, 2900000 - row * 1000 AS n, CAST(pop_total AS INT) AS pop_total, CAST(pop_65p AS INT) AS pop_65p, isnan(pop_2011) AS no_2011 FROM core""")
def _(t):
    cells = S.build_cells(_census(t))
    return cells.select("cell_id", "grid_id", "col", "row", "e", "n", "pop_total", "pop_65p", F.isnan("pop_2011").alias("no_2011"))


@query("src01_cell_centres", "core", f"""
WITH k AS (SELECT (5000000 + col * 1000 + 500 - 4321000)::DOUBLE AS x, (2900000 - row * 1000 + 500 - 3210000)::DOUBLE AS y, cell_id,
  {P.D!r}::DOUBLE AS d, {P.RQ!r}::DOUBLE AS rq, {P.SIN_B1!r}::DOUBLE AS s1, {P.COS_B1!r}::DOUBLE AS c1 FROM core),
r AS (SELECT *, sqrt((x / d) * (x / d) + (d * y) * (d * y)) AS rho FROM k), c AS (SELECT *, 2 * asin(rho / (2 * rq)) AS ce FROM r),
b AS (SELECT *, asin(cos(ce) * s1 + d * y * sin(ce) * c1 / rho) AS be FROM c)
SELECT cell_id, ROUND(10 + degrees(atan2(x * sin(ce), d * rho * c1 * cos(ce) - d * d * y * s1 * sin(ce))), 6) AS lon,
 ROUND(degrees(be + {P.C2!r} * sin(2 * be) + {P.C4!r} * sin(4 * be) + {P.C6!r} * sin(6 * be)), 6) AS lat FROM b""")
def _(t):
    return S.build_cells(_census(t)).select("cell_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("src01_uniqueness_check", "core", "SELECT COUNT(*) - COUNT(DISTINCT cell_id) AS duplicates FROM core")
def _(t):
    return G.duplicate_keys(S.build_cells(_census(t))).agg(F.count(F.lit(1)).alias("duplicates"))


@query("f01_grid_id_parts", "core", "SELECT cell_id, 2900000 - row * 1000 AS n, 5000000 + col * 1000 AS e FROM core")
def _(t):
    return S.build_cells(_census(t)).select("cell_id", "n", "e")


@query("src02_column_pruned_scan", "", "SELECT c_custkey, c_mktsegment FROM customer")
def _(t):
    return S.load_columns(t.spark, f"{t.sf_dir}/customer.parquet", ["c_custkey", "c_mktsegment"])


@query("src03_named_views", "core env", "SELECT county_mn, CAST(SUM(pop_total) AS BIGINT) AS pop FROM core JOIN env USING (cell_id) GROUP BY 1")
def _(t):
    S.register_views(t.spark, {"v_core": t.core, "v_env": t.env})
    return t.spark.sql("SELECT county_mn, SUM(pop_total) AS pop FROM v_core JOIN v_env USING (cell_id) GROUP BY county_mn")


@query("src04_wide_table_assembly", "env climate", """
SELECT cell_id, county_mn, landform_type, ROUND(CAST(dist_km AS DOUBLE), 4) AS dist_km, CAST(ROUND(dist_hospital_km, 0) AS SMALLINT) AS hospital, risc_urs, n_days
FROM env LEFT JOIN climate USING (cell_id)""")
def _(t):
    env = t.env
    parts = [env.select("cell_id", "county_mn", "county_name"), env.select("cell_id", "landform_type"), env.select("cell_id", "dist_km"),
             env.select("cell_id", F.round("dist_hospital_km", 0).alias("hospital")), env.select("cell_id", "risc_urs")]
    wide = S.assemble(parts, optional=t.climate.select("cell_id", "n_days"), drop=("county_name",), types={"hospital": "smallint"})
    return rounded(wide.withColumn("dist_km", F.col("dist_km").cast("double")), "dist_km", places=4)


@query("src05_clustered_parquet", "core", "SELECT cell_id, pop_total, pop_f FROM core")
def _(t):
    path = scratch_path(t.spark, "core")
    S.write_clustered(t.core, path)
    return S.load_columns(t.spark, path, ["cell_id", "pop_total", "pop_f"])


@query("src07_geojson_points", "sites", "SELECT site_id, name, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM sites WHERE active = 1")
def _(t):
    path = scratch_path(t.spark, "sites")
    pts = t.sites.filter("active = 1").withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    V.write_geojson_lines(pts, path, "x", "y", ["site_id", "name"])
    return V.read_geojson_lines(t.spark, path, "site_id bigint, name string")


@query("src07_geojson_polygons", "vertices", """
SELECT feature_id, name, CAST(ring AS INT) AS ring, CAST(seq AS INT) AS seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM vertices
UNION ALL SELECT feature_id, name, CAST(ring AS INT), 6, CAST(x AS DOUBLE), CAST(y AS DOUBLE) FROM vertices WHERE seq = 0""")
def _(t):
    path = scratch_path(t.spark, "shapes")
    V.write_geojson_shapes(t.vertices, path, ["feature_id", "name"])
    return V.read_geojson_shapes(t.spark, path, "feature_id bigint, name string")


@query("pf14_feature_filters", "sites", "SELECT site_id, name FROM sites WHERE active = 1 AND s_nationkey <> 3")
def _(t):
    return t.sites.filter((F.col("active") == 1) & (F.col("s_nationkey") != 3)).select("site_id", "name")


@query("src14_json_rows", "env", f"""
SELECT variable, nulls, min, max FROM ({_stats_sql(['alt_mean', 'slope_mean'], 'env')}) s""")
def _(t):
    path = scratch_path(t.spark, "registry")
    stats = rounded(M.numeric_stats(t.env, ["alt_mean", "slope_mean"]), "min", "max", places=3)
    S.write_json_rows(stats, path)
    return t.spark.read.schema("variable string, nulls bigint, min double, max double").json(path)


@query("src15_immutable_publish", "daily", "SELECT 'written' AS first, 'unchanged' AS again, TRUE AS refused, COUNT(*) AS n FROM daily")
def _(t):
    path = scratch_path(t.spark, "run")
    daily = t.daily
    first, again = S.publish_immutable(daily, path), S.publish_immutable(daily, path)
    try:
        S.publish_immutable(daily.withColumn("tmax", F.col("tmax") + 1), path)
        refused = False
    except ValueError:
        refused = True
    return t.spark.read.parquet(path).agg(F.lit(first).alias("first"), F.lit(again).alias("again"), F.lit(refused).alias("refused"),
                                          F.count(F.lit(1)).alias("n"))


@query("u04_frame_equality", "core", "SELECT COUNT(*) AS n FROM core WHERE pop_f > 40")
def _(t):
    a = t.core.select("cell_id", "pop_f")
    b = a.withColumn("pop_f", F.least("pop_f", F.lit(40)))
    return S.differences(a, b).filter("side = 'left'").agg(F.count(F.lit(1)).alias("n"))


_RUNS = "SELECT event_type AS source, CAST(ts AS DATE) AS run, COUNT(*) AS n, MAX(event_id) AS attempt, SUM(value) > {v} AS ok FROM events GROUP BY 1, 2"


@query("src16_run_retention", "", f"""
WITH r AS ({_RUNS.format(v=0)}), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY CASE WHEN run = DATE '2024-01-03' THEN 0 ELSE 1 END, run DESC) AS k FROM r)
SELECT source, run, n FROM k WHERE k <= 4""")
def _(t):
    runs = t.sql(_RUNS.format(v=0)).select("source", "run", "n")
    return S.keep_runs(runs, F.col("run") == F.lit("2024-01-03").cast("date"))


@query("src18_last_good_fallback", "", """
WITH r AS (SELECT event_type AS source, CAST(ts AS DATE) AS run, MAX(event_id) AS attempt, MAX(value) > 250 AS ok FROM events GROUP BY 1, 2),
g AS (SELECT source, MAX(run) FILTER (ok) AS run, arg_max(ok, attempt) AS ok FROM r GROUP BY 1)
SELECT source, run, ok, CASE WHEN ok THEN 3 ELSE LEAST(3, GREATEST(0, (run + 2) - DATE '2024-01-30' + 1)) END::INT AS n_days FROM g WHERE run IS NOT NULL""")
def _(t):
    runs = t.base("events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("run")).agg(
        F.max("event_id").alias("attempt"), (F.max("value") > 250).alias("ok"))
    attempts = runs.withColumn("days", F.sequence("run", F.date_add("run", 2)))
    now = S.current_entries(attempts, F.lit("2024-01-30").cast("date")).filter(F.col("run").isNotNull())
    return now.select("source", "run", "ok", F.size("days").alias("n_days"))


