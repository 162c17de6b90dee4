"""Bindings: SQL that runs unchanged in Spark and in DuckDB and turns the driver's tables
into the inputs of the operators. They read whole tables, so the work grows with the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

NCOLS = 40  # columns of the test grid; cells are 1000 m wide, y grows with the row

BINDINGS: dict[str, str] = {}

# --- one cell per customer; people are counted in units of order value -------------------
BINDINGS["core"] = """
SELECT c_custkey AS cell_id, CAST(FLOOR(c_custkey / 40.0) AS BIGINT) AS row, c_custkey % 40 AS col,
       CAST(COALESCE(SUM(p), 0) AS BIGINT) AS pop_total,
       CAST(COALESCE(SUM(CASE WHEN st = 'F' THEN p ELSE 0 END), 0) AS BIGINT) AS pop_f,
       CAST(COALESCE(SUM(CASE WHEN st <> 'F' THEN p ELSE 0 END), 0) AS BIGINT) AS pop_m,
       CAST(COALESCE(SUM(CASE WHEN p < 15 THEN p ELSE 0 END), 0) AS BIGINT) AS pop_0_14,
       CAST(COALESCE(SUM(CASE WHEN p >= 15 AND p < 35 THEN p ELSE 0 END), 0) AS BIGINT) AS pop_15_64,
       CAST(COALESCE(SUM(CASE WHEN p >= 35 THEN p ELSE 0 END), 0) AS BIGINT) AS pop_65p,
       CAST(COALESCE(SUM(CASE WHEN st = 'O' THEN p ELSE 0 END), 0) AS BIGINT) AS pop_ocupata,
       CASE WHEN COUNT(p) = 0 THEN CAST('NaN' AS FLOAT) ELSE CAST(SUM(p) + 3 AS FLOAT) END AS pop_2011
FROM customer LEFT JOIN (
  SELECT o_custkey, o_orderstatus AS st, CAST(FLOOR(o_totalprice / 10000) AS BIGINT) AS p
  FROM orders) o ON o_custkey = c_custkey
GROUP BY c_custkey"""

BINDINGS["env"] = """
SELECT c_custkey AS cell_id, n_name AS county_mn, 'County of ' || n_name AS county_name,
       r_name AS region_name, c_name AS uat_name,
       CASE WHEN n_regionkey = 0 THEN 'comună' WHEN n_regionkey = 1 THEN 'oraș'
            WHEN n_regionkey = 2 THEN 'municipiu' WHEN n_regionkey = 3 THEN 'sector București' ELSE NULL END AS uat_status,
       CASE WHEN n_regionkey = 0 THEN 'rural' WHEN n_regionkey < 4 THEN 'urban' ELSE NULL END AS mediu,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'oraș' WHEN 'MACHINERY' THEN 'sat' WHEN 'HOUSEHOLD' THEN 'sat' ELSE NULL END AS intravilan,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'conectat' WHEN 'MACHINERY' THEN 'neconectat' ELSE NULL END AS acces_gaz,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'munte' WHEN 'AUTOMOBILE' THEN 'deal' WHEN 'MACHINERY' THEN 'câmpie'
            WHEN 'HOUSEHOLD' THEN 'vale' ELSE NULL END AS landform_type,
       r_name AS landform_lvl0,
       CASE WHEN c_acctbal < 0 THEN CAST('NaN' AS FLOAT) ELSE CAST(c_acctbal / 4 AS FLOAT) END AS alt_mean,
       CAST((c_custkey * 13 % 120) / 10.0 AS FLOAT) AS slope_mean,
       CAST((c_custkey * 7 % 300) / 10.0 AS FLOAT) AS dist_km,
       CAST((c_custkey * 11 % 700) / 10.0 AS FLOAT) AS dist_coast_km,
       CAST((c_custkey * 17 % 900) / 10.0 AS FLOAT) AS dist_border_km,
       CAST((c_custkey * 19 % 90) / 10.0 AS FLOAT) AS dist_water_km,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Lac' WHEN 'AUTOMOBILE' THEN 'Iaz' ELSE 'Alt tip' END AS categorie_apa,
       CAST((c_custkey * 23 % 40) / 10.0 AS FLOAT) AS dist_curs_km,
       CASE WHEN n_regionkey < 2 THEN 'Râu' ELSE 'Pârâu' END AS categorie_curs,
       CAST((c_custkey * 29 % 25) / 10.0 AS FLOAT) AS dist_inundatii_km,
       CASE WHEN n_regionkey < 2 THEN '10% (~10 ani)' WHEN n_regionkey = 2 THEN '1% (~100 ani)' ELSE '0,1% (~1.000 ani)' END AS scenariu_inundatii,
       CAST((c_custkey * 31 % 35) / 10.0 AS FLOAT) AS dist_protected_km,
       CASE n_regionkey WHEN 0 THEN 'Risc potențial' WHEN 1 THEN 'Risc mediu' WHEN 2 THEN 'Risc ridicat' ELSE NULL END AS risc_urs,
       CAST((c_custkey * 37 % 400) / 10.0 AS FLOAT) AS dist_hospital_km,
       CAST((c_custkey * 41 % 1300) / 10.0 AS FLOAT) AS dist_airport_km
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""

# cells without an order have no climate row, so the implicit inner join matters
BINDINGS["climate"] = """
SELECT o_custkey AS cell_id, CAST(AVG(o_totalprice) / 20000 AS FLOAT) AS tmean,
       CAST(SUM(o_totalprice) / 2500 AS FLOAT) AS precip_total,
       CAST(COUNT(*) * 0.3 + 0.2 AS FLOAT) AS warming_deg,
       COUNT(*) * 7 AS hot_days, COUNT(*) AS n_days
FROM orders GROUP BY o_custkey"""

# --- a dense raster, 50 pixels wide ----------------------------------------------------------
BINDINGS["raster"] = """
SELECT CAST(FLOOR(p_partkey / 50.0) AS BIGINT) AS prow, p_partkey % 50 AS pcol,
       p_retailprice + p_size * 3 AS value, p_size % 4 AS class, p_size FROM part"""

# --- daily values on a 10 x 10 pixel lattice -------------------------------------------------
BINDINGS["cube"] = """
SELECT l_suppkey % 10 AS iy, l_partkey % 10 AS ix, CAST(l_shipdate AS DATE) AS date, YEAR(l_shipdate) AS year,
       AVG(l_quantity - 30) AS tmin, AVG(l_quantity - 30 + l_tax * 100) AS tmax, AVG(l_discount * 100) AS precip
FROM lineitem GROUP BY 1, 2, 3, 4"""

BINDINGS["sites"] = """
SELECT s_suppkey AS site_id, s_name AS name, s_suppkey * 7919 % 40000 AS x,
       CAST(FLOOR(s_suppkey * 375.0) AS BIGINT) + s_suppkey * 104729 % 4000 AS y,
       CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS active, s_nationkey
FROM supplier"""

BINDINGS["points"] = """
SELECT c_custkey AS cell_id, (c_custkey % 40) * 1000 + 500.5 AS x,
       CAST(FLOOR(c_custkey / 40.0) AS BIGINT) * 1000 + 500.5 AS y FROM customer"""

# --- six-cornered polygons with one slanted side, one per supplier, partly overlapping ----
BINDINGS["vertices"] = """
SELECT s_suppkey AS feature_id, s_name AS name, 0 AS ring, k AS seq,
       (s_suppkey * 7919 % 36) * 1000 + CASE k WHEN 0 THEN 300 WHEN 1 THEN 4300 WHEN 2 THEN 4300 WHEN 3 THEN 2300 WHEN 4 THEN 1900 ELSE 300 END AS x,
       CAST(FLOOR(s_suppkey * 0.375) AS BIGINT) * 1000 + CASE k WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 2200 WHEN 3 THEN 2200 WHEN 4 THEN 4200 ELSE 4200 END AS y
FROM supplier CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) kk"""

# Rows of the grid, which grows with the customers.
GRID_ROWS = "SELECT CAST(FLOOR(MAX(c_custkey) / 40.0) AS BIGINT) + 1 AS n_rows FROM customer"

# The same rows in Spark without a join against the list of corners, or against the one row of the grid's height.
SPARK_TEXT = {"vertices": BINDINGS["vertices"].replace(
    BINDINGS["vertices"][BINDINGS["vertices"].index("CROSS JOIN"):], "LATERAL VIEW explode(array(0, 1, 2, 3, 4, 5)) kk AS k")}

# The orders grow with the data, and the size of their files says little about that of their rows: they are not broadcast.
SPARK_TEXT["core"] = BINDINGS["core"].replace("SELECT c_custkey", "SELECT /*+ MERGE(o) */ c_custkey", 1)

BINDINGS["edges"] = """
SELECT v.feature_id, v.name, CAST(v.x AS DOUBLE) AS x1, CAST(v.y AS DOUBLE) AS y1,
       CAST(w.x AS DOUBLE) AS x2, CAST(w.y AS DOUBLE) AS y2
FROM vertices v JOIN vertices w ON w.feature_id = v.feature_id AND w.seq = (v.seq + 1) % 6"""

# --- four nodes at the corners of a 40 km square, hourly values ----------------------------
BINDINGS["hourly"] = """
SELECT user_id % 4 AS grid_id, DATE_TRUNC('hour', ts) AS valid_time, AVG(value) AS value, COUNT(*) AS n
FROM events GROUP BY 1, 2"""

BINDINGS["nodes"] = """
SELECT DISTINCT user_id % 4 AS grid_id, (user_id % 2) * 40000.0 AS x,
       FLOOR(user_id % 4 / 2) * 40000.0 AS y FROM events"""

BINDINGS["daily"] = """
SELECT user_id % 4 AS grid_id, CAST(ts AS DATE) AS valid_date, MIN(value) AS tmin, MAX(value) AS tmax
FROM events GROUP BY 1, 2"""

# --- warning messages: a square of half-size 1500 m around (cx, cy) -------------------------
BINDINGS["messages"] = """
SELECT event_id AS id, CASE WHEN event_type IN ('error', 'click') THEN 'nowcasting' ELSE 'general' END AS source,
       CAST(FLOOR(value) AS BIGINT) % 4 AS level_rank, ts AS start_ts, event_type,
       (event_id * 613 % 40) * 1000 AS cx, (event_id * 389 % n_rows) * 1000 AS cy
FROM events CROSS JOIN (SELECT CAST(FLOOR(MAX(c_custkey) / 40.0) AS BIGINT) + 1 AS n_rows FROM customer) g"""

SPARK_TEXT["messages"] = BINDINGS["messages"].replace("event_id * 389 % n_rows", f"event_id * 389 % ({GRID_ROWS})")
SPARK_TEXT["messages"] = SPARK_TEXT["messages"][:SPARK_TEXT["messages"].index(" CROSS JOIN")]

# --- a road graph: customers are junctions, consecutive orders are one-way roads -----------
BINDINGS["ways"] = """
SELECT a.o_orderkey AS gid, a.o_custkey AS source, b.o_custkey AS target,
       CAST(FLOOR(a.o_totalprice / 100) AS BIGINT) AS length_m, CAST(FLOOR(b.o_totalprice / 1000) AS BIGINT) + 1 AS cost,
       CASE a.o_orderpriority WHEN '1-URGENT' THEN 'motorway' WHEN '2-HIGH' THEN 'primary' WHEN '3-MEDIUM' THEN 'tertiary'
            WHEN '4-NOT SPECIFIED' THEN 'residential' ELSE 'service' END AS highway
FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1"""

BINDINGS["names"] = "SELECT doc_id AS entry_id, text AS name, CASE lang WHEN 'fr' THEN 'u' ELSE 'l' END AS kind FROM documents"

DEPENDS = {"edges": ("vertices",)}
BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_PLANS: dict[tuple, DataFrame] = {}


class Tables:
    """The bindings as DataFrames: ``t.core``, ``t.env``, … built lazily by Spark."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def base(self, name: str) -> DataFrame:
        """A base table. Only the plan is kept, so footers are read once per session."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _PLANS:
            _PLANS[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return _PLANS[key]

    def sql(self, text: str) -> DataFrame:
        """Run SQL over the base tables; only the tables named in it are registered."""
        words = set(text.replace(",", " ").replace("(", " ").replace(")", " ").split())
        for name in BASE_TABLES:
            if name in words:
                self.base(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BINDINGS:
            key = (self.spark.sparkContext.applicationId, self.sf_dir, f"binding {name}")
            if key not in _PLANS:
                _PLANS[key] = self.sql(with_bindings([name], f"SELECT * FROM {name}", SPARK_TEXT))
            return _PLANS[key]
        raise AttributeError(name)


def with_bindings(names: list[str], body: str, texts: dict[str, str] | None = None) -> str:
    ordered: list[str] = []
    for n in names:
        for d in (*DEPENDS.get(n, ()), n):
            if d not in ordered:
                ordered.append(d)
    ctes = ",\n".join(f"{n} AS ({(texts or {}).get(n, BINDINGS[n]).strip()})" for n in ordered)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.startswith(","):  # further common tables, then the question
        return f"WITH {ctes}\n{body}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, uses: str = "", sql: str | None = None):
    """Register a query; ``uses`` lists the bindings its SQL reads."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_bindings(uses.split(), sql) if uses else sql.strip()
        return fn
    return register
