"""Crosswalks between former and present units, merger scenarios, typologies, vulnerability and data contracts on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts, crosswalk, mergers, typology, vulnerability
from ..operators.contracts import Rule
from .base import BINDINGS, query

# --- crosswalk: three generations of units of customers ------------------------------------------------

BINDINGS["units_1_2"] = """
SELECT 'a' || CAST(c_custkey % 60 AS VARCHAR(9)) AS source, 'b' || CAST(c_nationkey * 2 + c_custkey % 2 AS VARCHAR(9)) AS target, COUNT(*) AS weight
FROM customer WHERE c_custkey % 60 <> 7 GROUP BY 1, 2"""
BINDINGS["units_2_3"] = """
SELECT 'b' || CAST(c_nationkey * 2 + c_custkey % 2 AS VARCHAR(9)) AS source, 'c' || CAST(c_nationkey % 7 AS VARCHAR(9)) || SUBSTR(c_mktsegment, 1, 1) AS target,
  CAST(SUM(FLOOR(ABS(c_acctbal))) AS BIGINT) AS weight FROM customer WHERE c_nationkey <> 4 GROUP BY 1, 2"""
BINDINGS["census_1"] = """
SELECT o_orderstatus AS st, 'a' || CAST(o_custkey % 60 AS VARCHAR(9)) AS unit, CAST(SUM(FLOOR(o_totalprice / 1000)) AS BIGINT) AS value FROM orders GROUP BY 1, 2"""
_CHAIN = """
, p1 AS (SELECT source, target, weight::DOUBLE / SUM(weight) OVER (PARTITION BY source) AS share FROM units_1_2),
p2 AS (SELECT source, target, weight::DOUBLE / SUM(weight) OVER (PARTITION BY source) AS share FROM units_2_3 WHERE weight > 0),
ch AS (SELECT p1.source, COALESCE(p2.target, p1.target) AS target, SUM(p1.share * COALESCE(p2.share, 1)) AS share FROM p1 LEFT JOIN p2 ON p2.source = p1.target GROUP BY 1, 2)"""


def _chain(t):
    return crosswalk.chain([crosswalk.bridge(t.units_1_2), crosswalk.bridge(t.units_2_3)])


@query("x12_bridge_over_two_steps", "units_1_2 units_2_3", f"{_CHAIN} SELECT source, target, ROUND(share, 9) AS share FROM ch")
def _(t):
    return _chain(t).withColumn("share", F.round("share", 9))


@query("x12_historical_crosswalk", "units_1_2 units_2_3 census_1", f"""{_CHAIN},
e AS (SELECT st, v.unit AS source, COALESCE(target, v.unit) AS target, value, ROUND(value * COALESCE(share, 1), 9) AS ex FROM census_1 v LEFT JOIN ch ON ch.source = v.unit),
r AS (SELECT *, FLOOR(ex) AS low, ROW_NUMBER() OVER (PARTITION BY st, source ORDER BY ex - FLOOR(ex) DESC, target) AS rk,
  value - SUM(FLOOR(ex)) OVER (PARTITION BY st, source) AS rest FROM e)
SELECT st, target AS unit, SUM(low + CASE WHEN rk <= rest THEN 1 ELSE 0 END)::BIGINT AS value FROM r GROUP BY 1, 2""")
def _(t):
    return crosswalk.convert(t.census_1, _chain(t), by=["st"])


@query("x12_unmatched_units", "units_1_2 census_1",
       " SELECT unit, SUM(value)::BIGINT AS value FROM census_1 WHERE unit NOT IN (SELECT source FROM units_1_2) GROUP BY 1")
def _(t):
    return crosswalk.unmatched(t.census_1, crosswalk.bridge(t.units_1_2))


# --- mergers -----------------------------------------------------------------------------------------------

_UNIT = "CAST(FLOOR(row / 6.0) * 5 + FLOOR(col / 8.0) AS BIGINT)"
_MERGE = f"""
, c AS (SELECT cell_id, row, col, pop_total, pop_65p, CASE WHEN isnan(alt_mean) THEN NULL ELSE alt_mean::DOUBLE END AS alt, {_UNIT} AS unit FROM core JOIN env USING (cell_id)),
sc AS (SELECT DISTINCT s AS scenario, unit % (5 + s) AS new_unit, unit FROM c, (SELECT UNNEST([1, 2, 3]) AS s) WHERE unit % (5 + s) < 4),
nb AS (SELECT x.cell_id, x.unit AS u, y.unit AS v FROM c x JOIN c y ON (y.row = x.row AND abs(y.col - x.col) = 1) OR (y.col = x.col AND abs(y.row - x.row) = 1)),
ad AS (SELECT u AS a, v AS b, COUNT(*)::DOUBLE AS length FROM nb WHERE u < v GROUP BY 1, 2)"""
_LIMITS = [("people", True, 700.0, 350.0), ("pieces", False, 1.0, 2.0), ("mean_alt", False, 1100.0, 1300.0)]


def _merger(t):
    cells = t.core.join(t.env, "cell_id").withColumn("unit", F.expr("CAST(FLOOR(row / 6) * 5 + FLOOR(col / 8) AS BIGINT)"))
    scenarios = cells.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("scenario"), "unit").distinct().withColumn(
        "new_unit", F.col("unit") % (5 + F.col("scenario"))).filter("new_unit < 4")
    return cells, scenarios, mergers.adjacency(mergers.cell_outlines(cells))


@query("x09_adjacent_units", "core env", f"{_MERGE} SELECT a, b, length FROM ad")
def _(t):
    return _merger(t)[2]


@query("x09_merge_scenarios", "core env", f"""
WITH RECURSIVE {_MERGE.strip()[1:]},
re(scenario, new_unit, unit, v) AS (SELECT scenario, new_unit, unit, unit FROM sc UNION
  SELECT re.scenario, re.new_unit, re.unit, s.unit FROM re JOIN (SELECT a, b FROM ad UNION ALL SELECT b, a FROM ad) e ON e.a = re.v
  JOIN sc s ON s.scenario = re.scenario AND s.new_unit = re.new_unit AND s.unit = e.b),
pc AS (SELECT scenario, new_unit, COUNT(DISTINCT piece) AS pieces FROM (SELECT scenario, new_unit, unit, MIN(v) AS piece FROM re GROUP BY 1, 2, 3) GROUP BY 1, 2),
su AS (SELECT sc.scenario, sc.new_unit, COUNT(DISTINCT sc.unit) AS units, COUNT(*) AS area, SUM(pop_total)::DOUBLE AS people, SUM(pop_65p)::DOUBLE AS old,
  SUM(alt * pop_total) / NULLIF(SUM(pop_total) FILTER (alt IS NOT NULL), 0) AS mean_alt FROM sc JOIN c ON c.unit = sc.unit GROUP BY 1, 2),
bo AS (SELECT x.scenario, x.new_unit, COUNT(*) AS inner_sides FROM nb JOIN sc x ON x.unit = nb.u JOIN sc y ON y.unit = nb.v AND y.scenario = x.scenario AND y.new_unit = x.new_unit GROUP BY 1, 2),
w AS (SELECT su.scenario, su.new_unit, units::DOUBLE AS units, area::DOUBLE AS area, people / area AS density, pieces::DOUBLE AS pieces,
  4.0 * area - COALESCE(inner_sides, 0) AS border, people, old, mean_alt FROM su JOIN pc USING (scenario, new_unit) LEFT JOIN bo USING (scenario, new_unit)),
l AS (SELECT scenario, new_unit, i.indicator, i.value FROM w, (SELECT UNNEST([{{'indicator': 'units', 'value': units}}, {{'indicator': 'area', 'value': area}}, {{'indicator': 'density', 'value': density}},
  {{'indicator': 'pieces', 'value': pieces}}, {{'indicator': 'border', 'value': border::DOUBLE}}, {{'indicator': 'people', 'value': people}}, {{'indicator': 'old', 'value': old}}, {{'indicator': 'mean_alt', 'value': mean_alt}}]) AS i))
SELECT scenario, new_unit, indicator, ROUND(value, 6) AS value, CASE WHEN value IS NULL THEN NULL
  WHEN indicator = 'people' THEN CASE WHEN value >= 700 THEN 'green' WHEN value >= 350 THEN 'amber' ELSE 'red' END
  WHEN indicator = 'pieces' THEN CASE WHEN value <= 1 THEN 'green' WHEN value <= 2 THEN 'amber' ELSE 'red' END
  WHEN indicator = 'mean_alt' THEN CASE WHEN value <= 1100 THEN 'green' WHEN value <= 1300 THEN 'amber' ELSE 'red' END END AS light FROM l""")
def _(t):
    cells, scenarios, neighbours = _merger(t)
    alt = F.when(~F.isnan("alt_mean"), F.col("alt_mean")).cast("double")
    found = mergers.merge_indicators(cells, scenarios, neighbours, {"people": F.col("pop_total"), "old": F.col("pop_65p")}, {"mean_alt": alt}, F.col("pop_total"))
    limits = t.spark.createDataFrame(_LIMITS, "indicator string, more_is_better boolean, green double, amber double")
    return mergers.judged(found, limits).withColumn("value", F.round("value", 6))


# --- typology ----------------------------------------------------------------------------------------------

_TRAITS = ["alt_mean", "slope_mean", "dist_coast_km", "dist_hospital_km", "dist_airport_km"]


@query("x08_typology")
def _(t):
    return typology.with_class(t.env, typology.fit_typology(t.env, _TRAITS, 6)).select("cell_id", "type")


@query("x08_types_of_counties")
def _(t):
    typed = typology.with_class(t.env, typology.fit_typology(t.env, _TRAITS, 6))
    return typed.join(t.core.select("cell_id", "pop_total"), "cell_id").groupBy("county_mn", "type").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("pop_total").alias("people"))


# --- vulnerability -----------------------------------------------------------------------------------------

_PARTS = {"pop_65p": 1, "dist_hospital_km": 1, "alt_mean": 1, "tmean": -1}
_WEIGHTS = {"even": dict.fromkeys(_PARTS, 1.0), "old": {"pop_65p": 5.0, "dist_hospital_km": 2.0, "tmean": 1.0}, "remote": {"dist_hospital_km": 3.0, "alt_mean": 2.0}}
_WEIGHT_ROWS = ", ".join(f"('{w}', '{n}', {x})" for w, ws in _WEIGHTS.items() for n, x in ws.items())
_INDEX = f"""
, x AS (SELECT cell_id, {", ".join(f"{c}::DOUBLE AS {c}" for c in _PARTS)} FROM core JOIN env USING (cell_id) LEFT JOIN climate USING (cell_id)),
l AS (SELECT cell_id, variable, 100 * PERCENT_RANK() OVER (PARTITION BY variable ORDER BY value) AS pos FROM (UNPIVOT x ON {", ".join(_PARTS)} INTO NAME variable VALUE value) WHERE NOT isnan(value)),
wt(weighting, part, weight) AS (VALUES {_WEIGHT_ROWS}),
sc AS (SELECT cell_id, weighting, ROUND(SUM(CASE WHEN variable = 'tmean' THEN 100 - pos ELSE pos END * weight) / SUM(weight), 9) AS score FROM l JOIN wt ON part = variable GROUP BY 1, 2),
rk AS (SELECT *, RANK() OVER (PARTITION BY weighting ORDER BY score DESC) AS rank FROM sc)"""


def _vulnerable(t):
    cells = t.core.join(t.env, "cell_id").join(t.climate, "cell_id", "left")
    return cells, vulnerability.composite_index(cells, _PARTS, _WEIGHTS)


@query("x10_vulnerability_index", "core env climate", f"{_INDEX} SELECT cell_id, weighting, ROUND(score, 6) AS score, rank FROM rk")
def _(t):
    return _vulnerable(t)[1].withColumn("score", F.round("score", 6))


@query("x10_rank_spread", "core env climate", f"""{_INDEX}
SELECT cell_id, COUNT(*) AS n_weightings, MIN(rank) AS best_rank, MAX(rank) AS worst_rank, ROUND(AVG(score), 6) AS mean_score FROM rk GROUP BY 1""")
def _(t):
    return vulnerability.rank_spread(_vulnerable(t)[1])


@query("x10_exposed_risk", "core env climate", f"""{_INDEX}
SELECT county_mn, weighting, SUM(c.pop_total)::BIGINT AS people, SUM(CASE WHEN e.dist_inundatii_km < 1 THEN c.pop_total ELSE 0 END)::BIGINT AS exposed,
  ROUND(SUM(CASE WHEN e.dist_inundatii_km < 1 THEN c.pop_total ELSE 0 END * score) / 100, 6) AS risk
FROM rk JOIN core c USING (cell_id) JOIN env e USING (cell_id) GROUP BY 1, 2""")
def _(t):
    cells, index = _vulnerable(t)
    return vulnerability.exposed_risk(cells, index, "county_mn", "pop_total", F.col("dist_inundatii_km") < 1)


# --- contracts ---------------------------------------------------------------------------------------------

_RULES = [
    Rule("core", "type", "cell_id", "bigint"), Rule("core", "type", "pop_total", "int"), Rule("core", "unique", "cell_id"), Rule("core", "range", "pop_total", (1, 200)),
    Rule("core", "required", "pop_2011"), Rule("core", "total", "pop_total", (1e6, 1e5)), Rule("env", "reference", "cell_id", "cell_id", "core"),
    Rule("env", "required", "intravilan"), Rule("env", "range", "alt_mean", (0, 2000.5)), Rule("env", "allowed", "landform_type", ("munte", "deal", "vale")),
    Rule("env", "unique", "uat_name"), Rule("core", "reference", "cell_id", "cell_id", "climate"), Rule("orders", "unique", "o_custkey"), Rule("orders", "range", "o_totalprice", (None, 400000.0)),
    Rule("climate", "required", "nowhere")]


@query("x15_data_contracts", "core env climate", """
SELECT 'core' AS "table", 'type' AS kind, 'cell_id' AS "column", 0::BIGINT AS violations UNION ALL
SELECT 'core', 'type', 'pop_total', COUNT(*) FROM core UNION ALL
SELECT 'core', 'unique', 'cell_id', COUNT(cell_id) - COUNT(DISTINCT cell_id) FROM core UNION ALL
SELECT 'core', 'range', 'pop_total', COUNT(*) FROM core WHERE pop_total < 1 OR pop_total > 200 UNION ALL
SELECT 'core', 'required', 'pop_2011', COUNT(*) FROM core WHERE pop_2011 IS NULL OR isnan(pop_2011) UNION ALL
SELECT 'core', 'total', 'pop_total', CASE WHEN ABS(SUM(pop_total) - 1e6) <= 1e5 THEN 0 ELSE 1 END FROM core UNION ALL
SELECT 'env', 'reference', 'cell_id', COUNT(*) FROM env WHERE cell_id NOT IN (SELECT cell_id FROM core) UNION ALL
SELECT 'env', 'required', 'intravilan', COUNT(*) FROM env WHERE intravilan IS NULL UNION ALL
SELECT 'env', 'range', 'alt_mean', COUNT(*) FROM env WHERE NOT isnan(alt_mean) AND (alt_mean < 0 OR alt_mean > 2000.5) UNION ALL
SELECT 'env', 'allowed', 'landform_type', COUNT(*) FROM env WHERE landform_type NOT IN ('munte', 'deal', 'vale') UNION ALL
SELECT 'env', 'unique', 'uat_name', COUNT(uat_name) - COUNT(DISTINCT uat_name) FROM env UNION ALL
SELECT 'core', 'reference', 'cell_id', COUNT(*) FROM core WHERE cell_id NOT IN (SELECT cell_id FROM climate) UNION ALL
SELECT 'orders', 'unique', 'o_custkey', COUNT(o_custkey) - COUNT(DISTINCT o_custkey) FROM orders UNION ALL
SELECT 'orders', 'range', 'o_totalprice', COUNT(*) FROM orders WHERE o_totalprice > 400000 UNION ALL
SELECT 'climate', 'required', 'nowhere', COUNT(*) FROM climate""")
def _(t):
    return contracts.check_contracts({"core": t.core, "env": t.env, "climate": t.climate, "orders": t.base("orders")}, _RULES)


@query("x15_products_agree", "core env climate", """
, a AS (SELECT cell_id, alt_mean::DOUBLE AS alt, slope_mean::DOUBLE AS slope FROM env),
b AS (SELECT cell_id, CASE WHEN hot_days % 5 = 0 THEN 0 ELSE alt_mean::DOUBLE END AS alt, slope_mean::DOUBLE AS slope FROM env JOIN climate USING (cell_id)),
f AS (SELECT a.cell_id AS ca, b.cell_id AS cb, CASE WHEN isnan(a.alt) THEN NULL ELSE a.alt END AS p, CASE WHEN isnan(b.alt) THEN NULL ELSE b.alt END AS q FROM a FULL JOIN b USING (cell_id))
SELECT 'alt' AS variable, COUNT(*) FILTER (ca IS NOT NULL AND cb IS NOT NULL) AS compared, COUNT(*) FILTER (ca IS NOT NULL AND cb IS NOT NULL AND p IS DISTINCT FROM q) AS differing,
  COUNT(*) FILTER (ca IS NULL OR cb IS NULL) AS missing FROM f UNION ALL
SELECT 'slope', COUNT(*) FILTER (ca IS NOT NULL AND cb IS NOT NULL), 0, COUNT(*) FILTER (ca IS NULL OR cb IS NULL) FROM f""")
def _(t):
    env = t.env.select("cell_id", F.col("alt_mean").cast("double").alias("alt"), F.col("slope_mean").cast("double").alias("slope"))
    cube = env.join(t.climate.select("cell_id", "hot_days"), "cell_id").withColumn("alt", F.when(F.col("hot_days") % 5 == 0, 0).otherwise(F.col("alt")))
    return contracts.compare_products(env, cube, "cell_id", ["alt", "slope"])
