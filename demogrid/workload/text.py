"""Names: normalisation, ranked search, the gazetteer, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import gazetteer as Z
from .base import query

_SCORE = """e AS (SELECT entry_id, kind, lower(strip_accents(name)) AS s FROM names),
q AS (SELECT * FROM (VALUES ('ele', 'ele'), (' Éta ', 'eta'), ('the', 'the')) v(query, needle)),
m AS (SELECT query, entry_id, s, kind, CASE WHEN instr(s, needle) = 1 THEN 0.0 WHEN regexp_matches(substr(s, instr(s, needle) - 1, 1), '[\\s\\-.]') THEN 1.0 ELSE 3.0 END
  + CASE WHEN kind <> 'u' THEN 0.5 ELSE 0.0 END + length(s) / 1000.0 AS score FROM e JOIN q ON instr(s, needle) > 0)"""


@query("f02_accent_insensitive_match", "names", """
SELECT entry_id, CAST(length(lower(strip_accents(name))) AS INT) AS n, instr(lower(strip_accents(name)), 'ele') > 0 AS hit FROM names""")
def _(t):
    n = X.normalise(F.col("name"))
    return t.names.select("entry_id", F.length(n).alias("n"), (F.instr(n, "ele") > 0).alias("hit"))


@query("f03_ranked_name_search", "names", f"""
WITH {_SCORE} SELECT query, entry_id, kind, ROUND(CAST(score AS DOUBLE), 6) AS score, CAST(pos AS INT) AS pos FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score, s, entry_id) AS pos FROM m) z WHERE pos <= 12""")
def _(t):
    found = X.search_names(t.names, ["ele", " Éta ", "the", "x"])
    return found.select("query", "entry_id", "kind", F.round("score", 6).alias("score"), "pos")


@query("f05_airport_label", "", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_name ELSE 'aeroport' END || CASE WHEN p_type = 'ECONOMY' THEN '' ELSE ' (' || p_type || ')' END AS label FROM part""")
def _(t):
    size = F.col("p_size") % 3
    return t.base("part").select("p_partkey", X.airport_label(
        F.when(size == 0, F.col("p_brand")).otherwise(""), F.when(size == 1, F.col("p_name")),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_type"))).alias("label"))


@query("f04_prefix_and_case_rules", "", """
SELECT p_partkey, NOT starts_with(p_name, 's') AS urban, CASE WHEN starts_with('S' || p_name, 'Sat') THEN 'sat' WHEN starts_with(p_type, 'Sector') THEN 'sector' ELSE 'localitate urbană' END AS kind,
 upper(p_name) AS up FROM part""")
def _(t):
    name = F.col("p_name")
    return t.base("part").select(
        "p_partkey", X.is_urban(F.when(name.startswith("s"), F.concat(F.lit("Sat "), name)).otherwise(name)).alias("urban"),
        X.locality_kind(F.concat(F.lit("S"), name)).alias("kind"), F.upper(name).alias("up"))


@query("a37_gazetteer", "vertices", """
WITH u AS (SELECT s_suppkey, s_name, s_nationkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
b AS (SELECT feature_id, CAST(MIN(x) AS DOUBLE) AS minx, CAST(MIN(y) AS DOUBLE) AS miny, CAST(MAX(x) AS DOUBLE) AS maxx, CAST(MAX(y) AS DOUBLE) AS maxy FROM vertices GROUP BY 1),
l AS (SELECT p_brand, arg_min(p_name, p_partkey) AS n, arg_min(CASE WHEN p_type = 'ECONOMY' THEN 'Sat' WHEN p_type = 'STANDARD' THEN 'Sector 1' END, p_partkey) AS kind,
  arg_min('nation_' || CAST(p_size % 30 AS VARCHAR), p_partkey) AS county, CAST(MIN(p_size) AS DOUBLE) AS minx, MIN(p_retailprice) AS miny, CAST(MAX(p_size) AS DOUBLE) AS maxx, MAX(p_retailprice) AS maxy FROM part GROUP BY 1)
SELECT 'u' AS k, s_name AS n, CASE WHEN s_nationkey % 3 = 0 THEN 'comună' WHEN s_nationkey % 3 = 1 THEN 'municipiu' ELSE 'UAT' END AS t, n_name AS j, minx, miny, maxx, maxy FROM u JOIN b ON b.feature_id = s_suppkey
UNION ALL SELECT 'l', n, CASE WHEN starts_with(COALESCE(kind, ''), 'Sat') THEN 'sat' WHEN starts_with(kind, 'Sector') THEN 'sector' ELSE 'localitate urbană' END,
 CASE WHEN upper(county) IN (SELECT upper(n_name) FROM u) THEN upper(county) ELSE 'Nation_' || substr(county, 8) END, minx, round_even(miny, 4), maxx, round_even(maxy, 4) FROM l""")
def _(t):
    from ..operators.cover import feature_bounds

    s, n = t.base("supplier"), t.base("nation")
    level = F.when(F.col("s_nationkey") % 3 == 0, "Comuna").when(F.col("s_nationkey") % 3 == 1, "Municipiu resedinta de judet").otherwise("?")
    units = s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("unit_id"), F.col("s_name").alias("name"), level.alias("level"), F.col("n_name").alias("county"))
    bounds = feature_bounds(t.vertices, ["feature_id"]).withColumnRenamed("feature_id", "unit_id")
    kind = F.when(F.col("p_type") == "ECONOMY", "Sat").when(F.col("p_type") == "STANDARD", "Sector 1")
    parts = t.base("part").select(
        F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("code"), F.col("p_name").alias("name"), kind.alias("kind"),
        F.concat(F.lit("nation_"), (F.col("p_size") % 30).cast("string")).alias("county"),
        F.col("p_size").cast("double").alias("minx"), F.col("p_retailprice").alias("miny"),
        F.col("p_size").cast("double").alias("maxx"), F.col("p_retailprice").alias("maxy"))
    return Z.build(units, bounds, parts)
