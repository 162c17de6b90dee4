"""Questions, measures and rankings over the thematic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import attach, has_data, nan_to_null, recode, to_long
from ..functions.text import share_label
from ..model import Between, In, Question, Registry, Variable
from ..operators import measures as M
from ..operators import questions as Q
from ..plans import catalogue as C
from .base import Tables, query

REG = Registry(C.REGISTRY.variables + (Variable("dist_km", "env", "float", ("filter", "profile")),),
               C.MEASURES)
ALL = "core env climate"
JOIN3 = "core JOIN env USING (cell_id) JOIN climate USING (cell_id)"
JOIN2 = "core JOIN env USING (cell_id)"


def atlas(t: Tables) -> Q.Atlas:
    return Q.Atlas(t.core, t.env, t.climate, REG)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def _ask(*cs, measure="pop_total") -> Question:
    return Question(measure, tuple(cs))


# --- predicates ----------------------------------------------------------------------------

@query("pf01_half_open_range", "core env",
       f"SELECT cell_id, CAST(pop_total AS DOUBLE) AS val FROM {JOIN2} WHERE dist_km >= 0.1 AND dist_km < 5")
def _(t):
    return Q.cell_values(atlas(t), _ask(Between("dist_km", 0.1, 5)))


@query("pf02_inclusive_bound", "core env",
       f"SELECT cell_id, CAST(pop_total AS DOUBLE) AS val FROM {JOIN2} WHERE dist_km <= 0.1")
def _(t):
    return Q.cell_values(atlas(t), _ask(Between("dist_km", None, 0.1, max_inclusive=True)))


@query("pf03_membership", "core env",
       f"SELECT cell_id, CAST(pop_total AS DOUBLE) AS val FROM {JOIN2} WHERE landform_type IN ('munte','deal')")
def _(t):
    return Q.cell_values(atlas(t), _ask(In("landform_type", ("munte", "deal")), In("county_mn")))


@query("pf04_no_data_guard", "env",
       "SELECT cell_id, CAST(alt_mean AS DOUBLE) AS alt_mean FROM env WHERE alt_mean IS NOT NULL AND NOT isnan(alt_mean)")
def _(t):
    env = t.env
    return env.filter(has_data(env, "alt_mean")).select("cell_id", F.col("alt_mean").cast("double").alias("alt_mean"))


@query("pf05_conjunction_minimal_joins", ALL, f"""
SELECT cell_id, CAST(pop_f AS DOUBLE) AS val FROM {JOIN3}
WHERE alt_mean >= 100 AND alt_mean < 2000 AND NOT isnan(alt_mean) AND tmean >= 11.5 AND NOT isnan(tmean)
  AND landform_type IN ('munte','vale')""")
def _(t):
    return Q.cell_values(atlas(t), _ask(Between("alt_mean", 100, 2000), Between("tmean", 11.5),
                                        In("landform_type", ("munte", "vale")), measure="pop_f"))


@query("pf05_open_range_still_joins", "core climate",
       "SELECT CAST(SUM(pop_total) AS BIGINT) AS value, COUNT(*) AS n_cells FROM core JOIN climate USING (cell_id)")
def _(t):
    return Q.total(atlas(t), _ask(Between("tmean")))


_PRESET_WHERE = {
    "atac-ancpi": "TRUE", "la-mare": "dist_coast_km < 5", "frontiera": "dist_border_km < 30",
    "munte": "landform_type = 'munte'", "deal": "landform_type IN ('deal','podiș','depresiune')",
    "campie": "landform_type IN ('câmpie','vale','grind','baltă/lac')", "unitate-relief": "TRUE",
    "judet": "TRUE", "corp-apa": "dist_water_km < 1", "curs-apa": "dist_curs_km < 0.5",
    "risc-inundatii": "dist_inundatii_km <= 0", "arie-protejata": "dist_protected_km <= 0",
    "risc-urs": "risc_urs IN ('Risc potențial','Risc mediu','Risc ridicat')", "oras-sat": "intravilan = 'oraș'",
    "acces-gaz": "acces_gaz = 'conectat'", "departe-spital": "dist_hospital_km >= 10",
    "peste-1000": "alt_mean >= 1000 AND NOT isnan(alt_mean)",
    "exemplu-multi": "h AND alt_mean >= 200 AND alt_mean < 500 AND precip_total < 400 AND tmean >= 11.5 AND tmean < 12.5",
    "bucuresti": "county_mn = 'B'", "altitudine-joasa": "alt_mean < 100",
    "departe-aeroport": "dist_airport_km >= 50", "teren-inclinat": "slope_mean >= 5",
    "incalzire": "h AND warming_deg >= 1.1", "zile-caniculare": "h AND hot_days >= 20",
}
_WIDE = """WITH j AS (SELECT *, climate.cell_id IS NOT NULL AS h FROM core JOIN env USING (cell_id)
                  LEFT JOIN climate ON climate.cell_id = core.cell_id)"""


def _totals_sql(rows) -> str:
    parts = [f"""SELECT '{label}' AS label, CAST(COALESCE(SUM({m}) FILTER ({w}), 0) AS BIGINT) AS value,
      COUNT(*) FILTER ({w}) AS n_cells, ROUND(CAST(COALESCE(SUM({m}) FILTER ({w}), 0) AS DOUBLE) / CAST(SUM({m}) AS DOUBLE), 6) AS share FROM j"""
             for label, m, w in rows]
    return _WIDE + " " + " UNION ALL ".join(parts)


@query("pf06_preset_catalogue", ALL, _totals_sql(
    [(k, "pop_f" if k == "exemplu-multi" else "pop_total", w) for k, w in _PRESET_WHERE.items()]))
def _(t):
    return rounded(Q.preset_totals(atlas(t), C.ALL_PRESETS), "share")


@query("pf07_flood_variants", "core env climate", _totals_sql(
    [("Combinat", "pop_total", "dist_inundatii_km <= 0"),
     ("0,1% (~1.000 ani)", "pop_total", "dist_inundatii_km <= 0 AND scenariu_inundatii IN ('0,1% (~1.000 ani)','1% (~100 ani)','10% (~10 ani)')"),
     ("1% (~100 ani)", "pop_total", "dist_inundatii_km <= 0 AND scenariu_inundatii IN ('1% (~100 ani)','10% (~10 ani)')"),
     ("10% (~10 ani)", "pop_total", "dist_inundatii_km <= 0 AND scenariu_inundatii = '10% (~10 ani)'")]))
def _(t):
    return rounded(Q.variant_totals(atlas(t), C.preset("risc-inundatii")), "share")


@query("pf07_distance_and_place_variants", "core env climate", _totals_sql(
    [(f"{v}:≥ {b} km", "pop_total", f"dist_{c}_km >= {b}") for v, c, bs in
     (("departe-spital", "hospital", (10, 20, 25)), ("departe-aeroport", "airport", (50, 75, 100))) for b in bs]
    + [("oras-sat:La oraș", "pop_total", "intravilan = 'oraș'"), ("oras-sat:La sat", "pop_total", "intravilan = 'sat'")]))
def _(t):
    return rounded(Q.many_totals(atlas(t), {f"{p}:{v.label}": v.question
                                            for p in ("departe-spital", "departe-aeroport", "oras-sat")
                                            for v in C.preset(p).variants}), "share")


@query("pf08_threshold_sweep", "core env climate", _totals_sql(
    [(f"{b:g}", "pop_total", f"dist_protected_km <= {b}") for b in (0, 0.5, 1, 1.5, 2, 2.5)]))
def _(t):
    return rounded(Q.threshold_sweep(atlas(t), C.preset("arie-protejata"), [0, 0.5, 1, 1.5, 2, 2.5]), "share")


@query("pf09_unknown_variable_pruning", "core env",
       f"SELECT CAST(COALESCE(SUM(pop_total), 0) AS BIGINT) AS value, COUNT(*) AS n_cells FROM {JOIN2} WHERE dist_km < 5")
def _(t):
    asked = _ask(Between("dist_km", None, 5), Between("no_such_variable", 1, 2), In("gone", ("x",)))
    return Q.total(atlas(t), REG.prune(asked))


_STATS_VARS = ["alt_mean", "slope_mean", "dist_km", "dist_water_km", "dist_protected_km"]


def _stats_sql(names, table, order=False) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS variable, ROUND(CAST(MIN(v) AS DOUBLE), 3) AS min, ROUND(CAST(MAX(v) AS DOUBLE), 3) AS max,
        ROUND(quantile_cont(v, 0.02), 3) AS p02, ROUND(quantile_cont(v, 0.5), 3) AS p50, ROUND(quantile_cont(v, 0.98), 3) AS p98,
        COUNT(*) - COUNT(v) AS nulls FROM (SELECT CASE WHEN NOT isnan({n}) THEN CAST({n} AS DOUBLE) END AS v FROM {table}) z"""
        for n in names)


@query("pf11_default_filter_range", "env", f"""
WITH s AS ({_stats_sql(["alt_mean", "slope_mean", "dist_water_km", "dist_protected_km"], "env")})
SELECT variable, CASE variable WHEN 'alt_mean' THEN 0.0 WHEN 'dist_water_km' THEN 0.0 ELSE p02 END AS lo,
       CASE variable WHEN 'alt_mean' THEN 2544.0 WHEN 'dist_water_km' THEN 28.0 ELSE p98 END AS hi FROM s""")
def _(t):
    stats = M.numeric_stats(t.env, ["alt_mean", "slope_mean", "dist_water_km", "dist_protected_km"])
    return rounded(M.default_range(REG, stats), "lo", "hi", places=3)


@query("pf12_cell_profile", ALL, f"""
SELECT cell_id, pop_total, county_mn, ROUND(CAST(dist_km AS DOUBLE), 4) AS dist_km, ROUND(CAST(tmean AS DOUBLE), 4) AS tmean, n_days
FROM core JOIN env USING (cell_id) LEFT JOIN climate USING (cell_id)
WHERE cell_id IN (SELECT s_suppkey FROM supplier)""")
def _(t):
    keys = t.base("supplier").select(F.col("s_suppkey").alias("cell_id"))
    p = Q.profile(atlas(t), keys=keys)
    return p.select("cell_id", "pop_total", "county_mn", F.round(F.col("dist_km").cast("double"), 4).alias("dist_km"),
                    F.round(F.col("tmean").cast("double"), 4).alias("tmean"), "n_days")


@query("pf12_long_profile", ALL, """
WITH w AS (SELECT core.cell_id, pop_total, pop_2011, county_mn, hot_days FROM core JOIN env USING (cell_id)
           LEFT JOIN climate ON climate.cell_id = core.cell_id)
SELECT cell_id, 'pop_total' AS variable, CAST(pop_total AS VARCHAR) AS value FROM w WHERE pop_total IS NOT NULL
UNION ALL SELECT cell_id, 'pop_2011', CAST(CAST(pop_2011 AS BIGINT) AS VARCHAR) FROM w WHERE NOT isnan(pop_2011)
UNION ALL SELECT cell_id, 'county_mn', county_mn FROM w WHERE county_mn IS NOT NULL
UNION ALL SELECT cell_id, 'hot_days', CAST(hot_days AS VARCHAR) FROM w WHERE hot_days IS NOT NULL""")
def _(t):
    wide = Q.profile(atlas(t)).select("cell_id", "pop_total", "pop_2011", "county_mn", "hot_days")
    long = Q.long_profile(wide, REG)
    whole = F.when(F.col("variable") == "pop_2011", F.col("value").try_cast("double").cast("bigint").cast("string"))
    return long.withColumn("value", F.coalesce(whole, F.col("value")))


@query("pf15_category_recode", "env", """
SELECT cell_id, CASE categorie_apa WHEN 'Lac' THEN 'Lac' WHEN 'Iaz' THEN 'Iaz' ELSE 'Alt tip' END AS water_kind,
       CASE WHEN uat_status = 'comună' THEN 'rural' WHEN uat_status IS NOT NULL THEN 'urban' END AS mediu,
       COALESCE(landform_type, landform_lvl0, uat_name) AS landform_filled FROM env""")
def _(t):
    kinds = {k: k for k in C.WATER_KINDS}
    status = F.col("uat_status")
    return t.env.select(
        "cell_id", recode(F.col("categorie_apa"), kinds, C.OTHER_WATER).alias("water_kind"),
        F.when(status == "comună", "rural").when(status.isNotNull(), "urban").alias("mediu"),
        F.coalesce("landform_type", "landform_lvl0", "uat_name").alias("landform_filled"))


@query("pf18_analysable_variables", "env", """
WITH n AS (SELECT 'landform_type' AS variable, 'cat' AS dtype, COUNT(DISTINCT landform_type) AS k FROM env UNION ALL SELECT 'county_mn', 'cat', COUNT(DISTINCT county_mn) FROM env
 UNION ALL SELECT 'uat_name', 'cat', COUNT(DISTINCT uat_name) FROM env UNION ALL SELECT 'alt_mean', 'float', 0 FROM env UNION ALL SELECT 'dist_km', 'float', 0 FROM env)
SELECT variable, dtype FROM n WHERE dtype <> 'cat' OR k BETWEEN 1 AND 40 GROUP BY 1, 2""")
def _(t):
    few = Registry(tuple(REG[v] for v in ("landform_type", "county_mn", "uat_name", "alt_mean", "dist_km")), REG.measures)
    return M.analysable(few, M.category_counts(t.env, ["landform_type", "county_mn", "uat_name"]))


# --- joins -----------------------------------------------------------------------------------

@query("j01_key_inner_join", ALL, f"SELECT cell_id, pop_total, county_mn, n_days FROM {JOIN3}")
def _(t):
    return Q.joined(atlas(t), ["pop_total", "county_mn"]).join(t.climate.select("cell_id", "n_days"), "cell_id")


@query("j02_left_outer_join", ALL, """
SELECT core.cell_id, pop_total, n_days FROM core LEFT JOIN climate ON climate.cell_id = core.cell_id""")
def _(t):
    return t.core.select("cell_id", "pop_total").join(t.climate.select("cell_id", "n_days"), "cell_id", "left")


# --- totals ----------------------------------------------------------------------------------

@query("a01_filtered_total", ALL, f"""
SELECT CAST(COALESCE(SUM(pop_total), 0) AS BIGINT) AS value, COUNT(*) AS n_cells FROM {JOIN3}
WHERE dist_km < 5 AND tmean >= 12 AND NOT isnan(tmean)""")
def _(t):
    return Q.total(atlas(t), _ask(Between("dist_km", None, 5), Between("tmean", 12)))


@query("a01_fractional_measure_total", "core", """
SELECT CAST(SUM(CAST(pop_total AS DOUBLE) * 0.25) AS BIGINT) AS value FROM core""")
def _(t):
    return t.core.agg(to_long(F.sum(F.col("pop_total").cast("double") * 0.25)).alias("value"))


@query("a02_matched_cells", "core env",
       f"SELECT cell_id, CAST(pop_65p AS DOUBLE) AS val FROM {JOIN2} WHERE dist_border_km < 30")
def _(t):
    return Q.cell_values(atlas(t), _ask(Between("dist_border_km", None, 30), measure="pop_65p"))


@query("a03_national_share", "core env", f"""
SELECT value, n_cells, national, ROUND(CAST(value AS DOUBLE) / national, 6) AS share FROM
 (SELECT CAST(COALESCE(SUM(pop_total), 0) AS BIGINT) AS value, COUNT(*) AS n_cells FROM {JOIN2} WHERE dist_coast_km < 5) a
 CROSS JOIN (SELECT CAST(SUM(pop_total) AS BIGINT) AS national FROM core) b""")
def _(t):
    return rounded(Q.national_share(atlas(t), C.preset("la-mare").question), "share")


# --- weighted statistics ---------------------------------------------------------------------

_X = "SELECT cell_id, county_mn AS area, CAST({v} AS DOUBLE) AS x, CAST(pop_total AS DOUBLE) AS w FROM " + JOIN2 + \
     " WHERE {v} IS NOT NULL AND NOT isnan({v})"


def _cells(t: Tables, var: str = "alt_mean", *cs) -> DataFrame:
    return M.analysed_cells(atlas(t), var, _ask(*cs))


def _spec_row(t: Tables, var: str = "alt_mean") -> DataFrame:
    """The published histogram range uses the rounded statistics."""
    return M.histogram_spec(M.rounded_stats(M.numeric_stats(t.env, [var])))


def _spec(t: Tables, var: str = "alt_mean") -> M.HistSpec:
    return M.read_spec(_spec_row(t, var))


def _hist_cte(v: str = "alt_mean") -> str:
    return f"""x AS ({_X.format(v=v)}),
s AS (SELECT ROUND(quantile_cont(CAST({v} AS DOUBLE), 0.02), 3) AS lo, ROUND(quantile_cont(CAST({v} AS DOUBLE), 0.98), 3) AS hi
      FROM env WHERE NOT isnan({v})),
sp AS (SELECT lo, hi, (hi - lo) / 120 AS bw FROM s),
h AS (SELECT area, CAST(LEAST(GREATEST(FLOOR((x - lo) / bw), 0), 119) AS INT) AS bin, SUM(w) AS pop FROM x CROSS JOIN sp GROUP BY 1, 2)"""


@query("a04_weighted_histogram", "core env",
       f"WITH {_hist_cte()} SELECT bin, ROUND(SUM(pop), 6) AS pop FROM h GROUP BY 1")
def _(t):
    return rounded(M.weighted_histogram(_cells(t), _spec(t)), "pop")


@query("a04_weighted_histogram_by_area", "core env",
       f"WITH {_hist_cte()} SELECT area, bin, ROUND(pop, 6) AS pop FROM h")
def _(t):
    return rounded(M.weighted_histogram(_cells(t), _spec(t), ["area"]), "pop")


@query("a05_histogram_range", "env", f"""
WITH {_hist_cte().split('h AS (')[0].replace('x AS (' + _X.format(v='alt_mean') + '),', '').strip().rstrip(',')}
SELECT 'alt_mean' AS variable, lo, hi, ROUND(bw, 6) AS bw FROM sp""")
def _(t):
    return rounded(_spec_row(t), "bw")


@query("a06_weighted_mean", "core env", f"""
WITH x AS ({_X.format(v='alt_mean')})
SELECT area, ROUND(SUM(x * w) / NULLIF(SUM(w), 0), 6) AS wmean, ROUND(SUM(w), 6) AS pop FROM x GROUP BY area""")
def _(t):
    return rounded(M.weighted_mean(_cells(t), ["area"]), "wmean", "pop")


_QUANT = """, c AS (SELECT *, SUM(pop) OVER (PARTITION BY area ORDER BY bin) AS cum, SUM(pop) OVER (PARTITION BY area) AS total FROM h),
qq AS (SELECT * FROM (VALUES (0.1), (0.5), (0.9)) v(q)),
f AS (SELECT area, q, MIN(bin) AS bin FROM c CROSS JOIN qq WHERE total > 0 AND cum >= total * CAST(q AS DOUBLE) GROUP BY 1, 2),
qt AS (SELECT f.area, f.q, lo + (f.bin + CASE WHEN c.pop > 0 THEN (c.total * CAST(f.q AS DOUBLE) - (c.cum - c.pop)) / c.pop ELSE 0 END) * bw AS value
       FROM f JOIN c ON c.area = f.area AND c.bin = f.bin CROSS JOIN sp)"""


@query("a07_weighted_quantiles", "core env",
       f"WITH {_hist_cte()}{_QUANT} SELECT area, CAST(q AS DOUBLE) AS q, ROUND(value, 6) AS value FROM qt")
def _(t):
    spec = _spec(t)
    return rounded(M.histogram_quantiles(M.weighted_histogram(_cells(t), spec, ["area"]), spec, [0.1, 0.5, 0.9], ["area"]), "value")


@query("a07_exact_weighted_quantiles", "core env", f"""
WITH x AS ({_X.format(v='alt_mean')}), d AS (SELECT area, x, SUM(w) AS w FROM x WHERE w > 0 GROUP BY 1, 2),
c AS (SELECT *, SUM(w) OVER (PARTITION BY area ORDER BY x) AS cum, SUM(w) OVER (PARTITION BY area) AS total FROM d)
SELECT area, CAST(q AS DOUBLE) AS q, ROUND(MIN(x), 6) AS value FROM c CROSS JOIN (VALUES (0.1), (0.5), (0.9)) v(q)
WHERE cum >= CAST(q AS DOUBLE) * total GROUP BY 1, 2""")
def _(t):
    return rounded(M.exact_quantiles(_cells(t), [0.1, 0.5, 0.9], ["area"]), "value")


@query("a08_display_bins", "core env", f"""
WITH {_hist_cte()}, d AS (SELECT area, CAST(FLOOR(bin / 3) AS INT) AS display_bin, SUM(pop) AS pop FROM h GROUP BY 1, 2)
SELECT area, display_bin, ROUND(lo + (display_bin * 3 + 1.5) * bw, 6) AS centre, ROUND(pop, 6) AS pop,
       ROUND(100 * (pop / NULLIF(SUM(pop) OVER (PARTITION BY area), 0)), 6) AS pct FROM d CROSS JOIN sp""")
def _(t):
    spec = _spec(t)
    return rounded(M.display_bins(M.weighted_histogram(_cells(t), spec, ["area"]), spec, 40, ["area"]),
                   "centre", "pop", "pct")


@query("a09_category_distribution", "core env", f"""
SELECT landform_type AS cat, CAST(SUM(pop_total) AS DOUBLE) AS pop, COUNT(*) AS cells FROM {JOIN2}
WHERE landform_type IS NOT NULL AND dist_km < 20 GROUP BY 1""")
def _(t):
    return M.category_distribution(_cells(t, "landform_type", Between("dist_km", None, 20)))


_RANK = f"""WITH x AS ({_X.format(v='alt_mean')}),
m AS (SELECT area, SUM(x * w) / NULLIF(SUM(w), 0) AS wmean, SUM(w) AS pop FROM x WHERE area IS NOT NULL GROUP BY 1 HAVING SUM(w) > 0)
SELECT area, ROUND(wmean, 6) AS wmean, pop, CAST(ROW_NUMBER() OVER (ORDER BY wmean DESC, area) AS INT) AS pos,
       ROUND(ABS(wmean) / MAX(ABS(wmean)) OVER (), 6) AS rel FROM m"""


@query("a10_county_ranking", "core env", _RANK)
def _(t):
    return rounded(M.ranking(_cells(t)), "wmean", "rel").orderBy("pos")


@query("w05_rank_position_within_filter", "core env", _RANK.replace("WHERE area IS NOT NULL", "WHERE x >= 500 AND area IS NOT NULL"))
def _(t):
    return rounded(M.ranking(_cells(t, "alt_mean", Between("alt_mean", 500))), "wmean", "rel")


@query("a11_registry_statistics", "env", _stats_sql(_STATS_VARS, "env"))
def _(t):
    return rounded(M.numeric_stats(t.env, _STATS_VARS), "min", "max", "p02", "p50", "p98", places=3)


@query("a12_registry_categories", "env", """
WITH l AS (SELECT 'landform_type' AS variable, landform_type AS value FROM env UNION ALL SELECT 'county_mn', county_mn FROM env
           UNION ALL SELECT 'uat_name', uat_name FROM env),
c AS (SELECT variable, value, COUNT(*) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT variable, value, n, CAST(pos AS INT) AS pos FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY variable ORDER BY n DESC, value) AS pos FROM c) z WHERE pos <= 200""")
def _(t):
    return M.category_counts(t.env, ["landform_type", "county_mn", "uat_name"])


@query("a13_national_totals", "core", "SELECT " + ", ".join(f"CAST(SUM({m}) AS BIGINT) AS {m}" for m in C.MEASURES) + " FROM core")
def _(t):
    return M.national_totals(t.core, list(C.MEASURES))


@query("a13_label_pairs", "env", "SELECT DISTINCT county_mn, county_name FROM env WHERE county_mn IS NOT NULL")
def _(t):
    return M.label_pairs(t.env)


@query("a13_label_map", "env", """
SELECT k.unnest.key AS county_mn, k.unnest.value AS county_name FROM (
 SELECT unnest(map_entries(map_from_entries(list((county_mn, county_name))))) AS unnest
 FROM (SELECT DISTINCT county_mn, county_name FROM env WHERE county_mn IS NOT NULL) p) k""")
def _(t):
    m = M.label_map(M.label_pairs(t.env), "county_mn", "county_name")
    return m.select(F.explode("labels").alias("county_mn", "county_name"))


@query("a14_consistency_checks", "core", """
SELECT 'sex' AS check, COUNT(*) FILTER (pop_f + pop_m <> pop_total) AS violations FROM core
UNION ALL SELECT 'age', COUNT(*) FILTER (pop_0_14 + pop_15_64 + pop_65p <> pop_total) FROM core
UNION ALL SELECT 'employed', COUNT(*) FILTER (pop_ocupata <> pop_total) FROM core""")
def _(t):
    return M.consistency(t.core, {"sex": (["pop_f", "pop_m"], "pop_total"),
                                  "age": (["pop_0_14", "pop_15_64", "pop_65p"], "pop_total"),
                                  "employed": (["pop_ocupata"], "pop_total")})


@query("a15_coverage_and_ranges", "env", """
SELECT 'landform_type' AS variable, ROUND(AVG(CASE WHEN landform_type IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage,
       CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max FROM env
UNION ALL SELECT 'alt_mean', ROUND(AVG(CASE WHEN isnan(alt_mean) THEN 0.0 ELSE 1.0 END), 6),
       ROUND(CAST(MIN(alt_mean) AS DOUBLE), 4), ROUND(CAST(MAX(alt_mean) FILTER (NOT isnan(alt_mean)) AS DOUBLE), 4) FROM env
UNION ALL SELECT 'slope_mean', 1.0, ROUND(CAST(MIN(slope_mean) AS DOUBLE), 4), ROUND(CAST(MAX(slope_mean) AS DOUBLE), 4) FROM env""")
def _(t):
    return rounded(rounded(M.coverage(t.env, ["landform_type", "alt_mean", "slope_mean"]), "coverage"), "min", "max", places=4)


_GOLD_SQL = [
    ("coast < 5 km", "pop_total", "dist_coast_km < 5"), ("border < 30 km", "pop_total", "dist_border_km < 30"),
    ("mountain landform", "pop_total", "landform_type = 'munte'"),
    ("hill landform", "pop_total", "landform_type IN ('deal','podiș','depresiune')"),
    ("plain landform", "pop_total", "landform_type IN ('câmpie','vale','grind','baltă/lac')"),
    ("altitude > 1000 m", "pop_total", "alt_mean > 1000 AND NOT isnan(alt_mean)"),
    ("urban unit", "pop_total", "mediu = 'urban'"), ("rural unit", "pop_total", "mediu = 'rural'"),
    ("built-up urban", "pop_total", "intravilan = 'oraș'"), ("built-up village", "pop_total", "intravilan = 'sat'"),
    ("outside built-up", "pop_total", "intravilan IS NULL"), ("gas connected", "pop_total", "acces_gaz = 'conectat'"),
    ("gas not connected", "pop_total", "acces_gaz = 'neconectat'"),
    ("protected area 0 km", "pop_total", "dist_protected_km <= 0"),
    ("protected area <= 1 km", "pop_total", "dist_protected_km <= 1"),
    ("water body < 1 km", "pop_total", "dist_water_km < 1"), ("watercourse < 0.5 km", "pop_total", "dist_curs_km < 0.5"),
    ("hospital >= 10 km", "pop_total", "dist_hospital_km >= 10"), ("hospital >= 20 km", "pop_total", "dist_hospital_km >= 20"),
    ("hospital >= 25 km", "pop_total", "dist_hospital_km >= 25"), ("airport >= 50 km", "pop_total", "dist_airport_km >= 50"),
    ("airport >= 100 km", "pop_total", "dist_airport_km >= 100"), ("warming >= 1.1 C", "pop_total", "h AND warming_deg >= 1.1"),
    ("women, 200-500 m, < 400 mm, 11.5-12.5 C", "pop_f",
     "h AND alt_mean BETWEEN 200 AND 500 AND precip_total < 400 AND tmean BETWEEN 11.5 AND 12.5"),
]


@query("a16_golden_report", ALL, _WIDE + ", g AS (" + " UNION ALL ".join(
    f"SELECT '{lb}' AS label, CAST(COALESCE(SUM({m}) FILTER ({w}), 0) AS BIGINT) AS value FROM j" for lb, m, w in _GOLD_SQL)
    + """ UNION ALL SELECT 'mean airport distance', CAST(TRUNC(ROUND(SUM(CAST(dist_airport_km AS DOUBLE) * pop_total) / SUM(pop_total), 1)) AS BIGINT) FROM j)
SELECT label, value, ROUND(CAST(value AS DOUBLE) / (SELECT SUM(pop_total) FROM core), 6) AS pct FROM g""")
def _(t):
    return rounded(Q.golden_report(atlas(t), C.GOLDEN, C.GOLDEN_MEAN), "pct")


@query("a35_area_comparison", "core env", f"""
WITH {_hist_cte()}{_QUANT},
p AS (SELECT area, MAX(CASE WHEN q = 0.1 THEN value END) AS p10, MAX(CASE WHEN q = 0.5 THEN value END) AS p50,
             MAX(CASE WHEN q = 0.9 THEN value END) AS p90 FROM qt GROUP BY 1),
m AS (SELECT area, SUM(x * w) / NULLIF(SUM(w), 0) AS wmean FROM x GROUP BY 1)
SELECT ROUND(a.p10, 6) AS p10_a, ROUND(a.p50, 6) AS p50_a, ROUND(a.p90, 6) AS p90_a, ROUND(ma.wmean, 6) AS wmean_a,
       ROUND(b.p10, 6) AS p10_b, ROUND(b.p50, 6) AS p50_b, ROUND(b.p90, 6) AS p90_b, ROUND(mb.wmean, 6) AS wmean_b,
       CASE WHEN ABS(a.p50 - b.p50) < GREATEST(ABS(a.p50), 1e-9) * 0.02 THEN 'about equal' WHEN a.p50 > b.p50 THEN 'higher' ELSE 'lower' END AS verdict
FROM p a JOIN m ma ON ma.area = a.area CROSS JOIN p b JOIN m mb ON mb.area = b.area WHERE a.area = 'NATION_0' AND b.area = 'NATION_1'""")
def _(t):
    df = M.compare_areas(_cells(t), _spec(t), "NATION_0", "NATION_1")
    return rounded(df, *[c for c in df.columns if c != "verdict"])


_DIST = f"""d AS (SELECT landform_type AS cat, CAST(SUM(pop_total) AS DOUBLE) AS pop FROM {JOIN2} WHERE landform_type IS NOT NULL GROUP BY 1)"""


@query("a36_top_category_share", "core env", f"""
WITH {_DIST} SELECT cat, pop, CAST(ROW_NUMBER() OVER (ORDER BY pop DESC, cat) AS INT) AS pos,
 ROUND(pop / SUM(pop) OVER (), 6) AS share, ROUND(SUM(pop) OVER (ORDER BY pop DESC, cat ROWS UNBOUNDED PRECEDING) / SUM(pop) OVER (), 6) AS cum_share FROM d""")
def _(t):
    return rounded(M.top_categories(M.category_distribution(_cells(t, "landform_type"))), "share", "cum_share")


@query("a40_category_comparison", "core env", f"""
WITH d AS (SELECT county_mn AS area, landform_type AS cat, CAST(SUM(pop_total) AS DOUBLE) AS pop FROM {JOIN2} WHERE landform_type IS NOT NULL GROUP BY 1, 2),
a AS (SELECT * FROM d WHERE area = 'NATION_0'), b AS (SELECT * FROM d WHERE area = 'NATION_1')
SELECT a.cat, ROUND(a.pop / (SELECT SUM(pop) FROM a), 6) AS share_a, ROUND(COALESCE(b.pop, 0) / (SELECT SUM(pop) FROM b), 6) AS share_b
FROM a LEFT JOIN b ON b.cat = a.cat""")
def _(t):
    dist = M.category_distribution(_cells(t, "landform_type"), ["area"])
    return rounded(M.category_comparison(dist, "NATION_0", "NATION_1"), "share_a", "share_b")


@query("a38_value_profile", "climate", """
SELECT ROUND(MIN(CAST(tmean AS DOUBLE)), 4) AS min, ROUND(quantile_cont(CAST(tmean AS DOUBLE), 0.5), 4) AS median, ROUND(MAX(CAST(tmean AS DOUBLE)), 4) AS max FROM climate""")
def _(t):
    return rounded(M.value_profile(t.climate, "tmean"), "min", "median", "max", places=4)


@query("a38_category_value_counts", "env", "SELECT risc_urs AS value, COUNT(*) AS n FROM env GROUP BY 1")
def _(t):
    return t.env.groupBy(F.col("risc_urs").alias("value")).agg(F.count(F.lit(1)).alias("n"))


# --- order and limits ----------------------------------------------------------------------

@query("o01_ordered_result", "core env", _RANK.replace(", ROUND(ABS(wmean) / MAX(ABS(wmean)) OVER (), 6) AS rel", "")
       .replace("ROW_NUMBER() OVER (ORDER BY wmean DESC, area)", "ROW_NUMBER() OVER (ORDER BY wmean DESC NULLS LAST, area)").replace(",\n       ROUND(ABS(wmean) / MAX(ABS(wmean)) OVER (), 6) AS rel", ""))
def _(t):
    r = M.ranking(_cells(t)).orderBy(F.desc_nulls_last("wmean"), "area")
    return rounded(r.drop("rel"), "wmean")


@query("o02_top_k_cells", "core", "SELECT cell_id, pop_total FROM core ORDER BY pop_total DESC, cell_id LIMIT 12")
def _(t):
    return t.core.select("cell_id", "pop_total").orderBy(F.desc("pop_total"), "cell_id").limit(12)


@query("o04_pinned_last_categories", "env", """
WITH c AS (SELECT 'categorie_apa' AS variable, categorie_apa AS value, COUNT(*) AS n FROM env WHERE categorie_apa IS NOT NULL GROUP BY 2)
SELECT variable, value, n, CAST(ROW_NUMBER() OVER (ORDER BY value = 'Alt tip', n DESC, value) AS INT) AS pos FROM c""")
def _(t):
    return M.pinned_last_order(M.category_counts(t.env, ["categorie_apa"]).drop("pos"), REG["categorie_apa"].pin_last)


# --- cell sets -----------------------------------------------------------------------------

@query("g19_cell_bitmap", "core env", f"""
SELECT county_mn, COUNT(DISTINCT cell_id) AS n_cells FROM {JOIN2} WHERE dist_km < 5 OR dist_coast_km < 5 GROUP BY 1""")
def _(t):
    near = Q.selection(atlas(t), _ask(Between("dist_km", None, 5)), ("county_mn",)).select("cell_id", "county_mn")
    sea = Q.selection(atlas(t), _ask(Between("dist_coast_km", None, 5)), ("county_mn",)).select("cell_id", "county_mn")
    both = M.cell_bitmap(near, ["county_mn"]).unionByName(M.cell_bitmap(sea, ["county_mn"]))
    return M.bitmap_cardinality(M.bitmap_union(both, ["county_mn"]), ["county_mn"])


@query("g20_log_density_class", "core env", f"""
SELECT cell_id, CASE WHEN pop_total > 0 THEN CAST(FLOOR(LEAST(1.0, LOG10(CAST(pop_total AS DOUBLE)) / 4) * 255) AS INT) ELSE -1 END AS shade
FROM {JOIN2} WHERE dist_km < 20""")
def _(t):
    return Q.cell_values(atlas(t), _ask(Between("dist_km", None, 20))).select("cell_id", M.density_class(F.col("val")).alias("shade"))


@query("f20_share_display_class", "core", """
WITH s AS (SELECT cell_id, CAST(pop_total AS DOUBLE) / (SELECT SUM(pop_total) FROM core) AS share FROM core)
SELECT cell_id, CASE WHEN share > 0 AND share < 0.001 THEN '<0.1%' ELSE printf('%.1f', ROUND(share * 100, 1)) || '%' END AS label FROM s""")
def _(t):
    whole = t.core.agg(F.sum("pop_total").alias("total"))
    return attach(t.core, whole).select("cell_id", share_label(F.col("pop_total").cast("double") / F.col("total")).alias("label"))


@query("f14_missing_value_tests", "env", """
SELECT COUNT(*) FILTER (isnan(alt_mean)) AS n_nan, COUNT(*) FILTER (landform_type IS NULL) AS n_null,
 ROUND(SUM(CASE WHEN isnan(alt_mean) THEN 0 ELSE CAST(alt_mean AS DOUBLE) END), 4) AS total FROM env""")
def _(t):
    env = t.env
    clean = nan_to_null(env, "alt_mean").agg(F.sum(F.coalesce(F.col("alt_mean").cast("double"), F.lit(0.0))).alias("total"))
    counts = env.agg(F.count_if(F.isnan("alt_mean")).alias("n_nan"), F.count_if(F.col("landform_type").isNull()).alias("n_null"))
    return attach(counts, rounded(clean, "total", places=4))
