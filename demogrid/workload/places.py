"""Places compared: similar ones, neighbourhoods, positions among all, travel times to facilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import focal, overlay, positions, similar
from .base import BINDINGS, query

# --- similar places ----------------------------------------------------------------------------------

_TOP = """SELECT id, ROW_NUMBER() OVER (PARTITION BY id ORDER BY similarity DESC, other)::INT AS rank, other, similarity FROM s
QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY similarity DESC, other) <= """


def _vectors(t):
    return similar.unit_vectors(t.base("embeddings"), "vec_id", "embedding")


def _every_100th(index):
    return index.table.filter("id % 100 = 0").select("id", "vec")


@query("x07_similar_places", "", f"""
WITH u AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.id, b.id AS other, ROUND(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM u a JOIN u b ON a.id <> b.id WHERE a.id % 100 = 0)
{_TOP} 10""")
def _(t):
    index = similar.build_index(_vectors(t))
    return similar.most_similar(index, _every_100th(index), 10)


@query("x07_similar_places_indexed")
def _(t):
    index = similar.build_index(_vectors(t))
    asked = _every_100th(index)
    return similar.most_similar(index, asked, 10, probes=similar.probes_for(index, asked, 10))


@query("x07_index_recall")
def _(t):
    index = similar.build_index(_vectors(t))
    asked = _every_100th(index)
    return similar.recall_by_probes(index, asked, similar.most_similar(index, asked, 10))


_PROFILE = ["alt_mean", "slope_mean", "dist_coast_km", "dist_border_km", "dist_water_km", "dist_curs_km", "dist_protected_km", "dist_hospital_km", "dist_airport_km"]


@query("x07_similar_cells", "env", f"""
, f AS (SELECT cell_id AS id, {", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c}::DOUBLE END AS {c}" for c in _PROFILE)} FROM env),
z AS (SELECT id, [{", ".join(f"COALESCE(({c} - AVG({c}) OVER ()) / NULLIF(STDDEV_POP({c}) OVER (), 0), 0)" for c in _PROFILE)}] AS v FROM f),
s AS (SELECT a.id, b.id AS other, ROUND(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM z a JOIN z b ON a.id <> b.id WHERE a.id % 100 = 0)
{_TOP} 5""")
def _(t):
    index = similar.build_index(similar.unit_vectors(similar.profile_vector(t.env, _PROFILE), "cell_id", "profile"))
    return similar.most_similar(index, _every_100th(index), 5)


# --- neighbourhoods ------------------------------------------------------------------------------------

_CLASSES = ["munte", "deal"]
_NEAR = """
, c AS (SELECT cell_id, row, col, pop_total, CASE WHEN isnan(alt_mean) THEN NULL ELSE alt_mean::DOUBLE END AS alt_mean, landform_type FROM core JOIN env USING (cell_id) {gaps}),
d AS (SELECT a.cell_id, r.radius, b.pop_total, b.alt_mean, b.landform_type FROM c a, (SELECT UNNEST([1.0, 3.0, 5.0])::DOUBLE AS radius) r
  JOIN c b ON b.row BETWEEN a.row - 5 AND a.row + 5 AND (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= r.radius * r.radius)
SELECT cell_id, radius, COUNT(*) AS n_cells, SUM(pop_total)::BIGINT AS sum_pop_total, ROUND(AVG(alt_mean), 6) AS mean_alt_mean,
  ROUND(COUNT(*) FILTER (landform_type = 'munte') / NULLIF(COUNT(landform_type), 0), 9) AS share_landform_type_0,
  ROUND(COUNT(*) FILTER (landform_type = 'deal') / NULLIF(COUNT(landform_type), 0), 9) AS share_landform_type_1
FROM d GROUP BY 1, 2"""


def _focal(cells):
    out = focal.focal_statistics(cells, [1, 3, 5], ["pop_total"], ["alt_mean"], {"landform_type": _CLASSES})
    return out.withColumns({"mean_alt_mean": F.round("mean_alt_mean", 6), "share_landform_type_0": F.round("share_landform_type_0", 9),
                            "share_landform_type_1": F.round("share_landform_type_1", 9)})


@query("x11_focal_statistics", "core env", _NEAR.format(gaps=""))
def _(t):
    return _focal(t.core.join(t.env, "cell_id"))


@query("x11_focal_over_gaps", "core env climate", _NEAR.format(gaps="WHERE cell_id IN (SELECT cell_id FROM climate WHERE hot_days % 3 <> 0)"))
def _(t):
    return _focal(t.core.join(t.env, "cell_id").join(t.climate.filter("hot_days % 3 <> 0"), "cell_id", "left_semi"))


# --- positions -----------------------------------------------------------------------------------------

_NUMERIC = ["pop_total", "pop_65p", *_PROFILE, "dist_km", "tmean", "precip_total"]


@query("x06_percentile_positions", "core env climate", f"""
, w AS (SELECT cell_id, county_mn, {", ".join(f"{c}::DOUBLE AS {c}" for c in _NUMERIC)} FROM core JOIN env USING (cell_id) LEFT JOIN climate USING (cell_id)),
l AS (SELECT * FROM (UNPIVOT w ON {", ".join(_NUMERIC)} INTO NAME variable VALUE value) WHERE NOT isnan(value))
SELECT cell_id, variable, value, ROUND(100 * PERCENT_RANK() OVER (PARTITION BY variable ORDER BY value), 9) AS position,
  ROUND(100 * PERCENT_RANK() OVER (PARTITION BY variable, county_mn ORDER BY value), 9) AS position_within FROM l""")
def _(t):
    wide = t.core.join(t.env, "cell_id").join(t.climate, "cell_id", "left")
    out = positions.percentile_positions(wide, _NUMERIC, "county_mn")
    return out.withColumns({"position": F.round("position", 9), "position_within": F.round("position_within", 9)})


# --- travel times ----------------------------------------------------------------------------------------

# Neighbouring cells are joined by a road each way, whose costs follow the balances; some roads are missing.
BINDINGS["lanes"] = """
SELECT a.c_custkey AS source, b.c_custkey AS target, CAST(FLOOR(ABS(a.c_acctbal)) AS BIGINT) % 9 + 1 AS cost
FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 40 <> 39 AND a.c_custkey % 11 <> 3
UNION ALL SELECT b.c_custkey, a.c_custkey, CAST(FLOOR(ABS(b.c_acctbal)) AS BIGINT) % 7 + 1
FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 40 <> 39 AND a.c_custkey % 13 <> 5
UNION ALL SELECT a.c_custkey, b.c_custkey, CAST(FLOOR(ABS(a.c_acctbal)) AS BIGINT) % 5 + 1
FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 40
UNION ALL SELECT b.c_custkey, a.c_custkey, CAST(FLOOR(ABS(b.c_acctbal)) AS BIGINT) % 8 + 2
FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 40 WHERE b.c_custkey % 17 <> 2"""
BINDINGS["few_places"] = "SELECT r_regionkey * 37 + 5 AS vertex, r_regionkey AS facility FROM region"
BINDINGS["many_places"] = "SELECT c_custkey AS vertex, CAST(FLOOR(c_custkey / 194.0) AS BIGINT) AS facility FROM customer WHERE c_custkey % 97 = 0"

_MATRIX = """
WITH RECURSIVE dj(v, f, c) USING KEY (v, f) AS (SELECT vertex, facility, 0::BIGINT FROM {places} UNION
  SELECT o.v, o.f, MIN(o.c) FROM (SELECT r.source AS v, d.f, d.c + r.cost AS c FROM dj d JOIN lanes r ON r.target = d.v) o
  LEFT JOIN recurring.dj k ON k.v = o.v AND k.f = o.f WHERE {limit} (k.c IS NULL OR o.c < k.c) GROUP BY o.v, o.f)"""


def _overlay(t):
    junctions = t.junctions.select("vertex", "x", "y")
    return overlay.build_overlay(t.lanes, overlay.spatial_partitions(junctions, 256))


@query("x13_travel_time_matrix", "lanes few_places", _MATRIX.format(places="few_places", limit="") +
       " SELECT v AS vertex, f AS facility, c::DOUBLE AS cost FROM dj")
def _(t):
    return overlay.travel_time_matrix(_overlay(t), t.few_places)


@query("x13_travel_times_within", "lanes many_places", _MATRIX.format(places="many_places", limit="o.c <= 60 AND") +
       " SELECT v AS vertex, f AS facility, c::DOUBLE AS cost FROM dj")
def _(t):
    return overlay.travel_time_matrix(_overlay(t), t.many_places, 60)


@query("x13_two_nearest_facilities", "lanes few_places", _MATRIX.format(places="few_places", limit="") + """
SELECT v AS vertex, (ROW_NUMBER() OVER (PARTITION BY v ORDER BY c, f))::INT AS rank, f AS facility, c::DOUBLE AS cost FROM dj
QUALIFY ROW_NUMBER() OVER (PARTITION BY v ORDER BY c, f) <= 2""")
def _(t):
    return overlay.nearest_facilities(overlay.travel_time_matrix(_overlay(t), t.few_places), 2)
