"""Warning feeds and the people under them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import warnings as N
from ..sources import feeds as X
from .base import query

_BOX = """box AS (SELECT *, 'm' || CAST(id AS VARCHAR) AS group_id, CASE level_rank WHEN 0 THEN 'VE' WHEN 1 THEN 'GA' WHEN 2 THEN 'PO' ELSE 'RO' END AS level_code,
 CASE level_rank WHEN 0 THEN 'Verde/Informare' WHEN 1 THEN 'Galben' WHEN 2 THEN 'Portocaliu' ELSE 'Roșu' END AS level_name FROM messages),
hit AS (SELECT p.cell_id, b.group_id, b.source, b.level_rank, b.level_code, b.level_name FROM points p JOIN box b
 ON p.x > b.cx - 1500 AND p.x < b.cx + 1500 AND p.y > b.cy - 1500 AND p.y < b.cy + 1500)"""
_WORST = """ws AS (SELECT cell_id, source, MAX(level_rank) AS level_rank FROM hit GROUP BY 1, 2),
w AS (SELECT *, CASE level_rank WHEN 0 THEN 'VE' WHEN 1 THEN 'GA' WHEN 2 THEN 'PO' ELSE 'RO' END AS level_code,
 CASE level_rank WHEN 0 THEN 'Verde/Informare' WHEN 1 THEN 'Galben' WHEN 2 THEN 'Portocaliu' ELSE 'Roșu' END AS level_name FROM ws)"""


def box_edges(messages):
    """The square around each message as one outline of four edges."""
    lo_x, hi_x = F.col("cx") - 1500.0, F.col("cx") + 1500.0
    lo_y, hi_y = F.col("cy") - 1500.0, F.col("cy") + 1500.0

    def edge(x1, y1, x2, y2):
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    return messages.select(F.col("id").alias("feature_id"), F.array(
        edge(lo_x, lo_y, hi_x, lo_y), edge(hi_x, lo_y, hi_x, hi_y), edge(hi_x, hi_y, lo_x, hi_y), edge(lo_x, hi_y, lo_x, lo_y)).alias("outline"))


def features(messages):
    return messages.select(F.col("id").alias("feature_id"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("group_id"),
                           "source", "level_rank")


def hits(t):
    m = t.messages
    return N.cells_of_features(t.points, box_edges(m), features(m))


def worst(t):
    return N.worst_per(hits(t), "cell_id", "source")


# --- XML ----------------------------------------------------------------------------------------

_WKT = ("'POLYGON ((' || CAST(cx - 1500 AS STRING) || ' ' || CAST(cy - 1500 AS STRING) || ', ' || CAST(cx + 1500 AS STRING) || ' ' || CAST(cy - 1500 AS STRING)"
        " || ', ' || CAST(cx + 1500 AS STRING) || ' ' || CAST(cy + 1500 AS STRING) || ', ' || CAST(cx - 1500 AS STRING) || ' ' || CAST(cy + 1500 AS STRING)"
        " || ', ' || CAST(cx - 1500 AS STRING) || ' ' || CAST(cy - 1500 AS STRING) || '))'")


def _spread(messages):
    """An element costs much more than the row it is made of, so few files must not make few tasks."""
    return messages.repartition("id")


def _nowcast_xml(t):
    """Feed elements built from the messages: one in four repeats an id, unknown codes occur."""
    m = _spread(t.messages.filter("source = 'nowcasting'"))
    code = F.when(F.col("level_rank") == 3, "XX").otherwise(F.element_at(F.array(F.lit("ve"), F.lit("GA"), F.lit("PO")), (F.col("level_rank") + 1).cast("int")))
    el = F.format_string('<avertizare avertizareId="%d" avertizareNivelCod="%s" coordsGis="%s" useCoordsGis="%s" dataInceput="%s">'
                         '<zona_afectata text="zone %d"/><zona_afectata text="row %d"/></avertizare>',
                         F.floor(F.col("id") / 4), code, F.expr(_WKT), F.when(F.col("level_rank") == 0, "false").otherwise("true"),
                         F.date_format("start_ts", "yyyy-MM-dd"), (F.col("cx") / 1000).cast("int"), (F.col("cy") / 1000).cast("int"))
    return m.select(F.col("id").alias("pos"), el.alias("xml"))


@query("src11_nowcasting_feed", "messages", """
WITH f AS (SELECT *, CAST(FLOOR(id / 4) AS BIGINT) AS wid, ROW_NUMBER() OVER (PARTITION BY FLOOR(id / 4) ORDER BY id) AS k FROM messages WHERE source = 'nowcasting')
SELECT CAST(wid AS VARCHAR) AS id, 'n' || CAST(wid AS VARCHAR) AS group_id, CAST(CASE level_rank WHEN 3 THEN 1 ELSE level_rank END AS INT) AS level_rank,
 CASE level_rank WHEN 0 THEN 'VE' WHEN 2 THEN 'PO' ELSE 'GA' END AS level_code, strftime(start_ts, '%Y-%m-%d') AS start,
 'zone ' || CAST(cx // 1000 AS VARCHAR) || ' row ' || CAST(cy // 1000 AS VARCHAR) AS area_text, level_rank <> 0 AS has_geometry FROM f WHERE k = 1""")
def _(t):
    m = X.nowcasting_messages(X.parse_elements(_nowcast_xml(t), "xml", X.NOWCASTING_SCHEMA))
    return m.select("id", "group_id", "level_rank", "level_code", "start", "area_text", F.col("wkt").isNotNull().alias("has_geometry"))


def _general_xml(t):
    """A county, a zone of a higher colour, and a context zone of colour 0 per message."""
    m = _spread(t.messages.filter("source = 'general'"))
    el = F.format_string('<avertizare numeTipMesaj="Cod" dataAparitiei="%s"><judet cod="J%d" culoare="%d" coordGis="%s"/>'
                         '<zona cod="Z%d" culoare="%d" coordGis="%s"/><zona cod="C" culoare="0" coordGis="%s"/><zona cod="U" culoare="3" useCoordGis="false" coordGis="%s"/></avertizare>',
                         F.date_format("start_ts", "yyyy-MM-dd"), F.col("id") % 41, F.col("level_rank"), F.expr(_WKT), F.col("id") % 7,
                         F.least(F.lit(3), F.col("level_rank") + 1), F.expr(_WKT), F.expr(_WKT), F.expr(_WKT))
    return X.parse_elements(m.select(F.col("id").alias("pos"), el.alias("xml")), "xml", X.GENERAL_SCHEMA)


_GENF = """gf AS (SELECT 'g' || CAST(id AS VARCHAR) AS group_id, 'judet' AS unit_kind, 'J' || CAST(id % 41 AS VARCHAR) AS unit_cod, CAST(level_rank AS INT) AS level_rank
  FROM messages WHERE source = 'general' AND level_rank >= 1
 UNION ALL SELECT 'g' || CAST(id AS VARCHAR), 'zona', 'Z' || CAST(id % 7 AS VARCHAR), CAST(LEAST(3, level_rank + 1) AS INT) FROM messages WHERE source = 'general')"""


@query("src12_general_feed_features", "messages", f"WITH {_GENF} SELECT group_id, unit_kind, unit_cod, level_rank FROM gf")
def _(t):
    return X.general_features(_general_xml(t)).select("group_id", "unit_kind", "unit_cod", "level_rank")


@query("src12_general_feed_messages", "messages", f"""
WITH {_GENF} SELECT g.group_id, MAX(g.level_rank) AS level_rank, strftime(MAX(m.start_ts), '%Y-%m-%d') AS start,
 COALESCE(MAX(unit_cod) FILTER (unit_kind = 'judet'), '') AS counties, COUNT(*) FILTER (unit_kind = 'zona') AS n_zones,
 array_to_string(list_reverse(list_sort(list(DISTINCT g.level_rank))), ',') AS levels FROM gf g JOIN messages m ON 'g' || CAST(m.id AS VARCHAR) = g.group_id GROUP BY 1""")
def _(t):
    rows = _general_xml(t)
    m = X.general_messages(rows, X.general_features(rows))
    return m.select("group_id", "level_rank", "start", F.array_join("counties", ",").alias("counties"), "n_zones",
                    F.array_join(F.transform("level_mix", lambda x: x["rank"].cast("string")), ",").alias("levels"))


@query("src12_xml_to_exposure", "messages points core", f"""
WITH {_BOX.replace("FROM messages)", "FROM messages WHERE source = 'general')")}
SELECT 'g' || substring(group_id, 2) AS group_id, CAST(SUM(pop_total) AS BIGINT) AS pop FROM (SELECT DISTINCT cell_id, group_id FROM hit) h JOIN core USING (cell_id) GROUP BY 1""")
def _(t):
    from ..sources.vectors import wkt_outlines

    f = X.general_features(_general_xml(t)).withColumn("feature_id", F.xxhash64("group_id", "unit_kind", "unit_cod"))
    edges = wkt_outlines(f, "wkt", ["feature_id"])
    pairs = N.cells_of_features(t.points, edges, f.select("feature_id", "group_id"))
    return N.people_by_message(pairs, t.core)


# --- people --------------------------------------------------------------------------------------

@query("a25_people_by_message", "messages points core", f"""
WITH {_BOX} SELECT group_id, CAST(SUM(pop_total) AS BIGINT) AS pop FROM (SELECT DISTINCT cell_id, group_id FROM hit) h JOIN core USING (cell_id) GROUP BY 1""")
def _(t):
    return N.people_by_message(hits(t), t.core)


@query("a26_worst_level_per_cell_and_source", "messages points", f"WITH {_BOX}, {_WORST} SELECT cell_id, source, level_rank, level_code, level_name FROM w")
def _(t):
    return worst(t)


@query("a26_worst_level_per_cell_and_message", "messages points", f"""
WITH {_BOX} SELECT cell_id, group_id, MAX(level_rank) AS level_rank, MAX(level_code) AS level_code, MAX(level_name) AS level_name FROM hit GROUP BY 1, 2""")
def _(t):
    return N.worst_per(hits(t), "cell_id", "group_id")


_BYL = "bl AS (SELECT source, level_rank, level_code, level_name, CAST(SUM(pop_total) AS BIGINT) AS pop, COUNT(*) AS n_cells FROM w JOIN core USING (cell_id) GROUP BY 1, 2, 3, 4)"


@query("a27_people_by_source_and_level", "messages points core", f"WITH {_BOX}, {_WORST}, {_BYL} SELECT * FROM bl")
def _(t):
    return N.people_by_level(worst(t), t.core)


@query("a27_source_totals", "messages points core", f"WITH {_BOX}, {_WORST}, {_BYL} SELECT source, CAST(SUM(pop) AS BIGINT) AS total_affected FROM bl GROUP BY 1")
def _(t):
    return N.people_by_source(N.people_by_level(worst(t), t.core))


@query("a28_combined_total", "messages points core", f"""
WITH {_BOX} SELECT CAST(SUM(pop_total) AS BIGINT) AS pop, COUNT(*) AS n_cells FROM core WHERE cell_id IN (SELECT cell_id FROM hit)""")
def _(t):
    return N.people_combined(worst(t), t.core)


@query("a29_level_mix", "messages", f"WITH {_GENF} SELECT group_id, level_rank, COUNT(*) AS n FROM gf GROUP BY 1, 2")
def _(t):
    return N.level_mix(X.general_features(_general_xml(t)))


@query("a29_levels_present", "messages points core", f"WITH {_BOX}, {_WORST}, {_BYL} SELECT DISTINCT level_rank, level_code, level_name FROM bl")
def _(t):
    return N.levels_present(N.people_by_level(worst(t), t.core))


@query("pf19_warning_selection", "messages points", f"WITH {_BOX}, {_WORST} SELECT cell_id, level_code FROM w WHERE source = 'general' AND level_code = 'PO'")
def _(t):
    return N.select_warnings(worst(t), "general", level="PO").select("cell_id", "level_code")


@query("j03_cells_under_any_warning", "messages points core", f"WITH {_BOX} SELECT cell_id, pop_total FROM core WHERE cell_id IN (SELECT cell_id FROM hit)")
def _(t):
    return t.core.select("cell_id", "pop_total").join(hits(t).select("cell_id"), "cell_id", "left_semi")


@query("w02_first_and_last_row_per_key", "messages", """
SELECT source, level_rank, MIN(id) AS first_id, arg_max(id, start_ts) AS last_id FROM messages GROUP BY 1, 2""")
def _(t):
    return t.messages.groupBy("source", "level_rank").agg(F.min("id").alias("first_id"), F.max_by("id", "start_ts").alias("last_id"))


@query("u02_distinct_on_subset", "messages points", f"WITH {_BOX} SELECT DISTINCT cell_id, source FROM hit")
def _(t):
    return hits(t).dropDuplicates(["cell_id", "source"]).select("cell_id", "source")


@query("o03_composite_message_order", "messages", """
SELECT id, source, CAST(ROW_NUMBER() OVER (PARTITION BY source ORDER BY level_rank DESC, start_ts, id) AS INT) AS pos FROM messages""")
def _(t):
    m = t.messages.withColumnRenamed("start_ts", "start")
    return N.message_positions(m.select("id", "source", "level_rank", "start")).select("id", "source", "pos")


@query("st08_valid_at_instant", "messages", """
SELECT id, source FROM messages WHERE start_ts <= TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-10 12:00:00' < start_ts + INTERVAL 6 HOUR""")
def _(t):
    m = t.messages.withColumns({"start": F.col("start_ts").cast("timestamp"), "end": F.col("start_ts").cast("timestamp") + F.expr("interval 6 hours")})
    return N.valid_at(m, F.lit("2024-01-10 12:00:00").cast("timestamp")).select("id", "source")


@query("f16_severity_lookup", "messages", f"WITH {_BOX.split('hit AS')[0].strip().rstrip(',')} SELECT id, level_code, level_name FROM box")
def _(t):
    from ..functions.levels import level_code, level_name

    r = F.col("level_rank")
    return t.messages.select("id", level_code(r).alias("level_code"), level_name(r).alias("level_name"))


