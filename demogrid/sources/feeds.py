"""Weather-warning feeds as XML: nowcasting (one geometry per message) and general (many)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import level_code, level_colour, level_name, rank_of_code, rank_of_colour
from ..functions.columns import blank_to_null

# Attributes of the feed elements; ``_`` marks an XML attribute.
_NOW = (
    "avertizareId", "numarAvertizare", "avertizareNivelCod", "avertizareTipDenumire", "fenomenAvertizat", "coordsGis",
    "useCoordsGis", "srid", "dataInceput", "dataSfarsit", "entitateOrganizatorica",
)
_GEN = (
    "numeTipMesaj", "numeCuloare", "fenomeneVizate", "dataAparitiei", "dataExpirarii", "intervalul",
    "zonaAfectata",
)
_UNIT = "struct<_VALUE: string, _cod: string, _culoare: string, _coordGis: string, _useCoordGis: string>"
NOWCASTING_SCHEMA = ", ".join(f"_{a} string" for a in _NOW) + ", zona_afectata array<struct<_VALUE: string, _text: string>>"
GENERAL_SCHEMA = ", ".join(f"_{a} string" for a in _GEN) + f", judet array<{_UNIT}>, zona array<{_UNIT}>"

NOWCAST_KIND = "Avertizare nowcasting"
GENERAL_KIND = "Atenționare meteorologică"


def read_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every ``avertizare`` element of a folder of feed documents, split between tasks."""
    return spark.read.format("xml").option("rowTag", "avertizare").schema(schema).load(path)


def parse_elements(df: DataFrame, xml: str, schema: str) -> DataFrame:
    """The same rows from a column holding one ``avertizare`` element per row.

    The parsed element is a row of its own, so that filters further on do not parse it again."""
    others = [c for c in df.columns if c != xml]
    return df.select(*others, F.explode(F.array(F.from_xml(xml, schema))).alias("a")).select(*others, "a.*")


def _used(coords: Column, use: Column) -> Column:
    return F.when(F.lower(F.coalesce(use, F.lit("true"))) != "false", blank_to_null(coords))


def nowcasting_messages(rows: DataFrame, position: str = "pos") -> DataFrame:
    """One row per message. The empty placeholder is skipped, a repeated id keeps its first
    occurrence, an unknown level counts as rank 1. ``wkt`` is NULL if the geometry is unused."""
    real = rows.filter(F.coalesce(blank_to_null(F.col("_avertizareId")), blank_to_null(F.col("_coordsGis")),
                                  blank_to_null(F.col("_fenomenAvertizat"))).isNotNull())
    wid = F.coalesce(blank_to_null(F.col("_avertizareId")), blank_to_null(F.col("_numarAvertizare")), F.col(position).cast("string"))
    rank = rank_of_code(F.coalesce(F.col("_avertizareNivelCod"), F.lit("")))
    zones = F.trim(F.array_join(F.transform(F.coalesce("zona_afectata", F.array()), lambda z: F.coalesce(z["_text"], F.lit(""))), " "))
    parsed = real.select(
        F.col(position).alias("pos"), wid.alias("id"), F.concat(F.lit("n"), wid).alias("group_id"), F.lit("nowcasting").alias("source"),
        rank.alias("level_rank"), F.coalesce("_avertizareTipDenumire", F.lit(NOWCAST_KIND)).alias("kind"),
        F.coalesce("_fenomenAvertizat", F.lit("")).alias("phenomenon"), F.col("_dataInceput").alias("start"),
        F.col("_dataSfarsit").alias("end"), F.coalesce("_entitateOrganizatorica", F.lit("")).alias("entity"),
        zones.alias("area_text"), F.coalesce(F.col("_srid").try_cast("int"), F.lit(3857)).alias("srid"),
        _used(F.col("_coordsGis"), F.col("_useCoordsGis")).alias("wkt"))
    names = [c for c in parsed.columns if c not in ("id", "pos")]
    first = parsed.groupBy("id").agg(F.min_by(F.struct("pos", *names), "pos").alias("m")).select("id", "m.*")
    return first.withColumns({"level_code": level_code(F.col("level_rank")), "level_name": level_name(F.col("level_rank")),
                              "colour": level_colour(F.col("level_rank"))})


def general_features(rows: DataFrame, position: str = "pos") -> DataFrame:
    """One row per active geometry of a message: counties first, then zones. Geometries of
    colour 0 only give context and are dropped; an unreadable colour counts as rank 1."""
    def unit(kind: str) -> Column:
        return F.transform(F.coalesce(kind, F.array().cast(f"array<{_UNIT}>")), lambda u: F.struct(
            F.lit(kind).alias("unit_kind"), F.coalesce(u["_cod"], F.lit("")).alias("unit_cod"),
            u["_culoare"].alias("culoare"), u["_coordGis"].alias("coords"), u["_useCoordGis"].alias("use")))

    exploded = rows.select(F.col(position).alias("pos"), F.inline(F.concat(unit("judet"), unit("zona"))))
    rank = F.when(F.col("culoare").isNull(), F.lit(1)).otherwise(rank_of_colour(F.col("culoare")))
    return (exploded.select("pos", F.concat(F.lit("g"), F.col("pos").cast("string")).alias("group_id"), F.lit("general").alias("source"),
                            "unit_kind", "unit_cod", rank.alias("level_rank"), _used(F.col("coords"), F.col("use")).alias("wkt"))
            .filter(F.col("wkt").isNotNull() & (F.col("level_rank") >= 1))
            .withColumns({"level_code": level_code(F.col("level_rank")), "level_name": level_name(F.col("level_rank"))}))


def general_messages(rows: DataFrame, features: DataFrame, position: str = "pos") -> DataFrame:
    """One row per message with its highest rank, level mix (most severe first), the set of
    counties and the number of zones; a message without active geometry has rank 0."""
    levels = features.groupBy("group_id", "level_rank").agg(F.count(F.lit(1)).alias("n"))
    mix = levels.groupBy("group_id").agg(
        F.max("level_rank").alias("top"),
        F.sort_array(F.collect_list(F.struct(F.col("level_rank").alias("rank"), F.col("n"))), asc=False).alias("level_mix"))
    units = features.groupBy("group_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("unit_kind") == "judet", F.col("unit_cod")))).alias("counties"),
        F.count_if(F.col("unit_kind") == "zona").alias("n_zones"))
    head = rows.select(F.concat(F.lit("g"), F.col(position).cast("string")).alias("group_id"),
                       F.coalesce("_numeTipMesaj", F.lit(GENERAL_KIND)).alias("kind"),
                       F.coalesce("_fenomeneVizate", F.lit("")).alias("phenomenon"), F.col("_dataAparitiei").alias("start"),
                       F.col("_dataExpirarii").alias("end"), F.coalesce("_intervalul", F.lit("")).alias("interval"),
                       F.coalesce("_zonaAfectata", F.lit("")).alias("area_text"))
    out = head.join(mix, "group_id", "left").join(units, "group_id", "left")
    rank = F.coalesce("top", F.lit(0))
    return out.withColumns({
        "level_rank": rank, "level_code": level_code(rank), "level_name": level_name(rank), "colour": level_colour(rank),
        "counties": F.coalesce("counties", F.array().cast("array<string>")), "n_zones": F.coalesce("n_zones", F.lit(0)),
        "level_mix": F.coalesce("level_mix", F.array().cast("array<struct<rank:int,n:bigint>>"))}).drop("top")
