"""Cells and people under weather warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import level_code, level_name
from .spatial import points_in_polygons

LEVEL = ["level_rank", "level_code", "level_name"]


def cells_of_features(points: DataFrame, edges: DataFrame, features: DataFrame, tile: float = 5000.0) -> DataFrame:
    """(cell_id, feature attributes…) for every feature a cell centre lies in."""
    found = points_in_polygons(points, edges, "cell_id", tile, attrs=features)
    return found.select("feature_id", "cell_id", *[c for c in features.columns if c != "feature_id"])


def worst_per(pairs: DataFrame, *keys: str) -> DataFrame:
    """The most severe level for each (cell, source) or (cell, message). Only the rank is
    carried through the shuffle: code and name follow from it."""
    rank = pairs.groupBy(*keys).agg(F.max("level_rank").alias("level_rank"))
    return rank.withColumns({"level_code": level_code(F.col("level_rank")), "level_name": level_name(F.col("level_rank"))})


def people_by_message(pairs: DataFrame, core: DataFrame, measure: str = "pop_total") -> DataFrame:
    """(group_id, pop): distinct cells under any geometry of the message. One shuffle by cell serves the distinct pairs
    and the people."""
    return (pairs.select("cell_id", "group_id").repartition("cell_id").distinct().join(core.select("cell_id", measure).hint("merge"), "cell_id")
            .groupBy("group_id").agg(F.sum(measure).cast("bigint").alias("pop")))


def people_by_level(affected: DataFrame, core: DataFrame, measure: str = "pop_total") -> DataFrame:
    """(source, level…, pop, n_cells)."""
    return (affected.join(core.select("cell_id", measure), "cell_id").groupBy("source", *LEVEL)
            .agg(F.sum(measure).cast("bigint").alias("pop"), F.count(F.lit(1)).alias("n_cells")))


def people_by_source(by_level: DataFrame) -> DataFrame:
    return by_level.groupBy("source").agg(F.sum("pop").alias("total_affected"))


def people_combined(affected: DataFrame, core: DataFrame, measure: str = "pop_total") -> DataFrame:
    """One row: people under at least one warning, nobody counted twice."""
    return core.join(affected.select("cell_id").distinct(), "cell_id", "left_semi").agg(
        F.coalesce(F.sum(measure), F.lit(0)).cast("bigint").alias("pop"), F.count(F.lit(1)).alias("n_cells"))


def level_mix(features: DataFrame) -> DataFrame:
    """(group_id, level_rank, n): geometries of a message at each level."""
    return features.groupBy("group_id", "level_rank").agg(F.count(F.lit(1)).alias("n"))


def levels_present(by_level: DataFrame) -> DataFrame:
    """Distinct levels over all sources, most severe first."""
    return by_level.select(*LEVEL).distinct().orderBy(F.desc("level_rank"))


def select_warnings(overlay: DataFrame, source: str, level: str | None = None, group: str | None = None) -> DataFrame:
    """What the map shows: a source, one of its levels, or one message; other sources are hidden."""
    out = overlay.filter(F.col("source") == source)
    if level is not None:
        out = out.filter(F.col("level_code") == level)
    if group is not None:
        out = out.filter(F.col("group_id") == group)
    return out


def message_order(messages: DataFrame) -> DataFrame:
    """Most severe first, then by start; a missing start sorts first, as an empty text would."""
    return messages.orderBy(F.desc("level_rank"), F.asc_nulls_first("start"), "id")


def message_positions(messages: DataFrame) -> DataFrame:
    """The messages with ``pos``, their place in `message_order` within their source.

    Places are counted within a level and day and moved by the number of messages before; only one row per source,
    level and day meets in the window of a source."""
    part = ["source", "level_rank", "_day"]
    dated = messages.withColumn("_day", F.to_date("start"))
    before = Window.partitionBy("source").orderBy(F.desc("level_rank"), F.asc_nulls_first("_day")).rowsBetween(Window.unboundedPreceding, -1)
    counts = dated.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(c).alias(f"_{c}") for c in part], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*part).orderBy(F.asc_nulls_first("start"), "id")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in part]
    return dated.withColumn("_pos", F.row_number().over(inside)).join(counts, same).select(
        *messages.columns, (F.col("_before") + F.col("_pos")).cast("int").alias("pos"))


def valid_at(messages: DataFrame, instant: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Messages whose interval [start, end) holds the instant; an open end never expires."""
    return messages.filter((F.col(start) <= instant) & (F.col(end).isNull() | (instant < F.col(end))))
