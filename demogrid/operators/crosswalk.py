"""Figures of former administrative units on later ones: weighted bridges between the units of two years, chained over several.

A bridge (source, target, weight) says which share of a former unit went to which later one. Bridges are sparse tables, composed
by a join on the units between and a sum of products. Totals are kept exactly: whole numbers are split by largest remainder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 9  # of a share times a value, before it is split into whole numbers


def bridge(rows: DataFrame, source: str = "source", target: str = "target", weight: str = "weight") -> DataFrame:
    """(source, target, share): shares of each source add up to 1. Repeated pairs add up; pairs without a unit or a positive weight
    are left out, so a source with no positive weight has no row and shows up in `unmatched`."""
    w = F.col(weight).cast("double")
    pairs = rows.filter((w > 0) & ~F.isnan(w) & F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(
        F.col(source).alias("source"), F.col(target).alias("target")).agg(F.sum(w).alias("w"))
    return pairs.join(pairs.groupBy("source").agg(F.sum("w").alias("all")), "source").select("source", "target", (F.col("w") / F.col("all")).alias("share"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """The bridge over two steps. What the second does not know of the first's targets keeps its name, so nothing is lost."""
    later = second.select(F.col("source").alias("_mid"), F.col("target").alias("_end"), F.col("share").alias("_part"))
    steps = first.join(later, F.col("target") == F.col("_mid"), "left").select(
        "source", F.coalesce("_end", "target").alias("target"), (F.col("share") * F.coalesce("_part", F.lit(1.0))).alias("share"))
    return steps.groupBy("source", "target").agg(F.sum("share").alias("share"))


def chain(bridges: list[DataFrame]) -> DataFrame:
    """The bridge over all steps, oldest first."""
    return reduce(compose, bridges)


def _whole_parts(exact: Column, value: Column, by: list[str]) -> Column:
    """``value`` split into whole numbers like ``exact``: rounded down, and one more for the largest remainders; ties go to the
    smaller target. The parts of one unit, a handful, make a window."""
    low = F.floor(exact)
    group = Window.partitionBy(*by)
    rank = F.row_number().over(group.orderBy(F.desc(exact - low), "target"))
    return (low + F.when(rank <= value - F.sum(low).over(group), 1).otherwise(0)).cast("bigint")


def convert(values: DataFrame, over: DataFrame, unit: str = "unit", value: str = "value", by: list[str] = (), whole: bool = True) -> DataFrame:
    """(by…, unit, value): the figures on the targets of the bridge.

    With ``whole`` each unit's figure (a whole number of 0 or more) is split into whole numbers that add up to it. Units that the
    bridge does not know keep their name. NULL figures are left out; rows that repeat a unit are added up first. The total of every
    ``by`` group stays the same."""
    by = list(by)
    given = values.filter(F.col(value).isNotNull() & F.col(unit).isNotNull()).groupBy(*by, F.col(unit).alias("source")).agg(F.sum(value).alias("_value"))
    parts = given.join(over, "source", "left").select(*by, "source", F.coalesce("target", "source").alias("target"), "_value",
                                                       F.round(F.col("_value") * F.coalesce("share", F.lit(1.0)), PLACES).alias("_exact"))
    part = _whole_parts(F.col("_exact"), F.col("_value"), [*by, "source"]) if whole else F.col("_value") * F.col("_exact") / F.nullif(
        F.sum("_exact").over(Window.partitionBy(*by, "source")), F.lit(0.0))
    parts = parts.withColumn("_part", part if whole else F.coalesce(part, F.lit(0.0)))
    return parts.groupBy(*by, F.col("target").alias(unit)).agg(F.sum("_part").alias(value))


def unmatched(values: DataFrame, over: DataFrame, unit: str = "unit", value: str = "value") -> DataFrame:
    """(unit, value): units with figures that the bridge does not know."""
    return values.filter(F.col(unit).isNotNull()).groupBy(unit).agg(F.sum(value).alias(value)).join(
        over.select(F.col("source").alias(unit)).distinct(), unit, "left_anti")
