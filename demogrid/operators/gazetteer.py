"""The search index: administrative units and localities with their bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import recode
from ..functions.text import locality_kind, normalise
from ..plans.catalogue import ADMIN_STATUS

BOX = ["minx", "miny", "maxx", "maxy"]


def unit_entries(units: DataFrame, bounds: DataFrame) -> DataFrame:
    """(k, n, t, j, b…) from ``units(unit_id, name, level, county)`` and their bounds."""
    return units.join(bounds, "unit_id").select(
        F.lit("u").alias("k"), F.col("name").alias("n"), recode(F.col("level"), ADMIN_STATUS, "UAT").alias("t"),
        F.col("county").alias("j"), *[F.bround(c, 4).alias(c) for c in BOX])


def locality_entries(parts: DataFrame, units: DataFrame) -> DataFrame:
    """The same from ``parts(part_id, code, name, kind, county, minx…)``: one entry per code, with
    the first part's name and kind and the merged box. The county is shown as the units spell
    it, found without regard to accents and case."""
    def first(c: str) -> Column:  # the first part that has a value
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("part_id")))

    one = parts.groupBy("code").agg(
        F.struct(first("name").alias("name"), first("kind").alias("kind"), first("county").alias("county")).alias("f"), F.min("minx").alias("minx"),
        F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    spelled = units.filter(F.col("county").isNotNull()).groupBy(F.upper(normalise(F.col("county"))).alias("key")).agg(F.min("county").alias("shown"))
    named = one.withColumn("key", F.upper(F.col("f.county"))).join(spelled, "key", "left")
    return named.select(
        F.lit("l").alias("k"), F.col("f.name").alias("n"), locality_kind(F.coalesce(F.col("f.kind"), F.lit(""))).alias("t"),
        F.coalesce("shown", F.initcap(F.lower(F.col("f.county")))).alias("j"), *[F.bround(c, 4).alias(c) for c in BOX])


def build(units: DataFrame, unit_bounds: DataFrame, parts: DataFrame) -> DataFrame:
    return unit_entries(units, unit_bounds).unionByName(locality_entries(parts, units))


def compact(entries: DataFrame) -> DataFrame:
    """Compact rows for a client: the box as one array."""
    return entries.select("k", "n", "t", "j", F.array(*BOX).alias("b"))

