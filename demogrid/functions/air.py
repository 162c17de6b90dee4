"""Pollutant names, units and the European air-quality rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import recode
from .text import alnum_key

# Lower bounds of the ranks 1..5 in µg/m³.
AQI_THRESHOLDS = {
    "pm25": (10.0, 20.0, 25.0, 50.0, 75.0),
    "pm10": (20.0, 40.0, 50.0, 100.0, 150.0),
    "no2": (40.0, 90.0, 120.0, 230.0, 340.0),
    "o3": (50.0, 100.0, 130.0, 240.0, 380.0),
    "so2": (100.0, 200.0, 350.0, 500.0, 750.0),
}
POLLUTANTS = tuple(AQI_THRESHOLDS)
# Particulates are ranked on their 24-hour mean, gases on hourly values.
ROLLING = ("pm25", "pm10")

# Spellings of each pollutant in source files, after alnum_key().
ALIASES = {
    "pm25": ("pm2p5", "pm25", "particulatematter25um", "particulatematterlessthan25um"),
    "pm10": ("pm10", "particulatematter10um", "particulatematterlessthan10um"),
    "no2": ("no2", "nitrogendioxide"),
    "o3": ("o3", "ozone"),
    "so2": ("so2", "sulfurdioxide", "sulphurdioxide"),
}
NOT_A_VALUE = ("uncertainty", "spread", "stddev")

# Unit spellings (blanks and ^*{}() removed) and their factor to µg/m³.
UNIT_FACTORS = {
    "ug/m3": 1.0, "ugm-3": 1.0, "ugm3": 1.0,
    "microgram/m3": 1.0, "microgramm-3": 1.0, "microgrammes/m3": 1.0,
    "mg/m3": 1e3, "mgm-3": 1e3, "mgm3": 1e3,
    "g/m3": 1e6, "gm-3": 1e6, "gm3": 1e6,
    "kg/m3": 1e9, "kgm-3": 1e9, "kgm3": 1e9,
}


def aqi_rank(value: Column, pollutant: str) -> Column:
    """Number of thresholds strictly below the value; -1 when it is missing."""
    if pollutant not in AQI_THRESHOLDS:
        raise ValueError(f"unknown pollutant: {pollutant}")
    v = value.cast("double")
    steps = sum(((v > t).cast("int") for t in AQI_THRESHOLDS[pollutant]), F.lit(0))
    return F.when(v.isNull() | F.isnan(v), F.lit(-1)).otherwise(steps)


def aqi_rank_by_name(value: Column, pollutant: Column) -> Column:
    """The same rank where the pollutant is itself a column."""
    out = F.lit(None).cast("int")
    for name in POLLUTANTS:
        out = F.when(pollutant == name, aqi_rank(value, name)).otherwise(out)
    return out


def pollutant_of(*names: Column) -> Column:
    """The pollutant named by any of the given texts; NULL for spread / uncertainty fields."""
    keys = [F.coalesce(alnum_key(n), F.lit("")) for n in names]

    def mentions(words: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for key in keys:
            for word in words:
                hit = hit | key.contains(word)
        return hit

    chosen = F.lit(None).cast("string")
    for name in reversed(POLLUTANTS):
        chosen = F.when(mentions(ALIASES[name]), F.lit(name)).otherwise(chosen)
    return F.when(~mentions(NOT_A_VALUE), chosen)


def unit_key(units: Column) -> Column:
    text = F.translate(F.lower(units), "µμ³", "uu3")
    return F.replace(F.regexp_replace(text, r"[\s*^{}()]+", ""), F.lit("per"), F.lit("/"))


def concentration_factor(units: Column, strict: bool = True) -> Column:
    """Factor to µg/m³; an unknown unit stops the job (or gives NULL if not ``strict``)."""
    found = recode(unit_key(units), UNIT_FACTORS)
    if not strict:
        return found
    return F.when(units.isNull(), F.lit(None).cast("double")).otherwise(
        F.coalesce(found, F.raise_error(F.concat(F.lit("unsupported unit: "), units)).cast("double")))


def clean_series(raw: DataFrame) -> DataFrame:
    """Long ``(variable, units, value, …)`` rows to canonical pollutants in µg/m³, never
    negative; rows of other variables are dropped."""
    return (raw.withColumn("pollutant", pollutant_of(F.col("variable")))
            .filter(F.col("pollutant").isNotNull())
            .withColumn("value", F.greatest(F.col("value") * concentration_factor(F.col("units")),
                                            F.lit(0.0)))
            .drop("variable", "units"))
