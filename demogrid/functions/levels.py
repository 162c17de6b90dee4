"""Severity levels of weather warnings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import recode

# Rank -> code, name, colour; a higher rank is more severe.
LEVELS = {
    0: ("VE", "Verde/Informare", "#2e9e3f"),
    1: ("GA", "Galben", "#f2c200"),
    2: ("PO", "Portocaliu", "#e8720c"),
    3: ("RO", "Roșu", "#cc1414"),
}
RANK_OF_CODE = {code: rank for rank, (code, _, _) in LEVELS.items()}


def _part(rank: Column, i: int) -> Column:
    return recode(rank.cast("int"), {r: v[i] for r, v in LEVELS.items()}, LEVELS[0][i])


def level_code(rank: Column) -> Column:
    return _part(rank, 0)


def level_name(rank: Column) -> Column:
    return _part(rank, 1)


def level_colour(rank: Column) -> Column:
    return _part(rank, 2)


def rank_of_code(code: Column) -> Column:
    """Letter code to rank; unknown codes count as rank 1."""
    return recode(F.upper(code), RANK_OF_CODE, 1)


def rank_of_colour(colour: Column) -> Column:
    """Integer colour attribute to rank; missing, unreadable or unknown counts as rank 1."""
    n = F.try_to_number(F.trim(colour), F.lit("99")).cast("int")
    return F.when(n.between(0, 3), n).otherwise(F.lit(1))
