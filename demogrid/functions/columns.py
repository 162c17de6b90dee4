"""Small column helpers shared by the operators: missing data, rounding, typed literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, FLOATING)


def nan_to_null(df: DataFrame, *names: str) -> DataFrame:
    """One missing-data encoding: NaN becomes NULL in the given (or all) float columns."""
    chosen = names or tuple(f.name for f in df.schema if isinstance(f.dataType, FLOATING))
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in chosen})


def has_data(df: DataFrame, name: str) -> Column:
    """NOT NULL and, for floats, not NaN (which would sort above every number)."""
    ok = F.col(name).isNotNull()
    return ok & ~F.isnan(name) if is_floating(df, name) else ok


def typed_literal(df: DataFrame, name: str, value: float) -> Column:
    """The literal in the column's own type, so a FLOAT column is compared as FLOAT."""
    if is_floating(df, name):
        return F.lit(value).cast(df.schema[name].dataType)
    return F.lit(value)


def to_long(col: Column) -> Column:
    """Half-even rounding to BIGINT (a plain cast would truncate)."""
    return F.bround(col.cast("double"), 0).cast("bigint")


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` in doubles, NULL where the denominator is zero."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def varies(spread: float, mean: float) -> float:
    """A deviation, or 0 where it is no more than what rounding leaves of a column that does not vary."""
    return spread if spread > 1e-12 * max(1.0, abs(mean)) else 0.0


def recode(col: Column, mapping: dict, default: object = None) -> Column:
    """Dictionary lookup with a default; a NULL key stays NULL unless a default is given."""
    if not mapping:
        return F.lit(default)
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.when(col.isNotNull(), F.try_element_at(F.create_map(*pairs), col))
    return found if default is None else F.coalesce(found, F.lit(default))


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """The columns of a one-row frame beside every row, as a scalar subquery: it is computed
    once and becomes a constant, with no join. More than one row is an error."""
    value = df.withColumn("_one", one_row.select(F.struct("*")).scalar())
    return value.select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in one_row.columns])


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def square(col: Column) -> Column:
    return col * col
