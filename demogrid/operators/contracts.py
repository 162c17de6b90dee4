"""Data contracts: rules as data, checked in one pass over each table.

Types, ranges, required values, allowed values and figures that must add up become conditional counts of one aggregation per
table; unique keys one more by the key; keys that must exist elsewhere an anti join. Nothing but counts leaves the cluster."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_floating


@dataclass(frozen=True)
class Rule:
    """``kind`` is type, required, range, allowed, unique, reference or total.

    ``value`` is the type's name, (low, high) with None for open ends, the allowed values, the column of ``other`` that must hold the
    key, or (total, tolerance)."""

    table: str
    kind: str
    column: str
    value: object = None
    other: str | None = None


def _present(df: DataFrame, name: str) -> Column:
    """Neither NULL nor NaN."""
    return F.col(name).isNotNull() & ~F.isnan(name) if is_floating(df, name) else F.col(name).isNotNull()


def _violations(df: DataFrame, rule: Rule) -> Column:
    """Rows that break the rule, as an aggregate. A missing value breaks a required rule only; a missing column breaks all."""
    if rule.column not in df.columns:
        return F.count(F.lit(1))
    there, col = _present(df, rule.column), F.col(rule.column)
    if rule.kind == "required":
        return F.count_if(~there)
    if rule.kind == "type":
        return F.lit(0) if df.schema[rule.column].dataType.simpleString() == rule.value else F.count(F.lit(1))
    if rule.kind == "allowed":
        return F.count_if(there & ~col.isin(*rule.value)) if rule.value else F.count_if(there)
    if rule.kind == "range":
        low, high = rule.value
        beyond = [x for x in (None if low is None else col < low, None if high is None else col > high) if x is not None]
        return F.count_if(there & reduce(lambda a, b: a | b, beyond, F.lit(False)))
    if rule.kind == "total":
        total, tolerance = rule.value
        return F.when(F.abs(F.coalesce(F.sum(F.when(there, col)).cast("double"), F.lit(0.0)) - total) <= tolerance, 0).otherwise(1)
    raise ValueError(f"unknown kind of rule: {rule.kind}")


def check_contracts(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """(table, kind, column, violations): a row per rule, kept ones with 0.

    ``violations`` counts rows; for ``unique`` the keys that occur again, each surplus row once; for ``total`` it is 1 if the sum is off.
    An empty table breaks only totals. A rule on a table that is not given raises KeyError."""
    made = []
    for name in dict.fromkeys(r.table for r in rules):
        df, mine = tables[name], [r for r in rules if r.table == name]
        plain = [r for r in mine if r.kind not in ("unique", "reference") or r.column not in df.columns]
        if plain:
            found = df.agg(*[_violations(df, r).cast("bigint").alias(f"v{i}") for i, r in enumerate(plain)])
            rows = [F.struct(F.lit(name).alias("table"), F.lit(r.kind).alias("kind"), F.lit(r.column).alias("column"), F.col(f"v{i}").alias("violations"))
                    for i, r in enumerate(plain)]
            made.append(found.select(F.inline(F.array(*rows))))
        for r in mine:
            if r in plain:
                continue
            if r.kind == "unique":
                count = df.filter(F.col(r.column).isNotNull()).groupBy(r.column).agg(F.count(F.lit(1)).alias("n")).agg(
                    F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
            else:
                known = tables[r.other].select(F.col(str(r.value)).alias("_known")).distinct()
                count = df.filter(F.col(r.column).isNotNull()).join(known, F.col(r.column) == F.col("_known"), "left_anti").agg(
                    F.count(F.lit(1)).alias("violations"))
            made.append(count.select(F.lit(name).alias("table"), F.lit(r.kind).alias("kind"), F.lit(r.column).alias("column"), "violations"))
    return reduce(lambda a, b: a.unionByName(b), made)


def compare_products(a: DataFrame, b: DataFrame, key: str, names: list[str], tolerance: float = 1e-6, sample: int | None = None, seed: int = 3) -> DataFrame:
    """(variable, compared, differing, missing): the same cells in two published products, e.g. the cube and the wide table.

    With ``sample`` about as many keys are compared, chosen by a seeded hash, the same ones in every run (a spot check is the
    feature); without, all. Cells that only one product has are ``missing``; both values missing is no difference."""
    if sample is not None:
        share = F.lit(sample) / F.greatest(a.select(F.count(F.lit(1)).cast("double")).scalar(), F.lit(1.0))
        chosen = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < share * 1_000_000
        a, b = a.filter(chosen), b.filter(chosen)
    both = a.select(key, F.lit(True).alias("_a"), *[F.col(n).cast("double").alias(f"a{i}") for i, n in enumerate(names)]).join(
        b.select(key, F.lit(True).alias("_b"), *[F.col(n).cast("double").alias(f"b{i}") for i, n in enumerate(names)]), key, "full")
    met = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    clean = [(F.when(~F.isnan(f"a{i}"), F.col(f"a{i}")), F.when(~F.isnan(f"b{i}"), F.col(f"b{i}"))) for i in range(len(names))]
    aggs = [x for i, (p, q) in enumerate(clean) for x in (
        F.count_if(met & ~F.when(p.isNull() | q.isNull(), p.isNull() & q.isNull()).otherwise(F.abs(p - q) <= tolerance * F.greatest(F.lit(1.0), F.abs(p)))).alias(f"d{i}"),)]
    found = both.agg(F.count_if(met).alias("n"), F.count_if(~met).alias("m"), *aggs)
    return found.select(F.inline(F.array(*[F.struct(F.lit(n).alias("variable"), F.col("n").alias("compared"), F.col(f"d{i}").alias("differing"), F.col("m").alias("missing"))
                                            for i, n in enumerate(names)])))
