"""Disclosure control of nested tables: small groups are hidden, and so many others that no hidden figure can be worked out.

The table is nested: each group is the sum of its parts on the next level (country, regions, counties …). A group is hidden for
its own sake if it has too few cells or people. A reader knows every figure that is shown, so each sum may only be shown with
none of its parts hidden, or with at least two whose own sum is not small either; and a hidden sum needs a hidden part. First,
from the finest level up, the smallest shown parts are hidden until that holds, and where hiding all parts is not enough the sum
is hidden itself. Then, from the top down, each hidden sum with all parts shown has its smallest part hidden. In a nested table
every figure occurs in at most two sums, which do not form circles, so this is enough against any combination of sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nested_totals(cells: DataFrame, levels: list[str], value: str, perturbed: str | None = None) -> list[DataFrame]:
    """For each level, the whole first: (levels up to it…, n, value, touched), with the number of cells, their sum, and whether any of
    them was perturbed at its source. Coarser levels add up the finer ones; NULL keys are groups of their own."""
    touched = F.coalesce(F.col(perturbed).cast("boolean"), F.lit(False)) if perturbed else F.lit(False)
    base = cells.select(*levels, F.lit(1).cast("bigint").alias("n"), F.coalesce(F.col(value), F.lit(0)).alias("value"), touched.alias("touched"))
    out: list[DataFrame] = []
    for k in range(len(levels), -1, -1):
        base = base.groupBy(*levels[:k]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("value"), F.lit(0)).alias("value"),
                                             F.coalesce(F.bool_or("touched"), F.lit(False)).alias("touched"))
        out.insert(0, base)
    return out


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)], F.lit(True))


def _against_sums(part: DataFrame, parents: list[str], key: str, least_cells: int, least_value: float) -> DataFrame:
    """``part`` with further rows hidden in each group of ``parents``, and ``_enough``: false where even all hidden are too small."""
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    line = group.orderBy(F.desc("hidden"), "value", F.asc_nulls_first(key))
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    hidden_n = F.sum(F.col("hidden").cast("int"))
    rows = part.withColumns({"_r": F.row_number().over(line), "_h": hidden_n.over(group), "_n": F.sum("n").over(upto), "_v": F.sum("value").over(upto)})
    good = (F.col("_r") >= F.greatest("_h", F.lit(2))) & (F.col("_n") >= least_cells) & (F.col("_v") >= least_value)
    rows = rows.withColumn("_m", F.min(F.when(good, F.col("_r"))).over(group))
    some = F.col("_h") > 0
    return rows.withColumns({"hidden": some & (F.col("_m").isNull() | (F.col("_r") <= F.col("_m"))),
                             "_enough": ~some | F.col("_m").isNotNull()}).drop("_r", "_h", "_n", "_v", "_m")


def protect(tables: list[DataFrame], levels: list[str], least_cells: int, least_value: float) -> DataFrame:
    """(level, levels…, n, value, hidden, approximate) of all levels of `nested_totals`: hidden rows have NULL for n and value.

    A row is hidden if it has fewer than ``least_cells`` cells or less than ``least_value``, or to protect another (ties go to the
    smaller key). Values must not be negative. ``approximate`` marks figures that contain perturbed cells; it is shown for
    hidden rows too. Windows hold the parts of one group each; no level is collected. An empty table has one row, hidden."""
    small = (F.col("n") < least_cells) | (F.col("value") < least_value)
    held = [t.withColumn("hidden", small) for t in tables]
    for k in range(len(levels), 0, -1):  # upwards: sums that are shown
        part = _against_sums(held[k], levels[: k - 1], levels[k - 1], least_cells, least_value)
        held[k] = part.drop("_enough")
        short = part.groupBy(*levels[: k - 1]).agg((~F.bool_and("_enough")).alias("_short"))
        if k == 1:
            held[0] = held[0].withColumn("hidden", F.col("hidden") | F.coalesce(short.select("_short").scalar(), F.lit(False)))
            continue
        named = short.withColumnsRenamed({c: f"_p{i}" for i, c in enumerate(levels[: k - 1])})
        held[k - 1] = held[k - 1].join(named, _same(levels[: k - 1], [f"_p{i}" for i in range(k - 1)]), "left").withColumn(
            "hidden", F.col("hidden") | F.coalesce("_short", F.lit(False))).select(*held[k - 1].columns)
    for k in range(1, len(levels) + 1):  # downwards: sums that are hidden
        above = held[k - 1].select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(levels[: k - 1])], F.col("hidden").alias("_above"))
        if k == 1:
            part = held[k].withColumn("_above", above.select("_above").scalar())
        else:
            part = held[k].join(above, _same(levels[: k - 1], [f"_p{i}" for i in range(k - 1)])).select(*held[k].columns, "_above")
        group = Window.partitionBy(*levels[: k - 1]) if k > 1 else Window.partitionBy(F.lit(0))
        first = F.row_number().over(group.orderBy("value", F.asc_nulls_first(levels[k - 1]))) == 1
        part = part.withColumns({"_none": ~F.bool_or("hidden").over(group), "_first": first})
        held[k] = part.withColumn("hidden", F.col("hidden") | (F.col("_above") & F.col("_none") & F.col("_first"))).select(*held[k].columns)
    shown = []
    for k, t in enumerate(held):
        keys = [F.col(c) if i < k else F.lit(None).cast(tables[-1].schema[c].dataType).alias(c) for i, c in enumerate(levels)]
        shown.append(t.select(F.lit(k).alias("level"), *keys, *[F.when(~F.col("hidden"), F.col(c)).alias(c) for c in ("n", "value")], "hidden",
                              F.col("touched").alias("approximate")))
    return reduce(lambda a, b: a.unionByName(b), shown)
