"""Where a value stands among all values: ranks with ties over many groups, without a window over a column.

Equal values of a group are counted first. The distinct values are put in order by range partitions; running counts are made
inside partitions, and what comes before a partition in each group is a table of a row per partition and group. A group of any
size, or one that holds most rows, is spread over as many partitions as its distinct values need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null
from ..session import cut_lineage


def ranked_values(rows: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by…, value, n, before, total): each distinct value of a group with its rows, the group's rows below it, and all its rows.

    NULL and NaN values take no part; NULL is a group of its own."""
    by = list(by)
    counts = nan_to_null(rows.select(*by, F.col(value).cast("double").alias(value)), value).filter(F.col(value).isNotNull())
    counts = counts.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    dealt = cut_lineage(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "_part").agg(F.sum("n").alias("_n"))  # a row per partition and group
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumns({"_start": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "total": F.sum("_n").over(Window.partitionBy(*by))})
    here = dealt.withColumn("_here", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] + [F.col("a._part") == F.col("b._part")]
    on = same[0]
    for s in same[1:]:
        on &= s
    return here.alias("a").join(starts.alias("b"), on).select(
        *[F.col(f"a.{c}").alias(c) for c in by], F.col(f"a.{value}").alias(value), "n", (F.col("_here") + F.col("_start")).alias("before"), "total")


def long_values(rows: DataFrame, key: str, names: list[str], keep: list[str] = ()) -> DataFrame:
    """(key, keep…, variable, value): one row per cell and numeric variable."""
    parts = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in names]
    return rows.select(key, *keep, F.inline(F.array(*parts)))


def percentile_positions(rows: DataFrame, names: list[str], within: str | None = None, key: str = "cell_id") -> DataFrame:
    """(key, variable, value, position, position_within): where each cell stands among all cells, and among those of its unit ``within``.

    A position is the share of the other cells with a smaller value, 0 to 100; equal values stand equal, an only value stands at 0.
    Cells without a value of a variable have no row for it. A NULL unit is a unit of its own; without ``within`` the last column is
    missing. Rows that repeat a key each stand for themselves."""
    keep = [within] if within else []
    values = nan_to_null(long_values(rows, key, names, keep), "value").filter("value is not null")

    def stand(by: list[str], name: str) -> DataFrame:
        at = ranked_values(values, "value", by)
        place = F.when(F.col("total") > 1, 100 * F.col("before") / (F.col("total") - 1)).otherwise(F.lit(0.0))
        return at.select(*by, "value", place.alias(name))

    out = values.join(stand(["variable"], "position"), ["variable", "value"])
    if not within:
        return out.select(key, "variable", "value", "position")
    local = stand(["variable", within], "position_within").withColumnsRenamed({within: "_unit", "variable": "_var", "value": "_val"})
    out = out.join(local, (F.col("variable") == F.col("_var")) & (F.col("value") == F.col("_val")) & F.col(within).eqNullSafe(F.col("_unit")))
    return out.select(key, "variable", "value", "position", "position_within")
