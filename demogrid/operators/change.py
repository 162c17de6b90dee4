"""Population change between censuses: cell by cell, and summed for groups of cells, between every two successive censuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import has_data, safe_ratio

#: What became of a cell; missing figures are told apart from nobody.
KINDS = ("missing", "empty", "settled", "abandoned", "grown", "shrunk", "same")


def _kind(before: Column, after: Column) -> Column:
    return (F.when(before.isNull() | after.isNull(), "missing").when((before == 0) & (after == 0), "empty").when(before == 0, "settled")
            .when(after == 0, "abandoned").when(after > before, "grown").when(after < before, "shrunk").otherwise("same"))


def _rates(change: Column, before: Column, after: Column, years: Column) -> list[Column]:
    """Share of the earlier figure, and the constant yearly rate that leads from one figure to the other."""
    return [safe_ratio(change, before).alias("share"),
            F.when((before > 0) & (after > 0), F.pow(after / before, 1.0 / years) - 1.0).alias("yearly")]


def population_change(cells: DataFrame, censuses: Sequence[tuple[int, str]], keys: Sequence[str] = ("cell_id",), estimated: Sequence[int] = ()) -> DataFrame:
    """(keys…, year_from, year_to, before, after, change, share, yearly, kind, estimated) of each pair of successive censuses.

    ``censuses`` lists (year, column) in any order. NULL and NaN are missing: then change and rates are NULL and the kind is
    'missing'. Nobody before gives no share; nobody before or after no yearly rate. ``estimated`` names years whose figures
    are marked as estimates. All pairs come from one pass over the cells; fewer than two censuses are an error."""
    order = sorted(censuses)
    if len(order) < 2 or len({y for y, _ in order}) < len(order):
        raise ValueError("two or more different years are needed")

    def figure(c: str) -> Column:
        return F.when(has_data(cells, c), F.col(c).cast("double"))

    pairs = F.array(*[F.struct(F.lit(y).alias("year_from"), F.lit(z).alias("year_to"), figure(a).alias("before"), figure(b).alias("after"),
                               F.lit(y in estimated or z in estimated).alias("estimated")) for (y, a), (z, b) in zip(order, order[1:])])
    long = cells.select(*keys, F.inline(pairs))
    before, after = F.col("before"), F.col("after")
    return long.select(*keys, "year_from", "year_to", "before", "after", (after - before).alias("change"),
                       *_rates(after - before, before, after, F.col("year_to") - F.col("year_from")), _kind(before, after).alias("kind"), "estimated")


def change_by(changes: DataFrame, *groups: str) -> DataFrame:
    """(groups…, year_from, year_to, before, after, change, share, yearly, n_<kind>…) of all cells of a group.

    Cells with a missing figure are counted in n_missing and add to neither sum, so before and after speak of the same cells;
    a group without any other cell has NULL sums."""
    known = F.col("kind") != "missing"
    summed = changes.groupBy(*groups, "year_from", "year_to").agg(
        F.sum(F.when(known, F.col("before"))).alias("before"), F.sum(F.when(known, F.col("after"))).alias("after"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS])
    before, after = F.col("before"), F.col("after")
    return summed.select(*groups, "year_from", "year_to", "before", "after", (after - before).alias("change"),
                         *_rates(after - before, before, after, F.col("year_to") - F.col("year_from")), *[f"n_{k}" for k in KINDS])
