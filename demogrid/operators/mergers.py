"""Scenarios of merged administrative units: who borders whom, whether a merger hangs together, what it would look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def cell_outlines(cells: DataFrame, unit: str = "unit", row: str = "row", col: str = "col") -> DataFrame:
    """(unit, x1, y1, x2, y2): the four sides of each cell, in cell units."""
    r, c = F.col(row).cast("bigint"), F.col(col).cast("bigint")

    def side(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    sides = F.array(side(c, r, c + 1, r), side(c, r + 1, c + 1, r + 1), side(c, r, c, r + 1), side(c + 1, r, c + 1, r + 1))
    return cells.filter(r.isNotNull() & c.isNotNull() & F.col(unit).isNotNull()).select(F.col(unit).alias("unit"), F.inline(sides))


def adjacency(edges: DataFrame) -> DataFrame:
    """(a, b, length): units a < b whose outlines (unit, x1, y1, x2, y2) share sides, and the length they share.

    A side counts for two units if both have it, in either direction; sides meet by their ends, in one shuffle."""
    ahead = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") <= F.col("y2")))
    ends = [F.when(ahead, F.col(p)).otherwise(F.col(q)).cast("double").alias(n) for n, p, q in (
        ("p", "x1", "x2"), ("q", "y1", "y2"), ("r", "x2", "x1"), ("s", "y2", "y1"))]
    sides = edges.select("unit", *ends).groupBy("p", "q", "r", "s").agg(F.sort_array(F.collect_set("unit")).alias("units")).filter(F.size("units") > 1)
    # a side has two units, on overlapping outlines a few
    pairs = sides.select(
        "p", "q", "r", "s", "units", F.posexplode("units").alias("at", "a")).select(
        "p", "q", "r", "s", "a", F.explode(F.slice("units", F.col("at") + 2, F.size("units"))).alias("b"))
    length = F.sqrt((F.col("r") - F.col("p")) * (F.col("r") - F.col("p")) + (F.col("s") - F.col("q")) * (F.col("s") - F.col("q")))
    return pairs.groupBy("a", "b").agg(F.sum(length).alias("length"))


def pieces(scenarios: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(scenario, new_unit, unit, piece): the smallest unit that each one is connected with inside its merger, over borders of units
    of the same merger. All scenarios are solved together; labels jump over labels, so rounds follow the logarithm of a chain."""
    own = scenarios.select("scenario", "new_unit", "unit").distinct()
    borders = neighbours.select("a", "b").unionByName(neighbours.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = own.select(F.col("scenario").alias("_s"), F.col("new_unit").alias("_n"), F.col("unit").alias("b"))
    links = cut_lineage(own.join(borders, F.col("unit") == F.col("a")).join(other, "b").filter(
        (F.col("_s") == F.col("scenario")) & (F.col("_n") == F.col("new_unit"))).select("scenario", "new_unit", F.col("unit").alias("a"), "b"))
    keys = ["scenario", "new_unit"]
    labels = cut_lineage(own.withColumn("piece", F.col("unit")))
    while True:
        offers = links.join(labels.withColumnRenamed("unit", "b"), [*keys, "b"]).select(*keys, F.col("a").alias("unit"), "piece", F.lit(False).alias("own"))
        least = offers.unionByName(labels.withColumn("own", F.lit(True))).groupBy(*keys, "unit").agg(
            F.min("piece").alias("piece"), F.min(F.when(F.col("own"), F.col("piece"))).alias("old"))
        jump = labels.select(*keys, F.col("unit").alias("piece"), F.col("piece").alias("far"))
        after = cut_lineage(least.join(jump, [*keys, "piece"], "left").select(*keys, "unit", F.least("piece", F.coalesce("far", "piece")).alias("piece"), "old"))
        labels = after.drop("old")
        if after.filter("piece <> old").isEmpty():
            return labels


def merge_indicators(cells: DataFrame, scenarios: DataFrame, neighbours: DataFrame, sums: dict[str, Column], means: dict[str, Column], weight: Column,
                     unit: str = "unit") -> DataFrame:
    """(scenario, new_unit, indicator, value): each merger's ``sums``, its ``means`` weighted by ``weight``, and units, area in cells,
    people per cell (of the first sum), pieces (1 if it hangs together) and outer border in cell sides.

    Indicators are first summed per unit in one pass over the cells; scenarios then add up units, so their number hardly counts."""
    w = weight.cast("double")
    per_unit = cells.groupBy(F.col(unit).alias("unit")).agg(
        F.count(F.lit(1)).alias("_cells"), *[F.sum(c).cast("double").alias(f"s_{n}") for n, c in sums.items()],
        *[x for n, c in means.items() for x in (F.sum(c.cast("double") * w).alias(f"m_{n}"), F.sum(F.when(c.isNotNull(), w)).alias(f"w_{n}"))])
    border = neighbours.select(F.col("a").alias("unit"), "b", "length").unionByName(neighbours.select("b", F.col("a"), "length").toDF("unit", "b", "length"))
    own = scenarios.select("scenario", "new_unit", "unit").distinct()
    other = own.select(F.col("scenario").alias("_s"), F.col("new_unit").alias("_n"), F.col("unit").alias("b"))
    inner = own.join(border, "unit").join(other, "b").filter((F.col("_s") == F.col("scenario")) & (F.col("_n") == F.col("new_unit"))).groupBy(
        "scenario", "new_unit").agg(F.sum("length").alias("_inner"))
    found = pieces(scenarios, neighbours).groupBy("scenario", "new_unit").agg(F.countDistinct("piece").alias("_pieces"))
    sides = cells.groupBy(F.col(unit).alias("unit")).agg((4.0 * F.count(F.lit(1))).alias("_sides"))
    within = within_sides(cells, unit)
    total = own.join(per_unit, "unit").join(sides.join(within, "unit", "left"), "unit").groupBy("scenario", "new_unit").agg(
        F.count(F.lit(1)).alias("units"), F.sum("_cells").alias("area"), F.sum(F.col("_sides") - F.coalesce("_within", F.lit(0.0))).alias("_rim"),
        *[F.sum(f"s_{n}").alias(n) for n in sums], *[(F.sum(f"m_{n}") / F.nullif(F.sum(f"w_{n}"), F.lit(0.0))).alias(n) for n in means])
    wide = total.join(found, ["scenario", "new_unit"]).join(inner, ["scenario", "new_unit"], "left")
    first = next(iter(sums))
    values = {"units": F.col("units"), "area": F.col("area"), "density": F.col(first) / F.col("area"), "pieces": F.col("_pieces"),
              "border": F.col("_rim") - F.coalesce("_inner", F.lit(0.0)), **{n: F.col(n) for n in (*sums, *means)}}
    rows = F.array(*[F.struct(F.lit(n).alias("indicator"), c.cast("double").alias("value")) for n, c in values.items()])
    return wide.select("scenario", "new_unit", F.inline(rows))


def within_sides(cells: DataFrame, unit: str = "unit") -> DataFrame:
    """(unit, _within): twice the cell sides that lie between two cells of one unit."""
    sides = cell_outlines(cells, unit).groupBy("unit", "x1", "y1", "x2", "y2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return sides.groupBy("unit").agg(F.sum(F.col("n").cast("double")).alias("_within"))


def judged(indicators: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The indicators with ``light``: green, amber or red by (indicator, more_is_better, green, amber); NULL without a threshold or value.

    Thresholds are rows like any others; their number is that of the indicators."""
    v = F.col("value")
    light = F.when(v.isNull() | F.col("green").isNull(), F.lit(None)).when(
        F.when(F.col("more_is_better"), v >= F.col("green")).otherwise(v <= F.col("green")), "green").when(
        F.when(F.col("more_is_better"), v >= F.col("amber")).otherwise(v <= F.col("amber")), "amber").otherwise("red")
    return indicators.join(F.broadcast(thresholds), "indicator", "left").select("scenario", "new_unit", "indicator", "value", light.alias("light"))
