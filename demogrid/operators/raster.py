"""Rasters as long tables ``(prow, pcol, …)``: block statistics, dominant classes, exact
distance transforms, slope and resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import square

BLOCK = 10  # pixels per side of a cell
BAND = 256  # pixel rows of a band in the column pass


def dense_lattice(spark: SparkSession, nrows: int, ncols: int) -> DataFrame:
    """Every (prow, pcol) of a raster, generated in parallel."""
    return spark.range(nrows * ncols).select(
        F.floor(F.col("id") / ncols).alias("prow"), (F.col("id") % ncols).alias("pcol"))


def label_raster(targets: DataFrame, nrows: int, ncols: int, cls: str = "class") -> DataFrame:
    """Dense (prow, pcol, class) with NULL where no target pixel is given."""
    return dense_lattice(targets.sparkSession, nrows, ncols).join(targets.select("prow", "pcol", cls), ["prow", "pcol"], "left")


def with_block(df: DataFrame, f: int = BLOCK) -> DataFrame:
    return df.withColumns({"brow": F.floor(F.col("prow") / f), "bcol": F.floor(F.col("pcol") / f)})


def dominant_class(pixels: DataFrame, cls: str = "class", f: int = BLOCK, count_empty: bool = False) -> DataFrame:
    """(brow, bcol, class): the class with most pixels in the block, ties to the higher class.

    Class 0 or NULL is "no cover". It is ignored, or with ``count_empty`` competes as class 0:
    then a block mostly outside every zone gets NULL. Only covered pixels need to be given."""
    counts = (with_block(pixels.filter(F.col(cls) > 0), f).groupBy("brow", "bcol", F.col(cls).alias("class"))
              .agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("brow", "bcol").agg(F.max(F.struct("n", "class")).alias("m"), F.sum("n").alias("covered"))
    win = F.col("m.class")
    if count_empty:
        win = F.when(F.col("m.n") >= f * f - F.col("covered"), win)
    return best.select("brow", "bcol", win.alias("class"))


def block_stats(pixels: DataFrame, value: str = "value", f: int = BLOCK) -> DataFrame:
    """(brow, bcol, mean, min, max, std): no-data left out; population deviation."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return with_block(pixels, f).groupBy("brow", "bcol").agg(
        F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"))


def _lower_envelope(col: np.ndarray, d2: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """min over j of (x - col[j])**2 + d2[j] at every x in ``col`` and the class it comes from, in linear time.

    Only columns with a target are visited (d2 >= 0). Of equal distances the smallest class wins."""
    have = np.flatnonzero(d2 >= 0)
    if len(have) == 0:
        return np.full(len(col), -1, dtype=np.int64), np.zeros(len(col), dtype=np.int64)
    xs, cs, ks = col[have].tolist(), d2[have].tolist(), cls[have].tolist()
    hull: list[int] = []
    start: list[int] = []  # first integer x at which hull[i] is the best
    for j, (x, c) in enumerate(zip(xs, cs)):
        begin = None
        while hull:
            i = hull[-1]
            # parabola j is better than i from this integer on; on a tie only with a smaller class
            num, den = c - cs[i] + x * x - xs[i] * xs[i], 2 * (x - xs[i])
            begin = -(-num // den) if ks[j] < ks[i] else num // den + 1
            if begin <= start[-1]:
                hull.pop()
                start.pop()
                begin = None
            else:
                break
        hull.append(j)
        start.append(begin if begin is not None else -(1 << 62))
    pick = have[np.asarray(hull)[np.searchsorted(np.asarray(start), col, side="right") - 1]]
    return (col - col[pick]) ** 2 + d2[pick], cls[pick]


def _nearest_in_column(pixels: DataFrame, target: Column, keys: list[str]) -> DataFrame:
    """Add ``_up`` and ``_down``: the nearest target (struct r, c) at or above and at or below each pixel of a column.

    Columns are cut into bands. Windows see one band of one column; what lies beyond comes from a table with one row per
    band, so no task sees a whole column of pixels."""
    banded = pixels.withColumns({"_t": target, "_band": F.floor(F.col("prow") / BAND)})
    cut = [*keys, "_band"]
    bands = banded.filter(F.col("_t").isNotNull()).groupBy(*cut).agg(F.max("_t").alias("_last"), F.min("_t").alias("_first"))
    every = banded.select(*cut).distinct().join(bands, cut, "left")
    before = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = every.select(*cut, F.last("_last", ignorenulls=True).over(before).alias("_above"),
                          F.last("_first", ignorenulls=True).over(after).alias("_below"))
    up = Window.partitionBy(*cut).orderBy("prow").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*cut).orderBy(F.desc("prow")).rowsBetween(Window.unboundedPreceding, 0)
    near = (banded.withColumn("_up", F.last("_t", ignorenulls=True).over(up))
            .withColumn("_down", F.last("_t", ignorenulls=True).over(down)))
    return near.join(beyond, cut).withColumns({"_up": F.coalesce("_up", "_above"), "_down": F.coalesce("_down", "_below")}).drop(
        "_t", "_band", "_above", "_below")


def distance_transform(pixels: DataFrame, cls: str = "class", groups: list[str] = (), rows: Column | None = None) -> DataFrame:
    """(groups…, prow, pcol, d2, class): squared pixel distance to the nearest target and that
    target's class, exactly; smallest class among equally near targets.

    ``pixels`` is dense, with a class number on targets and NULL elsewhere. Down the columns, the nearest target above and
    below is found band by band; along the rows, a lower envelope of parabolas combines the columns that have a target.
    Distance and class are carried side by side. Pixels of a group without targets get NULL.
    ``rows`` keeps only some pixel rows for the second pass, where only those are wanted."""
    groups = list(groups)
    target = F.when(F.col(cls).isNotNull(), F.struct(F.col("prow").alias("r"), F.col(cls).cast("bigint").alias("c")))

    def cost(hit: Column) -> Column:
        return F.when(hit.isNotNull(), F.struct(square(F.col("prow") - hit["r"]).alias("d2"), hit["c"].alias("c")))

    one = _nearest_in_column(pixels.select(*groups, "prow", "pcol", cls), target, [*groups, "pcol"])
    if rows is not None:
        one = one.filter(rows)
    best = F.least(cost(F.col("_up")), cost(F.col("_down")))
    vertical = one.select(*groups, "prow", "pcol", best.alias("b")).select(
        *groups, "prow", "pcol", F.coalesce("b.d2", F.lit(-1)).cast("bigint").alias("d2"), F.coalesce("b.c", F.lit(0)).cast("bigint").alias("class"))

    def along_row(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pcol", ignore_index=True)
        pdf["d2"], pdf["class"] = _lower_envelope(*(pdf[c].to_numpy(np.int64) for c in ("pcol", "d2", "class")))
        return pdf

    full = vertical.groupBy(*groups, "prow").applyInPandas(along_row, vertical.schema)
    known = F.col("d2") >= 0
    return full.select(*groups, "prow", "pcol", F.when(known, F.col("d2")).alias("d2"), F.when(known, F.col("class")).cast("int").alias("class"))


def distance_km(d2: Column, pixel_m: float) -> Column:
    return F.sqrt(d2.cast("double")) * pixel_m / 1000.0


def block_min_distance(distances: DataFrame, pixel_m: float = 100.0, f: int = BLOCK) -> DataFrame:
    """(brow, bcol, dist_km): distance of the nearest pixel of the block; 0 = the block touches
    a target. Rounded half-even to 10 m."""
    return with_block(distances, f).groupBy("brow", "bcol").agg(
        F.bround(distance_km(F.min("d2"), pixel_m), 2).alias("dist_km"))


def central_rows(f: int = BLOCK) -> Column:
    return F.col("prow") % f == f // 2


def central_pixel(pixels: DataFrame, f: int = BLOCK) -> DataFrame:
    """The pixel at the middle of each block, with its block number."""
    mid = central_rows(f) & (F.col("pcol") % f == f // 2)
    return with_block(pixels.filter(mid), f)


def scenario_overlay(distances: DataFrame, pixel_m: float = 100.0, f: int = BLOCK) -> DataFrame:
    """(brow, bcol, dist_km, scenario): the most frequent (smallest) scenario present in the
    block, else that of the target nearest to the block's nearest pixel.

    A target pixel has distance 0 and its own class, so one pass over the transform is enough."""
    d = with_block(distances, f)
    present = F.min(F.when(F.col("d2") == 0, F.col("class")))
    nearest = F.min(F.struct("d2", "prow", "pcol", "class"))
    return d.groupBy("brow", "bcol").agg(
        F.bround(distance_km(F.min("d2"), pixel_m), 2).alias("dist_km"),
        F.coalesce(present, nearest["class"]).alias("scenario"))


def nearest_group(distances: DataFrame, group: str, apart: str | None = None, pixel_m: float = 1000.0) -> DataFrame:
    """(prow, pcol, dist_km, nearest, apart_km): nearest of several target groups; one group
    may be reported apart (the coast) instead of competing."""
    own = F.lit(True) if apart is None else F.col(group) != apart
    best = F.min(F.when(own & F.col("d2").isNotNull(), F.struct("d2", group)))
    out = distances.groupBy("prow", "pcol").agg(
        best.alias("m"), F.min(F.when(~own, F.col("d2"))).alias("a"))
    return out.select("prow", "pcol", distance_km(F.col("m.d2"), pixel_m).alias("dist_km"),
                      F.col(f"m.{group}").alias("nearest"), distance_km(F.col("a"), pixel_m).alias("apart_km"))


def slope_degrees(pixels: DataFrame, value: str = "value", pixel_m: float = 100.0) -> DataFrame:
    """Add ``slope``: central differences inside, one-sided at the edges. A missing neighbour
    value leaves the slope NULL, as NaN would.

    Every pixel sends its value to itself and its four neighbours; the pixels then meet theirs in one
    aggregation, so no task sees a row or column of the raster."""
    def to(side: str, dr: int, dc: int) -> Column:
        return F.struct((F.col("prow") + dr).alias("prow"), (F.col("pcol") + dc).alias("pcol"), F.lit(side).alias("side"), F.col("v"))

    sent = pixels.select("prow", "pcol", F.col(value).cast("double").alias("v")).select(F.inline(F.array(
        to("own", 0, 0), to("above", 1, 0), to("below", -1, 0), to("left", 0, 1), to("right", 0, -1))))
    sides = ("own", "above", "below", "left", "right")
    met = sent.groupBy("prow", "pcol").agg(
        *[F.max(F.when(F.col("side") == x, F.struct("v"))).alias(x) for x in sides]).filter(F.col("own").isNotNull())

    def gradient(before: str, after: str) -> Column:
        v, b, a = F.col("own.v"), F.col(f"{before}.v"), F.col(f"{after}.v")
        return F.when(F.col(before).isNull(), a - v).when(F.col(after).isNull(), v - b).otherwise((a - b) / 2) / pixel_m

    slope = F.degrees(F.atan(F.sqrt(square(gradient("above", "below")) + square(gradient("left", "right")))))
    return pixels.join(met.select("prow", "pcol", slope.alias("slope")), ["prow", "pcol"])


def bilinear_resample(targets: DataFrame, source: DataFrame, x0: float, y0: float, step: float,
                      keys: list[str] = ("prow", "pcol"), value: str = "value") -> DataFrame:
    """(keys…, value) at target points (x, y), from a source raster whose pixel (i, j) is
    centred at (x0 + j*step, y0 + i*step). Missing neighbours are left out of the weights."""
    fx, fy = (F.col("x") - x0) / step, (F.col("y") - y0) / step
    t = targets.select(*keys, fx.alias("fx"), fy.alias("fy")).withColumns({
        "j0": F.floor("fx"), "i0": F.floor("fy")})
    wx, wy = F.col("fx") - F.col("j0"), F.col("fy") - F.col("i0")

    def corner(di: int, dj: int) -> Column:
        weight = (wy if di else 1 - wy) * (wx if dj else 1 - wx)
        return F.struct((F.col("i0") + di).alias("prow"), (F.col("j0") + dj).alias("pcol"), weight.alias("w"))

    four = t.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                    F.inline(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1)))).filter(F.col("w") > 0)
    src = source.select("prow", "pcol", F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    out = four.join(src, ["prow", "pcol"]).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(
        (F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias(value))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], value)
