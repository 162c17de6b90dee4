"""Daily climate cubes in long form ``(year, date, iy, ix, tmin, tmax, precip)``: sampling on
cells, accumulators, county series, normals, trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio

VARS = ("tmin", "tmax", "precip")
PIXEL = ["iy", "ix"]


def axis_index(value: Column, start: float, step: float, n: int) -> Column:
    """Nearest index on a regular axis, half-even at the middle, clipped to the ends."""
    i = F.rint((value - F.lit(float(start))) / F.lit(float(step)))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), i)).cast("bigint")


def sample_index(cells: DataFrame, lat: tuple[float, float, int], lon: tuple[float, float, int]) -> DataFrame:
    """Add the pixel (iy, ix) nearest to each cell; an axis is (start, step, size)."""
    return cells.withColumns({"iy": axis_index(F.col("lat"), *lat), "ix": axis_index(F.col("lon"), *lon)})


def reindex_with_tolerance(obs: DataFrame, lat: tuple[float, float, int], lon: tuple[float, float, int],
                           tolerance: float) -> DataFrame:
    """Every point (iy, ix) of a reference lattice with the observation (lat, lon, …) nearest to it,
    NULL where none is within the tolerance on both axes.

    Of equally near observations the one with the smallest columns, in their order, is taken."""
    def snap(name: str, axis: tuple[float, float, int]) -> tuple[Column, Column, Column]:
        i = F.rint((F.col(name) - axis[0]) / axis[1])
        gap = F.abs(F.col(name) - (axis[0] + i * axis[1]))
        return i.cast("bigint"), gap, (gap <= tolerance) & (i >= 0) & (i < axis[2])

    (iy, gy, oky), (ix, gx, okx) = snap("lat", lat), snap("lon", lon)
    row = F.struct(*[c for c in obs.columns if c not in PIXEL])
    near = obs.filter(oky & okx).groupBy(iy.alias("iy"), ix.alias("ix")).agg(
        F.min(F.struct((gy * gy + gx * gx).alias("gap"), row.alias("row"))).alias("m")).select("iy", "ix", "m.row.*")
    lattice = obs.sparkSession.range(lat[2] * lon[2]).select(
        F.floor(F.col("id") / lon[2]).alias("iy"), (F.col("id") % lon[2]).alias("ix"))
    return lattice.join(near, PIXEL, "left")


def align_exactly(frames: dict[str, DataFrame], keys: list[str] = ("date", "iy", "ix")) -> DataFrame:
    """Join variables whose times were floored to the day; a row present in one variable only
    stops the job, because the sources then do not describe the same days."""
    keys = list(keys)
    sides = [df.withColumn("date", F.to_date("time")).select(*keys, name).withColumn(f"_has_{name}", F.lit(True))
             for name, df in frames.items()]
    out = reduce(lambda a, b: a.join(b, keys, "full"), sides)
    complete = reduce(lambda a, b: a & b, [F.col(f"_has_{n}").isNotNull() for n in frames])
    checked = F.when(complete, F.lit(True)).otherwise(F.raise_error(F.lit("variables are not aligned")).cast("boolean"))
    return out.filter(checked).drop(*[f"_has_{n}" for n in frames])


def merge_series(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer merge: a key present in any frame is kept."""
    return reduce(lambda a, b: a.join(b, keys, "full"), frames)


def _valid(name: str) -> Column:
    v = F.col(name).cast("double")
    return F.when(~F.isnan(v), v)


def accumulate(cube: DataFrame, cells: DataFrame) -> DataFrame:
    """Per cell: means, totals, maxima, threshold days and valid-day counts.

    A cell shows its pixel, so the days are reduced once per pixel and only the result is
    joined to the cells."""
    tmin, tmax, precip = (_valid(v) for v in VARS)
    pixel = cube.groupBy(*PIXEL).agg(
        F.avg(tmin).alias("tmin_mean"), F.avg(tmax).alias("tmax_mean"),
        F.count_if(tmin < 0).alias("frost_days"), F.count_if(tmin >= 20).alias("tropical_nights"),
        F.count_if(tmax >= 25).alias("summer_days"), F.count_if(tmax >= 30).alias("hot_days"),
        F.coalesce(F.sum(precip), F.lit(0.0)).alias("precip_total"), F.max(precip).alias("precip_max_daily"),
        F.count_if(precip >= 1).alias("wet_days"), F.count(tmin).alias("n_days_temp"), F.count(precip).alias("n_days_precip"))
    pixel = pixel.withColumn("tmean", (F.col("tmin_mean") + F.col("tmax_mean")) / 2)
    return cells.select("cell_id", *PIXEL).join(pixel, PIXEL, "left").drop(*PIXEL)


def county_weights(cells: DataFrame) -> DataFrame:
    """(county_mn, iy, ix, n): how many cells of a county show each pixel."""
    return cells.filter(F.col("county_mn").isNotNull()).groupBy("county_mn", *PIXEL).agg(F.count(F.lit(1)).alias("n"))


def _cell_mean(name: str) -> Column:
    v = _valid(name)
    return safe_ratio(F.sum(v * F.col("n")), F.sum(F.when(v.isNotNull(), F.col("n"))))


def county_daily(cube: DataFrame, cells: DataFrame) -> DataFrame:
    """(county_mn, date, tmin, tmax, precip): mean over the county's cells, NULL when none."""
    return cube.join(county_weights(cells), PIXEL).groupBy("county_mn", "date").agg(
        *[_cell_mean(v).alias(v) for v in VARS])


def county_annual_from_daily(daily: DataFrame) -> DataFrame:
    """Yearly mean of the daily county means, with the number of distinct days."""
    return daily.groupBy("county_mn", F.year("date").cast("int").alias("year")).agg(
        *[F.avg(v).alias(v) for v in VARS], F.countDistinct("date").alias("n_days"))


def annual_pixels(cube: DataFrame, min_days: int = 300) -> DataFrame:
    """(iy, ix, year, tmin, tmax, tmean, precip_sum, precip_mean); the sum is NULL unless more
    than ``min_days`` days are valid."""
    a = cube.groupBy(*PIXEL, "year").agg(
        F.avg(_valid("tmin")).alias("tmin"), F.avg(_valid("tmax")).alias("tmax"),
        F.sum(_valid("precip")).alias("_sum"), F.count(_valid("precip")).alias("_n"))
    return a.select(*PIXEL, "year", "tmin", "tmax", ((F.col("tmin") + F.col("tmax")) * 0.5).alias("tmean"),
                    F.when(F.col("_n") > min_days, F.col("_sum")).alias("precip_sum"),
                    safe_ratio(F.col("_sum"), F.col("_n")).alias("precip_mean"))


def county_annual(annual: DataFrame, cube: DataFrame, cells: DataFrame) -> DataFrame:
    """Yearly county series as the cell mean of annual pixel values, with the year's days."""
    days = cube.groupBy("year").agg(F.countDistinct("date").alias("n_days"))
    src = annual.withColumn("precip", F.col("precip_mean")).join(county_weights(cells), PIXEL)
    return src.groupBy("county_mn", "year").agg(*[_cell_mean(v).alias(v) for v in VARS]).join(days, "year")


def normals(annual: DataFrame, early: tuple[int, int], late: tuple[int, int], last: int,
            first: int) -> DataFrame:
    """Per pixel: means of two periods, warming, precipitation change in %, the anomaly of the
    last complete year, and the linear trend per decade where no year is missing."""
    span = annual.filter(F.col("year").between(first, last))

    def mean(name: str, period: tuple[int, int]) -> Column:
        return F.avg(F.when(F.col("year").between(*period), F.col(name)))

    n_years = last - first + 1
    out = span.groupBy(*PIXEL).agg(
        mean("tmean", early).alias("tmean_early"), mean("tmean", late).alias("tmean_late"),
        mean("precip_sum", early).alias("prec_early"), mean("precip_sum", late).alias("prec_late"),
        F.max(F.when(F.col("year") == last, F.col("tmean"))).alias("_last"),
        F.when(F.count("tmean") == n_years, F.regr_slope("tmean", F.col("year").cast("double")) * 10).alias("trend_dec"))
    change = 100 * (F.col("prec_late") - F.col("prec_early")) / F.when(F.col("prec_early") > 0, F.col("prec_early"))
    return out.select(*PIXEL, "tmean_early", "tmean_late", "prec_early", "prec_late",
                      (F.col("tmean_late") - F.col("tmean_early")).alias("warming"), change.alias("prec_change_pct"),
                      (F.col("_last") - F.col("tmean_late")).alias("anomaly"), "trend_dec")


def on_cells(pixel: DataFrame, cells: DataFrame) -> DataFrame:
    """Pixel values at every cell."""
    return cells.select("cell_id", *PIXEL).join(pixel, PIXEL, "left").drop(*PIXEL)


def melt(wide: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, variable, value)."""
    return wide.unpivot(keys, [v for v in VARS if v in wide.columns], "variable", "value")


def county_series(series: DataFrame, county: str) -> DataFrame:
    """One county's series in time order; a yearly series is dated 1 January."""
    out = series.filter(F.col("county_mn") == county)
    if "date" not in series.columns:
        out = out.withColumn("date", F.make_date("year", F.lit(1), F.lit(1)))
    return out.select("date", *VARS).orderBy("date")


def replace_years(history: DataFrame, current: DataFrame) -> DataFrame:
    """History without the years present in the current batch, plus that batch."""
    kept = history.join(current.select("year").distinct(), "year", "left_anti")
    return kept.unionByName(current)
