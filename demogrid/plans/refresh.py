"""The daily climate refresh as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import climate as K
from ..sources.cube import check_columns, read_cube, write_cube


def refresh_climate(spark: SparkSession, delivery: DataFrame | None, cube_path: str, cells: DataFrame,
                    history: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Check a delivery of daily values, swap the years it covers into the cube, and derive the
    cell statistics and the county series again. Nothing happens without a delivery."""
    if delivery is None or delivery.isEmpty():
        return None
    check_columns(delivery, ("year", "date", "iy", "ix", *K.VARS))
    write_cube(delivery, cube_path)
    years = delivery.select("year").distinct()
    current = read_cube(spark, cube_path).join(years, "year", "left_semi")
    daily = K.county_daily(current, cells)
    annual = K.replace_years(history, K.county_annual_from_daily(daily))
    return K.accumulate(current, cells), annual
