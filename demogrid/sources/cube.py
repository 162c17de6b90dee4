"""The daily cube at rest: which yearly files to use, building it, reading it, refreshing it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File name pattern of one variable and year.
FILE_NAME = r"^daily_(precip|tmin|tmax)(_synop)?_(\d{4})\.nc$"
N_VARS = 3


def year_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """(year, var, path): one file per variable and year, the plain name before the provisional
    one, and only years for which all three variables exist."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    found = paths.select(
        path, F.regexp_extract(name, FILE_NAME, 1).alias("var"),
        (F.regexp_extract(name, FILE_NAME, 2) != "").alias("provisional"),
        F.regexp_extract(name, FILE_NAME, 3).try_cast("int").alias("year")).filter(F.col("var") != "")
    best = found.groupBy("year", "var").agg(F.min(F.struct("provisional", path)).alias("m")).select("year", "var", f"m.{path}")
    whole = best.groupBy("year").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == N_VARS)
    return best.join(whole.select("year"), "year", "left_semi")


def write_cube(cube: DataFrame, path: str, years: DataFrame | None = None) -> None:
    """Write (or replace) whole years. Years not present in the batch stay as they are, so a
    repeated run gives the same cube."""
    out = cube if years is None else cube.join(F.broadcast(years.select("year").distinct()), "year", "left_semi")
    (out.repartition("year", "iy").sortWithinPartitions("year", "iy", "ix", "date")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy("year").parquet(path))


def read_cube(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Long cube; year bounds prune partitions."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.filter(F.col("year") >= first)
    if last is not None:
        df = df.filter(F.col("year") <= last)
    return df


def check_columns(df: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """The frame itself, or an error naming what a delivered file lacks."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"delivery lacks {', '.join(missing)}")
    return df


def latest_values(deliveries: DataFrame, delivery: str = "delivery") -> DataFrame:
    """Of several deliveries of the same pixel and day, the newest; of equally new ones that with the largest values.

    Maxima are combined before the shuffle."""
    keys = ["year", "date", "iy", "ix"]
    rest = [c for c in deliveries.columns if c not in (*keys, delivery)]
    newest = deliveries.groupBy(*keys).agg(F.max(F.struct(delivery, *rest)).alias("m"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"m.{c}") for c in deliveries.columns if c != delivery])
