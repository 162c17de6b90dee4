"""The regular grid: ids, rows and columns, centroids, rings, point assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import attach
from ..model import GridSpec


def parse_grid_id(df: DataFrame, id_col: str = "GRD_ID") -> DataFrame:
    """Add ``n`` and ``e`` (south-west corner, metres) read from ``…N<northing>E<easting>``; corners south or west of the
    origin have a minus sign."""
    return df.withColumns({
        "n": F.regexp_extract(id_col, r"N(-?\d+)E(-?\d+)", 1).cast("bigint"),
        "e": F.regexp_extract(id_col, r"N(-?\d+)E(-?\d+)", 2).cast("bigint")})


def derive_spec(df: DataFrame, res: int = 1000) -> DataFrame:
    """One row (e_min, n_min, ncols, nrows, n_top, e_max) covering every corner."""
    d = df.agg(F.min("e").alias("e_min"), F.min("n").alias("n_min"),
               F.max("e").alias("_e1"), F.max("n").alias("_n1"))
    ncols = F.expr(f"(_e1 - e_min) div {res}") + 1
    nrows = F.expr(f"(_n1 - n_min) div {res}") + 1
    return d.select("e_min", "n_min", ncols.alias("ncols"), nrows.alias("nrows"),
                    (F.col("n_min") + nrows * res).alias("n_top"),
                    (F.col("e_min") + ncols * res).alias("e_max"))


def number_cells(df: DataFrame, spec: DataFrame, res: int = 1000) -> DataFrame:
    """Add ``col``, ``row`` (0 = north) and ``cell_id = row * ncols + col``."""
    out = attach(df, spec.select("e_min", "n_top", "ncols"))
    return (out.withColumn("col", F.expr(f"(e - e_min) div {res}"))
            .withColumn("row", F.expr(f"(n_top - {res} - n) div {res}"))
            .withColumn("cell_id", F.col("row") * F.col("ncols") + F.col("col"))
            .drop("e_min", "n_top", "ncols"))


def duplicate_keys(df: DataFrame, key: str = "cell_id") -> DataFrame:
    """Keys that occur more than once; a valid cell table gives no rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def centroid(e: Column, n: Column, res: int = 1000) -> tuple[Column, Column]:
    return e + res / 2, n + res / 2


def row_col(cell_id: Column, ncols: int) -> tuple[Column, Column]:
    return F.floor(cell_id / F.lit(ncols)), cell_id % ncols


def corner(spec: GridSpec, cell_id: Column) -> tuple[Column, Column]:
    """South-west corner of a numbered cell."""
    row, col = row_col(cell_id, spec.ncols)
    return spec.e_min + col * spec.res, spec.n_top - (row + 1) * spec.res


def cell_of_point(spec: GridSpec, e: Column, n: Column) -> Column:
    """Number of the cell that holds a projected point; NULL outside the grid."""
    col = F.floor((e - spec.e_min) / spec.res)
    row = F.floor((spec.n_top - n) / spec.res)
    inside = (col >= 0) & (col < spec.ncols) & (row >= 0) & (row < spec.nrows)
    return F.when(inside, row * spec.ncols + col)


def cell_ring(spec: GridSpec, cell_id: Column) -> Column:
    """Closed outline as five points: NW, NE, SE, SW, NW."""
    e0, n0 = corner(spec, cell_id)
    e1, n1 = e0 + spec.res, n0 + spec.res

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return F.array(point(e0, n1), point(e1, n1), point(e1, n0), point(e0, n0), point(e0, n1))
