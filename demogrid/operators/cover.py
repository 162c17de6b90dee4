"""Which lattice pixels do polygons and lines cover?

Edges are rows ``(feature_id, x1, y1, x2, y2)``. A lattice is ``(x0, y0, res)``; pixel
``(prow, pcol)`` is ``[y0 + prow*res, …) x [x0 + pcol*res, …)``. Rasters that count rows
from the north negate y first (``north_up``)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lattice:
    x0: float
    y0: float
    res: float
    north_up: bool = False  # y0 is then the top edge and rows grow southwards

    def pixels(self, df: DataFrame) -> DataFrame:
        """Edge coordinates in pixel units, as ``u1, v1, u2, v2``."""
        sign = -1.0 if self.north_up else 1.0
        return df.withColumns({
            "u1": (F.col("x1") - self.x0) / self.res, "v1": (F.col("y1") - self.y0) * sign / self.res,
            "u2": (F.col("x2") - self.x0) / self.res, "v2": (F.col("y2") - self.y0) * sign / self.res})


def rings_to_edges(vertices: DataFrame, keys: list[str] = ("feature_id", "ring"), closed: bool = True,
                   attrs: list[str] = ()) -> DataFrame:
    """Vertices ``(…keys, seq, x, y)`` numbered 0, 1, 2… to edges; the last joins the first if
    closed. A join on the number, not a window per ring, so a coastline of millions of vertices
    is spread like everything else."""
    keys = list(keys)
    follow = vertices.select(*keys, (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    if closed:
        ends = vertices.groupBy(*keys).agg(F.max("seq").alias("seq"), F.min_by(F.struct("x", "y"), "seq").alias("p"))
        follow = follow.filter("seq >= 0").unionByName(
            ends.select(*keys, "seq", F.col("p.x").alias("x2"), F.col("p.y").alias("y2")))
    edges = vertices.select(*keys, *attrs, "seq", "x", "y").join(follow.hint("merge"), [*keys, "seq"])
    return edges.filter((F.col("x") != F.col("x2")) | (F.col("y") != F.col("y2"))).select(
        *keys, *attrs, F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"),
        F.col("x2").cast("double").alias("x2"), F.col("y2").cast("double").alias("y2"))


def interior_spans(edges: DataFrame, lattice: Lattice, key: str = "feature_id") -> DataFrame:
    """(key, prow, c0, c1): runs of pixels whose centre lies inside, one scan line per row.

    Every edge is sent only to the pixel rows whose centre line it crosses; the crossings of
    a row, sorted by x, are taken in pairs."""
    p = lattice.pixels(edges)
    lo, hi = F.least("v1", "v2"), F.greatest("v1", "v2")
    # centre lines v = r + 0.5 with lo <= v < hi
    r0, r1 = F.ceil(lo - 0.5), F.ceil(hi - 0.5) - 1
    rows = p.filter(r1 >= r0).withColumn("prow", F.explode(F.sequence(r0, r1)))
    yc = F.col("prow") + 0.5
    cross = rows.select(key, "prow", (F.col("u1") + (yc - F.col("v1")) * (F.col("u2") - F.col("u1"))
                                      / (F.col("v2") - F.col("v1"))).alias("u"))
    w = Window.partitionBy(key, "prow").orderBy("u")
    pairs = (cross.withColumns({"i": F.row_number().over(w), "u_end": F.lead("u").over(w)})
             .filter((F.col("i") % 2 == 1) & F.col("u_end").isNotNull()))
    # centres c + 0.5 with u <= centre < u_end
    return (pairs.select(key, "prow", F.ceil(F.col("u") - 0.5).alias("c0"),
                         (F.ceil(F.col("u_end") - 0.5) - 1).alias("c1"))
            .filter(F.col("c1") >= F.col("c0")))


def interior_pixels(edges: DataFrame, lattice: Lattice, key: str = "feature_id") -> DataFrame:
    """(key, prow, pcol) by the pixel-centre rule; even-odd, so holes stay empty."""
    return interior_spans(edges, lattice, key).select(
        key, "prow", F.explode(F.sequence("c0", "c1")).alias("pcol"))


def edge_pixels(edges: DataFrame, lattice: Lattice, key: str = "feature_id") -> DataFrame:
    """(key, prow, pcol, edge coordinates…): every pixel an edge passes through.

    An edge is cut at pixel-row boundaries; in each row it touches the columns between the
    ends of its piece."""
    p = lattice.pixels(edges)
    rows = p.withColumn("prow", F.explode(F.sequence(F.floor(F.least("v1", "v2")),
                                                     F.floor(F.greatest("v1", "v2")))))
    slope = (F.col("u2") - F.col("u1")) / F.nullif(F.col("v2") - F.col("v1"), F.lit(0.0))
    lo, hi = F.least("v1", "v2"), F.greatest("v1", "v2")
    va, vb = F.greatest(lo, F.col("prow").cast("double")), F.least(hi, F.col("prow") + 1.0)
    ua = F.when(slope.isNull(), F.col("u1")).otherwise(F.col("u1") + (va - F.col("v1")) * slope)
    ub = F.when(slope.isNull(), F.col("u2")).otherwise(F.col("u1") + (vb - F.col("v1")) * slope)
    return (rows.withColumn("pcol", F.explode(F.sequence(F.floor(F.least(ua, ub)), F.floor(F.greatest(ua, ub)))))
            .drop("u1", "v1", "u2", "v2"))


def touched_pixels(edges: DataFrame, lattice: Lattice, key: str = "feature_id", filled: bool = True) -> DataFrame:
    """(key, prow, pcol): all-touched coverage of polygons, or of lines if not ``filled``."""
    outline = edge_pixels(edges, lattice, key).select(key, "prow", "pcol")
    if filled:
        outline = outline.unionByName(interior_pixels(edges, lattice, key))
    return outline.distinct()


def within(df: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """Clip pixels to a raster's extent."""
    return df.filter(F.col("prow").between(0, nrows - 1) & F.col("pcol").between(0, ncols - 1))


def burn(pixels: DataFrame, value: str, highest_wins: bool = True) -> DataFrame:
    """(prow, pcol, value): one value per pixel where features overlap."""
    pick = F.max(value) if highest_wins else F.min(value)
    return pixels.groupBy("prow", "pcol").agg(pick.alias(value))


def feature_bounds(vertices: DataFrame, keys: list[str], decimals: int = 4) -> DataFrame:
    """(keys…, minx, miny, maxx, maxy), merged over all features of a key."""
    return vertices.groupBy(*keys).agg(
        F.bround(F.min("x").cast("double"), decimals).alias("minx"),
        F.bround(F.min("y").cast("double"), decimals).alias("miny"),
        F.bround(F.max("x").cast("double"), decimals).alias("maxx"),
        F.bround(F.max("y").cast("double"), decimals).alias("maxy"))
