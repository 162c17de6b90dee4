"""Vector layers as text: WKT to edges, GeoJSON points, lines and polygons in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projection import to_grid

NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def wkt_vertices(df: DataFrame, wkt: str, keys: list[str], attrs: list[str] = ()) -> DataFrame:
    """(keys…, attrs…, ring, seq, x, y) from POLYGON / MULTIPOLYGON / LINESTRING text.

    Every innermost parenthesis is one ring; holes need no mark under the even-odd rule."""
    rings = df.select(*keys, *attrs, F.posexplode(F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), 1)).alias("ring", "_r"))
    pts = rings.select(*keys, *attrs, "ring", F.posexplode(
        F.regexp_extract_all("_r", F.lit(f"({NUMBER}\\s+{NUMBER})"), 1)).alias("seq", "_p"))
    xy = F.split("_p", r"\s+")
    return pts.select(*keys, *attrs, "ring", "seq", xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))


def wkt_outlines(df: DataFrame, wkt: str, keys: list[str], attrs: list[str] = (), srid: str | None = None) -> DataFrame:
    """(keys…, ring, attrs…, outline: array of x1, y1, x2, y2) of WKT features; the closing vertex repeats the first, so no edge is
    added.

    A ring is one text, so its vertices are paired where they are, without a join. ``srid`` names a column with each
    feature's coordinate system; its vertices are then brought onto the grid."""
    def vertex(p: Column) -> Column:
        x, y = (p[c].cast("double") for c in "xy")
        if srid:
            x, y = to_grid(x, y, F.col(srid))
        return F.struct(x.alias("x"), y.alias("y"))

    texts = [F.regexp_extract_all("_r", F.lit(f"({NUMBER})\\s+({NUMBER})"), i).alias(c) for i, c in ((1, "x"), (2, "y"))]
    rings = df.select(*keys, *attrs, *([srid] if srid else []), F.posexplode(F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), 1)).alias("ring", "_r"))
    line = rings.dropna(subset=list(keys)).withColumn("_v", F.transform(F.arrays_zip(*texts), vertex)).filter(F.size("_v") > 1)
    pair = F.arrays_zip(F.slice("_v", 1, F.size("_v") - 1).alias("a"), F.slice("_v", 2, F.size("_v") - 1).alias("b"))
    edge = F.transform(pair, lambda p: F.struct(p["a"]["x"].alias("x1"), p["a"]["y"].alias("y1"), p["b"]["x"].alias("x2"), p["b"]["y"].alias("y2")))
    return line.select(*keys, "ring", *attrs, F.filter(edge, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"])).alias("outline"))


def wkt_edges(df: DataFrame, wkt: str, keys: list[str], attrs: list[str] = (), srid: str | None = None) -> DataFrame:
    """(keys…, ring, attrs…, x1, y1, x2, y2): the edges of `wkt_outlines`, one by one."""
    return wkt_outlines(df, wkt, keys, attrs, srid).select(*keys, "ring", *attrs, F.inline("outline"))


def read_geojson(spark: SparkSession, path: str, properties: str, geometry: str = "array<double>") -> DataFrame:
    """(properties…, coordinates) of every feature in a folder of GeoJSON documents.

    ``properties`` is a DDL list, so nothing is inferred from the data. Point layers are the
    default; pass another coordinates type for lines and polygons."""
    schema = (f"features array<struct<properties: struct<{properties}>, "
              f"geometry: struct<type: string, coordinates: {geometry}>>>")
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return doc.select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry.coordinates")


def read_geojson_points(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(properties…, x, y) of point features."""
    pts = read_geojson(spark, path, properties)
    return pts.withColumns({"x": F.col("coordinates")[0], "y": F.col("coordinates")[1]}).drop("coordinates")


def _feature(properties: list[str], kind: str, coordinates: Column) -> Column:
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value")


def geojson_features(df: DataFrame, x: str, y: str, properties: list[str]) -> DataFrame:
    """One GeoJSON Feature per row, as text in ``value``."""
    return df.select(_feature(properties, "Point", F.array(F.col(x), F.col(y))))


def geojson_shapes(vertices: DataFrame, properties: list[str], kind: str = "Polygon") -> DataFrame:
    """One GeoJSON Feature per distinct ``properties``, as text in ``value``, from rows (properties…, ring, seq, x, y).

    A Polygon has its rings in order, each closed if it is not; for kind MultiLineString the rings are lines."""
    ring = vertices.groupBy(*properties, "ring").agg(F.sort_array(F.collect_list(F.struct(
        "seq", F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("p")))).alias("v"))
    points = F.transform("v", lambda v: v["p"])
    if kind == "Polygon":
        first = F.element_at(points, 1)
        points = F.when(first == F.element_at(points, -1), points).otherwise(F.concat(points, F.array(first)))
    rings = ring.select(*properties, F.struct("ring", points.alias("points")).alias("r"))
    whole = rings.groupBy(*properties).agg(F.sort_array(F.collect_list("r")).alias("r"))
    return whole.select(_feature(properties, kind, F.transform("r", lambda r: r["points"])))


def write_geojson_shapes(vertices: DataFrame, path: str, properties: list[str], kind: str = "Polygon") -> None:
    """A folder of newline-delimited GeoJSON Features with polygons or lines, written in parallel."""
    geojson_shapes(vertices, properties, kind).write.mode("errorifexists").text(path)


def read_geojson_shapes(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(properties…, ring, seq, x, y) of newline-delimited polygon or multi-line features."""
    schema = f"properties struct<{properties}>, geometry struct<type: string, coordinates: array<array<array<double>>>>"
    df = spark.read.schema(schema).json(path).select("properties.*", F.posexplode("geometry.coordinates").alias("ring", "_r"))
    return df.select("*", F.posexplode("_r").alias("seq", "_p")).withColumns({"x": F.col("_p")[0], "y": F.col("_p")[1]}).drop("_r", "_p")


def write_geojson_lines(df: DataFrame, path: str, x: str, y: str, properties: list[str]) -> None:
    """A folder of newline-delimited GeoJSON Features, written in parallel."""
    geojson_features(df, x, y, properties).write.mode("errorifexists").text(path)


def read_geojson_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    schema = f"properties struct<{properties}>, geometry struct<type: string, coordinates: array<double>>"
    df = spark.read.schema(schema).json(path)
    return df.select("properties.*", F.col("geometry.coordinates")[0].alias("x"), F.col("geometry.coordinates")[1].alias("y"))

