"""From source layers to the published tables: one function per layer, each giving one row
per cell, and their assembly.

``cells`` is the numbered cell table (cell_id, row, col, e, n). Polygon and line layers come as
edges ``(feature_id, x1, y1, x2, y2)`` in grid metres plus attributes by ``feature_id``; point
layers as rows with x and y."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import attach, recode
from ..functions.text import airport_label, is_urban
from ..model import GridSpec
from ..operators import cover as V
from ..operators import raster as R
from ..operators.cells import centroid
from ..operators.spatial import assign_polygons, exactly_one, nearest_with_label
from ..sources.tables import assemble
from . import catalogue as C

F100 = 10  # 100 m pixels per side of a cell


def fine_lattice(spec: GridSpec) -> V.Lattice:
    return V.Lattice(spec.e_min, spec.n_top, spec.res / F100, north_up=True)


def coarse_lattice(spec: GridSpec) -> V.Lattice:
    return V.Lattice(spec.e_min, spec.n_top, spec.res, north_up=True)


def _fine(pixels: DataFrame, spec: GridSpec) -> DataFrame:
    return V.within(pixels, spec.nrows * F100, spec.ncols * F100)


def _centres(cells: DataFrame, spec: GridSpec) -> DataFrame:
    x, y = centroid(F.col("e"), F.col("n"), spec.res)
    return cells.select("cell_id", x.alias("x"), y.alias("y"))


def _on_cells(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    b = blocks.withColumnsRenamed({"brow": "row", "bcol": "col"})
    return cells.select("cell_id", "row", "col").join(b, ["row", "col"], "left").drop("row", "col")


def admin(cells: DataFrame, spec: GridSpec, edges: DataFrame, units: DataFrame) -> DataFrame:
    """Administrative unit of each cell centre, the nearest within 5 km where none contains it."""
    found = assign_polygons(_centres(cells, spec), edges, 5000.0).drop("how")
    status = recode(F.col("natLevName"), C.ADMIN_STATUS)
    return found.join(units, "feature_id", "left").select(
        "cell_id", F.col("natCode").cast("int").alias("siruta"), F.col("name").alias("uat_name"), status.alias("uat_status"),
        F.col("countyMn").alias("county_mn"), F.col("county").alias("county_name"), F.col("region").alias("region_name"),
        F.when(status == "comună", "rural").when(status.isNotNull(), "urban").alias("mediu"))


def landform(cells: DataFrame, spec: GridSpec, edges: DataFrame, forms: DataFrame) -> DataFrame:
    """Landform of each cell centre; gaps in the upper levels are filled from the lower ones."""
    found = assign_polygons(_centres(cells, spec), edges, 5000.0).drop("how")
    return found.join(forms, "feature_id", "left").select(
        "cell_id", F.col("r_1name").alias("landform_name"), F.col("r_1type").alias("landform_type"),
        F.coalesce("r_1j_lvl0_name", "r_1j_lvl1_name", "r_1name").alias("landform_lvl0"),
        F.coalesce("r_1j_lvl1_name", "r_1name").alias("landform_lvl1"))


def _dominant(cells: DataFrame, spec: GridSpec, pixels: DataFrame, cls: str, labels: dict, name: str, count_empty: bool = False) -> DataFrame:
    blocks = R.dominant_class(V.burn(pixels, cls), cls, F100, count_empty)
    return _on_cells(cells, blocks).select("cell_id", recode(F.col("class"), labels).alias(name))


def built_up(cells: DataFrame, spec: GridSpec, edges: DataFrame, places: DataFrame) -> DataFrame:
    """Town or village and gas supply, by the dominant class of the 10 x 10 pixels."""
    pixels = _fine(V.interior_pixels(edges, fine_lattice(spec)), spec).join(places.select(
        "feature_id", F.when(is_urban(F.col("TipLocalitate")), 2).otherwise(1).alias("urban"),
        F.when(F.coalesce(F.col("conectata_gaz").cast("boolean"), F.lit(False)), 2).otherwise(1).alias("gas")), "feature_id")
    town = _dominant(cells, spec, pixels, "urban", {1: "sat", 2: "oraș"}, "intravilan")
    gas = _dominant(cells, spec, pixels, "gas", {1: "neconectat", 2: "conectat"}, "acces_gaz")
    return town.join(gas, "cell_id")


def bear_risk(cells: DataFrame, spec: GridSpec, edges: DataFrame, zones: DataFrame) -> DataFrame:
    """Risk zone covering most of the cell; mostly outside every zone gives NULL."""
    pixels = _fine(V.interior_pixels(edges, fine_lattice(spec)), spec).join(
        zones.select("feature_id", (F.col("symbol").cast("int") + 1).alias("zone")), "feature_id")
    return _dominant(cells, spec, pixels, "zone", {i + 1: v for i, v in enumerate(C.BEAR)}, "risc_urs", count_empty=True)


def _central_distance(cells: DataFrame, spec: GridSpec, burnt: DataFrame, labels: dict, dist: str, label: str) -> DataFrame:
    raster = R.label_raster(burnt, spec.nrows * F100, spec.ncols * F100)
    mid = R.central_pixel(R.distance_transform(raster, rows=R.central_rows(F100)), F100)
    return _on_cells(cells, mid.drop("prow", "pcol")).select(
        "cell_id", F.bround(R.distance_km(F.col("d2"), spec.res / F100), 2).cast("float").alias(dist),
        recode(F.col("class"), labels).alias(label))


def water(cells: DataFrame, spec: GridSpec, edges: DataFrame, lakes: DataFrame) -> DataFrame:
    """Distance of the cell's central pixel to standing water, and the kind of water. A known
    kind beats the catch-all where lakes overlap, then the later feature."""
    kinds = {k: i + 1 for i, k in enumerate(C.WATER_KINDS)}
    other = kinds[C.OTHER_WATER]
    pixels = _fine(V.interior_pixels(edges, fine_lattice(spec)), spec).join(
        lakes.select("feature_id", recode(F.col("categorie_ro"), kinds, other).alias("class")), "feature_id")
    top = F.max(F.struct((F.col("class") != other).alias("known"), "feature_id", "class"))
    burnt = pixels.groupBy("prow", "pcol").agg(top.alias("m")).select("prow", "pcol", F.col("m.class").alias("class"))
    return _central_distance(cells, spec, burnt, {v: k for k, v in kinds.items()}, "dist_water_km", "categorie_apa")


def watercourses(cells: DataFrame, spec: GridSpec, edges: DataFrame, streams: DataFrame) -> DataFrame:
    """The same for rivers and brooks, all-touched; the higher class number wins a pixel."""
    kinds = {k: i + 1 for i, k in enumerate(C.STREAM_KINDS)}
    pixels = _fine(V.touched_pixels(edges, fine_lattice(spec), filled=False), spec).join(
        streams.select("feature_id", recode(F.col("categorie_ro"), kinds, kinds["Pârâu"]).alias("class")), "feature_id")
    return _central_distance(cells, spec, V.burn(pixels, "class"), {v: k for k, v in kinds.items()}, "dist_curs_km", "categorie_curs")


def floods(cells: DataFrame, spec: GridSpec, edges: DataFrame, zones: DataFrame) -> DataFrame:
    """Distance to the nearest flood zone and its scenario, ``zones(feature_id, scenario)`` with
    1 = most frequent. The most frequent scenario that touches a pixel counts."""
    names = {1: C.FLOOD_10, 2: C.FLOOD_1, 3: C.FLOOD_01}
    pixels = _fine(V.touched_pixels(edges, fine_lattice(spec)), spec).join(zones.select("feature_id", F.col("scenario").cast("int").alias("class")), "feature_id")
    raster = R.label_raster(V.burn(pixels, "class", highest_wins=False), spec.nrows * F100, spec.ncols * F100)
    blocks = R.scenario_overlay(R.distance_transform(raster), spec.res / F100, F100)
    return _on_cells(cells, blocks).select("cell_id", F.col("dist_km").cast("float").alias("dist_inundatii_km"),
                                           recode(F.col("scenario"), names).alias("scenariu_inundatii"))


def protected_areas(cells: DataFrame, spec: GridSpec, edges: DataFrame) -> DataFrame:
    """Distance from the cell's nearest pixel to a protected area, 0 where they meet."""
    pixels = _fine(V.interior_pixels(edges, fine_lattice(spec)), spec).select("prow", "pcol").distinct().withColumn("class", F.lit(1))
    raster = R.label_raster(pixels, spec.nrows * F100, spec.ncols * F100)
    blocks = R.block_min_distance(R.distance_transform(raster), spec.res / F100, F100)
    return _on_cells(cells, blocks).select("cell_id", F.col("dist_km").cast("float").alias("dist_protected_km"))


def _nearest(cells: DataFrame, spec: GridSpec, sites: DataFrame, label: str, dist: str, name: str) -> DataFrame:
    near = nearest_with_label(_centres(cells, spec), sites, label)
    return near.select("cell_id", F.col("dist_km").cast("float").alias(dist), F.col(label).alias(name))


def hospitals(cells: DataFrame, spec: GridSpec, sites: DataFrame) -> DataFrame:
    """Straight distance to the nearest active hospital: ``sites(site_id, x, y, active, nume)``."""
    return _nearest(cells, spec, sites.filter("active = 1"), "nume", "dist_hospital_km", "nearest_hospital")


def crossings(cells: DataFrame, spec: GridSpec, sites: DataFrame) -> DataFrame:
    """Nearest border crossing; inland river ports are not crossings."""
    return _nearest(cells, spec, sites.filter(F.col("border") != "Dunărea interioară"), "name", "dist_crossing_km", "nearest_crossing")


def airports(cells: DataFrame, spec: GridSpec, sites: DataFrame) -> DataFrame:
    named = sites.withColumn("label", airport_label(F.col("municipality"), F.col("name"), F.col("iata")))
    return _nearest(cells, spec, named, "label", "dist_airport_km", "nearest_airport")


def terrain(cells: DataFrame, elevation: DataFrame, pixel_m: float = 100.0) -> DataFrame:
    """Altitude and slope statistics of the aligned raster ``(prow, pcol, value)``."""
    sloped = R.slope_degrees(elevation, "value", pixel_m)
    alt = R.block_stats(sloped, "value", F100)
    slope = R.block_stats(sloped, "slope", F100)

    def pick(df: DataFrame, prefix: str, names: tuple[str, ...]) -> DataFrame:
        return df.select("brow", "bcol", *[F.col(n).cast("float").alias(f"{prefix}_{n}") for n in names])

    blocks = pick(alt, "alt", ("mean", "min", "max", "std")).join(pick(slope, "slope", ("mean", "max")), ["brow", "bcol"])
    return _on_cells(cells, blocks)


def border(cells: DataFrame, spec: GridSpec, edges: DataFrame, lines: DataFrame, coast: str = "RO.RO") -> DataFrame:
    """Distance to the nearest state border and its neighbour, and to the coast. The lines
    ``lines(feature_id, border)`` are rasterised at cell size; each code is one target group."""
    named = edges.join(lines.select("feature_id", F.col("border").alias("side")), "feature_id").drop("feature_id")
    pixels = V.within(V.touched_pixels(named, coarse_lattice(spec), key="side", filled=False), spec.nrows, spec.ncols).withColumn("class", F.lit(1))
    sides = lines.select(F.col("border").alias("side")).distinct()
    # one code per neighbour state, a short list; exactly one of them is the coast
    codes = exactly_one(sides, F.col("side") == coast, "coast line", keep_all=True).agg(F.collect_set("side").alias("sides"))
    dense = attach(R.dense_lattice(cells.sparkSession, spec.nrows, spec.ncols), codes).select("prow", "pcol", F.explode("sides").alias("side"))
    raster = dense.join(pixels, ["side", "prow", "pcol"], "left")
    near = R.nearest_group(R.distance_transform(raster, groups=["side"]), "side", coast, spec.res)
    out = _on_cells(cells, near.withColumnsRenamed({"prow": "brow", "pcol": "bcol"}))
    code = F.element_at(F.split("nearest", r"\."), 2)
    return out.select("cell_id", F.col("dist_km").cast("float").alias("dist_border_km"), code.alias("border_neighbor"),
                      F.col("apart_km").cast("float").alias("dist_coast_km"))


def core_table(cells: DataFrame) -> DataFrame:
    """Demography, with coordinates narrowed to FLOAT."""
    out = cells.drop("grid_id", "e", "n", "pop_2021_eurostat", "pop_2018")
    return out.withColumns({c: F.col(c).cast("float") for c in ("lon", "lat") if c in out.columns})


def env_table(parts: list[DataFrame]) -> DataFrame:
    return assemble(parts)


def climate_table(current: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Current-year statistics, with the multi-year columns where they exist."""
    days = ("frost_days", "tropical_nights", "summer_days", "hot_days", "wet_days", "n_days_temp", "n_days_precip")
    real = ("tmin_mean", "tmax_mean", "tmean", "precip_total", "precip_max_daily")
    return assemble([current], optional=history, types={**{d: "smallint" for d in days}, **{r: "float" for r in real}})
