"""Forecast and air-quality runs on a coarse node grid, brought to the cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import air
from ..functions.columns import attach, safe_ratio, to_long
from ..functions.projection import unit_sphere
from ..functions.times import LOCAL_ZONE, expected_steps, local_day
from .spatial import nearest_sites

MAX_CHORD = 0.02
CORNERS = "abcd"

# Threshold ladders in °C, mildest first, and the share of people a band must expose.
HEAT_LADDER = (30, 32, 35, 38, 40)
COLD_LADDER = (0, -5, -10, -15, -20)
POP_FLOOR = 0.005
PRODUCTS = {
    "heat": ("weather", "tmax", "max", ">=", 35),
    "cold": ("weather", "tmin", "min", "<=", -10),
    "air_poor": ("air", "aqi_rank", "max", ">=", 3),
}


# --- series ------------------------------------------------------------------------------------

def crop(df: DataFrame, west: float, east: float, south: float, north: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows inside a box; longitudes may be given in any turn and come out in [-180, 180).

    The latitude test is a plain comparison, so it reaches the Parquet scan."""
    from ..functions.projection import wrap_longitude

    return (df.filter(F.col(lat).between(south, north)).withColumn(lon, wrap_longitude(F.col(lon)))
            .filter(F.col(lon).between(west, east)))


def canonical_ids(nodes: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Distinct nodes numbered from the north-west, row by row: (lon, lat, grid_id).

    The number is the count of nodes in more northern rows plus the place in the row, so only
    one record per latitude meets in a single task."""
    d = nodes.select(lon, lat).distinct()
    rows = d.groupBy(lat).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.desc(lat)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.select(lat, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy(lat).orderBy(lon)) - 1
    return d.withColumn("place", place).join(offsets, lat).select(lon, lat, (F.col("offset") + F.col("place")).alias("grid_id"))


def densify(df: DataFrame, keys: list[str], ts: str = "valid_time", step: str = "1 hour") -> DataFrame:
    """Every key at every step between the first and the last instant; gaps become NULL rows."""
    span = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    ids = attach(df.select(*keys).distinct(), span)
    axis = ids.select(*keys, F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias(ts))
    return axis.join(df, [*keys, ts], "left")


def rolling_mean(df: DataFrame, keys: list[str], value: str = "value", ts: str = "valid_time", n: int = 24) -> Column:
    """Mean of the last n rows of a key; NULL unless all n values are there. Rows, not time:
    the axis must be regular (see ``densify``)."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-(n - 1), 0)
    v = F.when(~F.isnan(value), F.col(value))
    return F.when(F.count(v).over(w) == n, F.avg(v).over(w))


def complete_local_days(times: DataFrame, interval_hours: int, ts: str = "valid_time", shift_minutes: int = 0,
                        keys: list[str] = (), zone: str = LOCAL_ZONE) -> DataFrame:
    """(keys…, day): local days covered by as many distinct steps as their 23, 24 or 25 hours need."""
    steps = times.select(*keys, ts).distinct()
    day = local_day(F.col(ts), zone, shift_minutes)
    return (steps.groupBy(*keys, day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= expected_steps(F.col("day"), interval_hours, zone)).select(*keys, "day"))


def weather_daily(steps: DataFrame, interval_hours: int = 3, only_complete: bool = True) -> DataFrame:
    """(grid_id, valid_date, tmin, tmax) in °C from interval extremes in kelvin.

    A step describes the interval before it, so its middle (90 minutes earlier) decides the day."""
    day = local_day(F.col("valid_time"), shift_minutes=-90)

    def celsius(c: str) -> Column:
        return F.when(~F.isnan(c), F.col(c)) - 273.15

    daily = steps.groupBy("grid_id", day.alias("valid_date")).agg(
        F.min(celsius("min_k")).alias("tmin"), F.max(celsius("max_k")).alias("tmax"))
    if not only_complete:
        return daily
    full = complete_local_days(steps, interval_hours, shift_minutes=-90).withColumnRenamed("day", "valid_date")
    return daily.join(full, "valid_date", "left_semi").select("grid_id", "valid_date", "tmin", "tmax")


def air_daily(series: DataFrame, only_complete: bool = True) -> DataFrame:
    """(grid_id, valid_date, aqi_rank, five ``*_max``) from (grid_id, valid_time, pollutant, value).

    Particulates are ranked on their strict 24-hour mean, gases hour by hour; the worst rank
    wins. Rows without any value are dropped."""
    s = series.withColumn("value", F.when(~F.isnan("value"), F.col("value").cast("double")))
    basis = F.when(F.col("pollutant").isin(*air.ROLLING), rolling_mean(s, ["grid_id", "pollutant"])).otherwise(F.col("value"))
    ranked = s.withColumn("rank", air.aqi_rank_by_name(basis, F.col("pollutant")))
    day = local_day(F.col("valid_time"))
    maxima = [F.max(F.when(F.col("pollutant") == p, F.col("value"))).alias(f"{p}_max") for p in air.POLLUTANTS]
    daily = ranked.groupBy("grid_id", day.alias("valid_date")).agg(F.max("rank").alias("aqi_rank"), *maxima)
    daily = daily.filter(F.coalesce(*[f"{p}_max" for p in air.POLLUTANTS]).isNotNull())
    if only_complete:
        full = complete_local_days(series, 1).withColumnRenamed("day", "valid_date")
        daily = daily.join(full, "valid_date", "left_semi")
    return daily.select("grid_id", "valid_date", "aqi_rank", *[f"{p}_max" for p in air.POLLUTANTS])


def run_problems(weather: DataFrame, air_run: DataFrame) -> DataFrame:
    """(problem, n): empty runs, inverted extremes, ranks out of range."""
    w = weather.agg(F.count_if(F.col("tmin") > F.col("tmax")).alias("inverted"), F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint").alias("empty"))
    a = air_run.agg(F.count_if(~F.col("aqi_rank").between(0, 5)).alias("out_of_range"), F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint").alias("empty_air"))
    return attach(w, a).unpivot([], ["inverted", "empty", "out_of_range", "empty_air"], "problem", "n")


def missing_steps(times: DataFrame, first: Column, last: Column, step: str, ts: str = "valid_time") -> DataFrame:
    """Expected instants that are absent; an empty result means full coverage."""
    one = times.sparkSession.range(1).select(first.cast("timestamp").alias("lo"), last.cast("timestamp").alias("hi"))
    axis = one.select(F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias(ts))
    return axis.join(times.select(F.col(ts).cast("timestamp").alias(ts)).distinct(), ts, "left_anti")


def same_grid(a: DataFrame, b: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """One row (same, n_only_one_side, n_moved): do two node grids agree?"""
    left = a.select("grid_id", F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"))
    right = b.select("grid_id", F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"))
    both = left.join(right, "grid_id", "full")
    single = F.col("lon_a").isNull() | F.col("lon_b").isNull()
    moved = (F.abs(F.col("lon_a") - F.col("lon_b")) > tolerance) | (F.abs(F.col("lat_a") - F.col("lat_b")) > tolerance)
    out = both.agg(F.count_if(single).alias("n_only_one_side"), F.count_if(moved).alias("n_moved"))
    return out.withColumn("same", (F.col("n_only_one_side") == 0) & (F.col("n_moved") == 0))


# --- mapping -------------------------------------------------------------------------------------

def nearest_node(cells: DataFrame, nodes: DataFrame, max_chord: float = MAX_CHORD) -> DataFrame:
    """(cell_id, grid_id): nearest node on the sphere; a cell too far from every node stops the job."""
    def placed(df: DataFrame, key: str) -> DataFrame:
        x, y, z = unit_sphere(F.col("lon").cast("double"), F.col("lat").cast("double"))
        return df.select(key, x.alias("x"), y.alias("y"), z.alias("z"))

    near = nearest_sites(placed(cells, "cell_id"), placed(nodes, "grid_id"), 1, "cell_id", "grid_id", ("x", "y", "z"))
    ok = F.when(F.col("d2") <= max_chord ** 2, F.col("grid_id")).otherwise(
        F.raise_error(F.lit("some cells are too far from the node grid")).cast("bigint"))
    return near.select("cell_id", ok.alias("grid_id"))


def node_lattice(nodes: DataFrame, lon: str = "lon", lat: str = "lat") -> dict | None:
    """Start, step and size of both axes, or None if the nodes do not fill a rectangle.

    Two one-row aggregates are read; the nodes stay where they are."""
    a = nodes.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(lon).alias("nx"), F.countDistinct(lat).alias("ny"),
                  F.countDistinct(lon, lat).alias("nxy"), F.min(lon).alias("x0"), F.min(lat).alias("y0")).first()
    if not (a["nx"] >= 2 and a["ny"] >= 2 and a["nx"] * a["ny"] == a["n"] == a["nxy"]):
        return None
    b = nodes.agg(F.min(F.when(F.col(lon) > a["x0"], F.col(lon))).alias("x1"),
                  F.min(F.when(F.col(lat) > a["y0"], F.col(lat))).alias("y1")).first()
    return {"x0": float(a["x0"]), "y0": float(a["y0"]), "dx": float(b["x1"] - a["x0"]), "dy": float(b["y1"] - a["y0"]),
            "nx": a["nx"], "ny": a["ny"]}


def bilinear_mapping(cells: DataFrame, nodes: DataFrame, nearest: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(cell_id, corner, grid_id, weight): four surrounding nodes and their weights, clamped at
    the border; a node grid with holes falls back to the nearest node with weight 1."""
    box = node_lattice(nodes, lon, lat)
    if box is None:
        parts = [F.struct(F.lit(c).alias("corner"), F.col("grid_id"), F.lit(1.0 if c == "a" else 0.0).alias("weight")) for c in CORNERS]
        return nearest.select("cell_id", F.inline(F.array(*parts)))

    def axis(name: str, start: float, step: float, n: int) -> tuple[Column, Column]:
        f = F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), (F.col(name).cast("double") - start) / step))
        i = F.greatest(F.lit(0), F.least(F.lit(n - 2), F.floor(f))).cast("bigint")
        return i, F.greatest(F.lit(0.0), F.least(F.lit(1.0), f - i))

    j, wj = axis(lon, box["x0"], box["dx"], box["nx"])
    i, wi = axis(lat, box["y0"], box["dy"], box["ny"])

    def corner(name: str, di: int, dj: int) -> Column:
        weight = (wi if di else 1 - wi) * (wj if dj else 1 - wj)
        return F.struct(F.lit(name).alias("corner"), (i + di).alias("i"), (j + dj).alias("j"), weight.alias("weight"))

    four = cells.select("cell_id", F.inline(F.array(
        corner("a", 0, 0), corner("b", 0, 1), corner("c", 1, 0), corner("d", 1, 1))))
    index = nodes.select("grid_id", F.rint((F.col(lat) - box["y0"]) / box["dy"]).cast("bigint").alias("i"),
                         F.rint((F.col(lon) - box["x0"]) / box["dx"]).cast("bigint").alias("j"))
    return four.join(index, ["i", "j"]).select("cell_id", "corner", "grid_id", "weight")


def wide_mapping(mapping: DataFrame, nearest: DataFrame) -> DataFrame:
    """One row per cell: nearest node, ``grid_id_a…d``, ``weight_a…d``."""
    cols = [F.max(F.when(F.col("corner") == c, F.col(v))).alias(f"{v}_{c}") for v in ("grid_id", "weight") for c in CORNERS]
    return nearest.join(mapping.groupBy("cell_id").agg(*cols), "cell_id")


def interpolate(mapping: DataFrame, values: DataFrame, fields: list[str]) -> DataFrame:
    """(cell_id, fields…): weights renormalised over the nodes that have a value."""
    joined = mapping.select("cell_id", "grid_id", "weight").join(values.select("grid_id", *fields), "grid_id", "left")

    def mean(f: str) -> Column:
        v = F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
        w = F.col("weight").cast("double")
        return safe_ratio(F.sum(w * v), F.sum(F.when(v.isNotNull(), w)))

    return joined.groupBy("cell_id").agg(*[mean(f).alias(f) for f in fields])


def grid_fingerprint(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row with a SHA-256 text that changes with the cells or the node positions.

    Row hashes (60 bits of MD5, positions in steps of 1e-7 degrees) are combined without order (xor and count), so no list is
    ever gathered, and any SQL engine can compute the same text."""
    def row(*cols: Column) -> Column:
        text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols])
        return F.bit_xor(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"))

    def step(c: str) -> Column:
        return F.round(F.col(c) * 10_000_000).cast("bigint")

    c = cells.agg(row(F.col("cell_id")).alias("hc"), F.count(F.lit(1)).alias("nc"))
    n = nodes.agg(row(F.col("grid_id"), step("lon"), step("lat")).alias("hn"), F.count(F.lit(1)).alias("nn"))
    return attach(c, n).select(F.sha2(F.concat_ws("|", "hc", "nc", "hn", "nn"), 256).alias("fingerprint"))


# --- exposure --------------------------------------------------------------------------------

def available_days(daily: DataFrame, today: Column, day: str = "valid_date") -> DataFrame:
    """Rows of days not before the reference local day."""
    return daily.filter(F.col(day) >= today)


def horizon(daily: DataFrame, field: str, reducer: str, date: Column | None = None, today: Column | None = None) -> DataFrame:
    """(grid_id, val): one day's value per node, or its minimum / maximum over the days."""
    if date is not None:
        return daily.filter(F.col("valid_date") == date).select("grid_id", F.col(field).cast("double").alias("val"))
    days = daily if today is None else available_days(daily, today)
    fn = {"min": F.min, "max": F.max}[reducer]
    return days.groupBy("grid_id").agg(fn(F.col(field).cast("double")).alias("val"))


def exposed_cells(mapping: DataFrame, node_values: DataFrame, core: DataFrame, operator: str, threshold: float,
                  measure: str = "pop_total") -> DataFrame:
    """(cell_id, val): people of the cells whose interpolated value passes the threshold."""
    v = interpolate(mapping, node_values, ["val"])
    test = {">=": F.col("val") >= threshold, "<=": F.col("val") <= threshold}[operator]
    hit = v.filter(F.col("val").isNotNull() & ~F.isnan("val") & test).select("cell_id")
    return hit.join(core.select("cell_id", F.col(measure).cast("double").alias("val")), "cell_id")


def exposure_total(exposed: DataFrame) -> DataFrame:
    return exposed.agg(F.coalesce(to_long(F.sum("val")), F.lit(0)).alias("value"), F.count(F.lit(1)).alias("n_cells"))


def ladder_pick(cells: DataFrame, field: str, ladder: tuple[int, ...], operator: str, pop: str = "pop_total",
                floor_share: float = POP_FLOOR) -> DataFrame:
    """One row (threshold, active): the most severe band that still exposes the floor share of
    people, else the band that exposes most, else NULL and inactive. All bands in one pass."""
    x = F.col(field)
    hit = {">=": lambda b: x >= b, "<=": lambda b: x <= b}[operator]
    sums = [F.coalesce(F.sum(F.when(hit(b), F.col(pop))), F.lit(0)).alias(f"b{i}") for i, b in enumerate(ladder)]
    one = cells.agg(F.coalesce(F.sum(pop), F.lit(0)).alias("people"), *sums)
    severity = {">=": 1, "<=": -1}[operator]
    bands = F.array(*[F.struct(F.col(f"b{i}").alias("n"), F.lit(-i).alias("order"), F.lit(b).alias("band"))
                      for i, b in enumerate(ladder)])
    enough = F.filter(bands, lambda b: (b["n"] >= F.col("people") * floor_share) & (b["n"] > 0))
    worst = F.array_max(F.transform(enough, lambda b: b["band"] * severity)) * severity
    most = F.array_max(bands)
    out = one.select(F.when(F.size(enough) > 0, worst).when(most["n"] > 0, most["band"]).alias("threshold"))
    return out.withColumn("active", F.col("threshold").isNotNull())


def build_products(heat: DataFrame, cold: DataFrame, air_ok: bool) -> DataFrame:
    """(product, source, field, reducer, operator, threshold, active): three questions, the
    weather thresholds fitted to the run."""
    def row(name: str, pick: DataFrame | None, active: bool | None) -> DataFrame:
        source, field, reducer, op, default = PRODUCTS[name]
        base = heat.sparkSession.range(1).select(F.lit(default).alias("threshold"), F.lit(active).cast("boolean").alias("active")) if pick is None else pick
        return base.select(F.lit(name).alias("product"), F.lit(source).alias("source"), F.lit(field).alias("field"),
                           F.lit(reducer).alias("reducer"), F.lit(op).alias("operator"),
                           F.coalesce("threshold", F.lit(default)).alias("threshold"), F.coalesce("active", F.lit(False)).alias("active"))

    return row("heat", heat, None).unionByName(row("cold", cold, None)).unionByName(row("air_poor", None, air_ok))


def active_products(products: DataFrame, overrides: dict[str, float] | None = None) -> DataFrame:
    """Active products with the threshold in force: the user's override, else the automatic one."""
    mine = F.lit(None).cast("double")
    for name, value in (overrides or {}).items():
        mine = F.when(F.col("product") == name, F.lit(float(value))).otherwise(mine)
    return products.filter("active").withColumn("effective", F.coalesce(mine, F.col("threshold").cast("double")))


def point_forecast(nearest: DataFrame, daily: DataFrame, cells: DataFrame, today: Column) -> DataFrame:
    """Daily rows of the nearest node for each requested cell, from the reference day on."""
    wanted = nearest.join(cells.select("cell_id").distinct(), "cell_id", "left_semi")
    return wanted.join(available_days(daily, today), "grid_id").drop("grid_id")


