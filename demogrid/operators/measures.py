"""Population-weighted statistics of a variable, by area, and the registry's own statistics."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import attach, has_data, safe_ratio
from ..model import Question, Registry
from .quantiles import interpolated_quantiles, weighted_quantiles
from .questions import KEY, Atlas, selection

N_BINS = 120


def numeric_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """(variable, min, max, p02, p50, p98, nulls) of many numeric columns together.

    Exact percentiles with linear interpolation. NaN counts as missing and is excluded."""
    long = df.select(*[F.when(has_data(df, n), F.col(n)).cast("double").alias(n) for n in names]) \
        .unpivot([], names, "variable", "x")
    base = long.groupBy("variable").agg(F.count_if(F.col("x").isNull()).alias("nulls"))
    qs = interpolated_quantiles(long, "x", [0.0, 0.02, 0.5, 0.98, 1.0], ["variable"])
    wide = qs.groupBy("variable").agg(*[
        F.max(F.when(F.col("q") == q, F.col("value"))).alias(c)
        for q, c in ((0.0, "min"), (0.02, "p02"), (0.5, "p50"), (0.98, "p98"), (1.0, "max"))])
    return base.join(wide, "variable", "left").select(
        "variable", "min", "max", "p02", "p50", "p98", "nulls")


def rounded_stats(stats: DataFrame, decimals: int = 3) -> DataFrame:
    return stats.withColumns({c: F.bround(c, decimals) for c in ("min", "max", "p02", "p50", "p98")})


def category_counts(df: DataFrame, names: list[str], limit: int = 200) -> DataFrame:
    """(variable, value, n, pos): the most frequent values of many categorical columns."""
    long = (df.select(*[F.col(n).cast("string").alias(n) for n in names])
            .unpivot([], names, "variable", "value").filter(F.col("value").isNotNull()))
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("variable").orderBy(F.desc("n"), "value")
    return counts.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)


def national_totals(core: DataFrame, measures: list[str]) -> DataFrame:
    return core.agg(*[F.sum(m).cast("bigint").alias(m) for m in measures])


def label_pairs(env: DataFrame, key: str = "county_mn", label: str = "county_name") -> DataFrame:
    return env.filter(F.col(key).isNotNull()).select(key, label).distinct()


def label_map(pairs: DataFrame, key: str, label: str) -> DataFrame:
    """One row holding the key -> label map; the keys are administrative units, a short list."""
    return pairs.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, label)))).alias("labels"))


def analysable(registry: Registry, env_counts: DataFrame, limit: int = 40) -> DataFrame:
    """Variables a chart can show: numeric ones, and categories with at most ``limit`` values."""
    spark = env_counts.sparkSession
    known = spark.createDataFrame([(v.id, v.dtype) for v in registry.variables], "variable string, dtype string")
    n = env_counts.groupBy("variable").agg(F.count(F.lit(1)).alias("n_values"))
    return (known.join(F.broadcast(n), "variable", "left")
            .filter((F.col("dtype") != "cat") | (F.col("n_values") <= limit))
            .select("variable", "dtype"))


def default_range(registry: Registry, stats: DataFrame) -> DataFrame:
    """(variable, lo, hi): the declared domain of a filter, else its 2nd and 98th percentiles."""
    declared = [(v.id, *(map(float, v.filter_range) if v.filter_range else (None, None))) for v in registry.variables
                if v.dtype != "cat" and "filter" in v.roles]
    d = stats.sparkSession.createDataFrame(declared, "variable string, dlo double, dhi double")
    return stats.join(F.broadcast(d), "variable").select(
        "variable", F.coalesce("dlo", "p02").alias("lo"), F.coalesce("dhi", "p98").alias("hi"))


def histogram_spec(stats: DataFrame) -> DataFrame:
    """(variable, lo, hi, bw) for 120 bins: p02..p98, else min..max, else one unit wide."""
    lo = F.coalesce("p02", "min", F.lit(0.0))
    hi = F.coalesce("p98", "max", F.lit(1.0))
    lo2 = F.when(hi > lo, lo).otherwise(F.coalesce("min", F.lit(0.0)))
    hi2 = F.when(hi > lo, hi).otherwise(F.coalesce(F.col("max"), lo2 + 1))
    return (stats.select("variable", lo2.alias("lo"), hi2.alias("hi"))
            .withColumn("hi", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1))
            .withColumn("bw", (F.col("hi") - F.col("lo")) / N_BINS))


class HistSpec(NamedTuple):
    """A published histogram range, read once and used as constants."""

    lo: float
    hi: float
    bw: float


def read_spec(spec: DataFrame) -> HistSpec:
    row = spec.select("lo", "hi", "bw").first()
    return HistSpec(row["lo"], row["hi"], row["bw"])


def _with_spec(df: DataFrame, spec: HistSpec | DataFrame) -> DataFrame:
    if isinstance(spec, HistSpec):
        return df.withColumns({k: F.lit(v) for k, v in spec._asdict().items()})
    return attach(df, spec.select("lo", "hi", "bw"))


def analysed_cells(atlas: Atlas, var: str, q: Question) -> DataFrame:
    """Selected cells with data for ``var``: (cell_id, county_mn, x, w)."""
    cells = selection(atlas, q, (var, "county_mn"), [lambda df: has_data(df, var)])
    dtype = "double" if atlas.registry[var].dtype != "cat" else "string"
    return cells.select(KEY, F.col("county_mn").alias("area"), F.col(var).cast(dtype).alias("x"),
                        F.col(q.measure).cast("double").alias("w"))


def weighted_histogram(cells: DataFrame, spec: HistSpec | DataFrame, by: list[str] = ()) -> DataFrame:
    """(by…, bin, pop): fine bins, tails clamped into the first and last. ``spec`` is one row."""
    raw = F.floor((F.col("x") - F.col("lo")) / F.col("bw"))
    bin_ = F.least(F.greatest(raw, F.lit(0)), F.lit(N_BINS - 1)).cast("int")
    return (_with_spec(cells, spec)
            .groupBy(*by, bin_.alias("bin")).agg(F.sum("w").alias("pop")))


def weighted_mean(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by…, wmean, pop)."""
    return cells.groupBy(*by).agg(
        safe_ratio(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("wmean"),
        F.sum("w").alias("pop"))


def histogram_quantiles(hist: DataFrame, spec: HistSpec | DataFrame, qs: list[float], by: list[str] = ()) -> DataFrame:
    """(by…, q, value) by linear interpolation on the cumulative histogram.

    At most 120 rows per area reach the window, whatever the number of cells."""
    w = Window.partitionBy(*by).orderBy("bin")
    whole = Window.partitionBy(*by)
    cum = (hist.withColumn("cum", F.sum("pop").over(w))
           .withColumn("total", F.sum("pop").over(whole)).filter(F.col("total") > 0)
           .withColumn("q", F.explode(F.array(*[F.lit(float(x)) for x in qs])))
           .withColumn("target", F.col("total") * F.col("q")))
    reached = F.when(F.col("cum") >= F.col("target"), F.struct("bin", "cum", "pop", "target"))
    first = cum.groupBy(*by, "q").agg(F.min(reached).alias("h"))
    before = F.col("h.cum") - F.col("h.pop")
    frac = F.when(F.col("h.pop") > 0, (F.col("h.target") - before) / F.col("h.pop")).otherwise(0.0)
    # where rounding leaves the last sum below the target, the upper end of the histogram is the answer
    return (_with_spec(first, spec)
            .select(*by, "q", (F.col("lo") + F.coalesce(F.col("h.bin") + frac, F.lit(float(N_BINS))) * F.col("bw")).alias("value")))


def exact_quantiles(cells: DataFrame, qs: list[float], by: list[str] = ()) -> DataFrame:
    """(by…, q, value): the value below which a share q of the people live, without bins."""
    return weighted_quantiles(cells, "x", "w", qs, by)


def display_bins(hist: DataFrame, spec: HistSpec | DataFrame, n: int = 40, by: list[str] = ()) -> DataFrame:
    """(by…, display_bin, centre, pop, pct): coarser bins for drawing, and percent of the area."""
    per = max(1, round(N_BINS / n))
    g = (F.col("bin") / per).cast("int")
    coarse = hist.groupBy(*by, g.alias("display_bin")).agg(F.sum("pop").alias("pop"))
    whole = Window.partitionBy(*by)
    return (_with_spec(coarse, spec)
            .select(*by, "display_bin",
                    (F.col("lo") + (F.col("display_bin") * per + per / 2) * F.col("bw")).alias("centre"),
                    "pop", (100 * safe_ratio(F.col("pop"), F.sum("pop").over(whole))).alias("pct")))


def category_distribution(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by…, cat, pop, cells)."""
    return cells.groupBy(*by, F.col("x").alias("cat")).agg(
        F.sum("w").alias("pop"), F.count(F.lit(1)).alias("cells"))


def top_categories(dist: DataFrame) -> DataFrame:
    """(cat, pop, pos, share, cum_share) heaviest first: the top share and running totals."""
    whole = Window.partitionBy()
    order = Window.orderBy(F.desc("pop"), "cat")
    ranked = dist.withColumn("pos", F.row_number().over(order)).withColumn("cum", F.sum("pop").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.withColumn("total", F.sum("pop").over(whole)).select(
        "cat", "pop", "pos", safe_ratio(F.col("pop"), F.col("total")).alias("share"),
        safe_ratio(F.col("cum"), F.col("total")).alias("cum_share"))


def category_comparison(dist: DataFrame, area_a: str, area_b: str, area: str = "area") -> DataFrame:
    """Share of each category of A beside its share in B, 0 where B lacks it."""
    pa, pb = (F.sum(F.when(F.col(area) == x, F.col("pop"))) for x in (area_a, area_b))
    both = dist.filter(F.col(area).isin(area_a, area_b))
    per_cat = both.groupBy("cat").agg(pa.alias("pa"), pb.alias("pb")).filter(F.col("pa").isNotNull())
    totals = both.agg(pa.alias("ta"), pb.alias("tb"))
    return attach(per_cat, totals).select(
        "cat", F.coalesce(safe_ratio(F.col("pa"), F.col("ta")), F.lit(0.0)).alias("share_a"),
        safe_ratio(F.coalesce(F.col("pb"), F.lit(0.0)), F.col("tb")).alias("share_b"))


def ranking(cells: DataFrame, by: str = "area") -> DataFrame:
    """(area, wmean, pop, pos, rel): weighted mean per area, positive weight only, best first.

    The window runs over one row per area."""
    means = weighted_mean(cells.filter(F.col(by).isNotNull()), [by]).filter(F.col("pop") > 0)
    order, whole = Window.orderBy(F.desc("wmean"), by), Window.partitionBy()
    return (means.withColumn("pos", F.row_number().over(order))
            .withColumn("rel", safe_ratio(F.abs("wmean"), F.max(F.abs("wmean")).over(whole))))


def verdict(a: Column, b: Column) -> Column:
    """``about equal`` within 2 % of A, else ``higher`` or ``lower``."""
    near = F.abs(a - b) < F.greatest(F.abs(a), F.lit(1e-9)) * 0.02
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("string"))
            .when(near, "about equal").when(a > b, "higher").otherwise("lower"))


def compare_areas(cells: DataFrame, spec: HistSpec | DataFrame, area_a: str, area_b: str,
                  area: str = "area") -> DataFrame:
    """One row: p10, p50, p90 and mean of two areas side by side, and the verdict on medians."""
    cells = cells.filter(F.col(area).isin(area_a, area_b))
    hist = weighted_histogram(cells, spec, [area])
    names = {0.1: "p10", 0.5: "p50", 0.9: "p90"}
    name = F.lit("wmean")
    for q, label in names.items():
        name = F.when(F.col("q") == q, label).otherwise(name)
    figures = (histogram_quantiles(hist, spec, list(names), [area]).select(area, name.alias("name"), "value")
               .unionByName(weighted_mean(cells, [area]).select(area, F.lit("wmean").alias("name"), F.col("wmean").alias("value"))))
    both = figures.agg(*[F.max(F.when((F.col(area) == x) & (F.col("name") == n), F.col("value"))).alias(f"{n}_{tag}")
                         for x, tag in ((area_a, "a"), (area_b, "b")) for n in (*names.values(), "wmean")])
    return both.withColumn("verdict", verdict(F.col("p50_a"), F.col("p50_b")))


def pinned_last_order(counts: DataFrame, pinned: tuple[str, ...]) -> DataFrame:
    """Positions of categories: by frequency, the pinned ones always at the end."""
    last = F.col("value").isin(*pinned) if pinned else F.lit(False)
    w = Window.partitionBy("variable").orderBy(last, F.desc("n"), "value")
    return counts.withColumn("pos", F.row_number().over(w))


def consistency(df: DataFrame, checks: dict[str, tuple[list[str], str]]) -> DataFrame:
    """(check, violations): rows whose parts do not add up to the whole, in one pass."""
    aggs = [F.count_if(sum((F.col(p) for p in parts), F.lit(0)) != F.col(whole)).alias(f"_{i}")
            for i, (parts, whole) in enumerate(checks.values())]
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"_{i}").alias("violations"))
                     for i, k in enumerate(checks)])
    return df.agg(*aggs).select(F.inline(rows))


def coverage(df: DataFrame, names: list[str]) -> DataFrame:
    """(variable, coverage, min, max): share of rows with a value; range of numeric columns."""
    aggs = []
    for n in names:
        numeric = df.schema[n].dataType.simpleString() != "string"
        ok = has_data(df, n)
        aggs += [F.avg(F.when(ok, 1.0).otherwise(0.0)).alias(f"{n}__c")]
        clean = F.when(ok, F.col(n)).cast("double") if numeric else F.lit(None).cast("double")
        aggs += [F.min(clean).alias(f"{n}__lo"), F.max(clean).alias(f"{n}__hi")]
    rows = F.array(*[F.struct(F.lit(n).alias("variable"), F.col(f"{n}__c").alias("coverage"),
                              F.col(f"{n}__lo").alias("min"), F.col(f"{n}__hi").alias("max"))
                     for n in names])
    return df.agg(*aggs).select(F.inline(rows))


def value_profile(df: DataFrame, name: str) -> DataFrame:
    """One row: min, median and max of a column, missing values excluded."""
    return numeric_stats(df, [name]).select("min", F.col("p50").alias("median"), "max")


def density_class(val: Column) -> Column:
    """Shade 0..255 on a log scale from 1 to 10⁴ people; -1 for a matched but empty cell."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log10(val) / 4))
    return F.when(val > 0, F.floor(t * 255).cast("int")).otherwise(F.lit(-1))


def cell_bitmap(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by…, bucket, bits): the cell set as fixed-size bitmaps, mergeable across sets."""
    return (cells.withColumn("bucket", F.bitmap_bucket_number(KEY))
            .groupBy(*by, "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(KEY)).alias("bits")))


def bitmap_union(bitmaps: DataFrame, by: list[str] = ()) -> DataFrame:
    return bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_cardinality(bitmaps: DataFrame, by: list[str] = ()) -> DataFrame:
    return bitmaps.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("n_cells"))

