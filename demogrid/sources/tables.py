"""Thematic tables at rest: census cells, column-pruned reads, views, assembly, clustered and
immutable writes, JSON rows, run retention and fallback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.projection import laea_to_lonlat
from ..functions.text import json_rows
from ..operators.cells import centroid, derive_spec, number_cells, parse_grid_id

ROW_GROUP_ROWS = 32768

# Census column -> published column.
CENSUS_COLUMNS = {
    "Populatia_totala_T": "pop_total",
    "Populatia_sex_feminin_F": "pop_f",
    "Populatia_sex_masculin_M": "pop_m",
    "Persoane_cu_varsta_mai_mica_de_15_ani_Y_LT15": "pop_0_14",
    "Persoane_cu_varsta_cuprinsa_intre_15_si_65_de_ani_Y15_64": "pop_15_64",
    "Persoane_cu_varsta_de_65_ani_si_peste_Y_GE65": "pop_65p",
    "Populatia_ocupata_EMP": "pop_ocupata",
    "Persoane_de_cetatenie_romana_NAT": "pop_cet_ro",
    "Persoane_de_alta_cetatenie_dar_al_unui_stat_membru_UE_EU_OTH": "pop_cet_ue",
    "Persoane_de_alta_cetatenie_dar_dintr_un_stat_non_UE_OTH": "pop_cet_non_ue",
    "Persoane_care_si_au_schimbat_resedinta_in_tara_CHG_IN": "pop_mutati_in_tara",
    "Persoane_care_si_au_schimbat_resedinta_in_afara_tarii_CHG_OU": "pop_mutati_strainatate",
    "Persoane_cu_resedinta_obisnuita_neschimbata_SAME": "pop_res_neschimbata",
    "TOT_P_2021": "pop_2021_eurostat",
    "TOT_P_2018": "pop_2018",
    "TOT_P_2011": "pop_2011",
    "TOT_P_2006": "pop_2006",
}


def build_cells(census: DataFrame, res: int = 1000) -> DataFrame:
    """The cell table from census rows with a ``GRD_ID``: numbering, centre coordinates, renamed
    counts (real-valued series stay FLOAT, the rest become INT)."""
    placed = parse_grid_id(census)
    cells = number_cells(placed, derive_spec(placed, res), res)
    lon, lat = laea_to_lonlat(*centroid(F.col("e"), F.col("n"), res))
    counts = []
    for src, dst in CENSUS_COLUMNS.items():
        if src in census.columns:
            real = census.schema[src].dataType.simpleString() in ("float", "double")
            counts.append(F.col(src).cast("float" if real else "int").alias(dst))
    return cells.select("cell_id", F.col("GRD_ID").alias("grid_id"), "col", "row", "e", "n", lon.alias("lon"), lat.alias("lat"), *counts)


def load_columns(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, reading only the named columns."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def register_views(spark: SparkSession, tables: dict[str, DataFrame | str]) -> None:
    """Expose tables (or Parquet paths) to SQL by name."""
    for name, source in tables.items():
        df = spark.read.parquet(source) if isinstance(source, str) else source
        df.createOrReplaceTempView(name)


def load_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder from whatever file system holds it; a missing one is fine."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def assemble(parts: list[DataFrame], key: str = "cell_id", optional: DataFrame | None = None,
             drop: tuple[str, ...] = (), types: dict[str, str] | None = None) -> DataFrame:
    """One wide table: inner joins on the key, an optional left join, dropped and narrowed columns.

    All joins share the key, so Spark shuffles each part once and keeps that partitioning."""
    wide = reduce(lambda a, b: a.join(b, key), parts)
    if optional is not None:
        wide = wide.join(optional, key, "left")
    wide = wide.drop(*drop)
    return wide.withColumns({c: F.col(c).cast(t) for c, t in (types or {}).items() if c in wide.columns})


def write_clustered(df: DataFrame, path: str, key: str = "cell_id", partitions: int | None = None) -> None:
    """Range-partitioned and sorted by key, zstd, small row groups: a key or range predicate
    then skips most row groups by their min / max."""
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    (ranged.sortWithinPartitions(key).write.mode("errorifexists").option("compression", "zstd")
     .option("parquet.block.row.count.limit", str(ROW_GROUP_ROWS)).parquet(path))


def write_json_rows(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("errorifexists").text(path)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with multiplicity) present in only one of two frames of the same columns."""
    if a.columns != b.columns:
        raise ValueError(f"columns differ: {a.columns} / {b.columns}")
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def publish_immutable(df: DataFrame, path: str) -> str:
    """Write a run once. A path that exists must already hold exactly these rows."""
    existing = load_optional(df.sparkSession, path)
    if existing is None:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        return "written"
    if not differences(df, existing.select(*df.columns)).isEmpty():
        raise ValueError(f"{path} exists with other contents")
    return "unchanged"


def keep_runs(runs: DataFrame, protected: Column, keep: int = 4, by: str = "source", run: str = "run") -> DataFrame:
    """Runs to keep per source: protected ones first, then the newest, up to a limit."""
    w = Window.partitionBy(by).orderBy(F.desc(F.coalesce(protected, F.lit(False)).cast("int")), F.desc(run))
    return runs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")


def current_entries(attempts: DataFrame, today: Column) -> DataFrame:
    """(source, run, ok, days): the newest successful run of every source.

    ``attempts(source, attempt, run, ok, days)``. A failed last attempt keeps the last good run
    but marks it not ok and drops days already past; an older run never replaces a newer one."""
    good = F.max(F.when(F.col("ok"), F.struct("run", "attempt", "days")))
    last = F.max_by("ok", "attempt")
    out = attempts.groupBy("source").agg(good.alias("g"), last.alias("ok"))
    days = F.coalesce(F.col("g.days"), F.array().cast("array<date>"))
    return out.select("source", F.col("g.run").alias("run"), "ok",
                      F.when(F.col("ok"), days).otherwise(F.filter(days, lambda d: d >= today)).alias("days"))
