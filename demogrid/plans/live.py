"""The two live runs as jobs: forecasts and warnings.

Every source stands on its own: one that fails keeps its last good result and says why. Results are
versions that readers see whole (`Snapshot`), and what no version names any more is deleted."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forecast as W
from ..operators import warnings as N
from ..session import cut_lineage
from ..sources.tables import delete_folder, differences, keep_runs
from ..sources.vectors import wkt_outlines
from ..streaming.jobs import Snapshot

ENTRY = "source string, run string, ok boolean, days array<date>, path string, error string"
RUN = "source string, run string, path string"
RUNS_KEPT = 4


class SourceError(Exception):
    """A source has nothing that may be published."""


# --- forecast --------------------------------------------------------------------------------

@dataclass(frozen=True)
class ForecastSource:
    """``fetch`` gives (run, steps) and may raise; runs are sortable texts such as 2026010700, fit for a path.
    ``reduce`` makes daily rows (grid_id, valid_date, …); ``checks`` are aggregates that must not be true of them."""

    name: str
    fetch: Callable[[], tuple[str, DataFrame]]
    reduce: Callable[[DataFrame], DataFrame]
    checks: dict[str, Column] = field(default_factory=dict)


def weather_source(fetch: Callable[[], tuple[str, DataFrame]], interval_hours: int = 3, only_complete: bool = True) -> ForecastSource:
    return ForecastSource("weather", fetch, lambda s: W.weather_daily(s, interval_hours, only_complete),
                          {"minimum above maximum": F.count_if(F.col("tmin") > F.col("tmax")) > 0})


def air_source(fetch: Callable[[], tuple[str, DataFrame]], only_complete: bool = True) -> ForecastSource:
    """Pollutant series with gaps: missing hours become rows, so means of 24 rows are means of 24 hours."""
    return ForecastSource("air", fetch, lambda s: W.air_daily(W.densify(s, ["grid_id", "pollutant"]), only_complete),
                          {"rank out of range": F.count_if(~F.col("aqi_rank").between(-1, 5)) > 0})


def published_mapping(spark: SparkSession, folder: str, cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node mapping of this grid, made once: its path follows the fingerprint of cells and nodes."""
    print_ = W.grid_fingerprint(cells, nodes).first()["fingerprint"]
    kept = Snapshot(spark, f"{folder}/mapping-{print_}")
    if kept.latest() is None:
        kept.write(W.bilinear_mapping(cells, nodes, W.nearest_node(cells, nodes)), 0)
    return kept.read()


def _publish(spark: SparkSession, folder: str, source: ForecastSource, old: dict | None, runs: dict[str, str]) -> dict:
    run, steps = source.fetch()
    if old and old["run"] and run < old["run"]:
        raise SourceError(f"run {run} is older than the published {old['run']}")
    daily = cut_lineage(source.reduce(steps))
    bad = daily.agg((F.count(F.lit(1)) == 0).alias("no rows"), *[c.alias(n) for n, c in source.checks.items()]).first().asDict()
    if any(bad.values()):
        raise SourceError(f"run {run}: " + ", ".join(n for n, hit in bad.items() if hit))
    path = f"{folder}/data/{source.name}_{run}"
    if run in runs:
        if not differences(daily, spark.read.parquet(path).select(*daily.columns)).isEmpty():
            raise SourceError(f"run {run} is published with other contents")
    else:
        delete_folder(spark, path)  # what lies there belongs to a write that was cut off
        daily.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    days = sorted(r["valid_date"] for r in daily.select("valid_date").distinct().collect())  # the horizon, a few days
    return {"source": source.name, "run": run, "ok": True, "days": days, "path": path, "error": None}


def forecast_products(spark: SparkSession, entries: dict[str, dict], mapping: DataFrame, core: DataFrame) -> DataFrame:
    """The three questions of the run: weather thresholds fitted to the people under its extremes; without a good
    weather run both are inactive at their defaults. Air is active while its source is good."""
    weather, air = entries.get("weather"), entries.get("air")
    if weather and weather["ok"]:
        nodes = spark.read.parquet(weather["path"]).groupBy("grid_id").agg(F.max("tmax").alias("tmax"), F.min("tmin").alias("tmin"))
        cells = W.interpolate(mapping, nodes, ["tmax", "tmin"]).join(core.select("cell_id", "pop_total"), "cell_id")
        heat, cold = W.ladder_pick(cells, "tmax", W.HEAT_LADDER, ">="), W.ladder_pick(cells, "tmin", W.COLD_LADDER, "<=")
    else:
        none = spark.range(1).select(F.lit(None).cast("int").alias("threshold"), F.lit(False).alias("active"))
        heat = cold = none
    return W.build_products(heat, cold, bool(air and air["ok"]))


def refresh_forecast(target: Snapshot, sources: list[ForecastSource], mapping: DataFrame, core: DataFrame, today: dt.date,
                     keep: int = RUNS_KEPT) -> DataFrame:
    """One round of the forecast job; returns the entries (``ENTRY``) now published.

    A source is fetched, reduced to days, checked, written once under its run and then named by a new version of the
    tables ``entries``, ``runs`` and ``products``, without waiting for the others. If anything of that fails, its entry
    keeps the last good run and the days from ``today`` on, not ok, with the reason. A run older than the published one
    is refused, the same run must have the same rows. ``keep`` runs per source stay, the present and the one before in any case."""
    spark = target.spark
    last = target.read("entries")
    entries = {} if last is None else {r["source"]: r.asDict() for r in last.collect()}
    runs = [] if last is None else [tuple(r) for r in target.read("runs").select("source", "run", "path").collect()]
    for source in sources:
        name = source.name
        old = entries.get(name)
        try:
            entries[name] = _publish(spark, target.folder, source, old, {r: p for s, r, p in runs if s == name})
        except Exception as e:  # any fault of a source is its own, and is reported in its entry
            base = old or {"source": name, "run": None, "days": [], "path": None}
            entries[name] = {**base, "ok": False, "days": [d for d in base["days"] if d >= today], "error": f"{type(e).__name__}: {e}"[:500]}
        new = entries[name]
        if new["ok"] and (name, new["run"], new["path"]) not in runs:
            runs.append((name, new["run"], new["path"]))
        named = [e["path"] for e in (old, new) if e and e["path"]]
        table = spark.createDataFrame(runs, RUN)
        stay = keep_runs(table, F.col("path").isin(named) if named else F.lit(False), keep).collect()
        gone = {p for _, _, p in runs} - {r["path"] for r in stay}
        runs = [tuple(r) for r in stay]

        version = (target.latest() or 0) + 1
        rows = [tuple(entries[s][c] for c in ("source", "run", "ok", "days", "path", "error")) for s in sorted(entries)]
        target.part(spark.createDataFrame(rows, ENTRY).coalesce(1), version, "entries")
        target.part(spark.createDataFrame(runs, RUN).coalesce(1), version, "runs")
        target.part(forecast_products(spark, entries, mapping, core), version, "products")
        target.finish(version)
        for path in sorted(gone):
            delete_folder(spark, path)
        target.prune()
    return target.read("entries")


# --- warnings --------------------------------------------------------------------------------

Feed = Callable[[], tuple[DataFrame, DataFrame]]


def refresh_warnings(target: Snapshot, feeds: dict[str, Feed], points: DataFrame, core: DataFrame, srid: str | None = None,
                     measure: str = "pop_total") -> bool:
    """One round of the warnings job; False if every feed failed, and then nothing changes.

    A feed gives (features: group_id, level_rank, wkt, …; messages: group_id, level_rank, …) and may raise; the round goes
    on with the others and marks it. A new version holds ``cells`` (worst level per cell and source), ``messages`` (with
    ``affected_pop``), ``levels``, ``sources`` (ok, total_affected, n_messages, error) and ``combined``.
    Features without geometry count as messages only; repeated geometries of a message count once.
    ``srid`` names a feature column with the coordinate system of its text."""
    spark = target.spark
    features, messages, state = [], [], []
    columns = ["group_id", "level_rank", "wkt", *([srid] if srid else [])]
    for source, read in feeds.items():
        try:
            f, m = read()
            kept = (cut_lineage(f.filter(F.col("wkt").isNotNull()).select(F.lit(source).alias("source"), *columns)),
                    cut_lineage(m.withColumn("source", F.lit(source))))
        except Exception as e:  # a feed that cannot be had or read must not stop the other
            state.append((source, False, f"{type(e).__name__}: {e}"[:500]))
            continue
        features.append(kept[0])
        messages.append(kept[1])
        state.append((source, True, None))
    if not messages:
        return False

    all_features, all_messages = features[0], messages[0]
    for f, m in zip(features[1:], messages[1:]):
        all_features, all_messages = all_features.unionByName(f), all_messages.unionByName(m, allowMissingColumns=True)
    all_features = all_features.withColumn("feature_id", F.xxhash64("source", "group_id", "level_rank", "wkt")).dropDuplicates(["feature_id"])
    edges = cut_lineage(wkt_outlines(all_features, "wkt", ["feature_id"], srid=srid))  # large and small polygons are told apart, so read twice
    pairs = cut_lineage(N.cells_of_features(points, edges, all_features.select("feature_id", "source", "group_id", "level_rank")))

    version = (target.latest() or 0) + 1
    cells = target.part(N.worst_per(pairs, "cell_id", "source"), version, "cells")
    levels = target.part(N.people_by_level(cells, core, measure), version, "levels")
    people = N.people_by_message(pairs, core, measure).withColumnRenamed("pop", "affected_pop")
    told = target.part(all_messages.join(people, "group_id", "left").fillna(0, ["affected_pop"]), version, "messages")
    flags = spark.createDataFrame(state, "source string, ok boolean, error string")
    totals = N.people_by_source(levels)
    counts = told.groupBy("source").agg(F.count(F.lit(1)).alias("n_messages"))
    target.part(flags.join(totals, "source", "left").join(counts, "source", "left").fillna(0, ["total_affected", "n_messages"]), version, "sources")
    target.part(N.people_combined(cells, core, measure), version, "combined")
    target.finish(version)
    target.prune()
    return True
