"""Streaming forms of the live jobs, run over all available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import warnings as N
from ..session import cut_lineage, scratch_path
from ..sources.cube import read_cube, write_cube
from ..streaming import jobs as J
from .air_weather import _ROLL, _stamp
from .base import GRID_ROWS, query
from .warnings import _BOX, _BYL, _WORST, box_edges, features, worst


def _events(t):
    schema = t.base("events").schema
    return J.file_stream(t.spark, t.sf_dir, schema, "events.parquet")


@query("st01_local_day_stream", "", """
WITH d AS (SELECT user_id % 4 AS grid_id, CAST(ts + INTERVAL 2 HOUR AS DATE) AS day, MIN(value) AS vmin, MAX(value) AS vmax, COUNT(DISTINCT date_trunc('hour', ts)) AS n FROM events GROUP BY 1, 2)
SELECT grid_id, day, vmin, vmax FROM d WHERE n >= 24 AND day + 1 <= (SELECT MAX(ts) + INTERVAL 2 HOUR - INTERVAL 2 HOUR FROM events)""")
def _(t):
    s = _events(t).select((F.col("user_id") % 4).alias("grid_id"), "ts", "value")
    out, state = J.new_folders(t.spark, "days")
    return J.run_available(J.daily_extremes(s, "grid_id", "value"), out, state)


@query("st02_sliding_mean_stream", "hourly", f"""
WITH {_ROLL} SELECT grid_id, strftime(valid_time, '%Y-%m-%d %H:%M:%S') AS at, ROUND(mean24, 8) AS mean FROM r24
WHERE mean24 IS NOT NULL AND valid_time + INTERVAL 1 HOUR <= (SELECT MAX(ts) - INTERVAL 2 HOUR FROM events)""")
def _(t):
    s = _events(t).select((F.col("user_id") % 4).alias("grid_id"), "ts", "value")
    out, state = J.new_folders(t.spark, "means")
    r = J.run_available(J.sliding_mean(s, "grid_id", "value"), out, state)
    return r.select("grid_id", _stamp("at").alias("at"), F.round("mean", 8).alias("mean"))


def _messages(t, stream):
    """The message binding, applied to an event stream."""
    n_rows = t.sql(GRID_ROWS).first()[0]
    return stream.select(
        F.col("event_id").alias("id"), F.when(F.col("event_type").isin("error", "click"), "nowcasting").otherwise("general").alias("source"),
        (F.floor("value") % 4).alias("level_rank"), "ts",
        (F.col("event_id") * 613 % 40 * 1000).alias("cx"), (F.col("event_id") * 389 % n_rows * 1000).alias("cy"))


@query("st03_warning_snapshot_refresh", "messages points", f"WITH {_BOX}, {_WORST} SELECT cell_id, source, level_rank, level_code, level_name FROM w")
def _(t):
    points = t.points
    out, state = J.new_folders(t.spark, "overlay")
    snap = J.Snapshot(t.spark, out)
    J.snapshot_refresh(_messages(t, _events(t)), lambda m: N.worst_per(
        N.cells_of_features(points, box_edges(m), features(m)), "cell_id", "source"), snap, state)
    return snap.read()


@query("st04_duplicate_message_drop", "messages", "SELECT DISTINCT CAST(FLOOR(id / 4) AS BIGINT) AS id FROM messages")
def _(t):
    s = _messages(t, _events(t)).withColumn("id", F.floor(F.col("id") / 4))
    out, state = J.new_folders(t.spark, "unique")
    return J.run_available(J.unique_messages(s).select("id"), out, state)


@query("st05_monotonic_run_pointer", "", "SELECT event_type AS source, MAX(CAST(ts AS DATE)) AS run, arg_max(event_id, ts) AS entry FROM events GROUP BY 1")
def _(t):
    s = _events(t).select(F.col("event_type").alias("source"), F.to_date("ts").alias("run"), F.col("ts").alias("at"), F.col("event_id").alias("entry"))
    out, state = J.new_folders(t.spark, "pointer")
    snap = J.Snapshot(t.spark, out)
    J.run_pointers(s, snap, state)
    return snap.read().select("source", "run", "entry")


@query("st06_late_data_for_open_year", "cube", """
SELECT CAST(year AS INT) AS year, COUNT(*) AS n, ROUND(SUM(CASE WHEN year = 2001 AND ix < 5 THEN tmin + 1 ELSE tmin END), 4) AS tmin FROM cube GROUP BY 1""")
def _(t):
    cube = t.cube
    out, state = J.new_folders(t.spark, "cube")
    write_cube(cube, out)
    late = scratch_path(t.spark, "late")
    part = cube.filter("year = 2001 AND ix < 5")
    # three batches, the job picks up after each; within the last, an outdated delivery comes with the newest one
    for batch in ([(1, 9.0)], [(2, 7.0)], [(4, 1.0), (3, 5.0)]):
        for delivery, change in batch:
            part.withColumns({"tmin": F.col("tmin") + change, "delivery": F.lit(delivery)}).write.mode("append").parquet(late)
        J.correct_days(J.file_stream(t.spark, late, cube.withColumn("delivery", F.lit(1)).schema), out, state)
    return read_cube(t.spark, out).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("tmin"), 4).alias("tmin"))


@query("st07_stream_static_enrichment", "messages points core", f"WITH {_BOX}, {_WORST}, {_BYL} SELECT * FROM bl")
def _(t):
    live = scratch_path(t.spark, "live")
    overlay = cut_lineage(worst(t))
    wrong = overlay.withColumns({"level_rank": (3 - F.col("level_rank")).cast(overlay.schema["level_rank"].dataType), "level_code": F.lit("XX")})
    out, state = J.new_folders(t.spark, "exposure")
    snap = J.Snapshot(t.spark, out)
    # an early overlay of other levels, the present one, and a late copy of the early one; the job picks up after each
    for df, at in ((wrong, 1), (overlay, 3), (wrong, 2)):
        df.withColumn("at", F.lit(at)).write.mode("append").parquet(live)
        J.live_exposure(J.file_stream(t.spark, live, overlay.withColumn("at", F.lit(1)).schema), t.core, snap, state)
    return snap.read()
