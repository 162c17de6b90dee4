"""The polling loops as Structured Streaming jobs. Each reuses a batch operator, runs with any
trigger, and keeps its state and results in folders all executors can reach."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import LOCAL_ZONE, expected_steps
from ..session import cut_lineage, scratch_path
from ..sources.cube import latest_values, write_cube
from ..sources.tables import delete_folder, load_optional


def file_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files appearing in a folder."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def run_available(stream: DataFrame, out: str, checkpoint: str | None = None) -> DataFrame:
    """Append a stream's results to a Parquet folder until the available input is used up."""
    spark = stream.sparkSession
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint or f"{out}-state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    q = (stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def daily_extremes(stream: DataFrame, key: str, value: str, ts: str = "ts", lateness: str = "2 hours", interval_hours: int = 1,
                   zone: str = LOCAL_ZONE) -> DataFrame:
    """(key, day, vmin, vmax) once a local day can no longer change, complete days only.

    Completeness needs the distinct UTC steps of the day, at most 25 per key."""
    local = stream.withColumn("_local", F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)).withWatermark("_local", lateness)
    agg = local.groupBy(F.window("_local", "1 day"), key).agg(
        F.min(value).alias("vmin"), F.max(value).alias("vmax"),
        F.size(F.collect_set(F.date_trunc("hour", F.col(ts).cast("timestamp")))).alias("_n"))
    day = F.to_date("window.start")
    return agg.filter(F.col("_n") >= expected_steps(day, interval_hours, zone)).select(key, day.alias("day"), "vmin", "vmax")


def sliding_mean(stream: DataFrame, key: str, value: str, ts: str = "ts", lateness: str = "2 hours", hours: int = 24) -> DataFrame:
    """(key, at, mean): mean of the last 24 hourly means, only where all 24 hours are present.
    ``at`` is the start of the newest hour."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    hourly = timed.groupBy(F.window("_ts", "1 hour"), key).agg(F.avg(value).alias("_mean"))
    wide = hourly.groupBy(F.window("window", f"{hours} hours", "1 hour"), key).agg(F.avg("_mean").alias("mean"), F.count(F.lit(1)).alias("_n"))
    return wide.filter(F.col("_n") == hours).select(key, (F.col("window.end") - F.expr("interval 1 hour")).alias("at"), "mean")


def unique_messages(stream: DataFrame, key: str = "id", ts: str = "ts", lateness: str = "1 day") -> DataFrame:
    """The first occurrence of each message id; repeats inside the lateness are dropped."""
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness).dropDuplicatesWithinWatermark([key])


class Snapshot:
    """A table that each batch replaces as a whole: versions are written side by side, and a
    reader takes the newest complete one, so a failed or empty batch leaves the last one.

    A version may also hold several named tables (`part`, then `finish`), which appear together.
    Old versions are dropped by `prune`; a reader has to be done before ``KEEP`` newer ones are there."""

    KEEP = 4

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, version: int, name: str = "") -> str:
        return f"{self.folder}/version={version:012d}" + (f"/{name}" if name else "")

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(self._path(batch))
        self.finish(batch)

    def part(self, df: DataFrame, version: int, name: str) -> DataFrame:
        """Write one table of a version that is not visible yet, and read it back."""
        df.write.mode("overwrite").parquet(self._path(version, name))
        return self.spark.read.schema(df.schema).parquet(self._path(version, name))

    def finish(self, version: int) -> None:
        done = self.spark.createDataFrame([(version,)], "version long")
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}-done/version={version:012d}")

    def _versions(self) -> list[int]:
        done = load_optional(self.spark, f"{self.folder}-done/*")  # one row per version kept
        return [] if done is None else sorted(r["version"] for r in done.collect())

    def latest(self) -> int | None:
        return max(self._versions(), default=None)

    def read(self, name: str = "") -> DataFrame | None:
        v = self.latest()
        return None if v is None else self.spark.read.parquet(self._path(v, name))

    def prune(self, keep: int = KEEP) -> None:
        """Drop all but the newest versions, their marks first, so no mark ever stands for missing rows."""
        for v in self._versions()[:-keep]:
            delete_folder(self.spark, f"{self.folder}-done/version={v:012d}")
            delete_folder(self.spark, self._path(v))


def snapshot_refresh(stream: DataFrame, overlay: Callable[[DataFrame], DataFrame], target: Snapshot, checkpoint: str) -> None:
    """Every non-empty batch of messages becomes the new overlay."""
    def handle(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            target.write(overlay(batch), number)
            target.prune()

    run_batches(stream, handle, checkpoint)


def run_pointers(stream: DataFrame, target: Snapshot, checkpoint: str) -> None:
    """Newest run per source: ``stream(source, run, …)``. A batch with only older runs of a
    source leaves its pointer; sources move independently. Replaying a batch is harmless."""
    def handle(batch: DataFrame, number: int) -> None:
        others = [c for c in batch.columns if c not in ("source", "run")]
        rows = batch.select("source", F.struct("run", *others).alias("r"))
        before = target.read()
        if before is not None:
            rows = rows.unionByName(before.select("source", F.struct("run", *others).alias("r")))
        target.write(cut_lineage(rows.groupBy("source").agg(F.max("r").alias("r")).select("source", "r.*")), number)
        target.prune()

    run_batches(stream, handle, checkpoint)


def correct_days(stream: DataFrame, cube_path: str, checkpoint: str, delivery: str = "delivery") -> None:
    """Late or corrected daily values: the touched years are merged with what is there, the
    newer value of a pixel and day winning, and only those years are rewritten.

    Of several corrections in one batch the one with the newest ``delivery`` (a column of the
    stream, not of the cube) wins; without that column, the one with the largest values."""
    keys = ["year", "date", "iy", "ix"]

    def handle(batch: DataFrame, _number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        dated = batch if delivery in batch.columns else batch.withColumn(delivery, F.lit(0))
        batch = cut_lineage(latest_values(dated, delivery))
        now = load_optional(spark, cube_path)
        merged = batch
        if now is not None:
            old = now.join(F.broadcast(batch.select("year").distinct()), "year", "left_semi").join(batch.select(*keys), keys, "left_anti")
            merged = old.select(*batch.columns).unionByName(batch)
        write_cube(cut_lineage(merged), cube_path)

    run_batches(stream, handle, checkpoint)


def live_exposure(stream: DataFrame, core: DataFrame, target: Snapshot, checkpoint: str, measure: str = "pop_total", at: str = "at") -> None:
    """People by source and level under the newest overlay: a later row (by ``at``) of a cell and
    source replaces the earlier one, whichever batch it comes in; totals join the static census cells."""
    overlay = Snapshot(target.spark, f"{target.folder}-overlay")
    level = ["level_rank", "level_code", "level_name"]

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.select("cell_id", "source", F.struct(at, *level).alias("r"))
        before = overlay.read()
        if before is not None:
            rows = rows.unionByName(before.select("cell_id", "source", F.struct(at, *level).alias("r")))
        now = cut_lineage(rows.groupBy("cell_id", "source").agg(F.max("r").alias("r")).select("cell_id", "source", "r.*"))
        overlay.write(now, number)
        totals = now.join(core.select("cell_id", measure), "cell_id").groupBy("source", *level).agg(
            F.sum(measure).cast("bigint").alias("pop"), F.count(F.lit(1)).alias("n_cells"))
        target.write(totals, number)
        overlay.prune()
        target.prune()

    run_batches(stream, handle, checkpoint)


def new_folders(spark: SparkSession, label: str) -> tuple[str, str]:
    """A fresh (output, state) pair below the shared folder."""
    base = scratch_path(spark, label)
    return f"{base}/out", f"{base}/state"
