"""The forecast and warnings jobs over rounds that fail, lag, repeat and are cut off."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from demogrid.plans import live as L
from demogrid.session import scratch_path
from demogrid.streaming.jobs import Snapshot

STEPS = "grid_id long, valid_time timestamp, min_k double, max_k double"
DAY = dt.date(2026, 1, 10)


@pytest.fixture(scope="module")
def core(spark):
    return spark.createDataFrame([(1, 10), (2, 30)], "cell_id long, pop_total long")


@pytest.fixture(scope="module")
def mapping(spark):
    rows = [(1, "a", 7, 1.0), (2, "a", 7, 0.5), (2, "b", 8, 0.5)]
    return spark.createDataFrame(rows, "cell_id long, corner string, grid_id long, weight double")


def steps(spark, day, low=263.15, high=310.15, days=2, nodes=(7, 8)):
    start = dt.datetime(2026, 1, day, 0)
    return spark.createDataFrame([(g, start + dt.timedelta(hours=h), low, high) for g in nodes for h in range(24 * days + 6)], STEPS)


def weather(spark, run, *args, **kw):
    return L.weather_source(lambda: (run, steps(spark, *args, **kw)), 1)


def entry(target, source="weather"):
    return target.read("entries").filter(F.col("source") == source).first()


def folders(target):
    return sorted(os.listdir(f"{target.folder}/data"))


def refresh(target, source, mapping, core, today=DAY):
    L.refresh_forecast(target, [source], mapping, core, today)
    return entry(target)


def test_a_run_is_published_with_products(spark, mapping, core):
    target = Snapshot(spark, scratch_path(spark, "fc"))
    e = refresh(target, weather(spark, "2026011000", 10), mapping, core)
    assert e.ok and e.run == "2026011000" and e.error is None and e.days == [dt.date(2026, 1, 10), dt.date(2026, 1, 11)]
    got = {r["product"]: (r.threshold, r.active) for r in target.read("products").collect()}
    assert got == {"heat": (35, True), "cold": (-10, True), "air_poor": (3, False)}  # 37 and -10 °C everywhere


def test_faults_keep_the_last_good_run(spark, mapping, core):
    target = Snapshot(spark, scratch_path(spark, "fc"))

    def broken():
        raise OSError("no answer")

    e = refresh(target, L.weather_source(broken, 1), mapping, core)
    assert (e.ok, e.run, e.days, e.path) == (False, None, [], None) and "no answer" in e.error
    good = refresh(target, weather(spark, "2026011000", 10), mapping, core)
    late = lambda: ("2026011100", steps(spark, 11).withColumn("min_k", F.raise_error(F.lit("torn file")).cast("double")))
    for fault, words in ((L.weather_source(broken, 1), "OSError"), (weather(spark, "2026010900", 9), "older"), (L.weather_source(late, 1), "torn file"),
                         (weather(spark, "2026011100", 11, low=320.0), "minimum above maximum"), (weather(spark, "2026011100", 11, days=0), "no rows"),
                         (weather(spark, "2026011000", 10, high=300.0), "other contents")):
        e = refresh(target, fault, mapping, core, dt.date(2026, 1, 11))
        assert not e.ok and words in e.error
        assert e.path == good.path and e.run == good.run and e.days == [dt.date(2026, 1, 11)]  # the past day is gone
        assert not target.read("products").filter("active").count()
    assert spark.read.parquet(good.path).count() == 4
    e = refresh(target, weather(spark, "2026011000", 10), mapping, core)  # the same run again, with the same rows
    assert e.ok and e.days == good.days and folders(target) == ["weather_2026011000"]


def test_sources_do_not_wait_for_each_other(spark, mapping, core):
    target = Snapshot(spark, scratch_path(spark, "fc"))
    hours = [dt.datetime(2026, 1, 10) + dt.timedelta(hours=h) for h in range(60)]
    series = spark.createDataFrame([(7, h, "no2", 100.0) for h in hours if h.hour != 5], "grid_id long, valid_time timestamp, pollutant string, value double")
    L.refresh_forecast(target, [L.weather_source(lambda: 1 / 0, 1), L.air_source(lambda: ("2026011000", series))], mapping, core, DAY)
    assert not entry(target).ok and "ZeroDivisionError" in entry(target).error
    air = entry(target, "air")
    assert air.ok and {r.aqi_rank for r in spark.read.parquet(air.path).collect()} == {2}
    assert {r["product"] for r in target.read("products").filter("active").collect()} == {"air_poor"}


def test_old_runs_and_versions_are_deleted(spark, mapping, core):
    target = Snapshot(spark, scratch_path(spark, "fc"))
    for day in range(10, 17):
        refresh(target, weather(spark, f"202601{day}00", day, days=1), mapping, core, dt.date(2026, 1, day))
    assert folders(target) == [f"weather_202601{d}00" for d in (13, 14, 15, 16)]
    assert target.read("runs").count() == 4 and len(os.listdir(target.folder)) == Snapshot.KEEP + 1 and target.latest() == 7


def test_a_write_that_was_cut_off_is_replaced(spark, mapping, core):
    target = Snapshot(spark, scratch_path(spark, "fc"))
    spark.range(3).write.parquet(f"{target.folder}/data/weather_2026011000")  # no manifest names it
    target.part(spark.range(1), 1, "entries")  # and this version was never finished
    e = refresh(target, weather(spark, "2026011000", 10), mapping, core)
    assert e.ok and spark.read.parquet(e.path).count() == 4


def test_the_mapping_is_made_once_per_grid(spark):
    folder = scratch_path(spark, "maps")
    cells = spark.createDataFrame([(1, 25.001, 45.001), (2, 25.009, 45.004)], "cell_id long, lon double, lat double")
    nodes = spark.createDataFrame([(0, 25.0, 45.0), (1, 25.01, 45.0), (2, 25.0, 45.01), (3, 25.01, 45.01)], "grid_id long, lon double, lat double")
    m = L.published_mapping(spark, folder, cells, nodes)
    total = m.groupBy("cell_id").agg(F.round(F.sum("weight"), 9).alias("w"), F.count("*").alias("n"))
    assert {tuple(r) for r in total.collect()} == {(1, 1.0, 4), (2, 1.0, 4)}
    before = sorted(os.listdir(folder))
    L.published_mapping(spark, folder, cells.orderBy(F.desc("cell_id")), nodes)
    assert sorted(os.listdir(folder)) == before
    L.published_mapping(spark, folder, cells.filter("cell_id = 1"), nodes)
    assert len(os.listdir(folder)) == 2 * len(before)


# --- warnings ----------------------------------------------------------------------------------

BOX = "POLYGON ((0 0, 1000 0, 1000 1000, 0 1000, 0 0))"
WIDE = "POLYGON ((0 0, 3000 0, 3000 1000, 0 1000, 0 0))"
FEATURES = "group_id string, level_rank int, wkt string"


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(1, 500.0, 500.0), (2, 2500.0, 500.0), (3, 9500.0, 500.0)], "cell_id long, x double, y double")


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, 10), (2, 30), (3, 500)], "cell_id long, pop_total long")


def feed(spark, features, messages, extra="kind"):
    return lambda: (spark.createDataFrame(features, FEATURES), spark.createDataFrame(messages, f"group_id string, level_rank int, {extra} string"))


def test_warnings_of_two_feeds(spark, points, people):
    target = Snapshot(spark, scratch_path(spark, "wn"))
    now = feed(spark, [("n1", 2, BOX), ("n2", 1, WIDE), ("n3", 3, None)], [("n1", 2, "a"), ("n2", 1, "b"), ("n3", 3, "c")])
    general = feed(spark, [("g1", 3, BOX), ("g1", 3, BOX), ("g1", 1, WIDE)], [("g1", 3, "d")], "interval")  # a geometry twice
    assert L.refresh_warnings(target, {"nowcasting": now, "general": general}, points, people)
    assert {(r.cell_id, r.source, r.level_rank) for r in target.read("cells").collect()} == {
        (1, "nowcasting", 2), (2, "nowcasting", 1), (1, "general", 3), (2, "general", 1)}
    assert {(r.source, r.ok, r.total_affected, r.n_messages) for r in target.read("sources").collect()} == {
        ("nowcasting", True, 40, 3), ("general", True, 40, 1)}
    assert target.read("combined").first().pop == 40
    assert {(r.group_id, r.affected_pop, r.kind, r.interval) for r in target.read("messages").collect()} == {
        ("n1", 10, "a", None), ("n2", 40, "b", None), ("n3", 0, "c", None), ("g1", 40, None, "d")}


def test_one_feed_may_fail_both_may_not(spark, points, people):
    target = Snapshot(spark, scratch_path(spark, "wn"))
    now = feed(spark, [("n1", 2, BOX)], [("n1", 2, "a")])

    def broken():
        raise TimeoutError("feed")

    def torn():  # fails only when its rows are asked for
        f, m = now()
        return f.withColumn("wkt", F.raise_error(F.lit("bad XML"))), m

    assert not L.refresh_warnings(target, {"nowcasting": broken, "general": torn}, points, people)
    assert target.latest() is None
    assert L.refresh_warnings(target, {"nowcasting": now, "general": torn}, points, people)
    assert not L.refresh_warnings(target, {"nowcasting": broken, "general": broken}, points, people)
    assert target.latest() == 1
    got = {r.source: r for r in target.read("sources").collect()}
    assert got["nowcasting"].ok and got["nowcasting"].total_affected == 10
    assert not got["general"].ok and "bad XML" in got["general"].error and got["general"].total_affected == 0
    empty = feed(spark, [], [])  # no warnings in force is an answer
    assert L.refresh_warnings(target, {"nowcasting": empty, "general": empty}, points, people)
    assert target.latest() == 2 and target.read("cells").count() == 0 and target.read("combined").first().pop == 0


def test_versions_are_pruned(spark):
    s = Snapshot(spark, scratch_path(spark, "versions"))
    for v in range(6):
        s.write(spark.range(v), v)
    s.prune(2)
    assert s.latest() == 5 and s.read().count() == 5 and sorted(os.listdir(s.folder)) == [f"version={v:012d}" for v in (4, 5)]
