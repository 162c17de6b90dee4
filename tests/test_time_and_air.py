"""Local days, extremes, air quality, node mapping: the small documented cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demogrid.functions import air, times
from demogrid.operators import forecast as W


def ts(text):
    return F.lit(text).cast("timestamp")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def stamps(spark, start, n, step="1 hour"):
    return spark.range(1).select(F.explode(F.expr(
        f"sequence(timestamp'{start}', timestamp'{start}' + interval {n - 1} hours, interval {step})")).alias("valid_time"))


def test_local_day_changes_at_local_midnight(spark):
    df = frame(spark, [("2026-01-01 21:00:00",), ("2026-01-01 22:00:00",)], "t string")
    got = [r[0] for r in df.select(times.local_day(F.col("t").cast("timestamp"))).collect()]
    assert got == [dt.date(2026, 1, 1), dt.date(2026, 1, 2)]


def test_daily_extremes_shift_and_celsius(spark):
    rows = [(1, "2026-01-01 18:00:00", 273.15, 278.15), (1, "2026-01-01 21:00:00", 271.15, 279.15), (1, "2026-01-02 00:00:00", 269.15, 280.15)]
    steps = frame(spark, rows, "grid_id long, t string, min_k double, max_k double").withColumn("valid_time", F.col("t").cast("timestamp"))
    got = {r.valid_date: (round(r.tmin, 6), round(r.tmax, 6)) for r in W.weather_daily(steps, 3, only_complete=False).collect()}
    assert got == {dt.date(2026, 1, 1): (-2.0, 6.0), dt.date(2026, 1, 2): (-4.0, 7.0)}


@pytest.mark.parametrize("value,rank", [(10.0, 0), (10.01, 1), (75.0, 4), (75.01, 5), (float("nan"), -1), (None, -1)])
def test_aqi_rank_edges(spark, value, rank):
    df = frame(spark, [(value,)], "v double")
    assert df.select(air.aqi_rank(F.col("v"), "pm25")).first()[0] == rank


def test_worst_pollutant_and_strict_mean(spark):
    rows = [(1, h, p, v) for p, vs in (("pm25", (9.0, 26.0)), ("no2", (20.0, 50.0))) for h, v in enumerate(vs)]
    s = frame(spark, rows, "grid_id long, h int, pollutant string, value double").withColumn(
        "valid_time", F.expr("timestamp'2026-07-01 00:00:00' + make_interval(0, 0, 0, 0, h)"))
    r = W.air_daily(s, only_complete=False).first()
    assert r.pm25_max == 26.0 and r.aqi_rank == 1  # no 24-hour mean yet, so particulates have no rank
    full = stamps(spark, "2026-07-01 00:00:00", 24).withColumns({"grid_id": F.lit(1), "value": F.lit(26.0)})
    means = [r.m for r in full.select("valid_time", W.rolling_mean(full, ["grid_id"]).alias("m")).orderBy("valid_time").collect()]
    assert means[:23] == [None] * 23 and means[23] == 26.0
    assert full.select(air.aqi_rank(F.lit(means[23]), "pm25")).first()[0] == 3


def test_only_complete_local_days(spark):
    days = W.complete_local_days(stamps(spark, "2026-07-19 00:00:00", 72), 1)
    assert sorted(r.day for r in days.collect()) == [dt.date(2026, 7, 20), dt.date(2026, 7, 21)]


@pytest.mark.parametrize("day,hours", [("2026-03-29", 23), ("2026-10-25", 25), ("2026-07-01", 24)])
def test_clock_changes(spark, day, hours):
    assert spark.range(1).select(times.hours_in_local_day(F.lit(day).cast("date"))).first()[0] == hours


def test_nearest_node(spark):
    cells = frame(spark, [(2, 29.9, 45.0), (1, 20.1, 45.0)], "cell_id long, lon double, lat double")
    nodes = frame(spark, [(7, 20.0, 45.0), (8, 30.0, 45.0)], "grid_id long, lon double, lat double")
    assert {tuple(r) for r in W.nearest_node(cells, nodes).collect()} == {(1, 7), (2, 8)}


def test_nearest_node_refuses_far_cells(spark):
    cells = frame(spark, [(1, 25.0, 45.0)], "cell_id long, lon double, lat double")
    nodes = frame(spark, [(7, 20.0, 45.0), (8, 30.0, 45.0)], "grid_id long, lon double, lat double")
    with pytest.raises(Exception, match="too far"):
        W.nearest_node(cells, nodes).collect()


NODES = [(0, 20.0, 45.0), (1, 21.0, 45.0), (2, 20.0, 46.0), (3, 21.0, 46.0)]


def test_bilinear_weights(spark):
    cells = frame(spark, [(1, 20.25, 45.3)], "cell_id long, lon double, lat double")
    nodes = frame(spark, NODES, "grid_id long, lon double, lat double")
    near = W.nearest_node(cells, nodes)
    assert near.first().grid_id == 0
    got = {r.grid_id: round(r.weight, 5) for r in W.bilinear_mapping(cells, nodes, near).collect()}
    assert got == {0: 0.525, 1: 0.175, 2: 0.225, 3: 0.075}
    wide = W.wide_mapping(W.bilinear_mapping(cells, nodes, near), near).first()
    assert (wide.grid_id_a, wide.grid_id_d, round(wide.weight_a, 5)) == (0, 3, 0.525)


def test_bilinear_falls_back_on_a_hole(spark):
    cells = frame(spark, [(1, 20.1, 45.1)], "cell_id long, lon double, lat double")
    nodes = frame(spark, NODES[:3], "grid_id long, lon double, lat double")
    m = W.bilinear_mapping(cells, nodes, W.nearest_node(cells, nodes)).collect()
    assert {r.grid_id for r in m} == {0} and sum(r.weight for r in m) == 1.0 and max(r.weight for r in m) == 1.0


def test_candidate_dates_never_in_the_future(spark):
    df = frame(spark, [("2026-07-20", "2026-07-22"), ("2026-07-20", None)], "today string, latest string")
    got = [r[0] for r in df.select(times.candidate_dates(F.col("today").cast("date"), F.col("latest").cast("date"))).collect()]
    assert got[0] == [dt.date(2026, 7, 20), dt.date(2026, 7, 19), dt.date(2026, 7, 18)]
    assert got[1][0] == dt.date(2026, 7, 19)


def test_coverage(spark):
    have = frame(spark, [("2026-07-19 15:00:00",), ("2026-07-19 18:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("valid_time"))
    assert W.missing_steps(have, F.lit("2026-07-19 15:00:00"), F.lit("2026-07-19 18:00:00"), "3 hours").isEmpty()
    assert W.missing_steps(have, F.lit("2026-07-19 15:00:00"), F.lit("2026-07-19 21:00:00"), "3 hours").count() == 1


def test_hour_axis(spark):
    df = frame(spark, [(0.0,), (1.0,)], "h double")
    got = df.select(F.date_format(times.hour_axis(F.lit("2026-07-18 00:00:00"), F.col("h")), "HH:mm")).collect()
    assert [r[0] for r in got] == ["00:00", "01:00"]


def test_units(spark):
    df = frame(spark, [("µg m-3",), ("mg/m^3",), ("kg per m**3",), ("g/m³",)], "u string")
    assert [r[0] for r in df.select(air.concentration_factor(F.col("u"))).collect()] == [1.0, 1e3, 1e9, 1e6]
    with pytest.raises(Exception, match="unsupported unit"):
        frame(spark, [("ppm",)], "u string").select(air.concentration_factor(F.col("u"))).collect()


def test_ladder(spark):
    cells = frame(spark, [(36.0, 990), (41.0, 4), (20.0, 6)], "x double, pop_total long")
    r = W.ladder_pick(cells, "x", W.HEAT_LADDER, ">=").first()
    assert (r.threshold, r.active) == (35, True)  # 40 degrees would reach only 0.4 %
    few = frame(spark, [(31.0, 3), (10.0, 100000)], "x double, pop_total long")
    assert W.ladder_pick(few, "x", W.HEAT_LADDER, ">=").first().threshold == 30
    none = frame(spark, [(1.0, 10)], "x double, pop_total long")
    assert tuple(W.ladder_pick(none, "x", W.HEAT_LADDER, ">=").first()) == (None, False)
    cold = frame(spark, [(-6.0, 10), (-16.0, 10)], "x double, pop_total long")
    assert W.ladder_pick(cold, "x", W.COLD_LADDER, "<=").first().threshold == -15
