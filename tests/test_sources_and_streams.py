"""Writers, feeds, retention, and streaming over several batches."""

import datetime as dt
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from demogrid.session import scratch_path
from demogrid.sources import cube as C
from demogrid.sources import feeds as X
from demogrid.sources import tables as T
from demogrid.sources import vectors as V
from demogrid.streaming import jobs as J


def test_clustered_writer_sorts_and_limits_row_groups(spark):
    path = scratch_path(spark, "clustered")
    T.write_clustered(spark.range(100000).select((F.col("id") * 7919 % 100000).alias("cell_id"), F.lit(1).alias("v")), path, partitions=2)
    spans = []
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        assert meta.row_group(0).column(0).compression == "ZSTD"
        assert all(meta.row_group(i).num_rows <= T.ROW_GROUP_ROWS for i in range(meta.num_row_groups))
        ids = pq.read_table(f)["cell_id"].to_pylist()
        assert ids == sorted(ids)
        spans.append((ids[0], ids[-1]))
    spans.sort()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_immutable_publish(spark):
    path = scratch_path(spark, "run")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    assert T.publish_immutable(df, path) == "written"
    assert T.publish_immutable(df.orderBy("v"), path) == "unchanged"
    with pytest.raises(ValueError):
        T.publish_immutable(df.distinct(), path)  # the same set, but not the same rows


def test_retention_and_fallback(spark):
    runs = spark.createDataFrame([("w", i) for i in range(7)], "source string, run int")
    assert sorted(r.run for r in T.keep_runs(runs, F.col("run") == 0).collect()) == [0, 4, 5, 6]
    d = [dt.date(2026, 7, i) for i in range(1, 6)]
    a = spark.createDataFrame([("w", 1, 10, True, d[:3]), ("w", 2, 11, False, None), ("x", 1, 12, True, d), ("x", 2, 9, True, d[:1])],
                              "source string, attempt int, run int, ok boolean, days array<date>")
    got = {r.source: (r.run, r.ok, len(r.days)) for r in T.current_entries(a, F.lit("2026-07-03").cast("date")).collect()}
    assert got == {"w": (10, False, 1), "x": (12, True, 5)}


def test_census_cells(spark):
    census = spark.createDataFrame([("CRS3035RES1000mN2001000E5002000", 7, 1.5), ("CRS3035RES1000mN2000000E5000000", 3, None)],
                                   "GRD_ID string, Populatia_totala_T int, TOT_P_2018 double")
    got = {r.cell_id: (r.row, r.col, r.pop_total) for r in T.build_cells(census).collect()}
    assert got == {2: (0, 2, 7), 3: (1, 0, 3)}


def test_census_cells_beyond_the_origin(spark):
    ids = ["CRS3035RES1000mN1000E-1000", "CRS3035RES1000mN-1000E2000"]
    census = spark.createDataFrame([(i, 1) for i in ids], "GRD_ID string, Populatia_totala_T int")
    got = {r.grid_id: (r.cell_id, r.row, r.col, r.n, r.e) for r in T.build_cells(census).collect()}
    assert got == {ids[0]: (0, 0, 0, 1000, -1000), ids[1]: (11, 2, 3, -1000, 2000)}


def test_year_files(spark):
    names = ["daily_tmin_2025.nc", "daily_tmax_2025.nc", "daily_precip_2025.nc", "daily_tmin_synop_2025.nc", "daily_tmin_synop_2026.nc", "daily_tmax_2026.nc", "other.nc"]
    paths = spark.createDataFrame([(f"/in/{n}",) for n in names], "path string")
    got = {(r.year, r.var, r.path) for r in C.year_files(paths).collect()}
    assert got == {(2025, v, f"/in/daily_{v}_2025.nc") for v in ("tmin", "tmax", "precip")}


def test_feed_files(spark, tmp_path):
    (tmp_path / "now.xml").write_text(
        '<avertizari><avertizare/><avertizare avertizareId="7" avertizareNivelCod="po" coordsGis="POLYGON ((0 0, 1 0, 1 1, 0 0))" fenomenAvertizat="vijelie">'
        '<zona_afectata text="A"/><zona_afectata text="B"/></avertizare><avertizare avertizareId="7" avertizareNivelCod="RO" fenomenAvertizat="x"/>'
        '<avertizare avertizareId="8" avertizareNivelCod="??" useCoordsGis="FALSE" coordsGis="POLYGON ((0 0, 1 0, 1 1, 0 0))"/></avertizari>', encoding="utf-8")
    rows = X.read_feed(spark, str(tmp_path / "now.xml"), X.NOWCASTING_SCHEMA).withColumn("pos", F.monotonically_increasing_id())
    got = {r.id: r for r in X.nowcasting_messages(rows).collect()}
    assert set(got) == {"7", "8"} and (got["7"].level_code, got["7"].area_text) == ("PO", "A B")
    assert got["8"].level_rank == 1 and got["8"].wkt is None
    wkt = "POLYGON ((0 0, 1 0, 1 1, 0 0))"
    (tmp_path / "gen.xml").write_text(
        f'<avertizari><avertizare numeTipMesaj="T"><judet cod="B" culoare="2" coordGis="{wkt}"/><judet cod="A" culoare="x" coordGis="{wkt}"/>'
        f'<zona cod="Z" culoare="0" coordGis="{wkt}"/><zona cod="Y" culoare="9" coordGis="{wkt}"/></avertizare><avertizare/></avertizari>', encoding="utf-8")
    rows = X.read_feed(spark, str(tmp_path / "gen.xml"), X.GENERAL_SCHEMA).withColumn("pos", F.monotonically_increasing_id())
    feats = X.general_features(rows)
    assert sorted((r.unit_cod, r.level_rank) for r in feats.collect()) == [("A", 1), ("B", 2), ("Y", 1)]
    msg = {r.kind: r for r in X.general_messages(rows, feats).collect()}
    assert msg["T"].level_rank == 2 and msg["T"].counties == ["A", "B"] and msg["T"].n_zones == 1
    assert [(m["rank"], m["n"]) for m in msg["T"].level_mix] == [(2, 1), (1, 2)]
    assert msg[X.GENERAL_KIND].level_rank == 0 and msg[X.GENERAL_KIND].counties == []


def test_geojson_documents(spark, tmp_path):
    (tmp_path / "p.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"Ș","iata":"X"},'
                                        '"geometry":{"type":"Point","coordinates":[26.5,44.25]}}]}', encoding="utf-8")
    r = V.read_geojson_points(spark, str(tmp_path / "p.geojson"), "name string, iata string").first()
    assert (r.name, r.x, r.y) == ("Ș", 26.5, 44.25)


def test_pointer_never_moves_back(spark):
    src = scratch_path(spark, "runs")
    out, state = J.new_folders(spark, "pointer")
    snap = J.Snapshot(spark, out)
    assert snap.read() is None
    for rows in ([("weather", 5, "a"), ("air", 3, "b")], [("weather", 4, "old")], [("air", 9, "c")]):
        spark.createDataFrame(rows, "source string, run int, entry string").coalesce(1).write.mode("append").parquet(src)
        J.run_pointers(J.file_stream(spark, src, "source string, run int, entry string"), snap, state)
    assert {tuple(r) for r in snap.read().collect()} == {("weather", 5, "a"), ("air", 9, "c")}


def test_snapshot_survives_an_empty_feed(spark):
    src = scratch_path(spark, "feed")
    out, state = J.new_folders(spark, "overlay")
    snap = J.Snapshot(spark, out)
    for rows in ([(1,), (2,)], [], [(3,)], []):
        spark.createDataFrame(rows, "id long").coalesce(1).write.mode("append").parquet(src)
        J.snapshot_refresh(J.file_stream(spark, src, "id long"), lambda m: m.select((F.col("id") * 10).alias("v")), snap, state)
    assert [r.v for r in snap.read().collect()] == [30]


def test_corrections_replace_only_their_days(spark):
    schema = "year int, date date, iy long, ix long, tmin double, tmax double, precip double"
    day = dt.date(2026, 1, 1)
    out, state = J.new_folders(spark, "cube")
    C.write_cube(spark.createDataFrame([(2025, dt.date(2025, 1, 1), 0, 0, 1.0, 2.0, 0.0), (2026, day, 0, 0, 1.0, 2.0, 0.0), (2026, day, 0, 1, 5.0, 6.0, 0.0)], schema), out)
    late = scratch_path(spark, "late")
    spark.createDataFrame([(2026, day, 0, 0, -9.0, 2.0, 0.0)], schema).write.parquet(late)
    J.correct_days(J.file_stream(spark, late, schema), out, state)
    assert sorted((r.year, r.ix, r.tmin) for r in C.read_cube(spark, out).collect()) == [(2025, 0, 1.0), (2026, 0, -9.0), (2026, 1, 5.0)]


def test_an_element_is_parsed_once(spark):
    xml = '<avertizare avertizareId="7" avertizareNivelCod="po" coordsGis="POLYGON ((0 0, 1 0, 1 1, 0 0))"/>'
    texts = spark.createDataFrame([(1, xml), (2, xml), (3, None)], "pos long, xml string")
    m = X.nowcasting_messages(X.parse_elements(texts, "xml", X.NOWCASTING_SCHEMA))
    assert m._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1  # not again for the filter on what was parsed
    assert [(r.id, r.pos, r.level_code) for r in m.collect()] == [("7", 1, "PO")]


def test_feeds_are_read_once(spark):
    from demogrid.session import staged

    runs = spark.sparkContext.accumulator(0)
    count = F.udf(lambda v: (runs.add(1), v)[1], "long")
    rows = staged(spark.range(5).withColumn("v", count("id")), "rows")
    assert rows.agg(F.sum("v")).first()[0] == rows.filter("v > 0").agg(F.sum("v")).first()[0] == 10
    assert runs.value == 5 and rows.columns == ["id", "v"]
