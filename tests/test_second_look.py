"""Cases that the small fixtures of the registered queries cannot show."""

import math
import random

import pytest
from pyspark.sql import functions as F

from demogrid.functions import projection
from demogrid.functions.text import normalise
from demogrid.operators import climate, measures, network, raster, spatial
from demogrid.sources import vectors


def test_distance_transform_with_large_classes_and_bands(spark, monkeypatch):
    monkeypatch.setattr(raster, "BAND", 4)
    rng = random.Random(1)
    h, w = 23, 17
    targets = {(rng.randrange(h), rng.randrange(w)): rng.choice([1, 900, 1500, 70_000]) for _ in range(14)}
    px = spark.createDataFrame([(r, c, targets.get((r, c))) for r in range(h) for c in range(w)], "prow long, pcol long, class int")
    got = {(r["prow"], r["pcol"]): (r["d2"], r["class"]) for r in raster.distance_transform(px).collect()}
    want = {(r, c): min(((r - a) ** 2 + (c - b) ** 2, k) for (a, b), k in targets.items()) for r in range(h) for c in range(w)}
    assert got == want
    none = raster.distance_transform(px.withColumn("class", F.lit(None).cast("int"))).filter("d2 is not null").count()
    assert none == 0


def test_distance_transform_on_a_long_strip(spark):
    n = 100_000
    px = raster.dense_lattice(spark, n, 3).withColumn("class", F.when((F.col("prow") == 7) & (F.col("pcol") == 1), 2000))
    far = raster.distance_transform(px).agg(F.max("d2"), F.min("d2"), F.min("class"), F.count("d2")).first()
    assert tuple(far) == ((n - 8) ** 2 + 1, 0, 2000, 3 * n)


def test_slope_at_edges_and_gaps_in_values(spark):
    v = {(r, c): float(r * r + 3 * c) for r in range(4) for c in range(3)}
    v[1, 1] = None
    px = spark.createDataFrame([(r, c, x) for (r, c), x in v.items()], "prow long, pcol long, value double")
    got = {(r["prow"], r["pcol"]): r["slope"] for r in raster.slope_degrees(px, pixel_m=1.0).collect()}
    assert math.isclose(got[0, 0], math.degrees(math.atan(math.hypot(1, 3)))) and math.isclose(got[2, 2], math.degrees(math.atan(math.hypot(4, 3))))
    assert got[1, 1] is not None and got[1, 0] is None and got[0, 1] is None and got[3, 0] is not None


def test_ways_of_no_cost_do_not_turn_in_circles(spark):
    edges = spark.createDataFrame([(1, 2, 3, 0.0, 5.0), (1, 3, 2, 0.0, 5.0), (2, 2, 1, 4.0, 9.0), (3, 3, 1, 4.0, 9.0), (4, 4, 3, 0.0, 1.0)],
                                  "gid long, source long, target long, cost double, length_m double")
    routes = network.nearest_by_network(edges, spark.createDataFrame([(1, 10)], "vertex long, facility long"))
    lengths = {r["vertex"]: (r["length_m"], r["n_edges"]) for r in network.route_lengths(routes, edges).collect()}
    assert lengths == {1: (0.0, 0), 2: (9.0, 1), 3: (9.0, 1), 4: (10.0, 2)}
    steps = network.route_edges(routes, edges, spark.createDataFrame([(4,)], "vertex long")).orderBy("step").collect()
    assert [r["gid"] for r in steps] == [4, 3]


def test_a_circle_of_routes_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(network, "MOST_DOUBLINGS", 5)
    edges = spark.createDataFrame([(1, 2, 3, 1.0, 5.0), (2, 3, 2, 1.0, 5.0)], "gid long, source long, target long, cost double, length_m double")
    routes = spark.createDataFrame([(2, 1.0, 9, 1), (3, 1.0, 9, 2)], "vertex long, cost double, facility long, via long")
    with pytest.raises(ValueError, match="circle"):
        network.route_lengths(routes, edges)
    with pytest.raises(ValueError, match="circle"):
        network.route_edges(routes, edges, routes.select("vertex"))


def test_each_lattice_point_takes_the_nearest_observation(spark):
    obs = spark.createDataFrame([(1, 0.1, 1.2), (2, 0.05, 1.1), (3, 1.4, 0.0), (4, 1.0, 1.0), (5, 1.0, 1.0)], "id long, lat double, lon double")
    got = {(r["iy"], r["ix"]): r["id"] for r in climate.reindex_with_tolerance(obs, (0.0, 1.0, 2), (0.0, 1.0, 2), 0.3).collect()}
    assert got == {(0, 0): None, (0, 1): 2, (1, 0): None, (1, 1): 4}


def test_accents_of_all_latin_letters(spark):
    row = spark.sql("SELECT 'ǎơĝẽḩȚşŁØ' AS a, 'éÅo' AS b").select(normalise(F.col("a")), normalise(F.col("b"))).first()
    assert tuple(row) == ("aogehtslo", "eao")


def test_quantile_is_the_upper_end_where_rounding_leaves_the_sum_below(spark):
    hist = spark.createDataFrame([(0, 0.1), (1, 0.2), (2, 0.3)], "bin int, pop double")
    spec = measures.HistSpec(0.0, 120.0, 1.0)
    got = {r["q"]: r["value"] for r in measures.histogram_quantiles(hist, spec, [0.5, 1.0 + 1e-9]).collect()}
    assert 1.9 < got[0.5] < 2.1 and got[1.0 + 1e-9] == measures.N_BINS * 1.0


def test_nearest_sites_in_one_tight_cluster(spark):
    rng = random.Random(4)
    sites = [(i, 50_000 + rng.random(), 50_000 + rng.random()) for i in range(400)]
    points = [(i, rng.uniform(0, 100_000), rng.uniform(0, 100_000)) for i in range(60)] + [(100 + i, x, y) for i, x, y in sites[:20]]
    got = {r["cell_id"]: r["site_id"] for r in spatial.nearest_sites(
        spark.createDataFrame(points, "cell_id long, x double, y double"), spark.createDataFrame(sites, "site_id long, x double, y double")).collect()}
    want = {p: min(((x - a) ** 2 + (y - b) ** 2, s) for s, a, b in sites)[1] for p, x, y in points}
    assert got == want


def test_geometries_are_brought_onto_the_grid(spark):
    rows = [(1, "POLYGON ((26 44, 26.1 44, 26.1 44.1, 26 44))", 4326), (2, "POLYGON ((0 0, 10 0, 10 10, 0 0))", 3035)]
    x, y = projection.lon_to_mercator(F.lit(26.0)), projection.lat_to_mercator(F.lit(44.0))
    mx, my = spark.range(1).select(x, y).first()
    rows.append((3, f"LINESTRING ({mx!r} {my!r}, {mx + 10!r} {my!r})", 3857))
    df = spark.createDataFrame(rows, "id long, wkt string, srid int")
    got = {}
    for r in vectors.wkt_edges(df, "wkt", ["id"], srid="srid").orderBy("id", "ring").collect():
        got.setdefault(r["id"], r)
    e, n = spark.range(1).select(*projection.lonlat_to_laea(F.lit(26.0), F.lit(44.0))).first()
    assert any(math.isclose(v, e, abs_tol=0.01) for v in (got[1]["x1"], got[1]["x2"])) and math.isclose(got[3]["x1"], e, abs_tol=0.01)
    assert math.isclose(got[3]["y1"], n, abs_tol=0.01) and 0 <= got[2]["x1"] <= 10
    with pytest.raises(Exception, match="unknown coordinate system 31700"):
        vectors.wkt_edges(df.withColumn("srid", F.lit(31700)), "wkt", ["id"], srid="srid").collect()
