"""Spatial and raster operators against brute force on small, awkward inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from demogrid.functions import projection as P
from demogrid.model import GridSpec
from demogrid.operators import cells as G
from demogrid.operators import cover as V
from demogrid.operators import raster as R
from demogrid.operators import spatial as S
from demogrid.sources.vectors import wkt_edges


def ring_edges(fid, pts):
    return [(fid, *map(float, a), *map(float, b)) for a, b in zip(pts, pts[1:] + pts[:1])]


EDGE = "feature_id long, x1 double, y1 double, x2 double, y2 double"


def star(cx, cy, n, rng, r):
    return [(cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(7)
    return {i: star(rng.uniform(-500, 4500), rng.uniform(-500, 4500), rng.randint(3, 25), rng, rng.uniform(50, 1500)) for i in range(12)}


def inside(x, y, pts):
    n = 0
    for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            n += 1
    return n % 2 == 1


def seg(x, y, a, b):
    (x1, y1), (x2, y2) = a, b
    d = (x2 - x1) ** 2 + (y2 - y1) ** 2
    t = 0 if d == 0 else max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / d))
    return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))


@pytest.fixture(scope="module")
def points():
    rng = random.Random(3)
    return [(i, rng.uniform(-1500, 5500), rng.uniform(-1500, 5500)) for i in range(400)]


@pytest.mark.parametrize("tile", [90.0, 700.0, 20000.0])
def test_points_in_polygons(spark, shapes, points, tile):
    edges = spark.createDataFrame([e for f, p in shapes.items() for e in ring_edges(f, p)], EDGE)
    pts = spark.createDataFrame(points, "cell_id long, x double, y double")
    got = {tuple(r) for r in S.points_in_polygons(pts, edges, tile=tile).collect()}
    assert got == {(i, f) for i, x, y in points for f, p in shapes.items() if inside(x, y, p)}


def test_polygon_with_hole(spark):
    wkt = spark.createDataFrame([(1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 8 2, 8 8, 2 8, 2 2))")], "feature_id long, wkt string")
    edges = wkt_edges(wkt, "wkt", ["feature_id"])
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 9.0, 5.0), (4, 11.0, 5.0)], "cell_id long, x double, y double")
    assert sorted(r.cell_id for r in S.points_in_polygons(pts, edges, tile=3.0).collect()) == [1, 3]


def test_nearest_polygon(spark, shapes, points):
    edges = spark.createDataFrame([e for f, p in shapes.items() for e in ring_edges(f, p)], EDGE)
    pts = spark.createDataFrame(points, "cell_id long, x double, y double")
    got = {r.cell_id: (r.feature_id, r.dist) for r in S.nearest_polygon(pts, edges, 400.0).collect()}
    for i, x, y in points:
        best = min((min(seg(x, y, a, b) for a, b in zip(p, p[1:] + p[:1])), f) for f, p in shapes.items())
        if best[0] <= 400.0:
            assert got[i][0] == best[1] and got[i][1] == pytest.approx(best[0])
        else:
            assert i not in got


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("layout", ["spread", "hot", "single", "line"])
def test_nearest_sites(spark, points, k, layout):
    rng = random.Random(11)
    sites = {"spread": [(i, rng.uniform(0, 4000), rng.uniform(0, 4000)) for i in range(60)],
             # most sites in one spot, many at exactly the same place
             "hot": [(i, 100.0 + (i % 5), 100.0) for i in range(50)] + [(100 + i, rng.uniform(0, 4000), rng.uniform(0, 4000)) for i in range(6)],
             "single": [(5, 10.0, 10.0)],
             "line": [(i, 0.0, 100.0 * i) for i in range(30)]}[layout]
    pts = spark.createDataFrame(points, "cell_id long, x double, y double")
    st = spark.createDataFrame(sites, "site_id long, x double, y double")
    got = {}
    for r in S.nearest_sites(pts, st, k).collect():
        got.setdefault(r.cell_id, {})[r["rank"]] = r.site_id
    for i, x, y in points:
        want = [s for _, s in sorted(((x - sx) ** 2 + (y - sy) ** 2, s) for s, sx, sy in sites)][:k]
        assert [got[i][j + 1] for j in range(len(want))] == want


@pytest.mark.parametrize("north_up", [False, True])
def test_pixel_centre_cover(spark, shapes, north_up):
    edges = spark.createDataFrame([e for f, p in shapes.items() for e in ring_edges(f, p)], EDGE)
    lat = V.Lattice(0.0, 4000.0 if north_up else 0.0, 100.0, north_up)
    got = {tuple(r) for r in V.within(V.interior_pixels(edges, lat), 40, 40).collect()}
    want = set()
    for f, p in shapes.items():
        for r in range(40):
            for c in range(40):
                y = 4000 - (r + 0.5) * 100 if north_up else (r + 0.5) * 100
                if inside((c + 0.5) * 100, y, p):
                    want.add((f, r, c))
    assert got == want


def test_all_touched_lines(spark, shapes):
    edges = spark.createDataFrame([e for f, p in shapes.items() for e in ring_edges(f, p)], EDGE)
    got = {(r.feature_id, r.prow, r.pcol) for r in V.touched_pixels(edges, V.Lattice(0.0, 0.0, 100.0), filled=False).collect()}
    want = set()
    for f, p in shapes.items():
        for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1]):
            cuts = {0.0, 1.0}
            for a, b in ((x1, x2), (y1, y2)):
                lo, hi = sorted((a, b))
                for k in range(math.floor(lo / 100), math.floor(hi / 100) + 2):
                    if a != b and 0 < (k * 100 - a) / (b - a) < 1:
                        cuts.add((k * 100 - a) / (b - a))
            cuts = sorted(cuts)
            for s, e in zip(cuts, cuts[1:]):
                m = (s + e) / 2
                want.add((f, math.floor((y1 + m * (y2 - y1)) / 100), math.floor((x1 + m * (x2 - x1)) / 100)))
    assert got == want


@pytest.mark.parametrize("density", [0.0, 0.002, 0.05, 0.6])
def test_distance_transform(spark, density):
    rng = np.random.default_rng(5)
    lab = np.where(rng.random((23, 31)) < density, rng.integers(1, 6, (23, 31)), 0)
    px = spark.createDataFrame([(r, c, int(lab[r, c]) or None) for r in range(23) for c in range(31)], "prow long, pcol long, class int")
    tg = [(r, c, lab[r, c]) for r in range(23) for c in range(31) if lab[r, c]]
    for r in R.distance_transform(px).collect():
        if not tg:
            assert r.d2 is None and r["class"] is None
            continue
        want = min(((r.prow - a) ** 2 + (r.pcol - b) ** 2, int(k)) for a, b, k in tg)
        assert (r.d2, r["class"]) == want


def test_slope_matches_gradient(spark):
    a = np.random.default_rng(1).random((7, 9)) * 300
    px = spark.createDataFrame([(r, c, float(a[r, c])) for r in range(7) for c in range(9)], "prow long, pcol long, value double")
    gy, gx = np.gradient(a, 100.0)
    want = np.degrees(np.arctan(np.hypot(gx, gy)))
    for r in R.slope_degrees(px).collect():
        assert r.slope == pytest.approx(want[r.prow, r.pcol])


def test_dominant_class_ties(spark):
    px = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 10, 1), (5, 12, 1), (6, 12, 2)], "prow long, pcol long, class int")
    assert {(r.bcol, r["class"]) for r in R.dominant_class(px).collect()} == {(0, 2), (1, 1)}
    assert {(r.bcol, r["class"]) for r in R.dominant_class(px, count_empty=True).collect()} == {(0, None), (1, None)}


def test_interior_points_are_inside(spark, shapes):
    edges = spark.createDataFrame([e for f, p in shapes.items() for e in ring_edges(f, p)], EDGE)
    got = S.interior_points(edges, V.Lattice(0.0, 0.0, 20.0)).collect()
    assert len(got) >= 11 and all(inside(r.x, r.y, shapes[r.feature_id]) for r in got)


def test_exactly_one(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert S.exactly_one(df, F.col("k") == 1, "row").count() == 1
    for k in (2, 3):
        with pytest.raises(Exception, match="exactly one"):
            S.exactly_one(df, F.col("k") == k, "row").collect()


def test_projection_known_point_and_round_trip(spark):
    df = spark.createDataFrame([(10.0, 52.0), (5.0, 50.0), (26.1, 44.43)], "lon double, lat double")
    e, n = P.lonlat_to_laea(F.col("lon"), F.col("lat"))
    rows = df.withColumns({"e": e, "n": n}).withColumns(dict(zip(("lo", "la"), P.laea_to_lonlat(F.col("e"), F.col("n"))))).collect()
    assert (rows[0].e, rows[0].n) == pytest.approx((4321000.0, 3210000.0), abs=1e-6)
    assert (rows[1].e, rows[1].n) == pytest.approx((3962799.45, 2999718.85), abs=0.01)  # published test point
    for r in rows:
        assert (r.lo, r.la) == pytest.approx((r.lon, r.lat), abs=1e-8)


def test_cell_numbering_round_trip(spark):
    spec = GridSpec(5000000, 2000000, 7, 5)
    df = spark.range(35).withColumnRenamed("id", "cell_id")
    e, n = G.corner(spec, F.col("cell_id"))
    back = df.withColumn("again", G.cell_of_point(spec, e + 500, n + 500))
    assert back.filter("again <> cell_id").isEmpty()
    assert spark.range(1).select(G.cell_of_point(spec, F.lit(4999999), F.lit(2000001))).first()[0] is None


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_polygons_with_many_edges_in_a_band(spark):
    """Bands of few and of many edges, level edges, one polygon over several tiles; attributes that occur twice."""
    from demogrid.operators.warnings import cells_of_features

    rng = random.Random(11)
    shapes = {1: star(60, 55, 400, rng, 45), 2: star(20, 30, 150, rng, 25), 3: [(5, 5), (95, 5), (95, 42), (5, 42)]}
    pts = [(i, rng.uniform(0, 110), rng.uniform(0, 110)) for i in range(600)]
    edges = spark.createDataFrame([e for f, p in shapes.items() for e in ring_edges(f, p)], EDGE)
    points = spark.createDataFrame(pts, "cell_id long, x double, y double")
    want = {(i, f) for i, x, y in pts for f, p in shapes.items() if inside(x, y, p)}
    for tile in (20.0, 500.0):
        assert {tuple(r) for r in S.points_in_polygons(points, edges, tile=tile).collect()} == want
    named = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c")], "feature_id long, group_id string")
    got = sorted((r.cell_id, r.feature_id, r.group_id) for r in cells_of_features(points, edges, named, 20.0).collect())
    assert got == sorted((i, f, " abc"[f]) for i, f in want for _ in range(2 if f == 1 else 1))


def test_pairs_of_points_and_polygons_stay_in_their_tile(spark):
    """Neither the pairs nor what the polygons are estimated to weigh goes through the driver or a shuffle."""
    from demogrid.operators.warnings import cells_of_features, worst_per

    points = spark.createDataFrame([(1, 0.5, 0.5)], "cell_id long, x double, y double")
    edges = spark.createDataFrame(ring_edges(1, [(0, 0), (1, 0), (1, 1), (0, 1)]), EDGE)
    features = spark.createDataFrame([(1, "a", 2)], "feature_id long, source string, level_rank int")
    pairs = cells_of_features(points, edges, features)
    plan = initial_plan(worst_per(pairs, "cell_id", "source"))
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan
    assert [(r.cell_id, r.level_rank) for r in pairs.collect()] == [(1, 2)]


def test_outlines_are_polygons_too(spark):
    """One array per ring gives what one row per edge does: several rings, open ones, a key given twice, points given twice."""
    rng = random.Random(5)
    rings = [(1, star(60, 55, 200, rng, 45)), (2, star(20, 30, 7, rng, 25)), (2, star(22, 90, 9, rng, 8)), (3, [(5, 5), (95, 5), (95, 42), (5, 42)]),
             (4, [(10, 10), (30, 10), (30, 30), (10, 30)]), (4, [(10, 10), (30, 10), (30, 30), (10, 30)]), (None, [(0, 0), (9, 0), (9, 9)])]
    pts = [(i, rng.uniform(0, 110), rng.uniform(0, 110)) for i in range(300)]
    points = spark.createDataFrame(pts + pts[:40] + [(900, None, 1.0)], "cell_id long, x double, y double")
    edges = [ring_edges(f, r) for f, r in rings] + [[(5, 40.0, 0.0, 70.0, 99.0)], []]
    flat = spark.createDataFrame([e for r in edges for e in r], EDGE)
    nested = spark.createDataFrame([(r[0][0] if r else 6, [tuple(map(float, e[1:])) for e in r]) for r in edges] + [(7, None)],
                                   "feature_id long, outline array<struct<x1: double, y1: double, x2: double, y2: double>>")
    named = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "feature_id long, group_id string")
    for tile in (20.0, 500.0):
        for attrs in (None, named):
            got, want = (sorted(tuple(r) for r in S.points_in_polygons(points, e, tile=tile, attrs=attrs).collect()) for e in (nested, flat))
            assert got == want and len({r[1] for r in got}) >= 3


def test_warnings_send_one_row_per_message(spark):
    """The four edges of a message are not shuffled and sorted one by one."""
    from demogrid.workload.warnings import box_edges

    edges = box_edges(spark.createDataFrame([(1, 10000, 20000)], "id long, cx long, cy long"))
    assert edges.count() == 1
    points = spark.createDataFrame([(1, 10500.5, 20500.5), (2, 12500.5, 20500.5)], "cell_id long, x double, y double")
    assert [tuple(r) for r in S.points_in_polygons(points, edges).collect()] == [(1, 1)]


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_sites_takes_k_before_it_groups(spark, k):
    """A point leaves the other sites it meets behind in its tile: memory of a task does not grow with them."""
    rows = [(i, float(i), 0.0) for i in range(20)]
    points = spark.createDataFrame([*rows, rows[4]], "cell_id long, x double, y double")
    sites = spark.createDataFrame([(i, float(3 * i), 1.0) for i in range(9)], "site_id long, x double, y double")
    near = S.nearest_sites(points, sites, k)
    assert ("array_min(" if k == 1 else "slice(") in initial_plan(near)
    got = {}
    for r in near.collect():
        got.setdefault(r.cell_id, {})[r["rank"]] = (r.d2, r.site_id)
    for i in range(20):
        order = sorted(((i - 3 * s) ** 2 + 1.0, s) for s in range(9) for _ in range(2 if i == 4 else 1))
        assert got[i] == {n + 1: order[n] for n in range(k)}


def test_points_given_twice(spark):
    """In tiles with an edge the crossings of both copies add up; in a tile wholly inside both are found."""
    edges = spark.createDataFrame(ring_edges(1, [(1, 1), (39, 1), (39, 39), (1, 39)]), EDGE)
    points = spark.createDataFrame([(1, 5.0, 5.0)] * 2 + [(2, 15.0, 15.0)] * 2 + [(3, 5.0, 6.0), (4, 15.0, 16.0)], "cell_id long, x double, y double")
    assert sorted(r.cell_id for r in S.points_in_polygons(points, edges, tile=10.0).collect()) == [2, 2, 3, 4]


def test_edges_of_text_need_no_join(spark):
    df = spark.createDataFrame([(1, "POLYGON ((0 0, 2 0, 2 0, 2 1e0, 0 0), (0.5 0.1, 1 0.1, 1 0.2, 0.5 0.1))"), (2, "POINT (1 1)"), (None, "LINESTRING (0 0, 1 1)")],
                               "feature_id long, wkt string")
    edges = wkt_edges(df, "wkt", ["feature_id"])
    assert "Join" not in initial_plan(edges)
    assert sorted(tuple(r) for r in edges.collect()) == [
        (1, 0, 0, 0, 2, 0), (1, 0, 2, 0, 2, 1), (1, 0, 2, 1, 0, 0), (1, 1, 0.5, 0.1, 1, 0.1), (1, 1, 1, 0.1, 1, 0.2), (1, 1, 1, 0.2, 0.5, 0.1)]


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_sites_far_from_all_sites(spark, monkeypatch, k):
    """Points far from all sites do not meet every tile that holds sites."""
    sites = [(i, float(i % 20) * 1000, float(i // 20) * 1000) for i in range(1200)]
    points = [(i, float(i % 10) * 1900 + 7, 100000.0 + i * 5000) for i in range(200)]
    sizes, down = [], S._downwards

    def watched(tiles, held, *args):
        out = down(tiles, held, *args)
        sizes.append((out.count(), tiles.count() * held.count()))
        return out

    monkeypatch.setattr(S, "_downwards", watched)
    got = {}
    for r in S.nearest_sites(spark.createDataFrame(points, "cell_id long, x double, y double"),
                             spark.createDataFrame(sites, "site_id long, x double, y double"), k).collect():
        got.setdefault(r["cell_id"], {})[r["rank"]] = r["site_id"]
    for i, x, y in points:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, s) for s, a, b in sites)[:k]
        assert [got[i][n] for n in range(1, k + 1)] == [s for _, s in near]
    assert sizes and sizes[0][0] < sizes[0][1] / 3
