"""Similar places, neighbourhoods, positions and travel times against brute force."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from demogrid.operators import focal, network, overlay, positions, similar
from demogrid.operators.measures import default_range
from demogrid.plans.catalogue import REGISTRY


# --- similar places ----------------------------------------------------------------------------

def brute_similar(vectors, asked, n):
    out = set()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    for q in asked:
        best = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in unit if i != q)[:n]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def told(df):
    return {(r["id"], r["rank"], r["other"], round(r["similarity"], 6)) for r in df.collect()}


def test_similar_places(spark, monkeypatch):
    monkeypatch.setattr(similar, "LIST_ROWS", 40)  # lists in parts, queries of a list in several tasks
    monkeypatch.setattr(similar, "LIST_QUERIES", 3)
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(6, 12))
    vectors = {i: [float(np.float32(x)) for x in middle[i % 6] + 0.4 * rng.normal(size=12)] for i in range(600)}
    vectors |= {700 + i: vectors[3] for i in range(15)}  # ties
    bad = [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [None] * 12), (None, vectors[1]), (904, [float("inf")] + [1.0] * 11), (905, [])]
    rows = [*vectors.items(), *bad, (5, vectors[5])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, least string")
    index = similar.build_index(similar.unit_vectors(df, "vec_id", "embedding"))
    assert index.table.count() == len(vectors) and int(index.parts.sum()) > len(index.centres)
    asked = index.table.filter("id % 20 = 0 or id = 3").select("id", "vec")
    exact = similar.most_similar(index, asked, 7)
    ids = [i for i in vectors if i % 20 == 0 or i == 3]
    assert told(exact) == brute_similar(vectors, ids, 7)
    probes = similar.probes_for(index, asked, 7, recall=0.95)
    assert probes < len(index.centres) / 2
    found = told(similar.most_similar(index, asked, 7, probes=probes))
    assert len({(q, i) for q, _, i, _ in found} & {(q, i) for q, _, i, _ in told(exact)}) >= 0.9 * len(told(exact))
    assert similar.most_similar(index, asked.limit(0), 7).count() == 0


def test_similar_places_of_few_rows(spark):
    one = similar.unit_vectors(spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>"), "id", "v")
    index = similar.build_index(one)
    assert similar.most_similar(index, one, 3).count() == 0
    none = similar.build_index(one.limit(0))
    assert similar.most_similar(none, one, 3).count() == 0
    cells = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 2.0), (3, float("nan"), 2.0)], "cell_id long, a double, b double")
    assert sorted(tuple(r) for r in similar.profile_vector(cells, ["a", "b"]).collect()) == [(1, [-1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])]


# --- neighbourhoods ------------------------------------------------------------------------------

def brute_focal(cells, radius):
    out = {}
    for key, r, c, *_ in cells:
        near = [x for x in cells if (x[1] - r) ** 2 + (x[2] - c) ** 2 <= radius ** 2]
        values = [x[4] for x in near if x[4] is not None and not math.isnan(x[4])]
        kinds = [x[5] for x in near if x[5] is not None]
        out[key] = (len(near), sum(x[3] or 0 for x in near), sum(values) / len(values) if values else None,
                    kinds.count("a") / len(kinds) if kinds else None, kinds.count("b") / len(kinds) if kinds else None)
    return out


@pytest.mark.parametrize("block", [8, 128])
def test_focal_statistics(spark, block):
    rng = random.Random(2)
    cells = [(i, i // 25 - 9, i % 25 - 9, rng.choice([None, rng.randrange(100)]), rng.choice([None, float("nan"), rng.random()]), rng.choice([None, "a", "b", "c"]))
             for i in range(700) if rng.random() < 0.6]
    cells.append((9999, 500, -500, 7, None, None))  # far from all
    df = spark.createDataFrame([(*c, "clash") for c in cells], "cell_id long, row int, col int, people int, height double, kind string, _v0 string")
    out = focal.focal_statistics(df, [0, 1, 2.5], ["people"], ["height"], {"kind": ["a", "b"]}, block=block)
    assert out.count() == 3 * len(cells)
    for radius in (0, 1, 2.5):
        got = {r["cell_id"]: r for r in out.filter(F.col("radius") == radius).collect()}
        for key, want in brute_focal(cells, radius).items():
            r = got[key]
            assert (r["n_cells"], r["sum_people"]) == want[:2]
            for name, w in zip(("mean_height", "share_kind_0", "share_kind_1"), want[2:]):
                assert r[name] is None if w is None else abs(r[name] - w) < 1e-9
    assert focal.focal_statistics(df.limit(0), [1], ["people"]).count() == 0
    assert focal.focal_statistics(df.withColumn("row", F.lit(None).cast("int")), [1], ["people"]).count() == 0
    assert [w for _, w in focal.disc(5)] == [0, 3, 4, 4, 4, 5, 4, 4, 4, 3, 0]
    with pytest.raises(ValueError):
        focal.focal_statistics(df, [])


# --- positions -----------------------------------------------------------------------------------

def test_percentile_positions(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0.0, 0.0, 0.0, float(rng.randrange(30))]), rng.choice([float("nan"), float(rng.randrange(5))]), rng.choice([None, "x", "y"]), 1)
            for i in range(400)] + [(400, 5.0, 1.0, "alone", 1), (7, 3.0, 2.0, "x", 1)]
    df = spark.createDataFrame(rows, "cell_id long, a double, b double, unit string, total int")
    got = sorted((r["cell_id"], r["variable"], r["value"], round(r["position"], 9), round(r["position_within"], 9))
                 for r in positions.percentile_positions(df, ["a", "b"], "unit").collect())
    want = []
    for k, name in ((1, "a"), (2, "b")):
        some = [r for r in rows if r[k] is not None and not math.isnan(r[k])]
        for r in some:
            def place(group):
                return round(100 * sum(x[k] < r[k] for x in group) / (len(group) - 1), 9) if len(group) > 1 else 0.0
            want.append((r[0], name, r[k], place(some), place([x for x in some if x[3] == r[3]])))
    assert got == sorted(want)
    assert positions.percentile_positions(df.limit(0), ["a"]).count() == 0


# --- travel times --------------------------------------------------------------------------------

def dijkstra(roads, start):
    back = {}
    for s, t, c in roads:
        if c is not None and c >= 0:
            back.setdefault(t, []).append((s, c))
    best, queue = {}, [(0, start)]
    while queue:
        d, v = heapq.heappop(queue)
        if v not in best:
            best[v] = d
            for s, c in back.get(v, ()):
                heapq.heappush(queue, (d + c, s))
    return best


def test_travel_times_equal_dijkstra(spark):
    rng = random.Random(4)
    side = 18
    places = {y * side + x: (x, y) for y in range(side) for x in range(side)}
    roads = []
    for v, (x, y) in places.items():
        for w in ([v + 1] if x + 1 < side else []) + ([v + side] if y + 1 < side else []):
            for a, b in ((v, w), (w, v)):
                if rng.random() < 0.8:
                    roads.append((a, b, rng.choice([0, 1, 2, 5, 9])))
    roads += [(3, 200, 4), (3, 200, 2), (200, 300, None), (10, 11, -1), (5, 5, 1), (8, 9999, 1)]
    points = spark.createDataFrame([(v, float(x), float(y)) for v, (x, y) in places.items()] + [(5000, None, None)], "vertex long, x double, y double")
    parts = overlay.spatial_partitions(points, 40)
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 100 and sum(sizes) == len(places) + 1
    edges = spark.createDataFrame(roads, "source long, target long, cost long")
    targets = spark.createDataFrame([(0, 100), (170, 101), (17, 100), (323, 7), (7777, 8), (0, 100)], "vertex long, facility long")
    graph = overlay.build_overlay(edges, parts)
    got = {(r["vertex"], r["facility"]): r["cost"] for r in overlay.travel_time_matrix(graph, targets).collect()}
    real = [r for r in roads if r[1] != 9999]
    want = {}
    for v, f in [(0, 100), (17, 100), (170, 101), (323, 7)]:
        for u, d in dijkstra(real, v).items():
            want[u, f] = min(d, want.get((u, f), d))
    assert got == want
    near = {(r["vertex"], r["facility"]): r["cost"] for r in overlay.travel_time_matrix(graph, targets, 12).collect()}
    assert near == {k: d for k, d in want.items() if d <= 12}
    first = {r["vertex"]: (r["facility"], r["cost"]) for r in overlay.nearest_facilities(overlay.travel_time_matrix(graph, targets)).collect()}
    assert first == {u: min(((d, f) for (x, f), d in want.items() if x == u))[::-1] for u in {x for x, _ in want}}
    assert overlay.travel_time_matrix(graph, targets.limit(0)).count() == 0


def test_long_chain_takes_rounds_by_partition(spark, monkeypatch):
    n = 5000
    points = spark.range(n).selectExpr("id AS vertex", "CAST(id AS DOUBLE) AS x", "0.0 AS y")
    edges = spark.range(n - 1).selectExpr("id AS source", "id + 1 AS target", "1 AS cost")
    graph = overlay.build_overlay(edges, overlay.spatial_partitions(points, 1000))
    assert graph.links.count() < 20
    out = overlay.travel_time_matrix(graph, spark.createDataFrame([(n - 1, 1)], "vertex long, facility long"))
    assert out.count() == n and out.filter(F.col("cost") != n - 1 - F.col("vertex")).count() == 0


def test_rounds_do_not_follow_the_number_of_partitions(spark, monkeypatch):
    n, rounds = 4000, []
    points = spark.range(n).selectExpr("id AS vertex", "CAST(id AS DOUBLE) AS x", "0.0 AS y")
    edges = spark.range(n - 1).selectExpr("id AS source", "id + 1 AS target", "1 + id % 3 AS cost")
    edges = edges.union(edges.selectExpr("target", "source", "2 + cost"))
    graph = overlay.build_overlay(edges, overlay.spatial_partitions(points, 20))
    relax = network._relax
    monkeypatch.setattr(network, "_relax", lambda *a: rounds.append(1) or relax(*a))
    targets = [(0, 1), (n // 2, 2), (n - 1, 2)]
    out = {(r["vertex"], r["facility"]): r["cost"] for r in overlay.travel_time_matrix(graph, spark.createDataFrame(targets, "vertex long, facility long")).collect()}
    ahead = np.concatenate([[0], np.cumsum(1 + np.arange(n - 1) % 3)])
    back = np.concatenate([[0], np.cumsum(3 + np.arange(n - 1) % 3)])
    want = {}
    for v, f in targets:
        for u in range(n):
            d = ahead[v] - ahead[u] if u <= v else back[u] - back[v]
            want[u, f] = min(float(d), want.get((u, f), float(d)))
    assert out == want
    assert 0 < len(rounds) <= 30  # some 200 partitions are crossed


# --- default ranges --------------------------------------------------------------------------------

def test_default_range_of_the_whole_registry(spark):
    names = [v.id for v in REGISTRY.variables if v.dtype != "cat" and "filter" in v.roles]
    stats = spark.createDataFrame([(n, 1.0, 9.0) for n in names], "variable string, p02 double, p98 double")
    got = {r["variable"]: (r["lo"], r["hi"]) for r in default_range(REGISTRY, stats).collect()}
    assert got == {n: tuple(map(float, REGISTRY[n].filter_range or (1, 9))) for n in names}
