"""Random constraint trees against three-valued logic row by row; disclosure control against an attacker."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from demogrid.model import Between, In, Registry, Variable
from demogrid.operators import disclosure
from demogrid.operators.questions import Atlas
from demogrid.operators.trees import And, Compare, Flag, Measure, Not, Or, Polygon, Radius, answer, cells_where, required_tables

REG = Registry((Variable("people", "core", "int"), Variable("x", "core", "float"), Variable("y", "core", "float"), Variable("height", "env", "float"),
                Variable("kind", "env", "cat"), Variable("coast", "env", "int"), Variable("warm", "climate", "float")), ("people",))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(1)
    pick = lambda *v: rng.choice(v)
    core = [(i, pick(None, 1, 5, 9), float(rng.randrange(20)), float(rng.randrange(20))) for i in range(300)]
    env = [(i, pick(None, float("nan"), 0.1, 1.5, 3.0), pick(None, "a", "b", "c"), pick(None, 0, 1)) for i in range(300) if rng.random() < 0.7]
    climate = [(i, pick(None, float("nan"), -1.0, 2.0, 4.5)) for i in range(300) if rng.random() < 0.6]
    atlas = Atlas(spark.createDataFrame(core, "cell_id long, people int, x double, y double"),
                  spark.createDataFrame(env, "cell_id long, height float, kind string, coast int").withColumn("extra", F.lit(1)),
                  spark.createDataFrame(climate, "cell_id long, warm double").withColumn("extra", F.lit(2)), REG)
    cells = {r[0]: dict(zip(("people", "x", "y"), r[1:])) for r in core}
    for r in env:
        cells[r[0]] |= {"height": r[1] if r[1] is None else float(np.float32(r[1])), "kind": r[2], "coast": r[3], "env": True}
    for r in climate:
        cells[r[0]] |= {"warm": r[1], "climate": True}
    return atlas, cells


RING = ((1.0, 1.0), (18.5, 2.0), (9.0, 17.0), (8.5, 6.5), (2.0, 15.0))


def value(cell, node):
    """True, False or None."""
    if isinstance(node, Not):
        v = value(cell, node.child)
        return None if v is None else not v
    if isinstance(node, And | Or):
        vs = [value(cell, c) for c in node.children]
        short = isinstance(node, Or)
        return short if short in vs else None if None in vs else not short
    if isinstance(node, Radius):
        return (cell["x"] - node.x) ** 2 + (cell["y"] - node.y) ** 2 <= node.metres ** 2
    if isinstance(node, Polygon):
        x, y = cell["x"], cell["y"]
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(RING, RING[1:] + RING[:1])) % 2 == 1
    table = REG[node.var].table
    v = cell.get(node.var)
    nothing = (isinstance(node, In) and not node.values) or (isinstance(node, Between) and node.min is None and node.max is None)
    if nothing:
        return True if table == "core" or cell.get(table) else None
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    low = lambda b: float(np.float32(b)) if node.var == "height" else b
    if isinstance(node, Flag):
        return bool(v) == node.value
    if isinstance(node, In):
        return v in node.values
    if isinstance(node, Compare):
        w = node.value if isinstance(node.value, str) else low(node.value)
        return {"<": v < w, "<=": v <= w, ">": v > w, ">=": v >= w, "=": v == w}[node.op]
    return (node.min is None or v >= low(node.min)) and (node.max is None or (v <= low(node.max) if node.max_inclusive else v < low(node.max)))


def random_tree(rng, depth):
    if depth and rng.random() < 0.8:
        kind = rng.choice([And, Or, Not])
        return Not(random_tree(rng, depth - 1)) if kind is Not else kind(tuple(random_tree(rng, depth - 1) for _ in range(rng.randrange(0 if depth < 2 else 1, 4))))
    return rng.choice([Between("height", 0.1, 3), Between("height", None, 0.1, True), Between("warm", None, None), In("kind", ("a", "c")), In("kind"),
                       Compare("kind", "=", "b"), Compare("people", ">", 4), Compare("warm", "<=", 2.0), Compare("height", ">=", 0.1), Flag("coast"), Flag("coast", False),
                       Radius(9.5, 9.5, 6.0), Polygon(RING), Between("people", 1, 9)])


def test_random_trees(world):
    atlas, cells = world
    rng = random.Random(2)
    sizes = []
    for _ in range(40):
        tree = random_tree(rng, 3)
        got = sorted(r["cell_id"] for r in cells_where(atlas, tree).select("cell_id").collect())
        want = sorted(i for i, c in cells.items() if value(c, tree) is True)
        assert got == want, tree
        sizes.append(len(want))
    assert len([s for s in sizes if 0 < s < 300]) > 20


def test_joins_follow_the_tree(world, tmp_path, spark):
    atlas, _ = world
    env, climate = Compare("height", ">", 1.0), Compare("warm", ">", 1.0)
    need = lambda n: sorted(required_tables(REG, n))
    assert need(And((env, climate))) == ["climate", "env"] and need(Or((env, climate))) == []
    assert need(Not(Or((env, climate)))) == ["climate", "env"] and need(Or((env, And((env, climate))))) == ["env"] and need(And(())) == need(Or(())) == []
    for name in ("core", "env", "climate"):
        atlas.table(name).write.parquet(f"{tmp_path}/{name}")
    stored = Atlas(*(spark.read.parquet(f"{tmp_path}/{n}") for n in ("core", "env", "climate")), REG)

    def plan(tree):
        return cells_where(stored, tree)._jdf.queryExecution().executedPlan().toString()
    both = plan(And((env, Or((climate, Compare("people", ">", 3))))))
    assert "GreaterThan(height" in both and "LeftOuter" in both and "Inner" in both and "kind" not in both and "extra" not in both
    assert "climate" not in plan(And((env, In("kind", ("a",))))) and "LeftOuter" not in plan(And((env, climate)))
    with pytest.raises(KeyError):
        cells_where(atlas, Compare("nowhere", ">", 1))
    with pytest.raises(ValueError):
        cells_where(atlas, Compare("warm", "~", 1))


def test_answers(world):
    atlas, cells = world
    tree = Or((Compare("warm", ">", 0.0), In("kind", ("a", "b"))))
    mine = [c for c in cells.values() if value(c, tree)]
    measures = [Measure("s", "sum", "people"), Measure("n", "count_cells"), Measure("m", "mean", "warm"), Measure("w", "weighted_mean", "warm", "people"),
                Measure("q", "quantile", "warm", q=0.5), Measure("wq", "quantile", "warm", "people", 0.5)]
    r = answer(atlas, tree, measures).first()
    warm = sorted(c["warm"] for c in mine if c.get("warm") is not None and not math.isnan(c["warm"]))
    assert (r["s"], r["n"]) == (sum(c["people"] or 0 for c in mine), len(mine)) and abs(r["m"] - sum(warm) / len(warm)) < 1e-9
    assert r["q"] == np.quantile(warm, 0.5)
    none = answer(atlas, Compare("people", ">", 99), measures).first()
    assert (none["s"], none["n"], none["m"], none["q"]) == (0, 0, None, None)
    rows = {(x["_level"], x["kind"]): x for x in answer(atlas, tree, measures, ("kind",), totals=True).collect()}
    assert rows[0, None]["n"] == len(mine) and {k for l, k in rows if l == 1} == {c.get("kind") for c in mine}
    assert rows[1, None]["s"] == sum(c["people"] or 0 for c in mine if c.get("kind") is None)


# --- disclosure --------------------------------------------------------------------------------------

def recovered(shown):
    """Hidden figures that sums of shown ones determine: unknowns whose unit vector lies in the span of the sums."""
    keys = list(shown)
    unknown = [k for k in keys if shown[k] is None]
    column = {k: i for i, k in enumerate(unknown)}
    rows = []
    for k in keys:
        parts = [p for p in keys if len(p) == len(k) + 1 and p[:len(k)] == k]
        if parts:
            row = np.zeros(len(unknown))
            for p, sign in [(k, 1), *[(p, -1) for p in parts]]:
                if shown[p] is None:
                    row[column[p]] += sign
            rows.append(row)
    if not unknown or not rows:
        return []
    space = np.array(rows)
    rank = np.linalg.matrix_rank(space)
    return [k for k in unknown if np.linalg.matrix_rank(np.vstack([space, np.eye(len(unknown))[column[k]]])) == rank]


@pytest.mark.parametrize("seed", range(6))
def test_attacker_recovers_nothing(spark, seed):
    rng = random.Random(seed)
    cells = []
    for region in range(rng.randrange(1, 6)):
        for county in range(rng.randrange(1, 5)):
            for town in range(rng.randrange(1, 4)):
                cells += [(f"r{region}" if region else None, f"c{county}", f"t{town}", rng.choice([None, 0, 1, 9, 30]), rng.choice([True, False, False, None]), 5)
                          for _ in range(rng.choice([1, 2, 6, 9]))]
    levels = ["region", "county", "town"]
    df = spark.createDataFrame(cells, "region string, county string, town string, people int, sdc boolean, n int")
    out = disclosure.protect(disclosure.nested_totals(df, levels, "people", "sdc"), levels, 4, 25).collect()
    shown = {tuple(r[c] or "none" for c in levels[: r["level"]]): r["value"] for r in out}
    assert len(shown) == len(out) and all((r["value"] is None) == (r["n"] is None) == r["hidden"] for r in out)
    assert recovered(shown) == []
    true = {}
    for k, c in itertools.product(range(4), cells):
        true.setdefault(tuple(x or "none" for x in c[:k]), []).append(c)
    for r in out:
        mine = true[tuple(r[c] or "none" for c in levels[: r["level"]])]
        people = sum(c[3] or 0 for c in mine)
        assert r["approximate"] == any(c[4] for c in mine) and (r["hidden"] or (r["n"], r["value"]) == (len(mine), people))
        assert r["hidden"] or (len(mine) >= 4 and people >= 25)
    # hidden parts of a shown sum are not small together
    for key, v in shown.items():
        hidden = [p for p in shown if len(p) == len(key) + 1 and p[:len(key)] == key and shown[p] is None]
        if v is not None and hidden:
            assert len(hidden) > 1 and sum(sum(c[3] or 0 for c in true[p]) for p in hidden) >= 25


def test_disclosure_edges(spark):
    none = spark.createDataFrame([], "region string, people int")
    out = disclosure.protect(disclosure.nested_totals(none, ["region"], "people"), ["region"], 1, 1).collect()
    assert [(r["level"], r["hidden"], r["value"]) for r in out] == [(0, True, None)]
    big = spark.createDataFrame([(c, 50) for c in "abc" for _ in range(9)], "region string, people int")
    out = disclosure.protect(disclosure.nested_totals(big, ["region"], "people"), ["region"], 3, 10).collect()
    assert not any(r["hidden"] or r["approximate"] for r in out) and sum(r["value"] for r in out if r["level"] == 1) == 1350
