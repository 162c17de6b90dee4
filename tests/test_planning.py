"""Crosswalks, typologies, the vulnerability index, mergers and contracts: small cases, awkward rows, brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from demogrid.operators import contracts, crosswalk, mergers, typology, vulnerability
from demogrid.operators.contracts import Rule


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- crosswalk -----------------------------------------------------------------------------------

BRIDGE = "source string, target string, weight double"


def test_crosswalk_over_three_censuses(spark):
    # A splits in 1 : 2, B and C merge, D is unknown later on, E has no weight
    first = crosswalk.bridge(spark.createDataFrame([("A", "A1", 1.0), ("A", "A2", 2.0), ("B", "BC", 5.0), ("C", "BC", 3.0), ("C", "BC", 4.0), ("D", "D1", 1.0),
                                                    ("E", "E1", 0.0), ("E", None, 1.0), ("E", "E2", float("nan"))], BRIDGE))
    second = crosswalk.bridge(spark.createDataFrame([("A1", "X", 1.0), ("A2", "X", 1.0), ("A2", "Y", 1.0), ("A2", "Z", 1.0), ("BC", "BC", 9.0)], BRIDGE))
    third = crosswalk.bridge(spark.createDataFrame([("X", "W", 1.0), ("Y", "W", 1.0), ("Z", "W", 1.0), ("BC", "B", 1.0), ("BC", "C", 1.0)], BRIDGE))
    both = crosswalk.chain([first, second])
    assert [(a, b, round(s, 9)) for a, b, s in rows(both)] == [
        ("A", "X", round(1 / 3 + 2 / 9, 9)), ("A", "Y", round(2 / 9, 9)), ("A", "Z", round(2 / 9, 9)), ("B", "BC", 1.0), ("C", "BC", 1.0), ("D", "D1", 1.0)]
    people = spark.createDataFrame([("A", 10), ("B", 7), ("C", 5), ("D", 3), ("E", 2), ("A", 1), ("F", None), (None, 4)], "unit string, value long")
    # 11 of A: 6.11, 2.44, 2.44; the one left goes to the largest remainder, of equal ones to the smaller name
    assert rows(crosswalk.convert(people, both)) == [("BC", 12), ("D1", 3), ("E", 2), ("X", 6), ("Y", 3), ("Z", 2)]
    assert rows(crosswalk.convert(people, crosswalk.chain([first, second, third]))) == [("B", 7), ("C", 5), ("D1", 3), ("E", 2), ("W", 11)]
    exact = dict(rows(crosswalk.convert(people, both, whole=False)))
    assert abs(exact["X"] - 11 * 5 / 9) < 1e-6 and abs(sum(exact.values()) - 28) < 1e-9
    assert rows(crosswalk.unmatched(people.filter("value is not null"), both)) == [("E", 2)]
    assert crosswalk.convert(people.limit(0), both).count() == 0


def test_crosswalk_keeps_totals(spark):
    rng = random.Random(1)
    link = crosswalk.bridge(spark.createDataFrame([(f"s{i}", f"t{rng.randrange(30)}", rng.random()) for i in range(40) for _ in range(6)], BRIDGE))
    given = [(k, f"s{i}", rng.randrange(1000)) for i in range(45) for k in "ab"]
    out = crosswalk.convert(spark.createDataFrame(given, "k string, unit string, value long"), link, by=["k"]).collect()
    assert all(sum(r["value"] for r in out if r["k"] == k) == sum(v for x, _, v in given if x == k) for k in "ab") and min(r["value"] for r in out) >= 0


# --- typology ------------------------------------------------------------------------------------

def test_types_are_nearest_centres_and_stable(spark):
    rng = np.random.default_rng(2)
    middle = np.array([[0, 0, 0], [10, 0, 5], [0, 12, -5], [9, 9, 9]])
    values = [(int(i), *map(float, middle[i % 4] + rng.normal(size=3))) for i in range(400)] + [(400, None, float("nan"), 1.0), (401, 0.0, 0.0, 0.0), (401, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame([(*v, 7.0, "clash") for v in values], "cell_id long, a double, b double, c double, same double, type string")
    names = ["a", "b", "c", "same"]
    model = typology.fit_typology(df, names, 4)
    assert len(model.centres) == 4 and list(model.centres) == sorted(model.centres) and model.spreads[3] == 0
    back = typology.read_model(typology.model_table(spark, model))
    assert back == model
    again = typology.fit_typology(df.repartition(7), names, 4)
    assert np.allclose(again.centres, model.centres, atol=1e-6)
    got = [(r["cell_id"], r["type"]) for r in typology.with_class(df, back).collect()]
    z = lambda v: np.array([0.0 if x is None or math.isnan(x) or not s else (x - m) / s for x, m, s in zip((*v, 7.0), model.means, model.spreads)])
    want = [(v[0], 1 + int(np.argmin([round(((z(v[1:]) - np.array(c)) ** 2).sum(), 9) for c in model.centres]))) for v in values]
    assert sorted(got) == sorted(want)
    types = dict(got)
    assert all(len({types[i] for i in range(k, 400, 4)}) == 1 for k in range(4)) and len(set(types.values())) == 4
    assert len(typology.fit_typology(df.filter("cell_id = 401"), names, 4).centres) == 1
    none = typology.fit_typology(df.limit(0), names, 4)
    assert none.centres == () and typology.with_class(df, none).filter("type is not null").count() == 0


# --- vulnerability -------------------------------------------------------------------------------

def test_vulnerability_shares_missing_weights(spark):
    df = spark.createDataFrame([(1, 1.0, 9.0, "u"), (2, 2.0, None, "u"), (3, 3.0, 1.0, "v"), (4, None, float("nan"), "v")], "cell_id long, old double, green double, unit string")
    index = vulnerability.composite_index(df, {"old": 1, "green": -1}, {"even": {"old": 1, "green": 1}, "old": {"old": 2, "green": 0}, "odd": {"nothing": 1}})
    assert rows(index) == [(1, "even", 0.0, 3), (1, "old", 0.0, 3), (2, "even", 50.0, 2), (2, "old", 50.0, 2), (3, "even", 100.0, 1), (3, "old", 100.0, 1)]
    assert rows(vulnerability.rank_spread(index))[0] == (1, 2, 3, 3, 0.0)
    risk = vulnerability.exposed_risk(df.withColumn("people", F.lit(10)), index.filter("weighting = 'even'"), "unit", "people", F.col("cell_id") != 1)
    assert rows(risk) == [("u", "even", 20, 10, 5.0), ("v", "even", 10, 10, 10.0)]
    with pytest.raises(ValueError):
        vulnerability.composite_index(df, {"old": 1}, {"x": {"old": -1}})
    assert vulnerability.composite_index(df.limit(0), {"old": 1}, {"x": {"old": 1}}).count() == 0


# --- mergers -------------------------------------------------------------------------------------

def test_mergers_that_do_not_hang_together(spark):
    # units in a row, two columns each: 0 1 2 ... 39, and one on an island
    cells = [(r, c, c // 2, 1 + c % 3, None if c == 0 else float(c)) for r in range(3) for c in range(80)] + [(50, 50, 99, 5, 1.0), (None, 3, 1, 0, 1.0)]
    df = spark.createDataFrame(cells[:-1], "row int, col int, unit int, people int, height double")
    near = mergers.adjacency(mergers.cell_outlines(df))
    assert rows(near) == [(i, i + 1, 3.0) for i in range(39)]
    plans = [("chain", "all", u) for u in range(40)] + [("gap", "ends", u) for u in (0, 1, 5, 6, 99)] + [("gap", "one", 20), ("gap", "one", 20)]
    scenarios = spark.createDataFrame(plans, "scenario string, new_unit string, unit int")
    found = mergers.pieces(scenarios, near)
    assert rows(found.filter("scenario = 'gap'")) == [("gap", "ends", 0, 0), ("gap", "ends", 1, 0), ("gap", "ends", 5, 5), ("gap", "ends", 6, 5), ("gap", "ends", 99, 99),
                                                        ("gap", "one", 20, 20)]
    assert found.filter("scenario = 'chain' and piece = 0").count() == 40
    told = {(r["scenario"], r["new_unit"], r["indicator"]): r["value"] for r in mergers.merge_indicators(
        df, scenarios, near, {"people": F.col("people")}, {"height": F.col("height")}, F.col("people")).collect()}
    assert told["gap", "ends", "pieces"] == 3 and told["chain", "all", "pieces"] == 1 and told["gap", "one", "units"] == 1
    assert told["chain", "all", "border"] == 2 * (80 + 3) and told["gap", "one", "border"] == 10 and told["gap", "ends", "border"] == 4 + 2 * 14
    assert told["chain", "all", "people"] == sum(c[3] for c in cells[:240]) and told["gap", "ends", "area"] == 25
    mine = [c for c in cells[:240] if c[2] < 40 and c[4] is not None]
    assert abs(told["chain", "all", "height"] - sum(c[3] * c[4] for c in mine) / sum(c[3] for c in mine)) < 1e-9
    limits = spark.createDataFrame([("pieces", False, 1.0, 2.0), ("area", True, 100.0, 25.0)], "indicator string, more_is_better boolean, green double, amber double")
    lights = {(r["scenario"], r["new_unit"], r["indicator"]): r["light"] for r in mergers.judged(mergers.merge_indicators(
        df, scenarios, near, {"people": F.col("people")}, {}, F.col("people")), limits).collect()}
    assert [lights[k] for k in (("chain", "all", "pieces"), ("gap", "ends", "pieces"), ("gap", "ends", "area"), ("gap", "one", "area"), ("gap", "one", "units"))] == [
        "green", "red", "amber", "red", None]
    assert mergers.pieces(scenarios.limit(0), near).count() == 0


# --- contracts -----------------------------------------------------------------------------------

def test_each_kind_of_violation_is_counted(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (1, float("nan"), "y"), (2, 7.0, None), (None, -3.0, "z")], "id long, v double, k string")
    b = spark.createDataFrame([(1,), (1,), (None,)], "key long")
    rules = [Rule("a", "type", "id", "bigint"), Rule("a", "type", "v", "int"), Rule("a", "required", "id"), Rule("a", "required", "v"), Rule("a", "range", "v", (0, 5)),
             Rule("a", "range", "v", (None, None)), Rule("a", "allowed", "k", ("x", "y")), Rule("a", "allowed", "k", ()), Rule("a", "unique", "id"),
             Rule("a", "reference", "id", "key", "b"), Rule("a", "total", "v", (5.0, 0.5)), Rule("a", "total", "v", (6.0, 0.5)), Rule("a", "unique", "gone"), Rule("b", "unique", "key")]
    got = [r["violations"] for r in contracts.check_contracts({"a": a, "b": b}, rules).collect()]
    names = [(r["table"], r["kind"], r["column"]) for r in contracts.check_contracts({"a": a, "b": b}, rules).collect()]
    want = {("type", "id"): [0], ("type", "v"): [4], ("required", "id"): [1], ("required", "v"): [1], ("range", "v"): [2, 0], ("allowed", "k"): [1, 3], ("unique", "id"): [1],
            ("reference", "id"): [1], ("total", "v"): [0, 1], ("unique", "gone"): [4], ("unique", "key"): [1]}
    told = {}
    for (_, kind, column), v in zip(names, got):
        told.setdefault((kind, column), []).append(v)
    assert told == want
    empty = contracts.check_contracts({"a": a.limit(0), "b": b.limit(0)}, rules).collect()
    assert sum(r["violations"] for r in empty) == 2
    with pytest.raises(KeyError):
        contracts.check_contracts({"a": a}, [Rule("c", "required", "id")])
    with pytest.raises(ValueError):
        contracts.check_contracts({"a": a}, [Rule("a", "odd", "id")])


def test_products_are_compared_cell_by_cell(spark):
    a = spark.createDataFrame([(i, float(i), None if i % 10 == 0 else 1.0) for i in range(3000)], "cell_id long, p double, q double")
    b = a.filter("cell_id <> 5").withColumn("p", F.when(F.col("cell_id") == 7, 0.0).otherwise(F.col("p") + 1e-9)).withColumn(
        "q", F.when(F.col("cell_id") == 20, 1.0).when(F.col("cell_id") == 30, float("nan")).otherwise(F.col("q")))
    assert rows(contracts.compare_products(a, b, "cell_id", ["p", "q"])) == [("p", 2999, 1, 1), ("q", 2999, 1, 1)]
    some = contracts.compare_products(a, b, "cell_id", ["p"], sample=1000)
    n = some.first()["compared"]
    assert 850 < n < 1150 and some.first()["compared"] == contracts.compare_products(a, b, "cell_id", ["p"], sample=1000).first()["compared"]
    assert rows(contracts.compare_products(a.limit(0), b.limit(0), "cell_id", ["p"], sample=10)) == [("p", 0, 0, 0)]
