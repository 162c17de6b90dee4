"""Semantics that are easy to lose."""

import pytest
from pyspark.sql import functions as F

from demogrid import Between, In, Question, Registry, Variable
from demogrid.functions.columns import nan_to_null, to_long
from demogrid.operators import measures as M
from demogrid.operators import questions as Q
from demogrid.operators.quantiles import interpolated_quantiles, weighted_quantiles

REG = Registry((Variable("d", "env", "float"), Variable("k", "env", "cat"), Variable("t", "climate", "float"), Variable("pop", "core", "int")), ("pop",))


@pytest.fixture()
def atlas(spark):
    core = spark.createDataFrame([(i, 10 * i) for i in range(1, 7)], "cell_id long, pop long")
    env = spark.createDataFrame([(1, 0.1, "a"), (2, 0.2, "b"), (3, float("nan"), "a"), (4, 5.0, None), (5, 0.0, "c"), (6, None, "a")], "cell_id long, d float, k string")
    climate = spark.createDataFrame([(1, 1.1), (2, 2.0)], "cell_id long, t float")
    return Q.Atlas(core, env, climate, REG)


def ids(df):
    return sorted(r.cell_id for r in df.collect())


def ask(*cs):
    return Question("pop", tuple(cs))


def test_nan_is_not_large(atlas):
    assert ids(Q.cell_values(atlas, ask(Between("d", 1)))) == [4]


def test_float_literals_compare_as_float(atlas):
    assert ids(Q.cell_values(atlas, ask(Between("d", None, 0.1, True)))) == [1, 5]
    assert ids(Q.cell_values(atlas, ask(Between("t", 1.1)))) == [1, 2]


def test_upper_bound_is_strict_unless_said(atlas):
    assert ids(Q.cell_values(atlas, ask(Between("d", None, 5)))) == [1, 2, 5]
    assert ids(Q.cell_values(atlas, ask(Between("d", None, 0, True)))) == [5]


def test_empty_membership_still_joins(atlas):
    assert ids(Q.cell_values(atlas, ask(In("k")))) == [1, 2, 3, 4, 5, 6]
    assert ids(Q.cell_values(atlas, ask(Between("t")))) == [1, 2]


def test_empty_selection_is_zero(atlas):
    assert tuple(Q.total(atlas, ask(Between("d", 100))).first()) == (0, 0)


def test_many_totals_agree_with_single_ones(atlas):
    qs = {"a": ask(Between("d", None, 5)), "b": ask(In("k", ("a",))), "c": ask(Between("t", 1.5)), "d": ask(Between("t")), "e": ask()}
    got = {r.label: (r.value, r.n_cells) for r in Q.many_totals(atlas, qs).collect()}
    assert got == {k: tuple(Q.total(atlas, q).first()) for k, q in qs.items()}


def test_profile_keeps_cells_without_climate(atlas):
    p = Q.profile(atlas, cell_id=4).first()
    assert p.pop == 40 and p.t is None


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(2.5,), (2.7,), (3.5,)], "x double")
    assert [r[0] for r in df.select(to_long(F.col("x"))).collect()] == [2, 3, 4]


def test_unknown_variables_are_pruned():
    q = REG.prune(ask(Between("d", 1), Between("gone", 1)))
    assert [c.var for c in q.constraints] == ["d"]
    assert REG.prune(Question("nobody")) is None


def test_threshold_override_keeps_the_rest():
    q = ask(Between("d", 1, 5), In("k", ("a",))).with_bound("d", "max", 7, True)
    assert q.constraints[0] == Between("d", 1, 7, True) and q.constraints[1] == In("k", ("a",))


def test_nan_to_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert df.filter("x IS NULL").count() == 1


def test_quantiles_equal_sorted_lists(spark):
    values = [((i * 7919) % 1000) / 7 for i in range(3000)] + [5.0] * 2000  # a third or more on one value
    df = spark.createDataFrame([(v, 1 + i % 3) for i, v in enumerate(values)], "x double, w long")
    got = {r.q: r.value for r in interpolated_quantiles(df, "x", [0.0, 0.02, 0.5, 0.98, 1.0]).collect()}
    s = sorted(values)
    for q, v in got.items():
        pos = q * (len(s) - 1)
        lo, hi = s[int(pos)], s[min(len(s) - 1, int(pos) + 1)]
        assert v == pytest.approx(lo + (hi - lo) * (pos - int(pos)))
    pairs = sorted((v, 1 + i % 3) for i, v in enumerate(values))
    total, cum, want = sum(w for _, w in pairs), 0, None
    for v, w in pairs:
        cum += w
        if want is None and cum >= 0.9 * total:
            want = v
    assert weighted_quantiles(df, "x", "w", [0.9]).first().value == want


def test_histogram_quantiles_saturate(spark):
    cells = spark.createDataFrame([("A", float(x), 1.0) for x in (-50, 0, 1, 2, 500)], "area string, x double, w double")
    spec = spark.createDataFrame([("x", 0.0, 12.0, 0.1)], "variable string, lo double, hi double, bw double")
    h = M.weighted_histogram(cells, spec, ["area"])
    got = {r.q: r.value for r in M.histogram_quantiles(h, spec, [0.99, 1.0], ["area"]).collect()}
    assert 11.9 < got[0.99] <= 12.0 and got[1.0] == pytest.approx(12.0)
