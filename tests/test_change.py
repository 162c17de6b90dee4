"""Population change between censuses: missing figures, nobody, repeated cells, clashing names."""

import pytest

from demogrid.operators.change import change_by, population_change

SCHEMA = "cell_id long, county string, p6 double, p11 long, p18 long, kind string"
CENSUSES = [(2011, "p11"), (2006, "p6"), (2018, "p18")]
CELLS = [(1, "A", 100.0, 121, 121, "x"), (2, "A", 0.0, 0, 7, "x"), (3, "A", 50.0, 0, 0, None), (4, "B", float("nan"), 9, 3, "x"), (5, "B", None, None, None, "x"),
         (None, None, 8.0, 4, 4, "x"), (1, "A", 100.0, 121, 121, "x")]


def changes(spark, rows):
    return population_change(spark.createDataFrame(rows, SCHEMA), CENSUSES, ["cell_id", "county"], estimated=[2018])


def test_kinds_and_rates(spark):
    got = {(r["cell_id"], r["year_from"]): r for r in changes(spark, CELLS).collect()}
    kinds = {k: r["kind"] for k, r in got.items()}
    assert kinds == {(1, 2006): "grown", (1, 2011): "same", (2, 2006): "empty", (2, 2011): "settled", (3, 2006): "abandoned", (3, 2011): "empty",
                     (4, 2006): "missing", (4, 2011): "shrunk", (5, 2006): "missing", (5, 2011): "missing", (None, 2006): "shrunk", (None, 2011): "same"}
    assert got[1, 2006]["share"] == pytest.approx(0.21) and got[1, 2006]["yearly"] == pytest.approx(1.21 ** 0.2 - 1)
    assert got[2, 2011]["share"] is None and got[2, 2011]["yearly"] is None and got[2, 2011]["change"] == 7
    assert got[3, 2006]["share"] == -1 and got[3, 2006]["yearly"] is None
    assert got[4, 2006]["change"] is None and got[4, 2011]["estimated"] and not got[4, 2006]["estimated"]


def test_groups_sum_the_same_cells(spark):
    got = {(r["county"], r["year_from"]): r for r in change_by(changes(spark, CELLS), "county").collect()}
    a = got["A", 2006]  # the repeated cell counts twice
    assert (a["before"], a["after"], a["change"]) == (250.0, 242.0, -8.0)
    assert (a["n_grown"], a["n_empty"], a["n_abandoned"], a["n_missing"]) == (2, 1, 1, 0)
    b = got["B", 2006]
    assert (b["before"], b["after"], b["share"], b["n_missing"]) == (None, None, None, 2)
    assert (got["B", 2011]["before"], got["B", 2011]["n_shrunk"], got["B", 2011]["n_missing"]) == (9.0, 1, 1)
    assert got[None, 2006]["change"] == -4.0


def test_empty_table_and_too_few_censuses(spark):
    assert changes(spark, []).count() == 0 and change_by(changes(spark, []), "county").count() == 0
    with pytest.raises(ValueError):
        population_change(spark.createDataFrame(CELLS, SCHEMA), [(2011, "p11")])
    with pytest.raises(ValueError):
        population_change(spark.createDataFrame(CELLS, SCHEMA), [(2011, "p11"), (2011, "p18")])
