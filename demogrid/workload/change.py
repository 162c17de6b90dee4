"""Population change between censuses on the test tables: a cell's people are the orders of a customer up to a year."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import change
from .base import BINDINGS, query

BINDINGS["census_cells"] = """
SELECT c_custkey AS cell_id, c_nationkey AS county,
  CASE WHEN c_acctbal < 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(COALESCE(p1, 0) AS DOUBLE) END AS pop_1993, COALESCE(p2, 0) AS pop_1995,
  CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 5 = 0 THEN NULL ELSE COALESCE(p3, 0) END AS pop_1998
FROM customer LEFT JOIN (
  SELECT o_custkey, CAST(SUM(CASE WHEN YEAR(o_orderdate) <= 1993 THEN FLOOR(o_totalprice / 10000) ELSE 0 END) AS BIGINT) AS p1,
    CAST(SUM(CASE WHEN YEAR(o_orderdate) BETWEEN 1993 AND 1995 THEN FLOOR(o_totalprice / 10000) ELSE 0 END) AS BIGINT) AS p2,
    CAST(SUM(CASE WHEN YEAR(o_orderdate) > 1995 THEN FLOOR(o_totalprice / 10000) ELSE 0 END) AS BIGINT) AS p3 FROM orders GROUP BY 1) o ON o_custkey = c_custkey"""

_PAIRS = """
p AS (SELECT cell_id, county, 1993 AS year_from, 1995 AS year_to, CASE WHEN NOT isnan(pop_1993) THEN pop_1993 END AS b, CAST(pop_1995 AS DOUBLE) AS a, FALSE AS estimated FROM census_cells
 UNION ALL SELECT cell_id, county, 1995, 1998, CAST(pop_1995 AS DOUBLE), CAST(pop_1998 AS DOUBLE), TRUE FROM census_cells),
k AS (SELECT *, CASE WHEN b IS NULL OR a IS NULL THEN 'missing' WHEN b = 0 AND a = 0 THEN 'empty' WHEN b = 0 THEN 'settled' WHEN a = 0 THEN 'abandoned'
 WHEN a > b THEN 'grown' WHEN a < b THEN 'shrunk' ELSE 'same' END AS kind FROM p)"""
_RATES = """ROUND((a - b) / NULLIF(b, 0), 6) AS share,
 ROUND(CASE WHEN a > 0 AND b > 0 THEN pow(a / b, 1.0 / (year_to - year_from)) - 1 END, 6) AS yearly"""


def _changes(t):
    return change.population_change(t.census_cells, [(1998, "pop_1998"), (1993, "pop_1993"), (1995, "pop_1995")], ["cell_id", "county"], [1998])


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("share", "yearly")})


@query("x14_population_change", "census_cells", f"""
WITH {_PAIRS} SELECT cell_id, county, year_from, year_to, b AS before, a AS after, a - b AS change, {_RATES}, kind, estimated FROM k""")
def _(t):
    return _rounded(_changes(t))


@query("x14_change_by_county", "census_cells", f"""
WITH {_PAIRS}, s AS (SELECT county, year_from, year_to, SUM(CASE WHEN kind <> 'missing' THEN b END) AS b, SUM(CASE WHEN kind <> 'missing' THEN a END) AS a,
 {", ".join(f"COUNT(*) FILTER (kind = '{k}') AS n_{k}" for k in change.KINDS)} FROM k GROUP BY 1, 2, 3)
SELECT county, year_from, year_to, b AS before, a AS after, a - b AS change, {_RATES}, {", ".join(f"n_{k}" for k in change.KINDS)} FROM s""")
def _(t):
    return _rounded(change.change_by(_changes(t), "county"))
