"""The registered queries against their SQL, on the smallest tables."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["pf01_half_open_range", "pf06_preset_catalogue", "pf07_flood_variants", "a07_weighted_quantiles", "a11_registry_statistics", "a16_golden_report",
          "j06_point_in_polygon_all", "j07_nearest_polygon_fallback", "j09_k_nearest_candidates", "g07_all_touched_coverage", "g10_distance_with_category",
          "a17_daily_accumulators", "a24_linear_trend_per_decade", "j12_weighted_interpolation", "a34_daily_air_quality", "src12_general_feed_messages",
          "a27_people_by_source_and_level", "n04_nearest_facility_by_network", "f03_ranked_name_search", "a37_gazetteer", "layer_built_up"]


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
    assert set(SAMPLE) <= set(o)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())
