"""The live jobs over several rounds, with sources that fail, lag behind and come back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import forecast as W
from ..plans import live as L
from ..session import scratch_path, staged
from ..sources import feeds as X
from ..streaming.jobs import Snapshot
from .air_weather import _AIR, _MAP, _ladder_sql, _mapping
from .base import query
from .warnings import _general_xml, _nowcast_xml


def _fails():
    raise L.SourceError("no answer")


def _forecast(t) -> Snapshot:
    """Three rounds: both sources good; air fails; weather offers an older run and is refused, air is back."""
    target = Snapshot(t.spark, scratch_path(t.spark, "forecast"))
    mapping = _mapping(t)

    def run(table, day):
        return lambda: (f"202401{day}00", table.filter(F.col("valid_time") >= F.lit(f"2024-01-{day}").cast("timestamp")))

    for weather, air, day in ((run(t.kelvin, 10), run(t.air_hourly, 10), 10), (run(t.kelvin, 15), _fails, 15), (run(t.kelvin, 12), run(t.air_hourly, 15), 16)):
        L.refresh_forecast(target, [L.weather_source(weather, 1, only_complete=False), L.air_source(air)], mapping, t.core, dt.date(2024, 1, day))
    return target


_KEL = """kr AS (SELECT grid_id, CAST(valid_time - INTERVAL 90 MINUTE + INTERVAL 2 HOUR AS DATE) AS valid_date, MIN(min_k - 273.15) AS tmin, MAX(max_k - 273.15) AS tmax
 FROM kelvin WHERE valid_time >= TIMESTAMP '2024-01-15' GROUP BY 1, 2)"""
_AIR_RUN = ("ar AS (SELECT * FROM air_hourly WHERE valid_time >= TIMESTAMP '2024-01-15'), " + _AIR.replace("air_hourly", "ar")
            + """, full_days AS (SELECT CAST(valid_time + INTERVAL 2 HOUR AS DATE) AS d FROM ax GROUP BY 1 HAVING COUNT(*) >= 24),
ad AS (SELECT grid_id, CAST(valid_time + INTERVAL 2 HOUR AS DATE) AS valid_date FROM aq WHERE CAST(valid_time + INTERVAL 2 HOUR AS DATE) IN (SELECT d FROM full_days)
 GROUP BY 1, 2 HAVING COUNT(value) > 0)""")


@query("live_forecast_entries", "kelvin air_hourly", f"""
WITH {_KEL}, {_AIR_RUN}
SELECT 'weather' AS source, '2024011500' AS run, FALSE AS ok, COUNT(DISTINCT valid_date) FILTER (valid_date >= DATE '2024-01-16') AS n_days,
 MIN(valid_date) FILTER (valid_date >= DATE '2024-01-16') AS first_day, COUNT(*) AS n_rows, 2 AS n_runs FROM kr
UNION ALL SELECT 'air', '2024011500', TRUE, COUNT(DISTINCT valid_date), MIN(valid_date), COUNT(*), 2 FROM ad""")
def _(t):
    target = _forecast(t)
    runs = target.read("runs").groupBy("source").agg(F.count(F.lit(1)).alias("n_runs"))
    path = {r["source"]: r["path"] for r in target.read("entries").select("source", "path").collect()}
    rows = [t.spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(s).alias("source"), "n_rows") for s, p in path.items()]
    return target.read("entries").join(rows[0].unionByName(rows[1]), "source").join(runs, "source").select(
        "source", "run", "ok", F.size("days").cast("bigint").alias("n_days"), F.array_min("days").alias("first_day"), "n_rows", F.col("n_runs").cast("int").alias("n_runs"))


@query("live_forecast_products", "kelvin points nodes core", f"""
WITH {_MAP}, kn AS (SELECT grid_id, MAX(max_k - 273.15) AS tmax, MIN(min_k - 273.15) AS tmin FROM kelvin WHERE valid_time >= TIMESTAMP '2024-01-15' GROUP BY 1),
cc AS (SELECT cell_id, SUM(weight * tmax) / NULLIF(SUM(CASE WHEN tmax IS NOT NULL THEN weight END), 0) AS tmax,
 SUM(weight * tmin) / NULLIF(SUM(CASE WHEN tmin IS NOT NULL THEN weight END), 0) AS tmin FROM m LEFT JOIN kn ON kn.grid_id = m.grid_id GROUP BY 1),
cv AS (SELECT cell_id, tmax AS x, pop_total FROM cc JOIN core USING (cell_id)), {_ladder_sql(W.HEAT_LADDER, '>=', 'MAX')},
cv2 AS (SELECT cell_id, tmin AS x, pop_total FROM cc JOIN core USING (cell_id)),
{_ladder_sql(W.COLD_LADDER, '<=', 'MIN').replace('lad AS', 'lad2 AS').replace('FROM lad)', 'FROM lad2)').replace('pick AS', 'pick2 AS').replace('cv', 'cv2')}
SELECT 'heat' AS product, CAST(COALESCE(threshold, 35) AS INT) AS threshold, threshold IS NOT NULL AS active FROM pick
UNION ALL SELECT 'cold', CAST(COALESCE(threshold, -10) AS INT), threshold IS NOT NULL FROM pick2 UNION ALL SELECT 'air_poor', 3, FALSE""")
def _(t):
    """After the second round: a good weather run, no air."""
    target = Snapshot(t.spark, scratch_path(t.spark, "forecast"))
    steps = t.kelvin.filter(F.col("valid_time") >= F.lit("2024-01-15").cast("timestamp"))
    L.refresh_forecast(target, [L.weather_source(lambda: ("2024011500", steps), 1, only_complete=False), L.air_source(_fails)],
                       _mapping(t), t.core, dt.date(2024, 1, 15))
    return target.read("products").select("product", F.col("threshold").cast("int").alias("threshold"), "active")


def _warnings(t) -> Snapshot:
    """Three rounds: both feeds, the general one over all messages; only nowcasting; neither."""
    target = Snapshot(t.spark, scratch_path(t.spark, "warnings"))

    def nowcasting():
        m = staged(X.nowcasting_messages(X.parse_elements(_nowcast_xml(t), "xml", X.NOWCASTING_SCHEMA)), "nowcasting")
        return m, m.drop("wkt", "pos", "srid")

    def general():
        rows = staged(_general_xml(t), "general")
        f = staged(X.general_features(rows), "features")
        return f, X.general_messages(rows, f)

    for feeds in ({"nowcasting": _fails, "general": general}, {"nowcasting": nowcasting, "general": _fails}, {"nowcasting": _fails, "general": _fails}):
        L.refresh_warnings(target, feeds, t.points, t.core)
    return target


_NOWF = """f AS (SELECT *, CAST(FLOOR(id / 4) AS BIGINT) AS wid, ROW_NUMBER() OVER (PARTITION BY FLOOR(id / 4) ORDER BY id) AS k FROM messages WHERE source = 'nowcasting'),
nw AS (SELECT CAST(wid AS VARCHAR) AS id, CASE level_rank WHEN 3 THEN 1 ELSE level_rank END AS rank, level_rank <> 0 AS drawn, cx, cy FROM f WHERE k = 1),
nh AS (SELECT b.id, b.rank, p.cell_id, c.pop_total FROM points p JOIN nw b ON drawn AND p.x > b.cx - 1500 AND p.x < b.cx + 1500 AND p.y > b.cy - 1500 AND p.y < b.cy + 1500
 JOIN core c ON c.cell_id = p.cell_id)"""


@query("live_warnings_sources", "messages points core", f"""
WITH {_NOWF}, tot AS (SELECT CAST(SUM(pop_total) AS BIGINT) AS n FROM (SELECT DISTINCT cell_id, pop_total FROM nh) z)
SELECT 'nowcasting' AS source, TRUE AS ok, (SELECT n FROM tot) AS total_affected, (SELECT COUNT(*) FROM nw) AS n_messages, (SELECT n FROM tot) AS combined
UNION ALL SELECT 'general', FALSE, 0, 0, (SELECT n FROM tot)""")
def _(t):
    from ..functions.columns import attach

    target = _warnings(t)
    return attach(target.read("sources").select("source", "ok", "total_affected", "n_messages"),
                  target.read("combined").select(F.col("pop").alias("combined")))


@query("live_warnings_messages", "messages points core", f"""
WITH {_NOWF} SELECT nw.id, CAST(nw.rank AS INT) AS level_rank, CAST(COALESCE(p.pop, 0) AS BIGINT) AS affected_pop
FROM nw LEFT JOIN (SELECT id, SUM(pop_total) AS pop FROM nh GROUP BY 1) p ON p.id = nw.id""")
def _(t):
    return _warnings(t).read("messages").select("id", "level_rank", "affected_pop")
