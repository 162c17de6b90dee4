"""Travel times over large road graphs by an overlay of partition borders.

Vertices are dealt to spatial partitions of bounded size. Inside each partition, in one task, shortcuts between its border
vertices are solved; the overlay graph has these shortcuts and the roads between partitions. A search settles the partition of
each facility, runs over the overlay, whose rounds follow the partitions crossed instead of the roads, and is then filled in for
the inner vertices, partition by partition.

A search without a limit crosses the whole graph, so neighbouring partitions are joined to larger ones whose borders get shortcuts
of their own, level by level, until few are left: its rounds follow the logarithm of the number of partitions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import attach
from ..session import cut_lineage
from .network import _fixpoint

PART_VERTICES = 1024  # of a partition, about
CELLS = 2_000_000  # distances that a task holds at once
FAN = 8  # neighbouring partitions that make one of the next level
PAYS = 4  # shortcuts for each link they are made of, up to which a level is worth its while


def _spread(v: Column) -> Column:
    """Sixteen bits with a zero before each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return v


def spatial_partitions(vertices: DataFrame, size: int = PART_VERTICES, vertex: str = "vertex", x: str = "x", y: str = "y") -> DataFrame:
    """(vertex, part): vertices in the order of a space-filling curve, cut into ranges of about ``size``.

    Places with very many vertices get smaller partitions in space, not larger ones. Vertices without position come first."""
    points = vertices.select(F.col(vertex).alias("vertex"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    box = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("side"))

    def step(v: str) -> Column:
        return F.floor((F.col(v) - F.col(f"{v}0")) / F.col("side") * 65535).cast("bigint")

    curve = attach(points, box).select("vertex", _spread(step("x")).bitwiseOR(F.shiftleft(_spread(step("y")), 1)).alias("_z"))
    n = max(1, -(-points.count() // size))
    return cut_lineage(curve.repartitionByRange(n, "_z", "vertex").select("vertex", F.spark_partition_id().alias("part")))


def _settle(dist: np.ndarray, source: np.ndarray, target: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Least distances, row by row: ``dist[:, v]`` starts with what is known and falls to what the edges v -> w offer from w."""
    if not len(source):
        return dist
    order = np.argsort(source, kind="stable")
    source, target, cost = source[order], target[order], cost[order]
    begin = np.flatnonzero(np.diff(source, prepend=-1))
    at = source[begin]
    while True:
        offer = np.minimum.reduceat(dist[:, target] + cost, begin, axis=1)
        better = offer < dist[:, at]
        if not better.any():
            return dist
        dist[:, at] = np.minimum(dist[:, at], offer)


def _numbered(edges: pd.DataFrame, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    names = np.unique(np.concatenate([edges["source"].to_numpy(), edges["target"].to_numpy(), more]))
    return (names, np.searchsorted(names, edges["source"].to_numpy()), np.searchsorted(names, edges["target"].to_numpy()),
            edges["cost"].to_numpy(dtype=np.float64))


@dataclass
class Overlay:
    """``inner`` (part, source, target, cost): roads inside partitions; ``links`` (source, target, cost): roads between partitions and
    shortcuts between border vertices; ``parts`` (vertex, part); ``borders`` (vertex, part)."""

    inner: DataFrame
    links: DataFrame
    parts: DataFrame
    borders: DataFrame


@dataclass
class _Level:
    """Partitions joined to larger ones: ``inner`` (part, source, target, cost): links of the level below that stay inside one;
    ``parts`` (vertex, part): the borders of the level below; ``borders`` (vertex, part): those that are still borders."""

    inner: DataFrame
    parts: DataFrame
    borders: DataFrame


def _divide(edges: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges inside parts (part, source, target, cost), edges between parts (source, target, cost), and their ends (vertex, part)."""
    placed = cut_lineage(edges.join(parts.select(F.col("vertex").alias("source"), F.col("part").alias("from")), "source").join(
        parts.select(F.col("vertex").alias("target"), F.col("part").alias("to")), "target"))
    inner = placed.filter(F.col("from") == F.col("to")).select(F.col("from").alias("part"), "source", "target", "cost")
    cross = placed.filter(F.col("from") != F.col("to"))
    borders = cut_lineage(cross.select(F.col("source").alias("vertex"), F.col("from").alias("part")).union(
        cross.select("target", "to")).distinct())
    return inner, cross.select("source", "target", "cost"), borders


def _by_part(df: DataFrame):
    """Grouped by part. A part is little data and much work, so small shuffles are not merged into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").groupBy("part")


def _shortcuts(borders: DataFrame, inner: DataFrame) -> DataFrame:
    """(source, target, cost): least costs between the border vertices of each part by its inner edges."""
    def run(key: tuple, border: pd.DataFrame, road: pd.DataFrame) -> pd.DataFrame:
        ends = border["vertex"].to_numpy()
        names, source, target, cost = _numbered(road, ends)
        place, out = np.searchsorted(names, ends), []
        step = max(1, CELLS // max(1, len(source), len(names)))
        for lo in range(0, len(ends), step):
            to = place[lo:lo + step]
            dist = np.full((len(to), len(names)), np.inf)
            dist[np.arange(len(to)), to] = 0
            there = _settle(dist, source, target, cost)[:, place]
            i, j = np.nonzero(np.isfinite(there) & (to[:, None] != place[None, :]))
            out.append(pd.DataFrame({"source": ends[j], "target": ends[lo + i], "cost": there[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"source": [], "target": [], "cost": []})

    kind = inner.schema["source"].dataType.simpleString()
    return _by_part(borders).cogroup(_by_part(inner)).applyInPandas(run, f"source {kind}, target {kind}, cost double")


def build_overlay(edges: DataFrame, parts: DataFrame) -> Overlay:
    """The overlay of ``edges`` (source, target, cost of 0 or more) whose vertices are dealt by ``parts`` (vertex, part).

    Of parallel roads the cheapest stays; roads with a NULL or negative cost, or an end without a partition, are closed."""
    best = edges.filter("cost >= 0 and source <> target").groupBy("source", "target").agg(F.min(F.col("cost").cast("double")).alias("cost"))
    inner, cross, borders = _divide(best, parts)
    return Overlay(inner, cut_lineage(cross.unionByName(_shortcuts(borders, inner))), parts, borders)


def _levels(overlay: Overlay) -> tuple[list[_Level], DataFrame]:
    """The levels above the overlay, and the links (source, target, cost) of the last one.

    A level is left out, and the search runs over the one below, where so many vertices are borders that their shortcuts
    would outgrow the links they are made of, as in graphs that do not lie in a plane."""
    levels: list[_Level] = []
    links, borders = overlay.links, overlay.borders
    while borders.select("part").distinct().count() > FAN:
        parts = cut_lineage(borders.select("vertex", F.floor(F.col("part") / FAN).cast("int").alias("part")).distinct())
        inner, cross, still = _divide(links, parts)
        pairs = still.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0]
        if pairs > PAYS * inner.count():
            break
        levels.append(_Level(inner, parts, still))
        links, borders = cut_lineage(cross.unionByName(_shortcuts(still, inner))), still
    return levels, links


def _fill(known: DataFrame, inner: DataFrame, limit: float | None) -> DataFrame:
    """(vertex, facility, part, cost): least costs in each partition, by its inner edges, from what is ``known`` of its vertices."""
    kind = known.schema["facility"].dataType.simpleString()
    name = known.schema["vertex"].dataType.simpleString()

    def run(start: pd.DataFrame, road: pd.DataFrame) -> pd.DataFrame:
        if not len(start):
            return pd.DataFrame({"vertex": [], "facility": [], "part": [], "cost": []})
        names, source, target, cost = _numbered(road, start["vertex"].to_numpy())
        facilities, row = np.unique(start["facility"].to_numpy(), return_inverse=True)
        col, first, out = np.searchsorted(names, start["vertex"].to_numpy()), start["cost"].to_numpy(dtype=np.float64), []
        step = max(1, CELLS // max(1, len(source), len(names)))
        for lo in range(0, len(facilities), step):
            some = (row >= lo) & (row < lo + step)
            dist = np.full((min(step, len(facilities) - lo), len(names)), np.inf)
            np.minimum.at(dist, (row[some] - lo, col[some]), first[some])
            dist = _settle(dist, source, target, cost)
            i, j = np.nonzero(np.isfinite(dist) & (dist <= (np.inf if limit is None else limit)))
            out.append(pd.DataFrame({"vertex": names[j], "facility": facilities[lo + i], "part": start["part"].iloc[0], "cost": dist[i, j]}))
        return pd.concat(out)

    return _by_part(known).cogroup(_by_part(inner)).applyInPandas(run, f"vertex {name}, facility {kind}, part int, cost double")


def travel_time_matrix(overlay: Overlay, targets: DataFrame, limit: float | None = None) -> DataFrame:
    """(vertex, facility, cost): the least cost from every vertex to every facility of ``targets`` (vertex, facility) it reaches, up to
    ``limit``.

    A facility may have several vertices; it costs 0 there. Vertices that reach no facility are absent, targets without a partition
    too. Equal to the shortest paths over all roads: a path is cut at the borders it crosses, and each piece is a link. Without a
    limit the costs climb the levels from each facility's partition, and descend them to every other."""
    seeds = targets.select("vertex", "facility").distinct().join(overlay.parts, "vertex").select(
        "vertex", "facility", F.col("part").cast("int").alias("part"), F.lit(0.0).alias("cost"))
    own = cut_lineage(_fill(seeds, overlay.inner, limit))
    levels, links = ([], overlay.links) if limit is not None else _levels(overlay)

    def on(costs: DataFrame, borders: DataFrame) -> DataFrame:
        return costs.join(borders.select("vertex"), "vertex", "left_semi").select("vertex", "facility", "cost")

    def placed(costs: DataFrame, parts: DataFrame) -> DataFrame:
        return costs.join(parts, "vertex").select("vertex", "facility", F.col("part").cast("int").alias("part"), "cost")

    below = [on(own, overlay.borders)]
    for level in levels:
        below.append(cut_lineage(on(_fill(placed(below[-1], level.parts), level.inner, None), level.borders)))

    def offer(best: Column) -> Column:
        cost = best + F.col("cost")
        return cost if limit is None else F.when(cost <= limit, cost)

    start = below[-1].withColumnRenamed("cost", "best")
    far = cut_lineage(_fixpoint(start, links, "target", "source", offer, ("vertex", "facility"))).withColumnRenamed("best", "cost")
    for level, known in zip(reversed(levels), reversed(below[:-1])):
        far = cut_lineage(_fill(placed(far.unionByName(known), level.parts), level.inner, None).select("vertex", "facility", "cost"))
    both = _fill(placed(far, overlay.borders).unionByName(seeds), overlay.inner, limit)
    return both.select("vertex", "facility", "cost")


def nearest_facilities(matrix: DataFrame, n: int = 1) -> DataFrame:
    """(vertex, rank, facility, cost): the ``n`` facilities of least cost from each vertex; ties go to the smaller facility."""
    best = F.slice(F.sort_array(F.collect_list(F.struct("cost", "facility"))), 1, n)
    return matrix.groupBy("vertex").agg(best.alias("b")).select("vertex", F.posexplode("b").alias("at", "f")).select(
        "vertex", (F.col("at") + 1).alias("rank"), "f.facility", "f.cost")
