"""Spatial joins as tile equi-joins: point in polygon, nearest polygon, k nearest points,
points near lines. No cross joins; the exact geometric test runs after the tile match."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import attach, square
from ..session import cut_lineage
from .cover import Lattice, edge_pixels


def _tile(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({"prow": F.floor(F.col(y) / size), "pcol": F.floor(F.col(x) / size)})


MANY_EDGES = 64  # of a polygon in one band of rows; where there are more, they are met one by one


def _crosses(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Does the ray from (x, y) towards larger x cross the edge?"""
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)


ENDS = ("x1", "y1", "x2", "y2")


def _stretch(end, prow: Column, tile: float) -> tuple[Column, Column, Column, Column]:
    """Lowest and highest y of an edge with the ends ``end("x1")``…, and its smallest and largest x within a band of tile rows."""
    x1, y1, x2, y2 = (end(c) for c in ENDS)
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    slope = (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0))
    cut = [F.coalesce(x1 + (y - y1) * slope, x) for y, x in ((F.greatest(low, prow * tile), x1), (F.least(high, (prow + 1) * tile), x2))]
    return low, high, F.least(*cut), F.greatest(*cut)


def _bands(edges: DataFrame, tile: float, key: str, sent: bool) -> DataFrame:
    """(key, prow, e, touched, lo_x, hi_x, lo_y, hi_y): edges of a polygon in a band of tile rows. ``sent``: by key first, as its
    attributes are."""
    outline = edges.select(key, *ENDS).filter(F.col(key).isNotNull())
    if sent:
        outline = outline.repartition(key)
    low, high, lo, hi = _stretch(F.col, F.col("prow"), tile)
    banded = outline.withColumn("prow", F.explode(F.sequence(F.floor(low / tile), F.floor(high / tile)))).select(
        key, "prow", *ENDS, lo.alias("lo"), hi.alias("hi"))
    steep = F.col("y1") != F.col("y2")  # level edges cross no ray, but the tiles they touch are not whole

    def of_steep(value: Column) -> Column:
        return F.when(steep, value)

    return banded.groupBy(key, "prow").agg(
        F.collect_list(of_steep(F.struct(*ENDS, F.col("hi").alias("to")))).alias("e"),
        F.collect_list(F.struct(F.floor(F.col("lo") / tile).alias("a"), F.floor(F.col("hi") / tile).alias("b"))).alias("touched"),
        F.min(of_steep(F.col("lo"))).alias("lo_x"), F.max(of_steep(F.col("hi"))).alias("hi_x"),
        F.min(of_steep(low)).alias("lo_y"), F.max(of_steep(high)).alias("hi_y"))


def _bands_of_outlines(outlines: DataFrame, tile: float, key: str) -> DataFrame:
    """`_bands` of polygons whose edges lie together in one array: each band is cut where the array is, and nothing is grouped."""
    def one(value: Column) -> Column:
        """The value as a row of its own, so that filters further on do not compute it again."""
        return F.explode(F.array(value))

    prow = F.col("prow")
    rows = F.struct(F.floor(F.least(F.array_min("outline.y1"), F.array_min("outline.y2")) / tile).alias("first"),
                    F.floor(F.greatest(F.array_max("outline.y1"), F.array_max("outline.y2")) / tile).alias("last"))

    def here(e: Column) -> Column:
        return prow.between(F.floor(F.least(e["y1"], e["y2"]) / tile), F.floor(F.greatest(e["y1"], e["y2"]) / tile))

    def cut(e: Column) -> Column:
        low, high, lo, hi = _stretch(lambda c: e[c], prow, tile)
        return F.struct(*[e[c].alias(c) for c in ENDS], low.alias("low"), high.alias("high"), lo.alias("lo"), hi.alias("to"))

    banded = outlines.select(key, "outline", one(rows).alias("_r")).withColumn("prow", F.explode(F.sequence("_r.first", "_r.last")))
    banded = banded.select(key, "prow", one(F.transform(F.filter("outline", here), cut)).alias("h")).filter(F.size("h") > 0)
    banded = banded.select(key, "prow", "h", one(F.filter("h", lambda e: e["y1"] != e["y2"])).alias("s"))
    touched = F.transform("h", lambda e: F.struct(F.floor(e["lo"] / tile).alias("a"), F.floor(e["to"] / tile).alias("b")))
    return banded.select(key, "prow", F.inline(F.array(F.struct(
        F.arrays_zip(*[F.col(f"s.{c}").alias(c) for c in (*ENDS, "to")]).alias("e"), touched.alias("touched"),
        F.array_min("s.lo").alias("lo_x"), F.array_max("s.to").alias("hi_x"), F.array_min("s.low").alias("lo_y"), F.array_max("s.high").alias("hi_y")))))


def points_in_polygons(points: DataFrame, edges: DataFrame, pid: str = "cell_id", tile: float = 5000.0,
                       key: str = "feature_id", attrs: DataFrame | None = None) -> DataFrame:
    """(pid, key) for every polygon a point lies inside (even-odd rule), with the other columns of ``attrs`` (key, …) if given.

    The edges of a polygon in a band of tile rows are sent, as one array, to the tiles between the first and the last
    of them, and the points of a tile are tested there: pairs of points and polygons are never shuffled. The attributes
    are joined to the polygons before they meet the points. Where a band has very many edges, each is sent on its own,
    and its crossings are counted within the tile.

    ``edges`` has one row per edge (key, x1, y1, x2, y2), or one per ring (key, outline: array of these four), which is
    much less to shuffle and sort. All edges of a key are one polygon.

    A point that is given n times is found n times in tiles that lie inside a polygon as a whole; elsewhere the
    crossings of its copies add up, so it is found once if n is odd."""
    pts = _tile(points.select(pid, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), tile)
    pts = pts.groupBy(pid, "x", "y", "prow", "pcol").agg(F.count(F.lit(1)).alias("copies"))
    if "outline" in edges.columns:
        outlines = edges.select(key, "outline").filter(F.col(key).isNotNull()).groupBy(key).agg(F.flatten(F.collect_list("outline")).alias("outline"))
        bands = _bands_of_outlines(outlines, tile, key)
        large = _bands_of_outlines(outlines.filter(F.size("outline") > MANY_EDGES), tile, key)
    else:
        large = bands = _bands(edges, tile, key, attrs is not None)
    slack = 1e-6 * tile  # for the rounding of the cut
    span = F.sequence(F.floor((F.col("lo_x") - slack) / tile), F.floor((F.col("hi_x") + slack) / tile))
    whole = ~F.exists("touched", lambda t: F.col("pcol").between(t["a"], t["b"]))

    def tiles(some: DataFrame, *others: str) -> DataFrame:
        """A tile inside or outside as a whole has no edge in it."""
        return some.withColumn("pcol", F.explode(span)).select(key, "prow", "pcol", "e", "lo_x", "hi_x", "lo_y", "hi_y", whole.alias("whole"), *others)

    def found(rows: DataFrame, *others: str) -> DataFrame:
        times = F.when(F.col("whole"), F.col("copies")).otherwise(F.col("copies") % 2).cast("int")
        return rows.select(pid, key, *others, F.explode(F.array_repeat(F.lit(True), times)).alias("_t")).drop("_t")

    few = bands.filter(F.size("e") <= MANY_EDGES).withColumn("e", F.transform("e", lambda e: F.struct(*[e[c].alias(c) for c in ENDS])))
    more = [] if attrs is None else [c for c in attrs.columns if c != key]
    if attrs is not None:
        few = few.join(attrs.hint("merge"), key)
    # sizes estimated from the files say little about the edges: nothing is broadcast on their account
    met = pts.join(tiles(few, *more).hint("merge"), ["prow", "pcol"]).filter(
        F.col("y").between(F.col("lo_y"), F.col("hi_y")) & F.col("x").between(F.col("lo_x") - slack, F.col("hi_x") + slack))
    odd = F.size(F.filter("e", lambda e: _crosses(F.col("x"), F.col("y"), *[e[c] for c in ENDS]))) % 2 == 1
    sure = found(met.filter(odd), *more)

    single = tiles(large.filter(F.size("e") > MANY_EDGES)).select(key, "prow", "pcol", "whole", F.inline("e")).filter(
        F.col("pcol") <= F.floor((F.col("to") + slack) / tile))
    counted = found(pts.join(single.hint("merge"), ["prow", "pcol"]).filter(_crosses(F.col("x"), F.col("y"), *[F.col(c) for c in ENDS]))
                    .groupBy("prow", "pcol", key, pid, "x", "y", "copies", "whole").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") % 2 == 1))
    if attrs is not None:
        counted = counted.join(attrs.hint("merge"), key).select(pid, key, *more)
    return sure.unionByName(counted)


def first_polygon(points: DataFrame, edges: DataFrame, pid: str = "cell_id", tile: float = 5000.0,
                  key: str = "feature_id") -> DataFrame:
    """(pid, key): the smallest matching polygon id for every point, NULL without a match."""
    hit = points_in_polygons(points, edges, pid, tile, key).groupBy(pid).agg(F.min(key).alias(key))
    return points.select(pid).join(hit, pid, "left")


def segment_distance2(x: Column, y: Column) -> Column:
    """Squared distance of (x, y) to the segment (x1, y1)-(x2, y2)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length2 = F.nullif(square(dx) + square(dy), F.lit(0.0))
    t = F.coalesce(((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / length2, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return square(x - (F.col("x1") + t * dx)) + square(y - (F.col("y1") + t * dy))


def edges_within(points: DataFrame, edges: DataFrame, distance: float, pid: str = "cell_id",
                 key: str = "feature_id") -> DataFrame:
    """(pid, key, d2) for every edge within ``distance`` of a point.

    The edges, fewer than the points, are copied to their tile's eight neighbours; a tile is
    as wide as the distance, so nothing in reach is missed and each point is sent once."""
    pts = _tile(points.select(pid, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), distance)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = (edge_pixels(edges.select(key, "x1", "y1", "x2", "y2"), Lattice(0.0, 0.0, distance), key)
              .withColumn("o", F.explode(around))
              .select(key, "x1", "y1", "x2", "y2", (F.col("prow") + F.col("o.i")).alias("prow"),
                      (F.col("pcol") + F.col("o.j")).alias("pcol")).distinct())
    return (pts.join(spread, ["prow", "pcol"])
            .select(pid, key, segment_distance2(F.col("x"), F.col("y")).alias("d2"))
            .filter(F.col("d2") <= distance * distance))


def nearest_polygon(points: DataFrame, edges: DataFrame, max_distance: float, pid: str = "cell_id",
                    key: str = "feature_id") -> DataFrame:
    """(pid, key, dist): the polygon whose outline is nearest, within the limit. Points inside
    a polygon are taken to be matched already. Ties go to the smallest id."""
    near = edges_within(points, edges, max_distance, pid, key)
    return near.groupBy(pid).agg(F.min(F.struct("d2", key)).alias("m")).select(
        pid, F.col(f"m.{key}").alias(key), F.sqrt("m.d2").alias("dist"))


def assign_polygons(points: DataFrame, edges: DataFrame, max_distance: float = 5000.0, pid: str = "cell_id",
                    tile: float = 5000.0, key: str = "feature_id") -> DataFrame:
    """(pid, key, how): containing polygon, else the nearest one within the limit, else NULL."""
    inside = points_in_polygons(points, edges, pid, tile, key).groupBy(pid).agg(F.min(key).alias(key))
    left = points.join(inside, pid, "left_anti")
    near = nearest_polygon(left, edges, max_distance, pid, key).select(pid, key)
    found = (inside.withColumn("how", F.lit("within"))
             .unionByName(near.withColumn("how", F.lit("nearest"))))
    return points.select(pid).join(found, pid, "left")


def points_near_lines(points: DataFrame, edges: DataFrame, distance: float, pid: str = "cell_id") -> DataFrame:
    """Distinct ids of the points within a distance of any line."""
    return edges_within(points, edges, distance, pid).select(pid).distinct()


CROWDED = 16  # sites per finest tile that call for a finer tile
FINER = 6     # halvings looked at in one pass
DEEPEST = 60  # beyond the resolution of coordinates: sites still together then are at one place
FLAT = 3      # doublings of a tile up to which its ring is met at once
AT_ONCE = 4   # levels between two checkpoints on the way down


def _pyramid_shape(points: DataFrame, sites: DataFrame, dims: list[str], k: int) -> tuple[list[float], float, int]:
    """Origin, finest tile size and number of doublings, from one-row aggregates.

    The tile starts at about half the mean spacing of the sites and is halved while the
    fullest tile stays crowded, so clusters of sites get small tiles."""
    def extent(df: DataFrame):
        aggs = [f(F.col(d).cast("double")).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
        return df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()

    p, s = extent(points), extent(sites)
    if not s["n"]:
        raise ValueError("there are no sites")
    los = [min(v for v in (p[f"lo_{d}"], s[f"lo_{d}"]) if v is not None) for d in dims]
    his = [max(v for v in (p[f"hi_{d}"], s[f"hi_{d}"]) if v is not None) for d in dims]
    span = max(max(h - lo for lo, h in zip(los, his)), 1e-9)
    fine = span / max(1.0, 2.0 * math.sqrt(s["n"]))
    keys = [F.floor((F.col(d).cast("double") - o) * F.pow(F.lit(2.0), F.col("h")) / fine).alias(f"c{i}") for i, (d, o) in enumerate(zip(dims, los))]
    crowd = None
    for h in range(0, DEEPEST, FINER + 1):
        halving = F.explode(F.sequence(F.lit(h), F.lit(h + FINER))).alias("h")
        crowd = (sites.select(*dims, halving).select("h", *keys).groupBy("h", *[f"c{i}" for i in range(len(dims))]).agg(F.count(F.lit(1)).alias("n"))
                 .groupBy("h").agg(F.max("n").alias("n")).filter(F.col("n") <= CROWDED + 2 * k).agg(F.min("h")).first()[0])
        if crowd is not None:
            break
    fine /= 2.0 ** (DEEPEST if crowd is None else crowd)
    return los, fine, max(1, math.ceil(math.log2(span / fine)) + 2)


def _gaps(a: list[str], b: list[str]) -> tuple[Column, Column]:
    """Least and largest squared distance of two tiles, in tile widths: two tiles g apart are g-1 to g+1 widths apart."""
    near, far = F.lit(0), F.lit(0)
    for t, o in zip(a, b):
        gap = F.abs(F.col(t) - F.col(o))
        near, far = near + square(F.greatest(gap - 1, F.lit(0))), far + square(gap + 1)
    return near, far


def _within_reach(cand: DataFrame, base: list[str], k: int) -> DataFrame:
    """The candidates (base…, n, near, far) that may hold one of the k nearest sites of a point in their tile, with the ``_limit``
    of the distance within which k sites are certain to be met."""
    by_far = Window.partitionBy(*base).orderBy("far").rangeBetween(Window.unboundedPreceding, 0)
    everywhere = Window.partitionBy(*base)
    cand = cand.withColumn("_sure", F.sum("n").over(by_far)).withColumn(
        "_limit", F.coalesce(F.min(F.when(F.col("_sure") >= k, F.col("far"))).over(everywhere), F.max("far").over(everywhere)))
    return cand.filter(F.col("near") <= F.col("_limit"))


def _downwards(tiles: DataFrame, held: DataFrame, base: list[str], occ: list[str], top: int, k: int) -> DataFrame:
    """(base…, occ…): for every tile of points the tiles of ``held`` (occ…, n) that may hold one of the k nearest sites.

    Both sides start as the tiles of level ``top`` and are split together, level by level. A pair too far apart is dropped
    before it is split, so tiles far from all sites do not meet them all."""
    def lifted(cols: list[str], level: int) -> list[Column]:
        return [F.floor(F.col(c) / F.lit(2.0 ** level)).cast("bigint") for c in cols]

    def named(cols: list[Column], names: list[str]) -> list[Column]:
        return [c.alias(n) for c, n in zip(cols, names)]

    above_t, above_o = [f"{t}_up" for t in base], [f"{o}_up" for o in occ]
    start = held.select(*named(lifted(occ, top), occ), "n").groupBy(*occ).agg(F.sum("n").alias("n"))
    ring = F.array(F.lit(-2), F.lit(-1), F.lit(0), F.lit(1), F.lit(2))
    probe = tiles.select(*named(lifted(base, top), base)).distinct().select(*base, *named([F.col(t) for t in base], occ))
    for o in occ:
        probe = probe.withColumn("_o", F.explode(ring)).withColumn(o, F.col(o) + F.col("_o")).drop("_o")
    pairs = probe.join(start, occ)
    near, far = _gaps(base, occ)
    pairs = _within_reach(pairs.withColumns({"near": near, "far": far}), base, k)
    for level in range(top - 1, -1, -1):
        points_here = tiles.select(*named(lifted(base, level + 1), above_t), *named(lifted(base, level), base)).distinct()
        sites_here = held.select(*named(lifted(occ, level + 1), above_o), *named(lifted(occ, level), occ), "n").groupBy(
            *above_o, *occ).agg(F.sum("n").alias("n"))
        split = (pairs.select(*named([F.col(c) for c in base + occ], above_t + above_o), (F.col("_limit") * 4).alias("_most"))
                 .join(points_here, above_t).join(sites_here, above_o))
        near, far = _gaps(base, occ)
        split = split.select(*base, *occ, "n", near.alias("near"), far.alias("far"), "_most").filter(F.col("near") <= F.col("_most"))
        pairs = _within_reach(split.drop("_most"), base, k)
        if level and (top - level) % AT_ONCE == 0:
            pairs = cut_lineage(pairs)
    return pairs.select(*base, *occ)


def nearest_sites(points: DataFrame, sites: DataFrame, k: int = 1, pid: str = "cell_id", sid: str = "site_id",
                  dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(pid, sid, rank, d2): the k nearest sites of every point, exactly; ties by site id.

    1. Count the sites in a pyramid of tiles, each level twice as wide as the one before.
    2. For every *distinct* finest tile that holds points, take the finest level at which its
       own tile already contains k sites; all k nearest of any point in it lie within one
       tile diagonal, hence in the ring of tiles around it. Where that level is high for some tiles, as for points far from
       all sites, both sides are split from there downwards instead, and pairs too far apart are dropped on the way.
    3. Of the occupied finest tiles in that ring keep those whose smallest possible distance is
       not beyond the distance within which k sites are certain to be met. This compares
       tiles with tiles; a crowded town costs its tiles, not its sites.
    4. Each point meets just the sites of the kept tiles, which are one array per tile.

    The points, the large side, are joined once and never multiplied by a ring. Each keeps the k
    nearest of the sites it meets before its final grouping, which is by point, so a tile that holds
    a large share of them can be split."""
    dims = list(dims)
    # Sites at one place beyond the k smallest ids can never be among the k nearest.
    place = Window.partitionBy(*dims).orderBy(sid)
    st = (sites.select(sid, *[F.col(d).cast("double").alias(d) for d in dims])
          .withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= k).drop("_r"))
    origin, fine, levels = _pyramid_shape(points, st, dims, k)
    pts = points.select(pid, *[F.col(d).cast("double").alias(d) for d in dims])
    base = [f"t{i}" for i in range(len(dims))]
    up = [f"u{i}" for i in range(len(dims))]
    occ = [f"o{i}" for i in range(len(dims))]
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")

    def tile_cols(names: list[str]) -> list[Column]:
        return [F.floor((F.col(d) - o) / fine).alias(t) for d, o, t in zip(dims, origin, names)]

    def lifted(cols: list[str]) -> list[Column]:
        return [F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).alias(u) for c, u in zip(cols, up)]

    tiled_sites = st.select(sid, *[F.col(d).alias(f"s_{d}") for d in dims], *tile_cols(occ))
    occupied = (st.select(*tile_cols(occ)).groupBy(*occ).agg(F.count(F.lit(1)).alias("n"))
                .select(*occ, "n", level).select("level", *lifted(occ), *occ, "n"))
    pyramid = occupied.groupBy("level", *up).agg(F.sum("n").alias("n"))
    tiles = pts.select(*tile_cols(base)).distinct()
    enough = (tiles.select(*base, level).select(*base, "level", *lifted(base)).join(pyramid, ["level", *up])
              .groupBy(*base).agg(F.coalesce(F.min(F.when(F.col("n") >= k, F.col("level"))), F.lit(levels)).alias("level")))
    enough = cut_lineage(enough)
    deepest = enough.agg(F.max("level")).first()[0]
    if deepest is not None and deepest > FLAT:
        held = cut_lineage(st.select(*tile_cols(occ)).groupBy(*occ).agg(F.count(F.lit(1)).alias("n")))
        reached = _downwards(enough.select(*base), held, base, occ, deepest, k)
    else:
        ring = F.array(F.lit(-2), F.lit(-1), F.lit(0), F.lit(1), F.lit(2))
        probe = enough.select(*base, "level", *lifted(base))
        for u in up:
            probe = probe.withColumn("_o", F.explode(ring)).withColumn(u, F.col(u) + F.col("_o")).drop("_o")
        near, far = _gaps(base, occ)
        cand = probe.join(occupied, ["level", *up]).select(*base, *occ, "n", near.alias("near"), far.alias("far"))
        reached = _within_reach(cand, base, k).select(*base, *occ)
    kept = reached.join(tiled_sites, occ).drop(*occ)
    near_by = kept.groupBy(*base).agg(F.collect_list(F.struct(sid, *[f"s_{d}" for d in dims])).alias("near_by"))

    def met(s: Column) -> Column:
        return F.struct(sum((square(F.col(d) - s[f"s_{d}"]) for d in dims), F.lit(0.0)).alias("d2"), s[sid].alias(sid))

    # an estimate from the files says nothing about the arrays: they are not broadcast on its account
    found = pts.select(pid, *dims, *tile_cols(base)).join(near_by.hint("merge"), base)
    if k == 1:  # a point may be given more than once
        best = found.select(pid, F.array_min(F.transform("near_by", met)).alias("m")).groupBy(pid).agg(F.min("m").alias("m"))
        return best.select(pid, F.col(f"m.{sid}").alias(sid), F.lit(1).alias("rank"), F.col("m.d2").alias("d2"))
    best = found.select(pid, F.inline(F.slice(F.sort_array(F.transform("near_by", met)), 1, k)))
    order = Window.partitionBy(pid).orderBy("d2", sid)
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select(pid, sid, "rank", "d2"))


def nearest_with_label(points: DataFrame, sites: DataFrame, label: str, pid: str = "cell_id",
                       sid: str = "site_id") -> DataFrame:
    """(pid, dist_km, label): straight distance to the nearest site and that site's label."""
    near = nearest_sites(points, sites, 1, pid, sid)
    return near.join(sites.select(sid, label), sid).select(
        pid, (F.sqrt("d2") / 1000.0).alias("dist_km"), label)


def interior_points(edges: DataFrame, lattice: Lattice, key: str = "feature_id") -> DataFrame:
    """(key, x, y): a point certainly inside each polygon - the middle of its longest scan-line
    run, lowest row and column first among equals."""
    from .cover import interior_spans

    runs = interior_spans(edges, lattice, key)
    best = runs.groupBy(key).agg(F.max(F.struct((F.col("c1") - F.col("c0")).alias("len"),
                                                (-F.col("prow")).alias("r"), (-F.col("c0")).alias("c"))).alias("m"))
    sign = -1.0 if lattice.north_up else 1.0
    col = -F.col("m.c") + F.floor(F.col("m.len") / 2)
    return best.select(key, (lattice.x0 + (col + 0.5) * lattice.res).alias("x"),
                       (lattice.y0 + sign * (-F.col("m.r") + 0.5) * lattice.res).alias("y"))


def exactly_one(df: DataFrame, condition: Column, what: str, keep_all: bool = False) -> DataFrame:
    """The row that satisfies a condition (or all rows); the job fails unless exactly one does."""
    n = df.agg(F.count_if(condition).alias("_n")).select(
        F.when(F.col("_n") == 1, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit(f"expected exactly one {what}, found "), F.col("_n").cast("string"))).cast("boolean")
        ).alias("_ok"))
    checked = attach(df, n).filter("_ok").drop("_ok")
    return checked if keep_all else checked.filter(condition)
