"""Questions as trees of constraints: AND, OR and NOT over variables of different tables, radius and polygon constraints,
several measures and breakdowns in one pass.

Three-valued logic: a constraint on a value that is missing, NaN or in a table without a row for the cell is unknown; NOT of
unknown is unknown; cells count where the whole tree is true. A table is joined by an inner join if the tree cannot be true
without it, else by an outer one, so an OR drops no cell for lack of the other branch's row. Conjunctive parts stay plain
filters, which Catalyst pushes to the scans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_floating, nan_to_null, typed_literal
from ..model import Between, In, Registry
from .quantiles import interpolated_quantiles, weighted_quantiles
from .questions import KEY, Atlas


@dataclass(frozen=True)
class Compare:
    """``var op value`` with <, <=, >, >=, =."""

    var: str
    op: str
    value: float | str


@dataclass(frozen=True)
class Flag:
    """A boolean (or 0 / 1) variable is as given."""

    var: str
    value: bool = True


@dataclass(frozen=True)
class Radius:
    """The cell's centre lies at most ``metres`` from (x, y); ``at`` names the core table's coordinate columns."""

    x: float
    y: float
    metres: float
    at: tuple[str, str] = ("x", "y")


@dataclass(frozen=True)
class Polygon:
    """The cell's centre lies inside the ring of (x, y) corners, by the even-odd rule. Meant for outlines drawn by hand; areas of
    many corners are joined as in `spatial.points_in_polygons`."""

    ring: tuple[tuple[float, float], ...]
    at: tuple[str, str] = ("x", "y")


@dataclass(frozen=True)
class And:
    children: tuple["Node", ...]


@dataclass(frozen=True)
class Or:
    children: tuple["Node", ...]


@dataclass(frozen=True)
class Not:
    child: "Node"


Leaf = Between | In | Compare | Flag | Radius | Polygon
Node = And | Or | Not | Leaf


@dataclass(frozen=True)
class Measure:
    """``agg`` is sum, count_cells, mean, weighted_mean, min, max or quantile; ``weight`` is for the weighted ones, ``q`` for quantiles."""

    name: str
    agg: str
    var: str | None = None
    weight: str | None = None
    q: float = 0.5


def leaves(node: Node) -> list[Leaf]:
    if isinstance(node, Not):
        return leaves(node.child)
    return [x for c in node.children for x in leaves(c)] if isinstance(node, And | Or) else [node]


def variables_of(leaf: Leaf) -> tuple[str, ...]:
    return leaf.at if isinstance(leaf, Radius | Polygon) else (leaf.var,)


def owner(registry: Registry, leaf: Leaf) -> str:
    return "core" if isinstance(leaf, Radius | Polygon) else registry[leaf.var].table


def required_tables(registry: Registry, node: Node, outcome: bool = True) -> frozenset[str]:
    """Tables without whose row the node cannot come out as ``outcome``. An empty AND is true, an empty OR false, without any."""
    if isinstance(node, Not):
        return required_tables(registry, node.child, not outcome)
    if isinstance(node, And | Or):
        parts = [required_tables(registry, c, outcome) for c in node.children]
        if isinstance(node, And) == outcome:  # all children must come out like this
            return frozenset().union(*parts)
        return reduce(frozenset.intersection, parts) if parts else frozenset()
    return frozenset((owner(registry, node),))


def _inside(ring: tuple[tuple[float, float], ...], x: Column, y: Column) -> Column:
    sides = [F.struct(F.lit(float(a[0])).alias("x1"), F.lit(float(a[1])).alias("y1"), F.lit(float(b[0])).alias("x2"), F.lit(float(b[1])).alias("y2"))
             for a, b in zip(ring, ring[1:] + ring[:1]) if a[1] != b[1]]
    if not sides:
        return F.lit(False)
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    crossed = F.filter(F.array(*sides), lambda s: ((s["y1"] > y) != (s["y2"] > y)) & (
        x < (s["x2"] - s["x1"]) * (y - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]))
    return box & (F.size(crossed) % 2 == 1)


def _known(df: DataFrame, name: str) -> Column:
    """The column, NaN being NULL."""
    return F.when(~F.isnan(name), F.col(name)) if is_floating(df, name) else F.col(name)


def _test(df: DataFrame, leaf: Leaf, known: Callable[[DataFrame, str], Column]) -> Column:
    """The constraint as a column; ``known`` reads a variable."""
    if isinstance(leaf, Radius):
        x, y = (known(df, c) for c in leaf.at)
        box = x.between(leaf.x - leaf.metres, leaf.x + leaf.metres) & y.between(leaf.y - leaf.metres, leaf.y + leaf.metres)
        return box & ((x - leaf.x) * (x - leaf.x) + (y - leaf.y) * (y - leaf.y) <= leaf.metres * leaf.metres)
    if isinstance(leaf, Polygon):
        return _inside(tuple(map(tuple, leaf.ring)), *(known(df, c) for c in leaf.at))
    col = known(df, leaf.var)
    if isinstance(leaf, Flag):
        return col.cast("boolean") == F.lit(leaf.value)
    if isinstance(leaf, In):
        return col.isin(*leaf.values) if leaf.values else F.col(f"_has_{leaf.var}")
    if isinstance(leaf, Compare):
        lit = F.lit(leaf.value) if isinstance(leaf.value, str) else typed_literal(df, leaf.var, leaf.value)
        tests: dict[str, Callable[[], Column]] = {"<": lambda: col < lit, "<=": lambda: col <= lit, ">": lambda: col > lit, ">=": lambda: col >= lit, "=": lambda: col == lit}
        if leaf.op not in tests:
            raise ValueError(f"unknown comparison: {leaf.op}")
        return tests[leaf.op]()
    parts = [] if leaf.min is None else [col >= typed_literal(df, leaf.var, leaf.min)]
    if leaf.max is not None:
        top = typed_literal(df, leaf.var, leaf.max)
        parts.append(col <= top if leaf.max_inclusive else col < top)
    return reduce(lambda a, b: a & b, parts) if parts else F.col(f"_has_{leaf.var}")


def truth(df: DataFrame, node: Node) -> Column:
    """The node as a column that is true, false or NULL for unknown. Constraints that ask for nothing are true where the variable's
    table has a row."""
    if isinstance(node, Not):
        return ~truth(df, node.child)
    if isinstance(node, And):
        return reduce(lambda a, b: a & b, [truth(df, c) for c in node.children], F.lit(True))
    if isinstance(node, Or):
        return reduce(lambda a, b: a | b, [truth(df, c) for c in node.children], F.lit(False))
    return _test(df, node, _known)


def must_hold(df: DataFrame, node: Node) -> Column:
    """The node as a filter. A constraint that has to hold in any case needs no third value: unknown may be false, and the bare
    comparison is one that scans understand."""
    if isinstance(node, And):
        return reduce(lambda a, b: a & b, [must_hold(df, c) for c in node.children], F.lit(True))
    if isinstance(node, Not | Or):
        return truth(df, node)
    numbers = [v for v in variables_of(node) if is_floating(df, v)]
    return reduce(lambda a, v: a & ~F.isnan(v), numbers if not _asks_nothing(node) else [], _test(df, node, lambda _, name: F.col(name)))


def _asks_nothing(leaf: Leaf) -> bool:
    return (isinstance(leaf, In) and not leaf.values) or (isinstance(leaf, Between) and leaf.min is None and leaf.max is None)


def cells_where(atlas: Atlas, node: Node, more: tuple[str, ...] = ()) -> DataFrame:
    """The cells for which the tree is true, with the variables it names and ``more``.

    Only tables that own a named variable are read, only with those columns. ``more`` drops no cell: its tables are joined by an
    outer join unless the tree needs them anyway. Unknown variables raise KeyError."""
    found = leaves(node)
    needed = required_tables(atlas.registry, node)
    names = [v for leaf in found for v in variables_of(leaf)]
    at = {v for leaf in found if isinstance(leaf, Radius | Polygon) for v in leaf.at}
    wanted = {v: "core" if v in at else atlas.registry[v].table for v in dict.fromkeys([*names, *more]) if v != KEY}
    nothing_asked = {leaf.var for leaf in found if _asks_nothing(leaf)}
    df = None
    for table in ("core", "env", "climate"):
        mine = [v for v, t in wanted.items() if t == table]
        if table != "core" and not mine:
            continue
        part = atlas.table(table).select(KEY, *mine)
        part = part.withColumns({f"_has_{v}": F.lit(True) for v in nothing_asked if wanted[v] == table})
        df = part if df is None else df.join(part, KEY, "inner" if table in needed else "left")
    return df.filter(must_hold(df, node)).select(KEY, *wanted)


def answer(atlas: Atlas, node: Node, measures: list[Measure], by: tuple[str, ...] = (), totals: bool = False) -> DataFrame:
    """(by…, a column per measure) over the cells for which the tree is true.

    Without ``by`` one row, also for an empty selection: sums and counts 0, the others NULL. With ``totals`` also rows of all
    coarser breakdowns, whose finer columns are NULL; ``_level`` tells how many columns of ``by`` a row is broken down by. All
    measures but quantiles come from one aggregation; missing values and NaN take no part in a measure."""
    used = tuple(dict.fromkeys(v for m in measures for v in (m.var, m.weight) if v))
    cells = cells_where(atlas, node, (*used, *by))
    cells = nan_to_null(cells)

    def column(m: Measure) -> Column:
        if m.agg == "count_cells":
            return F.count(F.lit(1))
        x = F.col(m.var)
        if m.agg == "weighted_mean":
            w = F.when(x.isNotNull(), F.col(m.weight).cast("double"))
            return F.sum(x.cast("double") * w) / F.nullif(F.sum(w), F.lit(0.0))
        return {"sum": lambda: F.coalesce(F.sum(x), F.lit(0)), "mean": lambda: F.avg(x), "min": lambda: F.min(x), "max": lambda: F.max(x)}[m.agg]()

    plain = [m for m in measures if m.agg != "quantile"]
    aggs = [column(m).alias(m.name) for m in plain] or [F.count(F.lit(1)).alias("_n")]
    levels = range(len(by), -1, -1) if totals else [len(by)]
    out = []
    for k in levels:
        keys = list(by[:k])
        part = cells.groupBy(*keys).agg(*aggs)
        for m in measures:
            if m.agg == "quantile":
                some = cells.filter(F.col(m.var).isNotNull())
                q = weighted_quantiles(some, m.var, m.weight, [m.q], keys) if m.weight else interpolated_quantiles(some, m.var, [m.q], keys)
                q = q.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("value").alias(m.name))
                on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
                part = part.join(q, reduce(lambda a, b: a & b, on), "left").drop(*[f"_k{i}" for i in range(k)]) if keys else part.withColumn(m.name, q.select(m.name).scalar())
        rest = [F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in by[k:]]
        out.append(part.select(*keys, *rest, *[m.name for m in measures], *([F.lit(k).alias("_level")] if totals else [])))
    return reduce(lambda a, b: a.unionByName(b), out)
