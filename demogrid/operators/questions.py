"""Questions over the thematic tables: predicates, minimal joins, totals, presets, profiles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import attach, has_data, is_floating, safe_ratio, to_long, typed_literal
from ..model import Constraint, In, Preset, Question, Registry

KEY = "cell_id"


@dataclass(frozen=True)
class Atlas:
    """The wide tables keyed by ``cell_id`` and the registry that says which owns what."""

    core: DataFrame
    env: DataFrame
    climate: DataFrame
    registry: Registry

    def table(self, name: str) -> DataFrame:
        return {"core": self.core, "env": self.env, "climate": self.climate}[name]


def predicate(df: DataFrame, c: Constraint, dtype: str | None = None) -> Column | None:
    """A constraint as a Column; ``None`` when it constrains nothing."""
    if isinstance(c, In):
        return F.col(c.var).isin(*c.values) if c.values else None
    parts = []
    if c.min is not None:
        parts.append(F.col(c.var) >= typed_literal(df, c.var, c.min))
    if c.max is not None:
        top = typed_literal(df, c.var, c.max)
        parts.append(F.col(c.var) <= top if c.max_inclusive else F.col(c.var) < top)
    if not parts:
        return None
    if is_floating(df, c.var):
        parts.append(~F.isnan(c.var))
    return all_of(parts)


def condition(df: DataFrame, var: str, op: str, value) -> Column:
    """A single comparison with a literal of the column's type, NaN counting as no data."""
    col = F.col(var)
    if op == "null":
        return col.isNull()
    if op == "in":
        return col.isin(*value)
    if op == "=":
        return col == F.lit(value)
    lit = typed_literal(df, var, value)
    test = {"<": col < lit, "<=": col <= lit, ">": col > lit, ">=": col >= lit}[op]
    return test & ~F.isnan(var) if is_floating(df, var) else test


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def joined(atlas: Atlas, variables: list[str]) -> DataFrame:
    """Inner join of exactly the tables that own the variables, core always first.

    A variable brings in its table even if its constraint is empty, so cells missing from
    that table drop out. Only the columns asked for are kept, which lets Parquet prune."""
    owners = {v: atlas.registry[v].table for v in variables if v != KEY}
    wanted = {t: [v for v in dict.fromkeys(variables) if owners.get(v) == t]
              for t in ("core", "env", "climate")}
    df = atlas.core.select(KEY, *wanted["core"])
    for name in ("env", "climate"):
        if wanted[name]:
            df = df.join(atlas.table(name).select(KEY, *wanted[name]), KEY)
    return df


def selection(atlas: Atlas, q: Question, extra_vars: tuple[str, ...] = (),
              extra: list | None = None) -> DataFrame:
    """Cells that satisfy every constraint, with the measure and the variables read."""
    variables = [q.measure, *(c.var for c in q.constraints), *extra_vars]
    df = joined(atlas, variables)
    parts = [p for p in (predicate(df, c) for c in q.constraints) if p is not None]
    parts += [make(df) for make in (extra or [])]
    return df.filter(all_of(parts)) if parts else df


def total(atlas: Atlas, q: Question) -> DataFrame:
    """One row: the measure summed over the selection (0 when empty) and the cell count."""
    return selection(atlas, q).agg(
        F.coalesce(to_long(F.sum(q.measure)), F.lit(0)).alias("value"),
        F.count(F.lit(1)).alias("n_cells"))


def cell_values(atlas: Atlas, q: Question) -> DataFrame:
    """The selected cells; at 1 km² per cell the value is also the density."""
    return selection(atlas, q).select(KEY, F.col(q.measure).cast("double").alias("val"))


def national_share(atlas: Atlas, q: Question) -> DataFrame:
    """The total with its share of the unfiltered national total."""
    national = atlas.core.agg(to_long(F.sum(q.measure)).alias("national"))
    return (attach(total(atlas, q), national)
            .withColumn("share", safe_ratio(F.col("value"), F.col("national"))))


def many_totals(atlas: Atlas, questions: dict[str, Question]) -> DataFrame:
    """(label, value, n_cells, share) for a family of questions in one pass.

    Every question is a conditional sum over one left-joined frame; a question that needs a
    table counts only cells present in it, as its own inner join would."""
    registry = atlas.registry
    variables = [v for q in questions.values() for v in (q.measure, *(c.var for c in q.constraints))]
    used = {t: [v for v in dict.fromkeys(variables) if registry[v].table == t]
            for t in ("core", "env", "climate")}
    measures = list(dict.fromkeys(q.measure for q in questions.values()))
    df = atlas.core.select(KEY, *used["core"])
    for name in ("env", "climate"):
        if used[name]:
            side = atlas.table(name).select(KEY, *used[name], F.lit(True).alias(f"_in_{name}"))
            df = df.join(side, KEY, "left")
    sums, labels = [], list(questions)
    for i, q in enumerate(questions.values()):
        parts = [F.col(f"_in_{t}").isNotNull()
                 for t in sorted({registry[c.var].table for c in q.constraints} - {"core"})]
        parts += [p for p in (predicate(df, c) for c in q.constraints) if p is not None]
        hit = all_of(parts)
        sums += [F.sum(F.when(hit, F.col(q.measure))).alias(f"_v{i}"),
                 F.count_if(hit).alias(f"_n{i}")]
    sums += [F.sum(m).alias(f"_t_{m}") for m in measures]
    rows = F.array(*[
        F.struct(F.lit(label).alias("label"),
                 F.coalesce(to_long(F.col(f"_v{i}")), F.lit(0)).alias("value"),
                 F.col(f"_n{i}").alias("n_cells"),
                 safe_ratio(F.coalesce(F.col(f"_v{i}"), F.lit(0)),
                            F.col(f"_t_{questions[label].measure}")).alias("share"))
        for i, label in enumerate(labels)])
    return df.agg(*sums).select(F.inline(rows))


def preset_totals(atlas: Atlas, presets: tuple[Preset, ...]) -> DataFrame:
    return many_totals(atlas, {p.id: p.question for p in presets})


def variant_totals(atlas: Atlas, preset: Preset) -> DataFrame:
    return many_totals(atlas, {v.label: v.question for v in preset.variants})


def threshold_sweep(atlas: Atlas, preset: Preset, bounds: list[float]) -> DataFrame:
    """The preset's adjustable bound at several values, everything else unchanged."""
    t = preset.threshold
    if t is None:
        raise ValueError(f"{preset.id} has no adjustable threshold")
    return many_totals(atlas, {
        f"{b:g}": preset.question.with_bound(t.var, t.bound, b, t.inclusive or None)
        for b in bounds})


def golden_report(atlas: Atlas, golden: tuple, mean: tuple | None = None) -> DataFrame:
    """(label, value, pct): every golden figure from one scan."""
    needed = list(dict.fromkeys([m for _, m, _ in golden] + [c[0] for _, _, cs in golden for c in cs]
                                + (list(mean[1:]) if mean else [])))
    names = {t: [v for v in needed if atlas.registry[v].table == t] for t in ("core", "env", "climate")}
    df = atlas.core.select(KEY, *names["core"]).join(atlas.env.select(KEY, *names["env"]), KEY)
    if names["climate"]:
        df = df.join(atlas.climate.select(KEY, *names["climate"]), KEY, "left")
    aggs = [F.sum(F.when(all_of([condition(df, *c) for c in cs]), F.col(m))).alias(f"_g{i}")
            for i, (_, m, cs) in enumerate(golden)]
    if mean:
        x, w = F.col(mean[1]).cast("double"), F.col(mean[2])
        ok = has_data(df, mean[1])
        aggs.append(F.round(safe_ratio(F.sum(F.when(ok, x * w)), F.sum(w)), 1).alias("_mean"))
    rows = [(label, F.col(f"_g{i}").cast("double")) for i, (label, _, _) in enumerate(golden)]
    if mean:
        rows.append((mean[0], F.col("_mean")))
    # Values are truncated to whole people, as the report prints them.
    whole = atlas.core.agg(F.sum("pop_total").alias("_total"))
    cells = F.array(*[
        F.struct(F.lit(label).alias("label"),
                 F.coalesce(v, F.lit(0.0)).cast("bigint").alias("value"),
                 safe_ratio(F.coalesce(v, F.lit(0.0)).cast("bigint"), F.col("_total")).alias("pct"))
        for label, v in rows])
    return attach(df.agg(*aggs), whole).select(F.inline(cells))


def profile(atlas: Atlas, keys: DataFrame | None = None, cell_id: int | None = None) -> DataFrame:
    """All variables of one cell, or of every cell in ``keys``: env must exist, climate may not."""
    core = atlas.core
    if cell_id is not None:
        core = core.filter(F.col(KEY) == cell_id)
    if keys is not None:
        core = core.join(keys.select(KEY).distinct(), KEY, "left_semi")
    return core.join(atlas.env, KEY).join(atlas.climate, KEY, "left")


def long_profile(wide: DataFrame, registry: Registry) -> DataFrame:
    """(cell_id, variable, value) with missing values left out."""
    names = [v.id for v in registry.variables if v.id in wide.columns and "profile" in v.roles]
    frame = wide.select(KEY, *[
        F.when(has_data(wide, n), F.col(n).cast("double" if is_floating(wide, n) else
                                                wide.schema[n].dataType)).cast("string").alias(n)
        for n in names])
    return frame.unpivot([KEY], names, "variable", "value").filter(F.col("value").isNotNull())


def with_area(q: Question, county: str | None) -> Question:
    """Restrict a question to one county, or leave it nationwide."""
    if county is None:
        return q
    return Question(q.measure, q.constraints + (In("county_mn", (county,)),))

