"""Types of places: clusters of standardised variables, stored as a table of centres and applied by columns.

Each round is one aggregation over the cells: their nearest centre is a column expression, the new centres are its means. Classes
are numbered by size of their centres' values, so that a rerun gives the same class the same number."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, varies
from ..session import cut_lineage

SAMPLE = 5_000  # cells among which the first centres are chosen, at most
ROUNDS, TOLERANCE, SEED = 25, 1e-6, 11


@dataclass(frozen=True)
class Typology:
    """Means and deviations that standardise the variables, and the centres of the classes 1, 2, … in standard units."""

    names: tuple[str, ...]
    means: tuple[float, ...]
    spreads: tuple[float, ...]
    centres: tuple[tuple[float, ...], ...]


def standardised(df: DataFrame, model: Typology) -> list[Column]:
    """The variables in standard units; missing ones are the mean, 0; so are all values of a variable that does not vary."""
    return [F.coalesce((F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")) - m) / s, F.lit(0.0)) if s else F.lit(0.0)
            for n, m, s in zip(model.names, model.means, model.spreads)]


def nearest_class(values: list[Column], centres: tuple[tuple[float, ...], ...]) -> Column:
    """Number of the nearest centre, from 1; the smaller of equally near ones. Distances are rounded to nine places."""
    far = [F.round(sum(((v - F.lit(float(c))) * (v - F.lit(float(c))) for v, c in zip(values, centre)), F.lit(0.0)), 9) for centre in centres]
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i + 1).alias("k")) for i, d in enumerate(far)]))["k"]


def _first_centres(rows: np.ndarray, k: int) -> np.ndarray:
    """The row nearest to the mean, then ever the row farthest from all chosen."""
    chosen = [int(((rows - rows.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    far = ((rows - rows[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def fit_typology(cells: DataFrame, names: list[str], k: int, key: str = "cell_id", rounds: int = ROUNDS, seed: int = SEED) -> Typology:
    """At most ``k`` classes of the cells. The first centres come from the `SAMPLE` cells with the smallest hash of their key; every
    round goes over all cells. A class that loses all its cells is given up; fewer distinct cells than classes give fewer classes."""
    rows = nan_to_null(cells.select(key, *[F.col(n).cast("double").alias(n) for n in names]), *names)
    stats = rows.agg(*[f(F.col(n)).alias(f"{f.__name__}_{i}") for i, n in enumerate(names) for f in (F.avg, F.stddev_pop)]).first()
    means = tuple(float(stats[f"avg_{i}"] or 0) for i in range(len(names)))
    spreads = tuple(varies(float(stats[f"stddev_pop_{i}"] or 0), m) for i, m in enumerate(means))
    model = Typology(tuple(names), means, spreads, ())
    table = cut_lineage(rows.select(F.xxhash64(F.lit(seed), key).alias("_h"), key, *[v.alias(f"v{i}") for i, v in enumerate(standardised(rows, model))]))
    values = [F.col(f"v{i}") for i in range(len(names))]
    sample = np.array([r[2:] for r in table.orderBy("_h", key).limit(SAMPLE).collect()], dtype=float).reshape(-1, len(names))
    if not len(sample):
        return model
    centres = _first_centres(sample, k)
    for _ in range(rounds):
        found = table.groupBy(nearest_class(values, tuple(map(tuple, centres))).alias("k")).agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]).collect()
        new = np.array([[r[f"m{i}"] for i in range(len(names))] for r in sorted(found, key=lambda r: r["k"])])
        moved = len(new) != len(centres) or np.abs(new - centres).max() > TOLERANCE
        centres = new
        if not moved:
            break
    centres = centres.round(9)
    return Typology(model.names, model.means, model.spreads, tuple(sorted(tuple(map(float, c)) for c in centres)))


def model_table(spark, model: Typology) -> DataFrame:
    """(class, variable, position, centre, mean, spread): the model as rows, to be stored beside the cells."""
    rows = [(k + 1, n, i, model.centres[k][i], model.means[i], model.spreads[i]) for k in range(len(model.centres)) for i, n in enumerate(model.names)]
    return spark.createDataFrame(rows, "class int, variable string, position int, centre double, mean double, spread double")


def read_model(table: DataFrame) -> Typology:
    rows = sorted(table.collect(), key=lambda r: (r["class"], r["position"]))  # classes times variables
    first = [r for r in rows if r["class"] == 1]
    centres = [tuple(r["centre"] for r in rows if r["class"] == k) for k in sorted({r["class"] for r in rows})]
    return Typology(tuple(r["variable"] for r in first), tuple(r["mean"] for r in first), tuple(r["spread"] for r in first), tuple(centres))


def with_class(cells: DataFrame, model: Typology, name: str = "type") -> DataFrame:
    """The cells with the number of their class; NULL if the model has none."""
    if not model.centres:
        return cells.withColumn(name, F.lit(None).cast("int"))
    return cells.withColumn(name, nearest_class(standardised(cells, model), model.centres))
