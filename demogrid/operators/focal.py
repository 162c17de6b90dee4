"""Neighbourhoods on the grid: sums, means and class shares within a radius of every cell.

The grid is cut into square blocks. A cell is sent to its own block and to those it lies within the largest radius of, so the
shuffle grows with the blocks' rims, not with the discs. Inside a block, sums along each row make a disc of radius r cost
2 r + 1 lookups a cell, whatever its area. Cells that do not exist, and missing values, count for nothing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128  # cells along a block's side, at least four times the largest radius


def disc(radius: float) -> list[tuple[int, int]]:
    """(dy, half width) of the rows of a disc of cell centres within ``radius`` cells."""
    r = int(radius)
    return [(dy, math.isqrt(int(radius * radius - dy * dy + 1e-9))) for dy in range(-r, r + 1)]


def _disc_sums(dense: np.ndarray, rows: np.ndarray, cols: np.ndarray, radius: float) -> np.ndarray:
    """Sums of the disc around each (row, col) of a dense block whose halo is at least the radius."""
    run = np.zeros((dense.shape[0], dense.shape[1] + 1), dtype=dense.dtype)
    np.cumsum(dense, axis=1, out=run[:, 1:])
    total = np.zeros(len(rows), dtype=dense.dtype)
    for dy, w in disc(radius):
        total += run[rows + dy, cols + w + 1] - run[rows + dy, cols - w]
    return total


def focal_statistics(cells: DataFrame, radii: list[float], sums: list[str] = (), means: list[str] = (), classes: dict[str, list[str]] | None = None,
                     key: str = "cell_id", row: str = "row", col: str = "col", block: int = BLOCK) -> DataFrame:
    """(key, radius, n_cells, sum_<c>…, mean_<c>…, share_<c>_<i>…) for each cell and each radius, in cells.

    The disc holds the cells whose centres are within the radius, the cell itself included. ``sum_`` adds whole numbers exactly;
    ``mean_`` is over the cells with a value (NaN is none) and NULL without any; ``share_<c>_<i>`` is the share of the disc's cells
    with a class whose class is the i-th listed one, NULL without any. Cells need distinct rows and columns; a place that occurs
    twice counts twice. Cells without row or column take no part. No cells give no rows."""
    if not radii or min(radii) < 0:
        raise ValueError("radii must be given, and not be negative")
    classes = dict(classes or {})
    halo = int(max(radii))
    block = max(block, 4 * halo, 1)
    kinds = {c: cells.schema[c].dataType for c in sums}
    whole = {c: k.simpleString() in ("tinyint", "smallint", "int", "bigint") for c, k in kinds.items()}
    chosen = list(dict.fromkeys([*sums, *means]))
    listed = {c: {v: i for i, v in enumerate(values)} for c, values in classes.items()}
    numbered = [F.coalesce(*[F.when(F.col(c) == v, i) for v, i in values.items()], F.when(F.col(c).isNotNull(), len(values))).alias(f"_c{i}")
                for i, (c, values) in enumerate(listed.items())]
    flat = cells.select(F.col(key).alias("_key"), F.col(row).cast("bigint").alias("_row"), F.col(col).cast("bigint").alias("_col"),
                        *[F.col(c).cast("bigint" if whole.get(c) else "double").alias(f"_v{i}") for i, c in enumerate(chosen)], *numbered).filter(
        "_row is not null and _col is not null")

    def touched(at: str) -> Column:
        return F.sequence(F.floor((F.col(at) - halo) / block), F.floor((F.col(at) + halo) / block))

    sent = flat.withColumn("_br", F.explode(touched("_row"))).withColumn("_bc", F.explode(touched("_col")))
    names = [*[f"sum_{c}" for c in sums], *[f"mean_{c}" for c in means], *[f"share_{c}_{i}" for c, v in listed.items() for i in range(len(v))]]
    key_type = cells.schema[key].dataType.simpleString()
    shape = ", ".join([f"`{key}` {key_type}", "radius double", "n_cells bigint",
                       *[f"`sum_{c}` {'bigint' if whole[c] else 'double'}" for c in sums],
                       *[f"`{n}` double" for n in names[len(sums):]]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf["_br"].iloc[0]) * block - halo, int(pdf["_bc"].iloc[0]) * block - halo
        y, x = pdf["_row"].to_numpy() - top, pdf["_col"].to_numpy() - left
        own = (y >= halo) & (y < halo + block) & (x >= halo) & (x < halo + block)
        oy, ox = y[own], x[own]
        if not len(oy):
            return pd.DataFrame(columns=[key, "radius", "n_cells", *names])
        side = block + 2 * halo

        def dense(values: np.ndarray, there: np.ndarray) -> np.ndarray:
            grid = np.zeros((side, side), dtype=values.dtype)
            np.add.at(grid, (y[there], x[there]), values[there])
            return grid

        every = np.ones(len(y), dtype=bool)
        ones = np.ones(len(y), dtype=np.int64)
        cells_here = dense(ones, every)
        grids = {}
        for i, c in enumerate(chosen):
            column = pdf[f"_v{i}"]
            there = column.notna().to_numpy()
            number = column.fillna(0).to_numpy(dtype=np.int64 if whole.get(c) else np.float64)
            grids[c] = dense(number, there), dense(ones, there) if c in means else None
        shares = {}
        for i, (c, values) in enumerate(listed.items()):
            code = pdf[f"_c{i}"].fillna(-1).to_numpy(dtype=np.int64)
            shares[c] = [dense(ones, code == k) for k in range(len(values))], dense(ones, code >= 0)
        out = []
        for r in radii:
            part = {key: pdf["_key"].to_numpy()[own], "radius": float(r), "n_cells": _disc_sums(cells_here, oy, ox, r)}
            with np.errstate(invalid="ignore", divide="ignore"):
                for c in sums:
                    part[f"sum_{c}"] = _disc_sums(grids[c][0], oy, ox, r)
                for c in means:
                    part[f"mean_{c}"] = _disc_sums(grids[c][0], oy, ox, r).astype(np.float64) / _disc_sums(grids[c][1], oy, ox, r)
                for c, (each, known) in shares.items():
                    n = _disc_sums(known, oy, ox, r)
                    for i, grid in enumerate(each):
                        part[f"share_{c}_{i}"] = _disc_sums(grid, oy, ox, r) / n
            out.append(pd.DataFrame(part))
        return pd.concat(out)

    found = sent.groupBy("_br", "_bc").applyInPandas(run, shape)
    return found.withColumns({n: F.nanvl(F.col(n), F.lit(None).cast("double")) for n in names[len(sums):]})
