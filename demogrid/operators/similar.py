"""Similar places: rows whose vectors point in nearly the same direction, by a coarse inverted index.

Seeded centres cut the unit sphere into lists; every row is dealt to the list of its nearest centre. A query is compared with
the lists nearest to it, list by list in tasks that return their best rows only, and the best of all tasks are merged by rank.
The exact search first probes a few lists, so that it knows what the n-th best reaches at least, and then exactly those lists
whose widest angle allows a better row. The indexed search probes a fixed number of lists, chosen by its measured recall.

Similarities are rounded to six places before they are ranked; ties go to the smaller id."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, varies
from ..session import cut_lineage

MOST_LISTS = 4096  # and about the square root of the rows below
SAMPLE_A_LIST = 32  # rows that centres are fitted to, per list; every row is indexed
ROUNDS, SEED = 10, 7
LIST_ROWS, LIST_QUERIES = 32_768, 2_048  # of a task, about; longer lists are cut by hash
FIRST_PROBES = 4
PLACES = 1_000_000  # of the rounded similarity
_PAIRS = "list long, part long, qpart long, qid long, vec array<double>, least long"


def unit_vectors(rows: DataFrame, key: str, vector: str | Column) -> DataFrame:
    """(id, vec): vectors of length 1. Rows without key or direction (a NULL, NaN or infinite component, all zero) are left out;
    of rows that repeat a key, the greatest vector counts."""
    v = F.col(vector) if isinstance(vector, str) else vector
    rows = rows.select(F.col(key).cast("bigint").alias("id"), v.cast("array<double>").alias("vec"))
    broken = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~broken).withColumn("_n", length).filter("_n > 0")
    return rows.select("id", F.transform("vec", lambda x: x / F.col("_n")).alias("vec")).groupBy("id").agg(F.max("vec").alias("vec"))


def profile_vector(rows: DataFrame, names: list[str], key: str = "cell_id") -> DataFrame:
    """(key, profile): the named numeric columns standardised by mean and deviation; missing values and columns that do not vary are 0,
    the mean. One aggregation gives all means and deviations."""
    values = rows.select(key, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    values = nan_to_null(values, *[f"v{i}" for i in range(len(names))])
    stats = values.agg(*[f(f"v{i}").alias(f"{f.__name__}{i}") for i in range(len(names)) for f in (F.avg, F.stddev_pop)]).first()
    moved = [(float(stats[f"avg{i}"] or 0), float(stats[f"stddev_pop{i}"] or 0)) for i in range(len(names))]
    parts = [F.coalesce((F.col(f"v{i}") - mean) / spread, F.lit(0.0)) if varies(spread, mean) else F.lit(0.0) for i, (mean, spread) in enumerate(moved)]
    return values.select(key, F.array(*parts).alias("profile"))


def _matrix(vecs: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vecs), width))
    for i, v in enumerate(vecs):
        out[i, :min(width, len(v))] = v[:width]
    return out


def fit_centres(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centres on the sphere: seeded rows, moved to the mean direction of their rows; a centre left without rows takes the row
    that lies farthest from its own."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        near = sample @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.sqrt((sums ** 2).sum(axis=1))
        empty = np.flatnonzero(length == 0)
        filled = length > 0
        centres[filled] = sums[filled] / length[filled][:, None]
        if len(empty):
            centres[empty] = sample[np.argsort(near.max(axis=1), kind="stable")[:len(empty)]]
    return centres


@dataclass
class SimilarIndex:
    """``table`` (list, part, id, vec) holds every row; ``centres``, widest angles and numbers of parts describe the lists."""

    table: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    parts: np.ndarray

    @property
    def width(self) -> int:
        return self.centres.shape[1]


def build_index(vectors: DataFrame, n_lists: int | None = None, seed: int = SEED) -> SimilarIndex:
    """Index of (id, vec). Centres are fitted to the rows with the smallest hash of their id, `SAMPLE_A_LIST` per list."""
    vectors = cut_lineage(vectors)
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    k = max(1, min(MOST_LISTS, n_lists or round(n ** 0.5)))
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_A_LIST * k).toPandas()
    centres = fit_centres(_matrix(some["vec"], width), k, seed=seed) if n else np.zeros((1, 1))
    width = centres.shape[1]

    def deal(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            near = _matrix(pdf["vec"], width) @ centres.T
            yield pdf.assign(list=near.argmax(axis=1), angle=np.arccos(np.clip(near.max(axis=1, initial=-1), -1, 1)))

    dealt = cut_lineage(vectors.mapInPandas(deal, "id long, vec array<double>, list long, angle double"))
    known = dealt.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")).toPandas()  # a row per list
    radius, parts = np.full(len(centres), -1.0), np.zeros(len(centres), dtype=np.int64)  # empty lists are never probed
    radius[known["list"]] = known["angle"]
    parts[known["list"]] = -(-known["n"] // LIST_ROWS)
    cuts = F.array(*[F.lit(int(p)) for p in parts]) if len(parts) <= 256 else F.split(F.lit(",".join(map(str, parts))), ",").cast("array<bigint>")
    table = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.get(cuts, F.col("list").cast("int")).cast("bigint"))).select("list", "part", "id", "vec")
    return SimilarIndex(table, centres, radius, parts)


def _probe(index: SimilarIndex, queries: DataFrame, choose) -> DataFrame:
    """(list, part, qpart, qid, vec, least) of the lists that ``choose(angles, rank, least)`` marks, every part of them."""
    centres, parts, width = index.centres, index.parts, index.width

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for at in range(0, len(pdf), 1024):
                some = pdf.iloc[at:at + 1024]
                theta = np.arccos(np.clip(_matrix(some["vec"], width) @ centres.T, -1, 1))
                theta[:, parts == 0] = np.inf
                rank = theta.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
                q, c = np.nonzero(choose(theta, rank, some["least"].to_numpy()[:, None]) & (parts > 0)[None, :])
                q, c = np.repeat(q, parts[c]), np.repeat(c, parts[c])
                begin = np.flatnonzero(np.diff(q * len(centres) + c, prepend=-1))
                part = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
                for lo in range(0, len(q), 8192):
                    s = slice(lo, lo + 8192)
                    yield pd.DataFrame({"list": c[s], "part": part[s], "qpart": 0, "qid": some["qid"].to_numpy()[q[s]],
                                        "vec": some["vec"].to_numpy()[q[s]], "least": some["least"].to_numpy()[q[s]]})
    return queries.select("qid", "vec", "least").mapInPandas(run, _PAIRS)


def _compare(index: SimilarIndex, probes: DataFrame, n: int) -> DataFrame:
    """(qid, id, micro): the n best rows of every probed part for each query, itself left out."""
    width = index.width
    probes = cut_lineage(probes)
    load = probes.filter("part = 0").groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_QUERIES).alias("qparts"))  # a row per list
    rows = index.table.join(F.broadcast(load), "list").withColumn("qpart", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("qparts") - 1)))
    asked = probes.drop("qpart").join(F.broadcast(load), "list").withColumn("qpart", F.pmod(F.xxhash64("qid"), F.col("qparts")))

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        ids, x = r["id"].to_numpy(), _matrix(r["vec"], width)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        for at in range(0, len(q) if len(r) else 0, 256):
            some = q.iloc[at:at + 256]
            qid = some["qid"].to_numpy()
            micro = np.rint(_matrix(some["vec"], width) @ x.T * PLACES).astype(np.int64)
            micro[qid[:, None] == ids[None, :]] = -2 * PLACES
            m = min(n, len(ids))
            nth = np.partition(micro, len(ids) - m, axis=1)[:, len(ids) - m]
            i, j = np.nonzero(micro >= np.maximum(nth, np.maximum(some["least"].to_numpy(), -PLACES - 1))[:, None])
            best = np.lexsort((ids[j], -micro[i, j], i))
            i, j = i[best], j[best]
            begin = np.flatnonzero(np.diff(i, prepend=-1))
            rank = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i))))
            i, j = i[rank < m], j[rank < m]
            out.append(pd.DataFrame({"qid": qid[i], "id": ids[j], "micro": micro[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "id": [], "micro": []}, dtype="int64")

    keys = ["list", "part", "qpart"]
    return asked.groupBy(*keys).cogroup(rows.select(*keys, "id", "vec").groupBy(*keys)).applyInPandas(run, "qid long, id long, micro long")


def _ranked(found: DataFrame, n: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.desc("micro"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def _told(ranked: DataFrame) -> DataFrame:
    return ranked.select(F.col("qid").alias("id"), "rank", F.col("id").alias("other"), (F.col("micro") / PLACES).alias("similarity"))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("id").alias("qid"), "vec", F.lit(-2 * PLACES).cast("bigint").alias("least"))


def most_similar(index: SimilarIndex, queries: DataFrame, n: int = 10, probes: int | None = None) -> DataFrame:
    """(id, rank, other, similarity): for each query (id, vec) the ``n`` rows of greatest cosine, other than itself.

    With ``probes`` only that many lists nearest to the query are looked at; without, the answer is exact: after the first
    lists, those follow whose bound cos(angle to the centre - widest angle of the list) reaches the n-th best so far."""
    asked = _asked(queries)
    first = cut_lineage(_ranked(_compare(index, _probe(index, asked, lambda t, rank, least: rank < (probes or FIRST_PROBES)), n), n))
    if probes:
        return _told(first)
    radius = index.radius
    least = first.filter(F.col("rank") == n).select("qid", F.col("micro").alias("least"))
    again = asked.drop("least").join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(-2 * PLACES)).cast("bigint"))

    def may_hold_better(theta: np.ndarray, rank: np.ndarray, least: np.ndarray) -> np.ndarray:
        bound = np.cos(np.maximum(0, np.where(np.isfinite(theta), theta, 0) - radius[None, :] - 1e-6))
        return (rank >= FIRST_PROBES) & (bound * PLACES + 1 >= least)

    rest = _compare(index, _probe(index, again, may_hold_better), n)
    return _told(_ranked(first.select("qid", "id", "micro").unionByName(rest), n))


def recall_by_probes(index: SimilarIndex, queries: DataFrame, exact: DataFrame) -> DataFrame:
    """(probes, recall): the share of the exact neighbours whose list is among the nearest 1, 2, … lists of their query."""
    centres, parts, width = index.centres, index.parts, index.width

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            theta = np.arccos(np.clip(_matrix(pdf["vec"], width) @ centres.T, -1, 1))
            theta[:, parts == 0] = np.inf
            rank = theta.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
            yield pd.DataFrame({"probes": rank[np.arange(len(pdf)), pdf["list"].to_numpy()] + 1})

    where = exact.select(F.col("id").alias("qid"), F.col("other").alias("id")).join(index.table.select("id", "list"), "id")
    ranks = where.join(queries.select(F.col("id").alias("qid"), "vec"), "qid").select("list", "vec").mapInPandas(run, "probes long")
    counts = ranks.groupBy("probes").count()  # a row per list at most
    upto = Window.orderBy("probes")
    return counts.select("probes", (F.sum("count").over(upto) / F.sum("count").over(Window.partitionBy())).alias("recall"))


def probes_for(index: SimilarIndex, queries: DataFrame, n: int = 10, recall: float = 0.95, most_queries: int = 500) -> int:
    """How many lists to probe for a recall, measured on the ``most_queries`` queries with the smallest hash."""
    some = cut_lineage(queries.orderBy(F.xxhash64("id"), "id").limit(most_queries))
    known = recall_by_probes(index, some, most_similar(index, some, n))
    return known.filter(F.col("recall") >= recall - 1e-9).agg(F.min("probes")).first()[0] or 1
