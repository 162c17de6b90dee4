"""Hard negatives by lists shared within clusters of anchors, sorted by an angular upper bound.

Anchors are clustered by direction. For a cluster with centre c and widest angle w, no member's inner product with a row i
exceeds |u| |i| cos(angle(i, c) - w): the bound, up to |u|, is the same for all members, so the rows are sorted by it once and
every member walks the list from the top until its worst kept score is above the bound of all that follows.

On Spark the list of a cluster is dealt into blocks of rows; a task walks one block for a group of members. Members start
with thresholds that their own group already reaches, and rows whose bound is below the lowest threshold of a group are not
sent to it: that ends the walk in front of whole blocks. The best of all blocks are merged by rank. First each anchor's
positives are found, then, within the window of scores that each positive sets, its negatives; nothing is capped or sampled,
but for the centres, which only decide who shares a list.

Scores are inner products of integers and exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SCALE = 256  # of the whole numbers that components become
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score
GROUP, MOST_GROUP = 512, 8192  # members of a cluster that share a task: a 64th of all anchors between these
CENTRE_SAMPLE = 20_000  # anchors that the centres are fitted to, at most
MEMBERS, MOST_CENTRES, ROUNDS, SEED = 512, 128, 8, 17  # anchors of a cluster, about
BLOCK, MOST_BLOCK = 8192, 131_072  # rows of a block, about: a 32nd of all rows between these
CHUNK = 512  # rows that members walk in one step
LEAST_SCORE, MOST_SCORE = -(2 ** 62), 2 ** 62


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """(id, label, vec, norm) of the rows that take part: components as whole numbers floor(256 x), packed.

    Left out are rows without id, label or vector, and with a component that is NULL, NaN or infinite."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                vectors = part.column(2)
                flat = vectors.flatten()
                sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
                x = np.floor(SCALE * np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64))
                ends = np.cumsum(sizes)
                keep, made, norms = [], [], []
                for k, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
                    v = x[end - n:end]
                    if not np.isfinite(v).all():
                        continue
                    norm = float(np.sqrt((v * v).sum()))
                    if norm >= 2 ** 31:
                        raise ValueError(f"a vector of length {norm / SCALE:g} is too long for exact 64-bit scores")
                    keep.append(k)
                    made.append(v.astype("<i4").tobytes())
                    norms.append(norm)
                kept = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept.column(0).cast(pa.int64()), kept.column(1).cast(pa.int64()), pa.array(made, pa.binary()),
                                                  pa.array(norms, pa.float64())], ["id", "label", "vec", "norm"])
    some = rows.select(F.col(vec_id).alias("id"), label.cast("bigint").alias("label"), F.col(vector).alias("vec")).dropna()
    return some.mapInArrow(run, "id long, label long, vec binary, norm double")


def unpack(vecs: list[bytes], width: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors end in zeros."""
    if all(len(v) == 4 * width for v in vecs):
        return np.frombuffer(b"".join(vecs), dtype="<i4").reshape(len(vecs), width)
    return np.frombuffer(b"".join(v.ljust(4 * width, b"\0") for v in vecs), dtype="<i4").reshape(len(vecs), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: in doubles while these hold every sum, else in 64-bit integers."""
    most = np.sqrt((a.astype(float) ** 2).sum(axis=1)).max(initial=0) * np.sqrt((b.astype(float) ** 2).sum(axis=1)).max(initial=0)
    if most < 2 ** 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def centres_of(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Directions of k clusters: spherical k-means from seeded rows. An emptied cluster keeps its centre."""
    rows = unit(sample)
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        filled = np.bincount(own, minlength=len(centres)) > 0
        centres[filled] = unit(sums[filled])
    return centres


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(x) @ centres.T, -1, 1))


def bounds_of(norm: np.ndarray, angle: np.ndarray, widest: float) -> np.ndarray:
    """Upper bounds of the inner products with a unit vector of the cluster, rounding included."""
    return norm * np.cos(np.maximum(0, angle - widest - 1e-7)) * (1 + 1e-9 * np.sign(np.cos(np.maximum(0, angle - widest)))) + 1e-6


class Slots:
    """What members look for: the best k scores from low to high, of rows of the own label or of others.

    ``member`` numbers the members' rows; ``worst`` is a score that the k-th best is known to reach."""

    def __init__(self, member: np.ndarray, low: np.ndarray, high: np.ndarray, worst: np.ndarray, k: int, same: bool):
        self.member, self.low, self.high, self.k, self.same = member, low, high, k, same
        self.worst = np.where(low > high, MOST_SCORE, np.maximum(worst, low))
        self.best = np.zeros((0, 3), dtype=np.int64)  # slot, -score, id

    def floors(self, n: int) -> np.ndarray:
        """For each member, the lowest score that can still matter."""
        out = np.full(n, MOST_SCORE, dtype=np.int64)
        np.minimum.at(out, self.member, self.worst)
        return out

    def offer(self, active: np.ndarray, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Scores of the active members (rows) with list rows (columns), where ``fits``."""
        place = np.full(int(self.member.max(initial=0)) + 1, -1)
        place[active] = np.arange(len(active))
        slots = np.flatnonzero(place[self.member] >= 0)
        for at in range(0, len(slots), 256):
            some = slots[at:at + 256]
            rows = place[self.member[some]]
            s = scores[rows]
            hit, col = np.nonzero(fits[rows] & (s >= self.worst[some][:, None]) & (s <= self.high[some][:, None]))
            if len(hit):
                self.keep(np.stack([some[hit], -s[hit, col], ids[col]], axis=1))

    def keep(self, new: np.ndarray) -> None:
        touched = np.unique(new[:, 0])
        old = np.isin(self.best[:, 0], touched)
        rows = np.concatenate([self.best[old], new])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        starts = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
        rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        rows = rows[rank < self.k]
        full = rows[np.flatnonzero(rank[rank < self.k] == self.k - 1)]
        self.worst[full[:, 0]] = np.maximum(self.worst[full[:, 0]], -full[:, 1])
        self.best = np.concatenate([self.best[~old], rows])


def walk(slots: Slots, members: np.ndarray, member_ids: np.ndarray, member_labels: np.ndarray, member_norms: np.ndarray,
         rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, bounds: np.ndarray) -> int:
    """Every member walks the rows by descending bound until no later row can reach what it has. Returns the rows scored."""
    order = np.argsort(-bounds, kind="stable")
    seen = 0
    for at in range(0, len(order), CHUNK):
        floors = slots.floors(len(members))
        top = bounds[order[at]] * member_norms
        active = np.flatnonzero((floors < MOST_SCORE) & (top + 1e-6 >= floors))
        if not len(active):
            break
        some = order[at:at + CHUNK]
        scores = products(members[active], rows[some])
        equal = member_labels[active][:, None] == labels[some][None, :]
        fits = (equal if slots.same else ~equal) & (member_ids[active][:, None] != ids[some][None, :])
        slots.offer(active, scores, ids[some], fits)
        seen += scores.size
    return seen


def slots_of(pdf: pd.DataFrame, same: bool, k: int) -> Slots:
    """Slots of a group's members, in the order of the group's rows: ``low``, ``high`` and ``worst`` are lists."""
    sizes = [len(x) for x in pdf["low"]]
    flat = [np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf[c]]) if len(pdf) else np.zeros(0, dtype=np.int64) for c in ("low", "high", "worst")]
    return Slots(np.repeat(np.arange(len(pdf)), sizes), *flat, k, same)


GROUPED = "group long, id long, label long, vec binary, norm double, low array<long>, high array<long>, worst array<long>"


def seeded(anchors: DataFrame, same: bool, k: int, width: int) -> DataFrame:
    """The anchors of each group with thresholds (``worst``) that other members of the group already reach."""
    def seed(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unpack(list(pdf["vec"]), width)
        ids, labels, norms = (pdf[c].to_numpy() for c in ("id", "label", "norm"))
        slots = slots_of(pdf, same, k)
        walk(slots, x, ids, labels, norms, x, ids, labels, norms)
        return pdf.assign(worst=np.split(slots.worst, np.cumsum([len(v) for v in pdf["low"]])[:-1]))

    return anchors.groupBy("group").applyInPandas(seed, GROUPED)


def best_of_all(rows: DataFrame, anchors: DataFrame, centres: np.ndarray, same: bool, k: int, width: int, n_blocks: int) -> DataFrame:
    """(id, slot, rank, other, score): the k best rows of each anchor's slots among all rows, by score, then smaller id."""
    anchors = cut_lineage(seeded(anchors, same, k, width))

    def describe(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            x = unpack(list(pdf["vec"]), width)
            theta = angles(x, centres)
            cluster = theta.argmin(axis=1)
            # a zero vector scores 0 with every row: no angle bounds it, and it must see all rows that may matter
            lowest = np.array([min(w) if len(w) else MOST_SCORE for w in pdf["worst"]], dtype=np.float64)
            norm = pdf["norm"].to_numpy()
            cut = np.where(lowest >= MOST_SCORE, np.inf, np.where(norm > 0, lowest / np.maximum(norm, 1e-300), np.where(lowest > 0, np.inf, -np.inf)))
            yield pd.DataFrame({"group": pdf["group"], "cluster": cluster, "wide": np.where(norm > 0, theta.min(axis=1), 0.0), "cut": cut})

    known = anchors.mapInPandas(describe, "group long, cluster long, wide double, cut double").groupBy("group", "cluster").agg(
        F.max("wide").alias("wide"), F.min("cut").alias("cut")).toPandas()  # a row per group, of which there are few
    known = known.sort_values("group")
    groups, cluster, wide, cut = (known[c].to_numpy() for c in ("group", "cluster", "wide", "cut"))

    def deal(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in pdfs:
            for at in range(0, len(whole), 2048):
                pdf = whole.iloc[at:at + 2048].reset_index(drop=True)
                theta, norm = angles(unpack(list(pdf["vec"]), width), centres), pdf["norm"].to_numpy()
                block = pd.util.hash_array(pdf["id"].to_numpy()) % np.uint64(n_blocks)
                for g, c, w, low in zip(groups, cluster, wide, cut):
                    bound = bounds_of(norm, theta[:, c], w)
                    reach = bound + 1e-6 + 1e-9 * abs(low) >= low if np.isfinite(low) else np.full(len(pdf), low < 0)
                    if reach.any():
                        yield pdf[reach].assign(group=g, block=block[reach].astype(np.int64), bound=bound[reach])[
                            ["group", "block", "id", "label", "vec", "bound"]]

    sent = rows.mapInPandas(deal, "group long, block long, id long, label long, vec binary, bound double")
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>"))
    looking = anchors.withColumn("block", blocks)

    def walk_block(pdf_anchors: pd.DataFrame, pdf_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf_anchors) or not len(pdf_rows):
            return pd.DataFrame({"id": [], "slot": [], "other": [], "score": []}, dtype="int64")
        slots = slots_of(pdf_anchors, same, k)
        walk(slots, unpack(list(pdf_anchors["vec"]), width), *(pdf_anchors[c].to_numpy() for c in ("id", "label", "norm")),
             unpack(list(pdf_rows["vec"]), width), *(pdf_rows[c].to_numpy() for c in ("id", "label", "bound")))
        member = slots.member[slots.best[:, 0]]
        first = np.searchsorted(slots.member, np.arange(len(pdf_anchors)))
        return pd.DataFrame({"id": pdf_anchors["id"].to_numpy()[member], "slot": slots.best[:, 0] - first[member],
                             "other": slots.best[:, 2], "score": -slots.best[:, 1]})

    found = looking.groupBy("group", "block").cogroup(sent.groupBy("group", "block")).applyInPandas(
        walk_block, "id long, slot long, other long, score long")
    best = Window.partitionBy("id", "slot").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every anchor and each of its best
    ``positives`` other rows of the same label, the best ``negatives`` rows of other labels whose score is from ``low`` to
    ``high`` percent of the positive's.

    Scores are inner products of the components as floor(256 x); ties go to the smaller id. Rows without id, label or vector
    or with a NULL, NaN or infinite component take no part. Of rows that repeat an id, the one with the smallest label and
    packed vector counts. Shorter vectors end in zeros; an empty or zero vector scores 0 with every row. Vectors of
    length 2^31 / 256 and more are refused, as their scores would not be exact. Other columns are ignored, whatever their names.
    ``is_anchor`` and ``label`` are columns of ``rows``. No anchors, no rows, or a single label give no rows."""
    label = F.col("label") if label is None else label
    clean = whole_vectors(rows.withColumn(vec_id, F.col(vec_id).cast("bigint")), vec_id, vector, label)
    clean = cut_lineage(clean.groupBy("id").agg(F.min(F.struct("label", "vec", "norm")).alias("r")).select("id", "r.*"))
    chosen = rows.filter(is_anchor).select(F.col(vec_id).cast("bigint").alias("id")).dropna().distinct()
    anchors = cut_lineage(clean.join(chosen, "id", "left_semi"))
    n_rows, width = clean.agg(F.count(F.lit(1)), F.max(F.length("vec"))).first()
    n_anchors = anchors.count()
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return rows.sparkSession.createDataFrame([], shape)
    width = (width or 0) // 4
    sample = anchors.orderBy(F.xxhash64("id"), "id").limit(CENTRE_SAMPLE).select("vec").toPandas()
    centres = centres_of(unpack(list(sample["vec"]), width), max(1, min(MOST_CENTRES, n_anchors // MEMBERS)))
    n_blocks = -(-n_rows // min(MOST_BLOCK, max(BLOCK, n_rows // 32)))
    size = min(MOST_GROUP, max(GROUP, n_anchors // 64))

    def cluster(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pdf.assign(cluster=angles(unpack(list(pdf["vec"]), width), centres).argmin(axis=1))

    placed = cut_lineage(anchors.mapInPandas(cluster, "id long, label long, vec binary, norm double, cluster long"))
    pieces = F.broadcast(placed.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / size).alias("pieces")))  # a row per centre
    grouped = placed.join(pieces, "cluster").withColumn("group", F.col("cluster") * 2 ** 32 + F.pmod(F.xxhash64("id"), F.col("pieces")))
    nothing, lowest, highest = F.array(F.lit(LEAST_SCORE)), F.lit(LEAST_SCORE), F.array(F.lit(MOST_SCORE))
    columns = ["group", "id", "label", "vec", "norm", "low", "high", "worst"]
    looking = grouped.withColumns({"low": nothing, "high": highest, "worst": nothing}).select(*columns)
    found = cut_lineage(best_of_all(clean, looking, centres, True, positives, width, n_blocks))
    window = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("other").alias("positive"), "score"))).alias("pos"))

    def percent(p: Column, part: int, rounded: Callable[[Column], Column]) -> Column:
        return rounded(p["score"].cast("decimal(20,0)") * F.lit(part).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")).cast("bigint")

    looking = grouped.join(window, "id").withColumns({
        "low": F.transform("pos", lambda p: percent(p, low, F.ceil)), "high": F.transform("pos", lambda p: percent(p, high, F.floor)),
        "worst": F.transform("pos", lambda p: lowest)}).select(*columns)
    near = best_of_all(clean, looking, centres, False, negatives, width, n_blocks)
    pos = found.select(F.col("id").alias("anchor_id"), (F.col("rank") - 1).cast("bigint").alias("slot"), F.col("other").alias("positive_id"),
                       F.col("score").alias("positive_score"))
    return near.withColumnsRenamed({"id": "anchor_id", "other": "negative_id", "score": "negative_score"}).join(
        pos, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                                           "positive_score", "negative_score")

