"""Near-duplicates by SimHash: tiles of fingerprints are compared exactly, by exclusive or and bit counts.

1. One pass over the texts makes a 64-bit fingerprint of each; equal fingerprints become one row.
2. A fingerprint's tile is the population count of each of its four 16-bit parts. Two fingerprints differ in at least as
   many bits as their counts differ in sum, so tiles farther apart than the radius cannot hold a link. There are at most
   17^4 tiles, whatever the number of rows; their sizes make the plan.
3. Neighbouring tiles are taken together to blocks (a tile larger than a block is cut by hash), and every two blocks whose
   boxes of counts are near enough meet in one task. Inside it, tile pairs beyond the radius are skipped again; the rest is
   compared in NumPy. A task returns as few links as connect what all its links connect.

Nothing is sampled or capped. Size and number of blocks both grow with the square root of the number of distinct
fingerprints; comparing them all stays quadratic work, a tenth or so of all pairs after skipping."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import components, small

SHINGLE = 4
RADIUS = 4  # differing bits of a link
SEED = 42
PARTS, WIDTH = 4, 16  # parts of a fingerprint whose population counts name its tile
BASE = WIDTH + 1
BLOCK = 512  # least fingerprints of a block times its number of blocks; see `block_size`
MOST_BLOCKS = 1024  # the plan of blocks stays below this squared; blocks grow beyond
CELLS = 4_000_000  # comparisons held in memory at once
HOT = 4096  # a fingerprint with more than one in so many rows is joined by broadcast; there are fewer of them than this


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number. A bit is set if it is set in over half of the shingles' hashes.

    A-Z are lower-cased; a text with fewer words is one shingle; without words (or NULL) the fingerprint is 0."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
    if not ws:
        return 0
    size = min(size, len(ws))
    joined = b" ".join(ws)
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in ws])])
    n = len(ws) - size + 1
    ends = (starts[size:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    starts = starts.tolist()
    for at in range(0, n, 65_536):  # very long texts in pieces, so that their bits need no more memory
        some = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:min(n, at + 65_536)], ends[at:at + 65_536])], dtype=np.uint64)
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text, NULL ids included."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                made = [fingerprint(t, size, seed) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.int64())], ["doc_id", "fp"])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def tile_counts(fps: np.ndarray) -> np.ndarray:
    """Population counts of the parts, one row per fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, PARTS)).astype(np.int32)


def tile_codes(counts: np.ndarray) -> np.ndarray:
    return counts @ (BASE ** np.arange(PARTS))


def block_size(n: int) -> int:
    """Fingerprints of a block: the square root grows along, so that blocks are neither too many nor too large."""
    return max(1, math.ceil(n / MOST_BLOCKS), math.isqrt(BLOCK * n))


class BlockPlan:
    """Which block a fingerprint belongs to, and which blocks must meet. Made from the sizes of the tiles."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, radius: int):
        self.first = np.zeros(BASE ** PARTS, dtype=np.int64)  # of a tile: its first block,
        self.cuts = np.ones(BASE ** PARTS, dtype=np.int64)  # and how many blocks share it
        counts = codes[:, None] // BASE ** np.arange(PARTS) % BASE
        most = block_size(int(sizes.sum()))
        low, high, todo = [], [], [np.arange(len(codes))] if len(codes) else []
        while todo:
            at = todo.pop()
            weight = int(sizes[at].sum())
            box = counts[at].min(axis=0), counts[at].max(axis=0)
            if weight > most and len(at) > 1:  # halve along the widest side
                side = int((box[1] - box[0]).argmax())
                order = at[np.argsort(counts[at, side], kind="stable")]
                half = int(np.searchsorted(np.cumsum(sizes[order]), weight / 2))
                half = min(max(half, 1), len(order) - 1)
                todo += [order[:half], order[half:]]
                continue
            pieces = max(1, -(-weight // most))
            self.first[codes[at]] = len(low)
            self.cuts[codes[at]] = pieces
            low += [box[0]] * pieces
            high += [box[1]] * pieces
        lo, hi = np.array(low).reshape(-1, PARTS), np.array(high).reshape(-1, PARTS)
        self.partners: list[np.ndarray] = []
        for i in range(len(lo)):
            apart = np.maximum(0, np.maximum(lo[i] - hi, lo - hi[i])).sum(axis=1)
            self.partners.append(np.flatnonzero(apart <= radius))

    def blocks(self, fps: np.ndarray) -> np.ndarray:
        codes = tile_codes(tile_counts(fps))
        mixed = (fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[codes] + (mixed % self.cuts[codes].astype(np.uint64)).astype(np.int64)


class Forest:
    """Links that join two so far unconnected nodes."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        for a, b in zip(i.tolist(), j.tolist()):
            ra, rb = top(int(root[a])), top(int(root[b]))
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                self.links.append((a, b))
        if parent:
            old = np.fromiter(parent, dtype=np.int64)
            root[old] = [top(int(x)) for x in old]
            self.root = root[root]


def near_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between two arrays of distinct fingerprints (or within ``left``): a forest that connects what all links connect."""
    def tiled(fps: np.ndarray):
        counts = tile_counts(fps)
        codes = tile_codes(counts)
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        return order, starts, np.append(starts[1:], len(order)), counts[order[starts]]

    base = 0 if right is None else len(left)
    both = (left if right is None else np.concatenate([left, right])).view(np.uint64)  # of signed numbers, bits of the magnitude are counted
    order, starts, ends, counts = tiled(left)
    order_r, starts_r, ends_r, counts_r = (order, starts, ends, counts) if right is None else tiled(right)
    forest = Forest(len(both))
    for k in range(len(starts)):
        mine = order[starts[k]:ends[k]]
        near = np.abs(counts_r - counts[k]).sum(axis=1) <= radius
        if right is None:
            near[:k] = False  # compared from the other side
        width = ends_r - starts_r
        others = order_r[np.repeat(near, width)] + base
        if not len(others):
            continue
        step = max(1, CELLS // len(others))
        for at in range(0, len(mine), step):
            some = mine[at:at + step]
            hit = np.bitwise_count(both[some][:, None] ^ both[others][None, :]) <= radius
            hit &= some[:, None] != others[None, :]
            rows, cols = hit.any(axis=1), hit.any(axis=0)
            if not rows.any():
                continue
            # one partner of each first, so that few of the remaining links still join anything
            forest.add(some[rows], others[hit[rows].argmax(axis=1)])
            forest.add(some[hit[:, cols].argmax(axis=0)], others[cols])
            hit &= forest.root[some][:, None] != forest.root[others][None, :]
            i, j = np.nonzero(hit)
            if len(i):
                forest.add(some[i], others[j])
    ends_of = np.array(forest.links, dtype=np.int64).reshape(-1, 2)
    return both.view(np.int64)[ends_of[:, 0]], both.view(np.int64)[ends_of[:, 1]]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of a table of distinct fingerprints (fp): links within the radius, as many as connect what all of them connect."""
    def code(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            codes, sizes = np.unique(tile_codes(tile_counts(pdf["fp"].to_numpy(dtype=np.int64))), return_counts=True)
            yield pd.DataFrame({"code": codes, "size": sizes})

    tiles = distinct.select("fp").mapInPandas(code, "code long, size long").groupBy("code").agg(F.sum("size").alias("size"))
    sizes = tiles.toPandas().sort_values("code")  # 17^4 rows at most
    plan = BlockPlan(sizes["code"].to_numpy(dtype=np.int64), sizes["size"].to_numpy(dtype=np.int64), radius)

    def deal(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            fps = pdf["fp"].to_numpy(dtype=np.int64)
            blocks = plan.blocks(fps)
            for at in range(0, len(fps), 10_000):  # each goes to all partners of its block
                own, some = blocks[at:at + 10_000], fps[at:at + 10_000]
                met = [plan.partners[b] for b in own]
                times = [len(m) for m in met]
                own, other = np.repeat(own, times), np.concatenate(met)
                yield pd.DataFrame({"a": np.minimum(own, other), "b": np.maximum(own, other), "side": own > other, "fp": np.repeat(some, times)})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, side = pdf["fp"].to_numpy(dtype=np.int64), pdf["side"].to_numpy(dtype=bool)
        if pdf["a"].iloc[0] == pdf["b"].iloc[0]:
            a, b = near_links(fps, None, radius)
        else:
            a, b = near_links(fps[~side], fps[side], radius)
        return pd.DataFrame({"a": a, "b": b})

    return distinct.select("fp").mapInPandas(deal, "a long, b long, side boolean, fp long").groupBy("a", "b").applyInPandas(
        compare, "a long, b long")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row: fingerprint, and the smallest doc_id that links lead to, itself included.

    Two rows are linked if their fingerprints differ in ``radius`` bits at most, whatever the texts: rows with NULL, empty or
    blank text have fingerprint 0 and are linked with one another and with any other that is near 0. Rows of equal id are
    returned each. Rows without id take part; component_id is the smallest id that is not NULL, and NULL if there is none.
    Other columns are ignored; no rows give no rows."""
    rows = cut_lineage(fingerprints(docs, doc_id, text, size))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    labels = components(links(distinct, radius))
    rooted = distinct.join(small(labels.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("label", "fp"))
    linked = rooted.filter("label is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut_lineage(rooted.join(linked, "root", "left").select(
        "fp", "n", F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")))
    # a fingerprint may belong to a third of all rows: these few go to the rows, not the rows to one task
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(named.filter(F.col("n") * HOT > total).select("fp", "component_id"))
    rest = rows.join(hot, "fp", "left_anti").join(named.filter(F.col("n") * HOT <= total).select("fp", "component_id"), "fp")
    return rows.join(hot, "fp").unionByName(rest).select("doc_id", "fp", "component_id")
