"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets follow the weights and stop at a multiple of each source's size. They are turned into whole
numbers of equal-token blocks, first per source and then per shard of a source, always by highest
quotients (size / 1, / 3, / 5, …). Inside a shard, documents lie in a seeded order on a line of
tokens; the shard takes all of its blocks a whole number of times and a seeded run of blocks once more."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, WORD, words

BLOCK = 8  # tokens of a block; blocks are never rows, so small ones cost nothing
SHARD_DOCS = 500  # documents of a shard, about
MOST_SHARDS = 4_096  # of a source; beyond it shards grow
FEW_SOURCES = 50_000  # whose plan may be broadcast (a few MB)


def n_words(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("bigint")


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats of each party by highest quotients votes / (2 k + 1), at most ``most`` each; ties to the first party.

    The common divisor is found by bisection, the last seats by a queue of quotients."""
    votes, most = np.asarray(votes, dtype=float), np.where(np.asarray(votes) > 0, most, 0).astype(np.int64)
    seats = int(min(seats, most.sum()))
    if seats <= 0:
        return np.zeros(len(votes), dtype=np.int64)

    def given(d: float) -> np.ndarray:
        return np.minimum(np.floor(votes / d + 0.5), most).astype(np.int64)

    low, high = votes[votes > 0].min() / (2.0 * most.max() + 2.0), 4.0 * votes.max()  # too many seats, none
    for _ in range(200):
        mid = (low + high) / 2
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
    got = given(high)  # at most ``seats``
    queue = [(-votes[i] / (2 * got[i] + 1), i) for i in np.flatnonzero(got < most)]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * got[i] + 1), i))
    return got


def fill_targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of ``total`` by weight; what exceeds ``most`` times a size is reshared by weight until nothing does."""
    sizes, weights = np.asarray(sizes, dtype=float), np.asarray(weights, dtype=float)
    caps = most * sizes
    target, open_ = np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool)
    left = min(float(total), caps.sum())
    while open_.any() and left > 0:
        share = np.where(open_, weights, 0) * (left / weights[open_].sum())
        full = open_ & (share >= caps)
        if not full.any():
            target[open_] = share[open_]
            break
        target[full] = caps[full]
        left -= caps[full].sum()
        open_ &= ~full
    return target


def mix_plan(rows: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), epochs: float = 1.5, most: float = 2.0, seed: int = 17,
             source: str = "source", doc_id: str = "doc_id", size: str = "size", block: int = BLOCK) -> DataFrame:
    """Every row with source_size, target, taken, first_piece and piece_words; ``size`` is its number of words.

    ``weights`` repeat over the sources in code-point order, NULL last; the mix has ``epochs`` times all words, no source
    more than ``most`` times its size. ``taken`` words of a document are used: all of it ``taken // size`` times and a piece
    of ``piece_words`` words from word ``first_piece`` (0-based) on; with whole ``most`` never more than that many copies.
    The seeded order depends on seed, id and size only, so reruns agree; rows equal in both are interchangeable. Size 0
    takes nothing and stays. No rows give no rows. Columns of the input with the same names are replaced.

    The driver sees one row per source (the list that the weights are given for); a task sees one row per shard of a
    source, at most MOST_SHARDS, or the rows of one shard."""
    rows = rows.drop("source_size", "target", "taken", "first_piece", "piece_words")
    spark = rows.sparkSession
    found = rows.groupBy(F.col(source).alias("s")).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("docs")).collect()
    found.sort(key=lambda r: (r["s"] is None, r["s"] or ""))  # Python compares strings by code point
    sizes = np.array([r["size"] for r in found], dtype=np.int64)
    w = np.array([weights[i % len(weights)] for i in range(len(found))], dtype=float)
    target = fill_targets(sizes, w, epochs * float(sizes.sum()), most)
    quota = sainte_lague(target, int(round(target.sum() / block)), np.floor(most * -(-sizes // block)).astype(np.int64))
    plan = spark.createDataFrame(
        [(i, r["s"], int(sizes[i]), float(target[i]), int(quota[i]), min(MOST_SHARDS, -(-r["docs"] // SHARD_DOCS)))
         for i, r in enumerate(found)], "_n int, _s string, source_size long, target double, _quota long, _shards int")

    if len(found) <= FEW_SOURCES:
        plan = F.broadcast(plan)
    placed = (rows.join(plan, F.col(source).eqNullSafe(F.col("_s"))).drop("_s")
              .withColumn("_order", F.xxhash64(F.lit(seed), F.col(doc_id), F.col(size)))
              .withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.col("_shards").cast("bigint")).cast("int")))

    def shard_quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_shard", ignore_index=True)
        blocks = -(-pdf["tokens"].to_numpy() // block)
        q = sainte_lague(pdf["tokens"].to_numpy(), int(pdf["_quota"].iloc[0]), np.floor(most * blocks).astype(np.int64))
        return pd.DataFrame({"_n2": pdf["_n"], "_shard2": pdf["_shard"], "_q": q, "_blocks": blocks})

    shards = (placed.groupBy("_n", "_shard").agg(F.sum(size).alias("tokens"), F.first("_quota").alias("_quota"))
              .groupBy("_n").applyInPandas(shard_quotas, "_n2 int, _shard2 int, _q long, _blocks long"))
    w_ = Window.partitionBy("_n", "_shard").orderBy("_order", F.col(doc_id), F.col(size)).rowsBetween(Window.unboundedPreceding, 0)
    lined = placed.withColumn("_end", F.sum(size).over(w_)).join(
        shards, (F.col("_n") == F.col("_n2")) & (F.col("_shard") == F.col("_shard2")))
    n = F.greatest("_blocks", F.lit(1))
    again = F.expr("_q % greatest(_blocks, 1)")
    lined = lined.withColumns({
        "_times": F.expr("_q div greatest(_blocks, 1)"), "_start": F.col("_end") - F.col(size),
        "_from": F.pmod(F.xxhash64(F.lit(seed + 2), "_n", "_shard"), n - again + 1) * block, "_len": again * block})
    first = F.greatest("_start", "_from")
    piece = F.greatest(F.least(F.col("_end"), F.col("_from") + F.col("_len")) - first, F.lit(0))
    return lined.select(*rows.columns, "source_size", "target", (F.col("_times") * F.col(size) + piece).alias("taken"),
                        F.when((piece > 0) & (piece < F.col(size)), first - F.col("_start")).otherwise(0).alias("first_piece"),
                        F.when(piece < F.col(size), piece).otherwise(F.lit(0)).cast("bigint").alias("piece_words"))


def word_piece(text: Column, first: Column, count: Column) -> Column:
    """``count`` words of a text from word ``first`` (0-based) on, with the white space behind each."""
    return F.rtrim(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"{WORD}(?:{GAP})?"), F.lit(0)), first + 1, count), ""))


def apply_mix(planned: DataFrame, text: str = "text", size: str = "size", piece: str = "is_piece") -> DataFrame:
    """The rows of the mix: each document as often as it is taken, then the piece of it, marked by the column ``piece``.

    Documents of which nothing is taken are gone."""
    copies = F.when(F.col(size) > 0, F.expr(f"(taken - piece_words) div greatest({size}, 1)")).otherwise(0)
    rows = planned.withColumn(piece, F.explode(F.concat(
        F.array_repeat(F.lit(False), copies.cast("int")), F.array_repeat(F.lit(True), (F.col("piece_words") > 0).cast("int")))))
    return rows.withColumn(text, F.when(F.col(piece), word_piece(
        F.col(text), F.col("first_piece").cast("int"), F.col("piece_words").cast("int"))).otherwise(F.col(text)))


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", chars: str = "n_chars", **options) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``; options as in `mix_plan`, repeats and pieces as in `apply_mix`."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_id"), F.col(source).alias("_source"),
                      F.col(text).alias("_text"), n_words(F.col(text)).alias("_size"))
    planned = mix_plan(row, source="_source", doc_id="_id", size="_size", **options)
    taken = apply_mix(planned, text="_text", size="_size", piece="_piece")
    new = {text: F.col("_text")}
    if chars in docs.columns:
        new[chars] = F.when(F.col("_piece"), F.length("_text").cast(docs.schema[chars].dataType)).otherwise(F.col(f"_row.{chars}"))
    return taken.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])
