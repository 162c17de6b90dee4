"""Language-model scores from a hidden Markov model over word classes.

Every training word is counted (a shuffle over all training tokens). The few words frequent enough
are classes of their own, all others share a class with the words of the same ending, so the
emission table is bounded while the word counts stay a distributed table. Baum-Welch runs over all
training texts: tasks return expected counts, Spark adds them up. From seeded noise, a first pass takes the texts
slice by slice (stepwise expectation maximisation: the counts of all slices so far, older ones with less
weight, make the model for the next slice), so one pass brings many rounds; a whole pass ends it. Slices
are shares of the corpus, no text reaches the driver. The score of a text is its exact
likelihood by the scaled forward recursion, times the share of each word within its class.

  p(text) = p(classes | HMM) * product of (c(word) + 0.5) / (N(class) + 0.5 (V(class) + 1))

Unknown words take the one spare share of their class. Words are lower-cased (A-Z); every text ends
with an end token that has a class of its own."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .common import lower_ascii, words

STATES = 8
OWN_CLASS = 4_096  # words with at least 1/OWN_CLASS of all tokens are classes of their own: at most that many
KNOWN_COUNT = 65_536  # words with at least 1/KNOWN_COUNT of all tokens are sent to every task: at most that many
ENDINGS = 1_024  # classes for the others, by hash of the last ENDING bytes
ENDING = 4
SLICES = 12  # the first pass over all training texts goes slice by slice, with a new model after each
DECAY = 0.7  # counts of slice i enter with weight (i + 1) ** -DECAY
ROUNDS = 1  # whole passes after that
CELLS = 200_000  # texts times tokens of a batch
LOG10 = math.log(10.0)
END = 0  # class of the end token; classes 1… are frequent words, the rest endings


def is_training(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is not 1 (fixed rule). NULL ids are training texts."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 1, F.lit(True))


@dataclass
class Hmm:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (C, K): p(class | state)


def _batches(seqs: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(positions, observations, live): texts of like length together, longest first; ``live[t]`` of them reach token t."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    at = 0
    while at < len(order):
        longest = len(seqs[order[at]])
        take = order[at:at + max(1, min(1024, CELLS // max(1, longest)))]
        at += len(take)
        lengths = np.array([len(seqs[i]) for i in take])
        obs = np.zeros((longest, len(take)), dtype=np.int32)
        for j, i in enumerate(take):
            obs[:lengths[j], j] = seqs[i]
        yield take, obs, len(take) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")


def forward(m: Hmm, obs: np.ndarray, live: np.ndarray, keep: bool = False):
    """Log likelihood of each text by the scaled forward recursion; with ``keep`` also alphas and scales."""
    total = np.zeros(obs.shape[1])
    a = None
    alphas, scales = [], []
    for t, n in enumerate(live):
        e = m.emit[obs[t, :n]]
        a = (m.start * e) if t == 0 else (a[:n] @ m.move) * e
        c = a.sum(axis=1)
        a /= c[:, None]
        total[:n] += np.log(c)
        if keep:
            alphas.append(a)
            scales.append(c)
    return (total, alphas, scales) if keep else total


def expected_counts(m: Hmm, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of start, moves and emissions over some texts."""
    k, classes = len(m.start), m.emit.shape[0]
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes))
    for _, obs, live in _batches(seqs):
        _, alphas, scales = forward(m, obs, live, keep=True)
        b = np.ones((live[-1], k))
        gammas, seen = [], []
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            if len(b) < n:  # texts that end here
                b = np.concatenate([b, np.ones((n - len(b), k))])
            g = alphas[t] * b
            gammas.append(g)
            seen.append(obs[t, :n])
            if t:
                eb = m.emit[obs[t, :n]] * b / scales[t][:, None]
                move += alphas[t - 1][:n].T @ eb
                b = eb @ m.move.T
        start += gammas[-1].sum(axis=0)
        g, o = np.concatenate(gammas), np.concatenate(seen)
        for s in range(k):
            emit[s] += np.bincount(o, weights=g[:, s], minlength=classes)
    return start, move * m.move, emit


def maximise(start: np.ndarray, move: np.ndarray, emit: np.ndarray, common: np.ndarray) -> Hmm:
    """New parameters; a few pseudo-counts keep every class possible in every state."""
    e = emit + 20.0 * common[None, :]
    return Hmm((start + 1.0) / (start + 1.0).sum(), (move + 1.0) / (move + 1.0).sum(axis=1, keepdims=True),
               np.ascontiguousarray((e / e.sum(axis=1, keepdims=True)).T))


class _Symbols(dict):
    """Symbol of every word met: its own for frequent words, else that of its ending."""

    def __init__(self, frequent: dict[bytes, int], endings_from: int):
        super().__init__(frequent)
        self.frequent, self.first = frequent, endings_from

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000 + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        got = self[word] = self.first + zlib.crc32(word[-ENDING:]) % ENDINGS
        return got


class Classes:
    """Class of every word, and the logarithm of the count of the frequent ones.

    ``frequent`` has (word, count, own class or 0). Symbols are 0 for the end, then the frequent words, then the endings;
    tables give the class of a symbol and log10(count + 0.5) where it is a frequent word."""

    def __init__(self, frequent: list[tuple[bytes, float, int]], endings_from: int):
        n = len(frequent)
        self.symbols = _Symbols({w: 1 + i for i, (w, _, _) in enumerate(frequent)}, 1 + n)
        shared = [endings_from + zlib.crc32(w[-ENDING:]) % ENDINGS for w, _, _ in frequent]
        self.class_of = np.array([END, *[own or s for (_, _, own), s in zip(frequent, shared)], *range(endings_from, endings_from + ENDINGS)], dtype=np.int32)
        self.log_of = np.array([0.0, *[math.log10(c + 0.5) for _, c, _ in frequent], *[0.0] * ENDINGS])
        self.shared_log_of = np.where(self.class_of >= endings_from, self.log_of, 0.0)
        self.is_known = np.array([False, *[True] * n, *[False] * ENDINGS])

    def sequence(self, text: str | None) -> tuple[np.ndarray, float, float, int]:
        """Classes of a text's tokens with the end; summed log10(c + 0.5) of its frequent words, of those among them that
        share a class, and how many they are."""
        tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
        sym = np.fromiter(map(self.symbols.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        seq = np.empty(len(sym) + 1, dtype=np.int32)
        seq[:-1], seq[-1] = self.class_of[sym], END
        return seq, float(self.log_of[sym].sum()), float(self.shared_log_of[sym].sum()), int(self.is_known[sym].sum())


def ending_class(word: Column) -> Column:
    """Index (0-based) of the class that a word shares by its ending."""
    b = word.cast("binary")
    return (F.crc32(F.substring(b, F.greatest(F.octet_length(b) - ENDING + 1, F.lit(1)), F.lit(ENDING))) % ENDINGS).cast("int")


def word_counts(train: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all training texts."""
    return train.select(F.explode(words(lower_ascii(F.coalesce(F.col(text), F.lit(""))))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("c"))


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS,
                seed: int = 5) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; log10 probabilities.

    The model and the base (add-half word frequencies) learn from rows with `is_training`. NULL text is empty and has the
    end token only. Rows equal in id and text share their scores and are all returned. Without training texts all words
    are unknown. Other columns are ignored; no rows give no rows."""
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), is_training(F.col(doc_id)).alias("train"))
    d = d.withColumn("key", F.xxhash64("doc_id", F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))))
    counts = cut_lineage(word_counts(d.filter("train")))
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_docs = d.filter("train").count()
    n_all, v_all = n_words + n_docs, n_distinct + (n_docs > 0)

    # at most KNOWN_COUNT words reach this share
    frequent = counts.filter(F.col("c") * KNOWN_COUNT >= n_all).collect()
    own_words = sorted(r["word"] for r in frequent if r["c"] * OWN_CLASS >= n_all)
    own = {w: 1 + i for i, w in enumerate(own_words)}
    first = 1 + len(own)
    n_classes = first + ENDINGS
    # tokens and distinct words of the classes by ending; a class by itself has share 1 for its word
    inside = np.zeros(ENDINGS)
    spread = np.zeros(ENDINGS)
    own_table = spark.createDataFrame([(w,) for w in own_words] or [("",)], "word string")
    for r in counts.join(F.broadcast(own_table), "word", "left_anti").groupBy(ending_class(F.col("word")).alias("e")).agg(
            F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        inside[r["e"]], spread[r["e"]] = r["n"], r["v"]
    share_log = np.zeros(n_classes)  # log10 of the denominator within the class
    share_log[first:] = np.log10(inside + 0.5 * (spread + 1))
    common = np.zeros(n_classes)
    common[END] = n_docs
    for r in frequent:
        if r["word"] in own:
            common[own[r["word"]]] = r["c"]
    common[first:] = inside
    common = (common + 0.5) / (common + 0.5).sum()

    tools = spark.sparkContext.broadcast(([(r["word"].encode(), r["c"], own.get(r["word"], 0)) for r in frequent], first))

    def to_sequences(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = Classes(*tools.value)
        for pdf in parts:
            for at in range(0, len(pdf), 500):
                p = pdf.iloc[at:at + 500]
                got = [classes.sequence(t) for t in p["text"]]
                yield pd.DataFrame({"doc_id": p["doc_id"], "key": p["key"], "train": p["train"], "seq": [g[0] for g in got],
                                    "known_log": [g[1] for g in got], "shared_log": [g[2] for g in got], "known_n": [g[3] for g in got]})

    schema = "doc_id long, key long, train boolean, seq array<int>, known_log double, shared_log double, known_n long"
    slice_of = F.when(F.col("train"), F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(SLICES))).otherwise(-1).cast("int")
    path = scratch_path(spark, "sequences")
    d.mapInPandas(to_sequences, schema).withColumn("slice", slice_of).write.partitionBy("slice").parquet(path)
    seqs = spark.read.schema(f"{schema}, slice int").parquet(path)

    rng = np.random.default_rng(seed)
    noise = common[:, None] * rng.gamma(1.0, 1.0, (n_classes, states))
    model = Hmm(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), noise / noise.sum(axis=0))
    total = None
    for i in range(SLICES if n_docs else 0):  # stepwise: every text once, each slice by the model of those before
        new = _counts_of_all(seqs.filter(F.col("slice") == i), model)
        weight = (i + 1) ** -DECAY
        total = [SLICES * n if t is None else (1 - weight) * t + weight * SLICES * n for t, n in zip(total or [None] * 3, new)]
        model = maximise(*total, common)
    for _ in range(rounds if n_docs else 0):
        model = maximise(*_counts_of_all(seqs.filter("slice >= 0"), model), common)

    final = spark.sparkContext.broadcast((model, share_log))

    def likelihoods(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, inner = final.value
        for pdf in parts:
            got = [np.asarray(s, dtype=np.int32) for s in pdf["seq"]]
            out = np.zeros(len(got))
            for at, obs, live in _batches(got):
                out[at] = forward(m, obs, live)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": pdf["key"], "train": pdf["train"], "n_tokens": [len(s) for s in got],
                                "known_n": pdf["known_n"], "known_log": pdf["known_log"], "shared_log": pdf["shared_log"],
                                "hmm": out / LOG10 - np.array([inner[s].sum() for s in got])})

    scored = seqs.mapInPandas(likelihoods, "doc_id long, key long, train boolean, n_tokens long, known_n long, known_log double, shared_log double, hmm double")

    # counts of the words that are not frequent come from a join; a hash of 64 bits stands for the word
    freq_table = spark.createDataFrame([(r["word"],) for r in frequent] or [("",)], "word string")
    rare = (d.select("key", F.explode(words(lower_ascii(F.coalesce("text", F.lit(""))))).alias("word"))
            .join(F.broadcast(freq_table), "word", "left_anti").select("key", F.xxhash64("word").alias("h")))
    table = counts.filter(F.col("c") * KNOWN_COUNT < n_all).select(F.xxhash64("word").alias("h"), F.col("c"))
    c = F.coalesce("c", F.lit(0))
    sums = rare.join(table, "h", "left").groupBy("key").agg(
        F.sum(F.log10(c + 0.5)).alias("rare_log"), F.count("c").alias("rare_known"))
    copies = d.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    sums = sums.join(copies, "key").select("key", (F.col("rare_log") / F.col("copies")).alias("rare_log"),
                                           (F.col("rare_known") / F.col("copies")).cast("bigint").alias("rare_known"))
    whole_log = math.log10(n_all + 0.5 * (v_all + 1))
    end_log = math.log10(n_docs + 0.5)
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return scored.join(sums, "key", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens",
        (F.col("known_n") + F.coalesce("rare_known", F.lit(0)) + int(n_docs > 0)).alias("n_known"), F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("known_log") + rare_log + end_log - F.col("n_tokens") * whole_log).alias("base_score"),
        (F.col("hmm") + F.col("shared_log") + rare_log).alias("score"))


def _counts_of_all(seqs: DataFrame, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts over all texts: one set per task, added up by Spark."""
    k, classes = len(model.start), model.emit.shape[0]
    shared = seqs.sparkSession.sparkContext.broadcast(model)
    names = [f"s{i}" for i in range(k)]

    def part(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes))
        for pdf in parts:
            s, m, e = expected_counts(shared.value, [np.asarray(x, dtype=np.int32) for x in pdf["seq"]])
            start, move, emit = start + s, move + m, emit + e
        table = np.concatenate([start[None, :], move, emit.T])
        some = np.flatnonzero(table.sum(axis=1) > 0)
        yield pd.DataFrame(table[some], columns=names).assign(row=some)

    got = seqs.select("seq").mapInPandas(part, ", ".join(f"{n} double" for n in names) + ", row long").groupBy("row").agg(
        *[F.sum(n).alias(n) for n in names]).collect()
    table = np.zeros((1 + k + classes, k))
    for r in got:
        table[r["row"]] = [r[n] for n in names]
    return table[0], table[1:1 + k], np.ascontiguousarray(table[1 + k:].T)
