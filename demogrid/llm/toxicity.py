"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: density, number and variety of lexicon words, how many of them stand near a
second-person pronoun, capitals, punctuation and obfuscated spellings. The lexicon is learned from
labelled training texts. Features come from one pass over the texts; trees and calibration are
Spark ML."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import whole

SAMPLE = 30_000  # labelled training rows that the model is fitted on, about; fewer are all taken
LEXICON = 300  # words of the learned lexicon at most
LEAST_DOCS, LEAST_ODDS = 3, 4.0  # toxic documents with a lexicon word, and how much likelier it is in them
NEAR = 4  # words around a pronoun
THRESHOLD = 0.3  # fixed value
TREES, DEPTH = 25, 4
CALIBRATION = 5  # one of so many fitted rows is kept for the isotonic regression
#: Second-person words of the four languages (fixed list).
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine deiner ihr euch euer sie ihnen tu te toi ton ta tes vous "
                          "votre vos tú ti tus usted ustedes vosotros".split())
#: Letters that digits and signs stand for in disguised spellings (fixed list).
_LEET = str.maketrans("013457@$!", "oieastasi")
_WORDS = re.compile(r"[^\W_](?:[\w@$!*'-]*[^\W_])?|[@$][\w@$!*]+")

FEATURES = ["lexicon_density", "lexicon_weight", "lexicon_hits", "lexicon_kinds", "disguised_hits", "near_you", "you_density",
            "capital_letters", "capital_words", "exclaim", "question", "punctuation", "obfuscated", "symbols", "log_words"]


def is_training(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is not 2 (fixed rule). NULL ids are training rows."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def tokens(text: str) -> list[str]:
    return _WORDS.findall(text)


def features_of(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The dense features of one text; all 0 for NULL and ''."""
    text = text or ""
    ws = tokens(text)
    n = max(1, len(ws))
    low = [w.lower() for w in ws]
    get = lexicon.get
    hits = [(i, get(w)) for i, w in enumerate(low) if w in lexicon]
    obfuscated = [i for i, w in enumerate(low) if not w.isalpha() and any(c.isalpha() for c in w) and not w.isalnum() or (w.isalnum() and not w.isalpha() and not w.isdigit())]
    disguised = []
    for i in obfuscated:
        plain = low[i].translate(_LEET)
        plain = "".join(c for c in plain if c.isalpha())
        if plain in lexicon and low[i] not in lexicon:
            disguised.append((i, get(plain)))
    you = [i for i, w in enumerate(low) if w in SECOND_PERSON]
    where = np.array(you)
    every = hits + disguised
    near = 0
    if you and every:
        at = np.array([i for i, _ in every])
        k = np.searchsorted(where, at)
        left = np.where(k > 0, at - where[np.maximum(k - 1, 0)], 1 << 30)
        right = np.where(k < len(where), where[np.minimum(k, len(where) - 1)] - at, 1 << 30)
        near = int((np.minimum(left, right) <= NEAR).sum())
    weight = sum(x for _, x in every)
    written = max(1, len(text) - text.count(" "))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    caps = sum(1 for w in ws if len(w) > 2 and w.isupper())
    marks = len(re.findall(r"[.,;:!?\"'()-]", text))
    symbols = len(re.findall(r"[#*$%&|<>@]", text))
    chars = max(1, len(text))
    return [len(hits) / n, weight / n, float(len(every)), float(len({low[i] for i, _ in every})), float(len(disguised)), float(near), len(you) / n,
            upper / written, caps / n, text.count("!") / n, text.count("?") / n, marks / chars, len(obfuscated) / n, symbols / chars,
            math.log1p(len(ws))]


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Words with the log odds of standing in toxic texts, at most LEXICON of them, from (text, label) rows."""
    w = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(whole("text")), F.lit(r"[\p{L}\p{N}@$][\p{L}\p{N}@$!*'-]*"), F.lit(0))))
    n1, n0 = labelled.agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first()
    if not n1 or not n0:
        return {}
    found = (labelled.select(w.alias("w"), "label").groupBy("w").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
             .filter(F.col("a") >= LEAST_DOCS)
             .withColumn("odds", ((F.col("a") + 0.5) / (n1 + 1)) / ((F.col("b") + 0.5) / (n0 + 1)))
             .filter(F.col("odds") >= LEAST_ODDS).orderBy(F.desc(F.col("a") * F.log("odds")), "w").limit(LEXICON).collect())
    return {r["w"].rstrip("!*'-"): math.log(r["odds"]) for r in found}


def with_features(docs: DataFrame, lexicon: dict[str, float], keep: list[str], text: str = "text") -> DataFrame:
    """(keep…, features…): one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = shared.value
        for pdf in parts:
            made = np.array([features_of(t, lex) for t in pdf[text]], dtype=float).reshape(len(pdf), len(FEATURES))
            yield pd.concat([pdf[keep].reset_index(drop=True), pd.DataFrame(made, columns=FEATURES)], axis=1)

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"{f} double" for f in FEATURES])
    return docs.select(*keep, text).mapInPandas(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
                   sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Only labels of training rows (`is_training`) are read, of those at most about ``sample`` by a hash of the id; a label
    given twice counts as toxic if one of them is. The score is the calibrated probability, with a hundredth of the
    uncalibrated one added to keep the order within the steps of the calibration. Without labels of both kinds every
    score is the share of toxic labels (0 without any). NULL text is empty and is scored like any text; NULL ids are
    scored, not learned from. Other columns are ignored; no rows give no rows."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = labels.filter(is_training(F.col(doc_id)) & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("double")).alias("label"))
    n = known.count()
    range_ = 1_000_000
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(range_))
    few = known.filter(part < math.ceil(range_ * min(1.0, sample / max(1, n))))
    held_out = ~is_training(F.col("doc_id"))
    learned = cut_lineage(d.join(F.broadcast(few), "doc_id"))  # about ``sample`` texts at most
    share = learned.agg(F.avg("label")).first()[0]
    if share in (None, 0.0, 1.0):
        score = F.lit(float(share or 0.0))
        return d.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
    lexicon = learn_lexicon(learned)
    pack = VectorAssembler(inputCols=FEATURES, outputCol="features")
    # boosting makes many passes over these rows: few partitions, read back from the shared folder
    rows = cut_lineage(with_features(learned, lexicon, ["doc_id", "label"])).coalesce(4)
    rows = pack.transform(rows).withColumn("held", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(CALIBRATION)) == 0)
    fit, check = rows.filter(~F.col("held")), rows.filter("held")
    if fit.agg(F.countDistinct("label")).first()[0] < 2 or check.agg(F.countDistinct("label")).first()[0] < 2:
        fit = check = rows
    trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=seed, minInstancesPerNode=5).fit(fit)

    def probability(df: DataFrame) -> DataFrame:
        return trees.transform(df).withColumn("raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    steps = IsotonicRegression(labelCol="label", featuresCol="raw", predictionCol="step").fit(probability(check))
    scored = steps.transform(probability(pack.transform(with_features(d, lexicon, ["doc_id"]))))
    score = F.least(F.greatest(0.99 * F.col("step") + 0.01 * F.col("raw"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
