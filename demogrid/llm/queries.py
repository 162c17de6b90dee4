"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprints, jaccard, licenses, lm, mixing, negatives, pii, quality, runs, simhash, toxicity
from .common import let, table, whole, words
from .oracles import ORACLES  # noqa: F401


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files are installed; pass another path to the operator elsewhere."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(
        [(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"))
    out = chat.format_chats(turns).withColumn("formatted", chat.formatted(F.col("segments")))
    loss = chat.loss_text(F.col("segments"))
    told = F.array_join(F.transform("_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (out.withColumns({"_back": chat.read_turns(F.col("formatted")), "_loss": loss})
            .select("conv_id", F.size("_back").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                    F.length("_loss").cast("bigint").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("bigint").alias("formatted_chars"), "valid", "error_turn"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", whole("text").alias("text"))
    docs = docs.withColumn("sketch", fingerprints.sketch(F.col("text")))
    near = fingerprints.with_following(docs, columns=("text", "sketch"))
    near = near.withColumn("edited", fingerprints.edited_text(F.col("text"), F.col("next_text")))
    near = near.withColumn("edited_sketch", fingerprints.sketch(F.col("edited")))
    return near.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprints.encode(F.col("sketch")).alias("fingerprint"),
                       fingerprints.encode(F.col("edited_sketch")).alias("edited_fingerprint"),
                       fingerprints.containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                       fingerprints.containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                   table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op4_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.quality_rules(docs, carry=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                              "base_failed", "kept", F.round("removed_share", 6).alias("removed_share"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", F.size("licenses").cast("bigint").alias("n_licenses"), "licenses")


#: Key of the registered query; a deployment passes its own secret.
SAMPLE_KEY = b"documentation key, not a secret"


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, SAMPLE_KEY).select("doc_id", "text", "pii", F.size("pii").cast("bigint").alias("n_entities"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, vocabulary_path()).select("doc_id", *bpe.digests(docs))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.mix_plan(sized).select("doc_id", "size", "source_size", "target", "taken", "first_piece", "piece_words")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), vec_id % 50 == 0,
                                    F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


def repeated_tail(text: Column, doc_id: Column) -> Column:
    """The text; if h = crc32(doc_id) is divisible by 10, its words from a on repeat the first p of them (see op13)."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def rewritten(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = let(F.struct(n.alias("n"), a.alias("a"), p.alias("p")), lambda c: F.transform(
            F.sequence(F.lit(0).cast("bigint"), c["n"] - 1), lambda i: F.get(w, F.when(i < c["a"], i).otherwise(c["a"] + (i - c["a"]) % c["p"]).cast("int"))))
        return F.when(n > 0, F.array_join(place, " ")).otherwise(F.lit(""))

    return F.when(h % 10 == 0, let(words(whole(text)), rewritten)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_tail(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.periodic_runs(docs).withColumn("best", runs.longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
                        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_document_fingerprints, op3_toxicity, op4_hmm_scores, op5_quality_rules, op6_license_scan, op7_jaccard_join,
    op8_pii_surrogates, op9_bpe_round_trip, op10_source_mix, op11_simhash, op12_hard_negatives, op13_periodic_runs)}
