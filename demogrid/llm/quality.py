"""Quality rules: basic counts of each text, and cross-document line frequency.

Every text is read once: its counts and the hashes of its normalised lines are written to a table, by
which all further steps go. Per host, the distinct documents with a line are counted; lines above the
limit are taken out of every document of that host, and documents of which too little remains are
rejected. Columns and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import GAP, let, lower_ascii, whole, word_runs, words
from .graph import SMALL

SYMBOLS = r"[#*$%&|<>]"  # fixed value
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3  # fixed values of the base rules
LINE_SHARE = 0.10  # a line is boilerplate in a host above this share of its distinct documents
LINE_FLOOR = 5  # and above this number of them
LEAST_LEFT = 0.30  # share of a document's words that must remain


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Number of words inside word windows that occur twice or more in the text.

    Windows are sorted with their positions; equal neighbours are repeats; the covered words are
    counted from the gaps between their positions. No step compares all pairs of windows."""
    def covered(runs: Column) -> Column:
        pairs = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(pairs, lambda p: F.transform(F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]).eqNullSafe(True)
                                                          | (x["h"] == F.get(p, k + 1)["h"]).eqNullSafe(True)), lambda x: x["i"]))
        return let(F.sort_array(again), lambda at: F.aggregate(
            F.transform(at, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - x, F.lit(window)))),
            F.lit(0).cast("bigint"), lambda a, x: a + x))

    return let(word_runs(hashes, window), lambda runs: F.when(
        F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0).cast("bigint")).otherwise(covered(runs)))


def base_counts(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words> of a text; all 0 for NULL."""
    t = F.coalesce(text, F.lit(""))
    hashed = F.transform(words(t), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_replace(x, GAP, "") != "")
    return F.struct(
        let(hashed, lambda h: F.struct(F.size(h).cast("bigint").alias("n"), repeated_words(h).alias("r"))).alias("w"),
        F.length(F.regexp_replace(t, GAP, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("bigint")).alias("n_dup_lines"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def hashed_lines(text: Column) -> Column:
    """array<struct<h, n, i>>: hash, words and number (from 0, blank lines counted too) of the lines with a word, normalised:
    case of A-Z, digits and the amount of white space do not matter."""
    plain = F.regexp_replace(F.regexp_replace(lower_ascii(text), r"[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    numbered = F.transform(F.split(plain, "\n"), lambda x, i: F.struct(F.trim(x).alias("x"), i.alias("i")))
    return F.transform(F.filter(numbered, lambda l: l["x"] != ""), lambda l: F.struct(
        F.xxhash64(l["x"]).alias("h"), (F.length(l["x"]) - F.length(F.replace(l["x"], F.lit(" "), F.lit(""))) + 1).cast("bigint").alias("n"), l["i"].alias("i")))


def document_key(lines: Column) -> Column:
    """One hash over the whole list of hashed lines: texts that differ in white space, case or digits only are one document."""
    return F.when(F.size(lines) > 0, F.xxhash64(F.transform(lines, lambda l: l["h"])))


def frequent_lines(docs: DataFrame, share: float = LINE_SHARE, floor: int = LINE_FLOOR) -> DataFrame:
    """(host, gone) of the distinct documents (host, doc, lines): the lines that more than ``floor`` and more than ``share`` of a host's have.

    Counts are combined before they are shuffled by host and line; hosts are counted from one row per document. As each line of
    a host's list is in a ``share`` of its documents, the list is no longer than the mean number of lines divided by that share."""
    seen = docs.select("host", F.explode(F.array_distinct(F.transform("lines", lambda l: l["h"]))).alias("h")).groupBy("host", "h").agg(
        F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > floor)
    hosts = docs.groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("every"))
    return seen.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).filter(F.col("docs") > share * F.col("every")).groupBy("host").agg(
        F.collect_list("h").alias("gone"))


def without_lines(text: Column, at: Column) -> Column:
    """The text without the lines of the sorted numbers ``at``; the other lines stay as they are, in order.

    The runs between removed lines are cut out one by one, so the work follows the number of lines."""
    return let(F.split(text, "\n"), lambda lines: F.array_join(F.flatten(F.transform(
        F.concat(F.array(F.lit(-1)), at), lambda a, k: F.slice(lines, a + 2, F.coalesce(F.get(at, k), F.size(lines)) - a - 1))), "\n"))


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", share: float = LINE_SHARE, floor: int = LINE_FLOOR,
                  least_left: float = LEAST_LEFT, cleaned: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (its columns ``carry``, or all) with the base counts, ``base_failed``, ``removed_share`` and ``kept``.

    ``kept`` is false if the base rules fail or less than ``least_left`` of the words remains once the lines above the
    limit of the host are removed. Distinct documents are counted: texts with the same normalised lines count once in a host,
    so that copies do not make their own text boilerplate. NULL host is a host of its own. With ``cleaned`` also ``clean_text``,
    the text without these lines, and ``clean_failed``, whether that fails the base rules; all other columns are about the original
    text. NULL text is empty and fails the base rules. Repeated rows are returned each. Columns of the input with the
    names of the made ones are replaced; other names cannot clash, as rows are carried as a whole."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_share", "kept",
            *(["clean_text", "clean_failed"] if cleaned else [])]
    spark, chosen = docs.sparkSession, [c for c in (docs.columns if carry is None else carry) if c not in made]
    read = docs.select(F.struct(*[F.col(c) for c in chosen]).alias("row"), F.col(host).alias("host"), base_counts(F.col(text)).alias("base"),
                       hashed_lines(whole(text)).alias("lines"), *([F.col(text).alias("text")] if cleaned and text not in chosen else [])).withColumn(
        "doc", document_key(F.col("lines")))
    path = scratch_path(spark, "quality")
    read.write.option("compression", "zstd").parquet(f"{path}/read")
    read = spark.read.parquet(f"{path}/read")
    read.filter("doc is not null").select("host", "doc", "lines").dropDuplicates(["host", "doc"]).write.option("compression", "zstd").parquet(f"{path}/docs")
    often = frequent_lines(spark.read.parquet(f"{path}/docs"), share, floor).withColumnRenamed("host", "_host")
    often.write.parquet(f"{path}/often")
    # a short row per host, sent to the texts while all of them together are few lines; else the join is shuffled
    often = spark.read.parquet(f"{path}/often")
    few = (often.agg(F.sum(F.size("gone") + 1)).first()[0] or 0) <= SMALL
    judged = read.join(F.broadcast(often) if few else often, F.col("host").eqNullSafe(F.col("_host")), "left")
    own = F.array_intersect(F.transform("lines", lambda l: l["h"]), F.coalesce("gone", F.array().cast("array<bigint>")))
    judged = judged.withColumn("hit", let(own, lambda g: F.when(F.size(g) > 0, F.filter("lines", lambda l: F.array_contains(g, l["h"])))))
    judged = judged.withColumn("removed", F.aggregate("hit", F.lit(0).cast("bigint"), lambda s, l: s + l["n"]))
    failed = base_failed(F.col("base.w.n"), F.col("base.w.r"))
    left_out = F.coalesce(F.col("removed") / F.col("base.w.n"), F.lit(0.0))
    counts = [F.col("base.w.n").alias("n_words"), F.col("base.word_chars"), F.col("base.n_symbols"), F.col("base.n_dup_lines"),
              F.col("base.w.r").alias("n_repeat_words"), failed.alias("base_failed"), left_out.alias("removed_share"),
              (~failed & (left_out <= 1 - least_left)).alias("kept")]
    if not cleaned:
        return judged.select("row.*", *counts)
    judged = judged.withColumn("text", F.col("row")[text]) if text in chosen else judged
    judged = judged.withColumn("clean_text", F.when(F.col("hit").isNull(), F.col("text")).otherwise(
        without_lines(F.col("text"), F.transform("hit", lambda l: l["i"]))))
    # most texts lose nothing: only the others are counted again
    again = F.when(F.col("hit").isNotNull(), let(base_counts(F.col("clean_text")), lambda b: base_failed(b["w"]["n"], b["w"]["r"])))
    return judged.select("row.*", *counts, "clean_text", F.coalesce(again, failed).alias("clean_failed"))
