"""Words, lines, row keys and small column helpers shared by the text operators.

A word is a run of characters other than space and U+0009-U+000D. NULL text counts as empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text, '' for NULL."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters keep their case. For plain ASCII texts `lower` does the same, much faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Array of the words of a text, in order."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once, however often the body names it.

    A lambda variable is bound per array element, so a one-element array binds it once; a plain
    column inside another lambda would be inlined there and evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_runs(hashes: Column, size: int) -> Column:
    """Hash of every run of ``size`` consecutive words, given the array of word hashes."""
    return let(hashes, lambda h: F.when(F.size(h) < size, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))))


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct hashes of the word ``size``-grams; a shorter text is one shingle, no words none."""
    hashed = F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
               .when(F.size(h) < size, F.array(F.aggregate(h, F.size(h).cast("bigint"), lambda a, x: F.xxhash64(a, x))))
               .otherwise(F.array_distinct(word_runs(h, size))))
