"""Names and labels: accent-insensitive normalisation, ranked search scores, JSON rows."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latin letters that have no decomposition, and what they fold to.
PLAIN_LETTERS = {"ł": "l", "ø": "o"}


def _folding() -> dict[str, str]:
    """Lower-case letters with a canonical decomposition, and their base letters."""
    table = dict(PLAIN_LETTERS)
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if base != letter and letter == letter.lower():
            table[letter] = base
    return table


FOLDING = _folding()
ACCENTED, FOLDED = "".join(FOLDING), "".join(FOLDING.values())


def normalise(col: Column) -> Column:
    """Lower case without accents, whether letters are composed or followed by combining marks; the same
    rule for indexed names and for queries."""
    return F.regexp_replace(F.translate(F.lower(col), ACCENTED, FOLDED), "[\\u0300-\\u036F]", "")


def alnum_key(col: Column) -> Column:
    """Only ``a-z0-9`` of the normalised text, for matching variable names."""
    return F.regexp_replace(normalise(col), "[^a-z0-9]+", "")


def search_score(name: Column, needle: Column, secondary: Column) -> Column:
    """Smaller is better: match at the start 0, at a word start 1, inside 3; entries of the
    secondary kind cost half a point, longer names a little more. NULL without a match."""
    pos = F.instr(name, needle)
    before = F.substr(name, pos - 1, F.lit(1))
    place = (F.when(pos == 1, F.lit(0.0)).when(before.rlike(r"[\s\-.]"), F.lit(1.0))
             .otherwise(F.lit(3.0)))
    return F.when(pos > 0, place + F.when(secondary, 0.5).otherwise(0.0)
                  + F.length(name) / F.lit(1000.0))


def search_names(entries: DataFrame, queries: list[str], limit: int = 12) -> DataFrame:
    """The ``limit`` best entries for every typed query of two letters or more.

    ``entries(entry_id, name, kind)``; kind ``'u'`` ranks before the others. The queries are
    constants in the plan: each entry is read once, tested against all of them where it lies,
    and only its hits are ranked."""
    pairs = F.array(*[F.struct(F.lit(q).alias("query"), normalise(F.trim(F.lit(q))).alias("needle"))
                      for q in dict.fromkeys(queries)])
    names = entries.select("entry_id", "kind", normalise(F.col("name")).alias("norm_name"))
    hits = names.withColumn("hit", F.explode(F.filter(
        pairs, lambda p: (F.length(p["needle"]) >= 2) & F.col("norm_name").contains(p["needle"])))).select(
        "entry_id", "kind", "norm_name", "hit.query", "hit.needle")
    scored = hits.withColumn("score", search_score(F.col("norm_name"), F.col("needle"), F.col("kind") != "u"))
    return top_per_key(scored, ["query"], ["score", "norm_name", "entry_id"], limit, "pos")


def top_per_key(df: DataFrame, keys: list[str], order: list, limit: int, rank: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= limit)


def airport_label(municipality: Column, name: Column, iata: Column) -> Column:
    """``municipality (IATA)``; falls back to the name, then to a plain word."""
    from .columns import blank_to_null

    place = F.coalesce(blank_to_null(municipality), blank_to_null(name), F.lit("aeroport"))
    code = blank_to_null(iata)
    return F.when(code.isNotNull(), F.concat(place, F.lit(" ("), code, F.lit(")"))).otherwise(place)


def is_urban(kind: Column) -> Column:
    """Built-up areas whose type does not begin with the village prefix are urban."""
    return kind.isNotNull() & ~kind.startswith("Sat")


def locality_kind(kind: Column) -> Column:
    return (F.when(kind.startswith("Sat"), "sat").when(kind.startswith("Sector"), "sector")
            .otherwise("localitate urbană"))


def share_label(share: Column) -> Column:
    """Display class of a share: tiny but not zero reads ``<0.1%``, else one decimal."""
    return F.when((share > 0) & (share < 0.001), F.lit("<0.1%")).otherwise(
        F.concat(F.format_string("%.1f", F.bround(share * 100, 1)), F.lit("%")))


def json_rows(df: DataFrame) -> DataFrame:
    """One compact JSON document per row, in a single ``value`` column."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
