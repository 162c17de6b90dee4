"""Threshold-scaled document sketches: of the distinct shingle hashes of a text, all those below a
fixed fraction of the hash range are kept.

Which hashes are kept does not depend on the text, so sketches of parts merge by union, and the
share of one sketch found in another estimates containment whatever the sizes of the two texts.
Columns and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, shingles

FRACTION = 0.25  # of all hashes
SHINGLE = 5
BUCKET_DOCS = 64  # documents of a bucket in `with_following`, about
MOST_BUCKETS = 16_384


def _limit(fraction: float) -> int:
    return int(-(2 ** 63) + fraction * 2 ** 64) if fraction < 1 else 2 ** 63 - 1


def _kept(hashes: Column, fraction: float) -> Column:
    """The hashes below the threshold, sorted; the smallest one if there is none below."""
    below = F.sort_array(F.filter(hashes, lambda h: h <= F.lit(_limit(fraction))))
    return let(below, lambda b: F.when((F.size(b) > 0) | (F.size(hashes) == 0), b).otherwise(F.array(F.array_min(hashes))))


def sketch(text: Column, fraction: float = FRACTION, size: int = SHINGLE) -> Column:
    """Sorted array of the kept hashes. Equal texts give equal sketches; NULL and texts without words give an empty one.

    A text with words is never without a hash: if all of its shingles are above the threshold, the smallest is kept."""
    return let(shingles(F.coalesce(text, F.lit("")), size), lambda h: _kept(h, fraction))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Sketch of two parts taken together: a smallest hash above the threshold stays only if neither part has one below."""
    return let(F.array_union(a, b), lambda h: _kept(h, fraction))


def containment(a: Column, b: Column) -> Column:
    """Estimated share (0 to 1) of the shingles of ``a`` that ``b`` has too. Equal sketches give 1, two empty ones included;
    otherwise an empty one is contained in nothing: 0."""
    return F.when(a == b, F.lit(1.0)).when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity (0 to 1); 1 for equal sketches, two empty ones included."""
    return let(F.array_union(a, b), lambda u: F.when(a == b, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(u)))


def encode(sketched: Column) -> Column:
    """The sketch as a string of 16 hex digits per hash."""
    return F.array_join(F.transform(sketched, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_following(docs: DataFrame, doc_id: str = "doc_id", columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """Every row with ``next_<column>``: the values of the next row in descending doc_id; the first row's after the last.

    Rows of equal doc_id are ordered by the columns; NULL ids come last. One row is its own next. Ids are cut into
    buckets at quantiles that are ids themselves; the row that begins a bucket is copied to the end of the bucket above
    it (and the very first row to the end of the last bucket), so one shuffle by bucket is enough and no window spans
    the table."""
    spark = docs.sparkSession
    least = -(2 ** 63)
    rows = docs.withColumn("_id", F.coalesce(F.col(doc_id).cast("bigint"), F.lit(least)))
    n, top, low = rows.agg(F.count(F.lit(1)), F.max("_id"), F.min("_id")).first()
    n_buckets = max(1, min(MOST_BUCKETS, n // BUCKET_DOCS))
    cuts: list[int] = []
    if n_buckets > 1:
        at = [k / n_buckets for k in range(1, n_buckets)]
        found = rows.agg(F.percentile_approx("_id", at, min(10 * n_buckets, 100_000))).first()[0]
        cuts = sorted({c for c in found if c < top})
    # bucket b holds the ids with exactly b cuts below them; a cut itself is the highest id of its bucket
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    steps = [2 ** k for k in range(len(cuts).bit_length() - 1, -1, -1)] if cuts else []
    below = F.lit(0)
    if steps:
        below = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda acc, s: F.when(
            (acc + s <= len(cuts)) & (F.get(table, acc + s - 1) < F.col("_id")), acc + s).otherwise(acc))
    rows = rows.withColumn("_b", below.cast("int"))
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("extra"))
    is_cut = (F.get(table, F.col("_b")) == F.col("_id")).eqNullSafe(True) if cuts else F.lit(False)
    nobody = F.lit(None).cast("struct<b:int,extra:int>")
    places = F.array_compact(F.array(
        own, F.when(is_cut, F.struct((F.col("_b") + 1).alias("b"), F.lit(1).alias("extra"))).otherwise(nobody),
        F.when(F.col("_id") == F.lit(top), F.struct(F.lit(0).alias("b"), F.lit(2).alias("extra"))).otherwise(nobody)))
    dealt = rows.withColumn("_p", F.explode(places)).drop("_b")
    w = Window.partitionBy("_p.b").orderBy("_p.extra", F.desc("_id"), *columns)
    out = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.filter(F.col("_p.extra") == 0).drop("_p", "_id")


def edited_text(text: Column, following: Column) -> Column:
    """The last floor(n / 3) code points replaced by the first as many (or all) of the following text."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))
