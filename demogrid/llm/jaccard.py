"""Exact self-join of documents on the Jaccard similarity of their word shingles, by prefixes of token combinations.

1. One pass hashes the shingles of every text. A document can only be linked if enough of its smallest hashes (a
   prefix in hash order) occur in other documents' prefixes too; most documents end here.
2. Equal sets become one member. Tokens of the members left are ordered by how many members have them. Tokens that
   only one member has are passed over; rare tokens are indexed singly, frequent ones as pairs within small token
   classes, on a prefix extended until every linked pair must share an entry.
3. Entries are verified against full sets. First every member meets one hub; entries whose members that connects need no
   further comparison. Of the rest, small entries are verified pair by pair, large ones in blocks of members that are
   compared inside tasks.

Only token hashes, ids and counts are shuffled; nothing is capped and no class is collected."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import SMALL, components, small

SHINGLE = 5
PERCENT = 75  # a link needs 100 * intersection >= PERCENT * union
RARE = 8  # members that may have a token which is indexed singly
SPARE = 8  # one more shared token is asked for per so many shingles
SAMPLE = 64  # one in so many documents is looked at to find hot tokens; results do not depend on it
HOT, HOT_SEEN = 100_000, 4  # hot tokens at most (a few MB), and sampled documents that have one
HEAVY = 16  # members of an entry from which on blocks of members are compared instead of pairs
BLOCK_DOCS, BLOCK_TOKENS = 512, 400_000  # of a block, about
_LEVEL = math.log(1.34)  # sizes that may be linked are in the same or neighbouring levels
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; words are hashed once per task while they are remembered."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # lower() and split() of bytes: ASCII only
        if not ws:
            return np.zeros(0, dtype=np.int64)
        if len(self.known) > 300_000:
            self.known.clear()
        known = self.known
        hs = []
        for w in ws:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            hs.append(h)
        one = np.array(hs, dtype=np.uint64)
        size = min(self.size, len(one))
        with np.errstate(over="ignore"):
            run = np.full(len(one) - size + 1, np.uint64(size), dtype=np.uint64)
            for j in range(size):
                run = _finish(run * _MIX + one[j:len(one) - size + 1 + j])
        return np.unique(run.view(np.int64))


def allowed_misses(n: int, percent: int = PERCENT) -> int:
    """Tokens of a set of n that may be missing from a partner: n minus the least intersection, ceil(percent * n / 100)."""
    return n - -(-percent * n // 100)


def spare(n: int) -> int:
    return n // SPARE


def needed(n: int, percent: int = PERCENT) -> int:
    """Shared tokens that the extended hash prefixes of a set of n and any partner have: 1 + what the smaller one spares."""
    return 1 + spare(-(-percent * n // 100))


def token_pairs(tokens: np.ndarray, counts: np.ndarray, n: int, percent: int = PERCENT) -> np.ndarray:
    """Index entries of a member: ``tokens`` that other members have too, in global order, with their ``counts``; n is the set's size.

    Tokens that nobody else has come first in the order, but are never shared. Rare tokens are entries themselves. If they
    are fewer than the misses allowed, frequent tokens follow, in classes by hash; a class of m tokens gives its pairs and
    outlasts m - 1 misses. The number of classes depends on the size level, and a member is entered at the levels of all
    sizes that a smaller partner may have. If a set ends before its misses are covered, plain single entries are added,
    which two such sets must share."""
    misses = allowed_misses(n, percent)
    rare = tokens[counts <= RARE]
    lonely = n - len(tokens)
    left = misses + 1 - lonely
    if left <= 0:
        return np.zeros(0, dtype=np.int64)
    out = [_finish(rare[:left].view(np.uint64)).view(np.int64)]
    left -= len(rare)
    if left <= 0:
        return out[0]
    often = tokens[counts > RARE].view(np.uint64)
    for level in {n.bit_length(), (-(-percent * n // 100)).bit_length()}:
        classes = np.uint64(max(1, (1 << level) // 16))
        cls = _finish(often ^ _MIX) % classes
        # gain after each token: one, except for the first of its class
        order = np.argsort(cls, kind="stable")
        first = np.ones(len(often), dtype=bool)
        first[order[1:]] = cls[order[1:]] != cls[order[:-1]]
        gain = np.cumsum(~first)
        end = int(np.searchsorted(gain, left)) + 1
        if end > len(often):  # not enough: also found by any other set that ends like this
            out.append(_finish(often[:left] + np.uint64(7)).view(np.int64))
            end = len(often)
        at = order[order < end]
        c, t = cls[at], often[at]
        bounds = np.flatnonzero(np.diff(c.astype(np.int64), prepend=-1, append=-1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a > 1:
                i, j = np.triu_indices(b - a, 1)
                # stable sort: both members list a class in the same global order
                out.append(_finish(_finish(t[a:b][i] + np.uint64(level)) * _MIX + t[a:b][j]).view(np.int64))
    return np.unique(np.concatenate(out))


def _sets(docs: DataFrame, columns: str, make) -> DataFrame:
    """Run ``make(ids, sets)`` -> record batch over batches of (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                p = b.slice(at, 500)
                yield make(p.column(0), [shingle(t) for t in p.column(1).to_pylist()])
    return docs.select("id", "text").mapInArrow(run, columns)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)))


def _describe(hot: np.ndarray):
    def make(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        numbers = ([len(s) for s in sets], [int.from_bytes(k[:8], "big", signed=True) for k in keys],
                   [int.from_bytes(k[8:], "big", signed=True) for k in keys], [int(_among(hot, prefix(s)).sum()) for s in sets])
        return pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in numbers]], ["id", "n", "k1", "k2", "hot"])
    return make


def _among(hot: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(tokens), dtype=bool)
    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
    return hot[at] == tokens


def prefix(tokens: np.ndarray) -> np.ndarray:
    return tokens[:allowed_misses(len(tokens)) + 1 + spare(len(tokens))]


def _prefixes(hot: np.ndarray):
    def make(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        parts = [prefix(s) for s in sets]
        return pa.RecordBatch.from_arrays([ids, _lists([p[~_among(hot, p)] for p in parts])], ["id", "tokens"])
    return make


def _whole_sets(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, _lists(sets)], ["id", "tokens"])


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (distinct): a broadcast while they are few, else a join by id."""
    return docs.join(small(ids), "id", "left_semi")


def hot_tokens(docs: DataFrame) -> np.ndarray:
    """Prefix tokens that very many documents have. They are known to be shared, so they need not be shuffled to find out."""
    part = docs.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    seen = _sets(part, "id long, tokens array<long>", _prefixes(np.zeros(0, dtype=np.int64))).select(F.explode("tokens").alias("token"))
    rows = seen.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= HOT_SEEN).orderBy(F.desc("c"), "token").limit(HOT)
    return np.array(sorted(r["token"] for r in rows.select("token").collect()), dtype=np.int64)


def candidates_left(docs: DataFrame, described: DataFrame, hot: np.ndarray) -> DataFrame:
    """(id): documents with enough shared tokens in their hash-order prefixes to have a partner."""
    tokens = _sets(docs, "id long, tokens array<long>", _prefixes(hot)).select("id", F.explode("tokens").alias("token"))
    # one shuffle by token counts and looks up; hot tokens, which would pile up in one task, are not in it
    shared = tokens.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("c > 1")
    found = shared.groupBy("id").agg(F.count(F.lit(1)).alias("hits"))
    return described.select("id", "n", "hot").join(found, "id", "left").filter(
        F.coalesce("hits", F.lit(0)) + F.col("hot") > F.floor(F.ceil(PERCENT * F.col("n") / 100) / SPARE)).select("id").distinct()


def entries(sets: DataFrame) -> DataFrame:
    """(entry, id, n): index entries of the members (id, n, tokens)."""
    tokens = sets.select("id", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = tokens.join(counts, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("shared"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = [token_pairs(np.asarray(t, dtype=np.int64), np.asarray(c, dtype=np.int64), int(n))
                    for t, c, n in zip(pdf["token"], pdf["c"], pdf["n"])]
            size = [len(m) for m in made]
            yield pd.DataFrame({"entry": np.concatenate(made) if made else np.zeros(0, dtype=np.int64),
                                "id": np.repeat(pdf["id"].to_numpy(), size), "n": np.repeat(pdf["n"].to_numpy(), size)})

    rows = shared.join(sets.select("id", "n"), "id").select("id", "n", F.col("shared.token").alias("token"), F.col("shared.c").alias("c"))
    return rows.mapInPandas(run, "entry long, id long, n long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Only sets that occur in a pair are shuffled."""
    pairs = cut_lineage(pairs.select("a", "b"))
    named = small(pairs)
    left = sets.join(named, F.col("id") == F.col("a")).select("a", "b", F.col("tokens").alias("ta"))
    right = sets.join(named, F.col("id") == F.col("b")).select("a", "b", F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return left.join(right, ["a", "b"]).filter(
        100 * both >= PERCENT * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def _fits(a: Column, b: Column) -> Column:
    """Sizes alone allow a link."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def spanning_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between two blocks of sets (or within ``left``), as few as connect what all of them connect.

    Members are numbered through both blocks. Intersections are products of 0/1 matrices over the tokens that at least
    two members have, taken in slices of tokens, so memory stays with the block sizes."""
    both = left + (right or [])
    rows = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, codes, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    use = counts[codes] > 1
    rows, codes = rows[use], codes[use]
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], np.cumsum(np.diff(codes[order], prepend=codes[order][:1]) != 0) if len(order) else codes
    k = len(left)
    meet = np.zeros((k, len(both) - k if right is not None else k), dtype=np.float32)
    width = 4096
    for start in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
        lo, hi = np.searchsorted(codes, [start, start + width])
        part = np.zeros((len(both), width), dtype=np.float32)
        part[rows[lo:hi], codes[lo:hi] - start] = 1
        meet += part[:k] @ (part[k:] if right is not None else part).T
    n = np.array([len(s) for s in both], dtype=np.float64)
    total = n[:k, None] + (n[None, k:] if right is not None else n[None, :]) - meet
    near = 100.0 * meet >= percent * total
    full = np.zeros((len(both), len(both)), dtype=bool)
    if right is None:
        full[:] = near
    else:
        full[:k, k:] = near
        full |= full.T
    np.fill_diagonal(full, False)
    out, open_ = [], full.any(axis=1)
    for root in range(len(both)):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(full[i] & open_)
            open_[new] = False
            out += [(i, int(j)) for j in new]
            queue += new.tolist()
    return out


def block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that connect, within each cluster of members (cluster, id, n), all that are linked.

    A cluster's members are dealt into blocks by size level and hash; each two blocks whose sizes may be linked are compared
    in one task. Neither the cluster nor its pairs come together anywhere: a member is sent once per block it meets."""
    level = F.floor(F.log(F.col("n").cast("double")) / _LEVEL).cast("int")
    placed = members.withColumn("level", level)
    stats = cut_lineage(placed.groupBy("cluster", "level").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks")))
    known = small(stats)

    def near(by: int, name: str) -> DataFrame:
        return known.select(F.col("cluster").alias("_c"), (F.col("level") - by).alias("_l"), F.col("blocks").alias(name))

    for by, name in ((0, "own"), (1, "above"), (-1, "below")):
        placed = placed.join(near(by, name), (F.col("cluster") == F.col("_c")) & (F.col("level") == F.col("_l")), "left").drop("_c", "_l")
    placed = placed.withColumn("h", F.pmod(F.xxhash64("id"), F.col("own").cast("bigint")).cast("int"))

    def to(count: str, key) -> Column:
        some = F.when(F.coalesce(count, F.lit(0)) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(some, key)

    def key(l1: Column, h1: Column, l2: Column, h2: Column, side: Column) -> Column:
        return F.struct(l1.alias("l1"), h1.alias("h1"), l2.alias("l2"), h2.alias("h2"), side.alias("side"))

    lv, h = F.col("level"), F.col("h")
    keys = F.concat(to("own", lambda x: key(lv, F.least(h, x), lv, F.greatest(h, x), F.when(h > x, 1).otherwise(0))),
                    to("above", lambda x: key(lv, h, lv + 1, x, F.lit(0))), to("below", lambda x: key(lv - 1, x, lv, h, F.lit(1))))
    sent = placed.select("cluster", "id", F.explode(keys).alias("k")).select("cluster", "id", "k.*").join(sets.select("id", "tokens"), "id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["l1"].iloc[0] == pdf["l2"].iloc[0] and pdf["h1"].iloc[0] == pdf["h2"].iloc[0]
        pdf = pdf.sort_values("side", kind="stable")
        tokens, ids, k = list(pdf["tokens"]), pdf["id"].to_numpy(), int((pdf["side"] == 0).sum())
        found = spanning_links(tokens, None) if same else spanning_links(tokens[:k], tokens[k:]) if 0 < k < len(tokens) else []
        return pd.DataFrame({"a": [ids[i] for i, _ in found], "b": [ids[j] for _, j in found]}, dtype="int64")

    return sent.groupBy("cluster", "l1", "h1", "l2", "h2").applyInPandas(compare, "a long, b long")


def connected(sets: DataFrame) -> DataFrame:
    """(node, label) of the members (id, n, tokens) with a link: the smallest member that links lead to.

    First every member meets one hub, the one it shares most entries with. Entries whose members that does not connect
    are gone through fully: small ones pair by pair, large ones block by block."""
    index = entries(sets)
    rows = cut_lineage(index.join(index.groupBy("entry").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "entry"))
    hubs = rows.groupBy("entry").agg(F.min(F.struct("id", "n")).alias("hub"))
    votes = rows.join(hubs, "entry").filter((F.col("id") != F.col("hub.id")) & _fits(F.col("n"), F.col("hub.n"))).groupBy(
        "id", F.col("hub.id").alias("hub")).count()
    found = cut_lineage(verified(votes.groupBy("id").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("b")).select(
        F.col("id").alias("a"), "b"), sets))
    labels = components(found)

    now = rows.join(small(labels.withColumnRenamed("node", "id")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    split = now.groupBy("entry").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("id").alias("hub")).filter(
        "lo <> hi").select("entry", "hub")
    mine = cut_lineage(now.join(split, "entry"))
    few = mine.filter(F.col("m") <= HEAVY)
    other = few.select("entry", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    pairs = few.join(other, "entry").filter((F.col("id") < F.col("b")) & (F.col("label") != F.col("lb")) & _fits(
        F.col("n"), F.col("nb"))).select(F.col("id").alias("a"), "b").distinct()
    found = found.union(cut_lineage(verified(pairs, sets)))
    many = mine.filter(F.col("m") > HEAVY)
    if many.limit(1).count():
        clusters = components(many.select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
        members = cut_lineage(many.select("id", "n").distinct().join(
            clusters.select(F.col("node").alias("id"), F.col("label").alias("cluster")), "id"))
        found = found.union(cut_lineage(block_links(members, sets)))
    return components(found)


NAMELESS = 1 << 62  # ids from here on stand for rows without one


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: size of its set and smallest doc_id that links lead to, itself included.

    A-Z are lower-cased; a text with fewer than five words is one shingle; NULL, '' and texts without words are empty sets
    and linked with nothing. Rows of equal id are one document with several texts. Rows without id take part under a hash
    of their text, and their component_id is NULL unless they are linked with a row that has one. Equal texts are linked.
    Other columns are ignored; no rows give no rows."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NAMELESS) + F.pmod(
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(1 << 60))).alias("id"), F.col(text).alias("text"))
    hot = hot_tokens(d)
    described = cut_lineage(_sets(d, "id long, n long, k1 long, k2 long, hot long", _describe(hot)))
    members = cut_lineage(described.filter("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min("n").alias("n")))
    copies = described.join(members, "id", "left_anti").select("id").distinct()
    copies = cut_lineage(copies)
    once = d.join(F.broadcast(copies), "id", "left_anti") if copies.limit(SMALL + 1).count() <= SMALL else d
    alive = cut_lineage(candidates_left(once, described, hot).join(members, "id").select("id", "n"))
    sets = cut_lineage(_sets(_chosen(d, alive.select("id").distinct()), "id long, tokens array<long>", _whole_sets).withColumn(
        "n", F.size("tokens").cast("bigint")))
    labels = connected(sets)
    out = described.join(members.select("k1", "k2", F.col("id").alias("node")), ["k1", "k2"], "left").join(labels, "node", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("label", "node", "id").alias("component_id"))
    real = F.col("id") < NAMELESS
    return out.select(F.when(real, F.col("id")).alias("doc_id"), "n_shingles",
                      F.when(F.col("component_id") < NAMELESS, F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of every component, the document with the smallest id stays.

    Of rows repeated under one id, one stays; of rows without id, one of each text that no other row is linked with.
    Documents without words are linked with nothing and stay. Columns and their order do not change."""
    found = cut_lineage(jaccard_components(docs, doc_id, text))
    gone = found.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(doc_id)).distinct()
    repeated = cut_lineage(found.filter("doc_id is not null").groupBy(F.col("doc_id").alias(doc_id)).agg(F.count(F.lit(1)).alias("n")).filter(
        "n > 1").select(doc_id))
    nameless = found.filter("doc_id is null").limit(1).count() > 0
    out = docs.join(gone, doc_id, "left_anti")
    if repeated.limit(1).count():
        out = out.join(repeated, doc_id, "left_anti").unionByName(out.join(repeated, doc_id, "left_semi").dropDuplicates([doc_id]))
    if nameless:
        lone = out.filter(F.col(doc_id).isNull())
        known = out.filter(F.col(doc_id).isNotNull())
        out = known.unionByName(lone.dropDuplicates([text]).join(known.select(F.col(text).alias("_t")), F.col(text) == F.col("_t"), "left_anti"))
    return out.select(*docs.columns)
