"""Byte-pair encoding and decoding with a given public vocabulary.

A piece is a doubly linked list of symbols; a priority queue holds (rank, position) of the pairs
that may merge, and entries whose pair has changed are skipped when they come up. Decoding
concatenates vocabulary strings. Spark deals out the texts; a task keeps a bounded cache of
pieces it has met. The vocabulary (fixed size, a parameter) is broadcast."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Split pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 250_000  # pieces in each of the two generations that a task remembers
_POSITION = (1 << 40) - 1
LONGEST_CACHED = 64  # characters of a piece worth remembering
BATCH = 128  # texts turned into one Arrow batch


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where printable, else from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def load_vocabulary(path: str) -> dict:
    """Vocabulary bytes by id, ranks of pairs, the symbol each rank makes, ids of the 256 bytes and added tokens, from a tokenizer's JSON file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    back = {c: b for b, c in letters.items()}
    ids = spec["model"]["vocab"]
    vocab = {i: bytes(back[c] for c in s) for s, i in ids.items() if all(c in back for c in s)}
    ranks, made = {}, []
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        ranks.setdefault(ids[a] << 32 | ids[b], rank)
        made.append(ids[a + b])
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab |= {i: s.encode() for s, i in added.items()}
    return {"vocab": vocab, "ranks": ranks, "made": made, "bytes": [ids[letters[b]] for b in range(256)], "added": added}


def merge_piece(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Apply the merges to one piece, lowest rank first, leftmost first among equals.

    ``ranks`` has a pair (a, b) at ``a << 32 | b``, ``made`` the symbol of each rank. A queue entry is
    ``rank << 40 | position``; it is stale if the pair at its position no longer has that rank."""
    n = len(symbols)
    rank_of = ranks.get
    queue = []
    for i in range(n - 1):
        r = rank_of(symbols[i] << 32 | symbols[i + 1])
        if r is not None:
            queue.append(r << 40 | i)
    if not queue:
        return symbols
    heapify(queue)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while queue:
        entry = heappop(queue)
        i, r = entry & _POSITION, entry >> 40
        j = after[i]
        if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 32 | symbols[j]) != r:
            continue
        one = symbols[i] = made[r]
        symbols[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            r = rank_of(one << 32 | symbols[k])
            if r is not None:
                heappush(queue, r << 40 | i)
        h = before[i]
        if h >= 0:
            r = rank_of(symbols[h] << 32 | one)
            if r is not None:
                heappush(queue, r << 40 | h)
    return [s for s in symbols if s >= 0]


class Codec:
    """Encoder and decoder of whole texts."""

    def __init__(self, model: dict):
        self.ranks, self.made, self.bytes = model["ranks"], model["made"], model["bytes"]
        self.vocab = model["vocab"]
        self.added = model["added"]
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.cache: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        ids = self.older.get(piece)
        if ids is None:
            of = self.bytes
            ids = merge_piece([of[b] for b in piece.encode("utf-8")], self.ranks, self.made)
        if len(piece) <= LONGEST_CACHED:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = ids
        return ids

    def _plain(self, text: str, out: list[int]) -> None:
        make, extend = self._piece, out.extend
        for piece in self.split.findall(text):
            extend(self.cache.get(piece) or make(piece))

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text. Added tokens' strings in it become their id; NULL is empty."""
        out: list[int] = []
        text = text or ""
        at = 0
        if self.special is not None:
            for m in self.special.finditer(text):
                self._plain(text[at:m.start()], out)
                out.append(self.added[m.group()])
                at = m.end()
        self._plain(text[at:] if at else text, out)
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The ids' vocabulary strings one after the other; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.vocab.__getitem__, ids or ())).decode("utf-8", errors="replace")


_latest: list = [None, None]


def _codec(model) -> Codec:
    """One codec per worker process and broadcast vocabulary, so that its cache lasts over tasks."""
    if _latest[0] is not model:
        _latest[:] = [model, Codec(model.value)]
    return _latest[1]


def _run(df: DataFrame, path: str, source: str, made: dict[str, T.DataType], work) -> DataFrame:
    """Append the columns ``made`` that ``work(codec, value)`` gives for each value of ``source``."""
    model = df.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    schema = T.StructType([f for f in df.schema.fields if f.name not in made] + [T.StructField(k, t) for k, t in made.items()])
    keep = [f.name for f in df.schema.fields if f.name not in made]
    arrow = {"ids": pa.list_(pa.int32()), "decoded": pa.string()}

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                rows = [work(codec, v) for v in b.column(source).to_pylist()]
                new = [pa.array([r[i] for r in rows], arrow[kind]) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + new, [*keep, *made])

    kinds = ["ids" if isinstance(t, T.ArrayType) else "decoded" for t in made.values()]
    return df.mapInArrow(mapper, schema)


IDS = T.ArrayType(T.IntegerType())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append the array of token ids of every text. Other columns stay; a column of the same name is replaced."""
    return _run(df, path, text, {ids: IDS}, lambda c, v: (c.encode(v),))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Append the text of every array of ids; NULL and empty arrays are ''. Unknown ids raise KeyError."""
    return _run(df, path, ids, {decoded: T.StringType()}, lambda c, v: (c.decode(v),))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Encode, then decode the ids, in one pass over the texts."""
    def work(c: Codec, v: str | None) -> tuple:
        got = c.encode(v)
        return got, c.decode(got)
    return _run(df, path, text, {ids: IDS, decoded: T.StringType()}, work)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> list:
    """Columns n_tokens, ids_sha256 and decoded_sha256 of an encoded table."""
    return [F.size(ids).cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
            F.sha2(F.col(decoded), 256).alias("decoded_sha256")]
