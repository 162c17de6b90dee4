"""Periodic runs in texts by grammar compression: boilerplate that repeats itself back to back.

1. Re-Pair: the word numbers of a text become a grammar. Again and again pairs of neighbouring symbols that occur at least
   twice in the text are replaced by new nonterminals, the most frequent first; pairs that no more frequent pair overlaps
   are replaced in the same round, for all texts of a batch at once. Rules never span two texts.
2. A run lies in the smallest piece of the derivation that holds it whole, and crosses the middle of that piece: the
   boundary of a nonterminal, or one between two symbols of the start rule. So the runs that cross a boundary are computed
   once for each nonterminal, in its first expansion, and once for each boundary of the start rule.
3. The runs of a nonterminal are moved to all positions it derives; pieces of one run are merged to maximal intervals.

A text is worked on in one task, in memory that follows its own length; texts are independent of one another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, EXPONENT = 6, 4  # a run has at least LEAST words and EXPONENT periods
BATCH_BYTES = 1 << 20  # of texts that are compressed together, about
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Grammar:
    """Rules (left, right, length) with the places they derive, and the start rule, of numbered words."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        base = 2 * n + 1  # symbols are below it
        symbols, at = words.astype(np.int64), np.arange(n)
        next_symbol = int(symbols.max()) + 1 if n else 0
        firsts, middles, ends, self.places = [], [], [], []
        active = np.arange(max(0, n - 1))  # pairs that may occur twice: the others cannot become more frequent
        end_of = np.append(at[1:], n)
        while len(active):
            keys = symbols[active] * base + symbols[active + 1]
            # in a stretch of one symbol every second pair counts
            same = np.flatnonzero((symbols[active] == symbols[active + 1]))
            counts_for = np.ones(len(active), dtype=bool)
            if len(same):
                where = active[same]
                starts = np.flatnonzero(np.diff(where, prepend=-2) != 1)
                offset = np.arange(len(where)) - np.repeat(starts, np.diff(np.append(starts, len(where))))
                new_stretch = symbols[where] != np.append(-1, symbols[where])[:-1]
                if new_stretch.any():  # neighbours in a row may be stretches of different symbols
                    begin = np.maximum.accumulate(np.where((offset == 0) | new_stretch, np.arange(len(where)), 0))
                    offset = np.arange(len(where)) - begin
                counts_for[same[offset % 2 == 1]] = False
            known, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
            if len(same):
                counts = np.bincount(inverse[counts_for], minlength=len(known))
            often = counts[inverse] > 1
            active, inverse, counts_for = active[often], inverse[often], counts_for[often]
            if not len(active):
                break
            rank = np.empty(len(known), dtype=np.int64)
            rank[np.argsort(counts, kind="stable")] = np.arange(1, len(known) + 1)
            weight = np.zeros(len(symbols) + 2, dtype=np.int64)
            weight[active[counts_for] + 1] = rank[inverse[counts_for]]
            wins = (weight[active + 1] > weight[active]) & (weight[active + 1] > weight[active + 2])
            uses = np.bincount(inverse[wins], minlength=len(known))
            wins &= uses[inverse] > 1
            chosen, which = active[wins], inverse[wins]
            rules, which = np.unique(which, return_inverse=True)
            # of the chosen pairs, the first place of each rule stands for it
            order = np.argsort(which, kind="stable")
            first = chosen[order[np.flatnonzero(np.diff(which[order], prepend=-1))]]
            firsts.append(at[first])
            middles.append(end_of[first])
            ends.append(end_of[first + 1])
            self.places.append(np.split(at[chosen[order]], np.flatnonzero(np.diff(which[order])) + 1))
            symbols[chosen] = next_symbol + which
            next_symbol += len(rules)
            keep = np.ones(len(symbols), dtype=bool)
            keep[chosen + 1] = False
            end_of[chosen] = end_of[chosen + 1]
            moved = np.cumsum(keep) - 1
            touched = np.zeros(len(symbols) + 1, dtype=bool)
            touched[moved[active[keep[active]]]] = True
            touched[moved[chosen]] = True
            touched[np.maximum(moved[chosen] - 1, 0)] = True
            symbols, at, end_of = symbols[keep], at[keep], end_of[keep]
            active = np.flatnonzero(touched[:len(symbols) - 1])
        none = [np.zeros(0, dtype=np.int64)]
        self.first, self.middle, self.end = (np.concatenate(parts or none) for parts in (firsts, middles, ends))
        self.places = [p for some in self.places for p in some]
        self.start = at  # where each symbol of the start rule begins


def _reach(x: np.ndarray, a: int, b: int, limit: int, step: int) -> int:
    """How many of x[a], x[a + step], … equal x[b], x[b + step], …, at most ``limit``."""
    done, size = 0, 32
    while done < limit:
        size = min(size, limit - done)
        if step > 0:
            differ = x[a + done:a + done + size] != x[b + done:b + done + size]
        else:
            differ = x[a - done - size + 1:a - done + 1][::-1] != x[b - done - size + 1:b - done + 1][::-1]
        if differ.any():
            return done + int(differ.argmax())
        done += size
        size *= 2
    return limit


def crossing(x: np.ndarray, s: np.ndarray, b: np.ndarray, e: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """(k, period, start, end): for each piece k, the runs of x[s:e] that cross the boundary before b, each as long as x[s:e] has it.

    Words are taken two, four, eight, … together. A stretch of ``width`` words that lies in a run of period q, where q is at
    most width and more than half of it, comes again first exactly q words on. Whatever the run's place around b, the stretch
    that begins or ends at b and its next or previous equal tell q: four looks a boundary and width. Then the run is followed
    word by word to both sides, once for all boundaries it crosses."""
    at, names, width = np.arange(len(x)), x, 1
    found = []
    reach = int((e - s).max(initial=0)) // exponent  # of the longest period
    while len(at) and width < 2 * reach:
        order = np.argsort(names, kind="stable")
        equal = np.diff(names[order]) == 0
        apart = np.where(equal, np.diff(at[order]), 0)
        ahead, back = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        ahead[order[:-1]], back[order[1:]] = apart, apart
        for p in (b, b - width):
            place = np.minimum(np.searchsorted(at, p), len(at) - 1)
            known = at[place] == p
            for distance, side in ((ahead, 0), (back, 1)):
                q = distance[place]
                k = np.flatnonzero(known & (2 * q > width) & (q <= width) & (exponent * q <= e - s))
                found.append((k, q[k], p[k] - side * q[k]))
        again = (ahead > 0) | (back > 0)
        at = at[again]
        names = np.cumsum(np.diff(names[order], prepend=-1) != 0)[np.argsort(order)][again]
        place = np.minimum(np.searchsorted(at, at + width), max(0, len(at) - 1))
        both = at[place] == at + width
        names = names[both] * (len(x) + 1) + names[place[both]]
        at = at[both]
        width *= 2
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 4
    k, q, t = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((t, q))
    k, q, t = k[order], q[order], t[order]
    i, j = np.empty_like(t), np.empty_like(t)
    period, begin, end = 0, 0, 0
    for m, (one_q, one_t) in enumerate(zip(q.tolist(), t.tolist())):
        if one_q != period or one_t >= end - one_q:
            period = one_q
            begin = one_t - _reach(x, one_t - 1, one_t - 1 + one_q, one_t, -1)
            end = one_t + one_q + _reach(x, one_t, one_t + one_q, len(x) - one_q - one_t, 1)
        i[m], j[m] = begin, end
    i, j = np.maximum(i, s[k]), np.minimum(j, e[k])
    good = (i < b[k]) & (b[k] < j) & (j - i >= np.maximum(least, exponent * q))
    return k[good], q[good], i[good], j[good]


def find_runs(texts: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start, then period. Texts are arrays of word numbers (0 or more)."""
    if exponent < 4:
        raise ValueError("runs of fewer than four periods are not found this way")
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    n = int(sizes.sum())
    if not n:
        return out
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    text_of = np.repeat(np.arange(len(texts)), sizes)
    flat = np.concatenate(texts).astype(np.int64)
    _, x = np.unique(text_of * (int(flat.max()) + 1) + flat, return_inverse=True)  # words of different texts differ
    grammar = Grammar(x)
    inner = grammar.start[np.isin(grammar.start, bounds, invert=True)]
    s = np.concatenate([grammar.first, bounds[text_of[inner]]])
    b = np.concatenate([grammar.middle, inner])
    e = np.concatenate([grammar.end, bounds[text_of[inner] + 1]])
    long = np.flatnonzero(e - s >= least)
    s, b, e = s[long], b[long], e[long]
    found: set[tuple[int, int, int]] = set()
    for k, q, i, j in zip(*(c.tolist() for c in crossing(x, s, b, e, least, exponent))):
        if long[k] < len(grammar.first):  # to all derivation positions
            found.update((q, i + d, j + d) for d in (grammar.places[long[k]] - s[k]).tolist())
        else:
            found.add((q, i, j))
    merged: list[list[int]] = []
    for q, i, j in sorted(found):
        if merged and merged[-1][0] == q and i + q <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], j)
        else:
            merged.append([q, i, j])
    for q, i, j in sorted(merged, key=lambda r: (r[1], r[0])):
        t = int(text_of[i])
        out[t].append((i - int(bounds[t]), j - i, q))
    return out


def split_words(text: str | None) -> list[bytes]:
    """Runs of characters other than space and U+0009-U+000D, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by one space, without those that some run contains after its first period."""
    if runs:
        steps = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            steps[start + period] += 1
            steps[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: all periodic runs of the whole text, by start, then period, and the text without
    the words that a run repeats.

    A run is a stretch of at least ``least`` words and ``exponent`` times its smallest period that no neighbouring word extends.
    NULL, empty and blank texts have no words, no runs and collapse to ''. Rows of equal or NULL id are each returned. Other
    columns are ignored, whatever their names; no rows give no rows."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def flush(ids: list, cut: list[list[bytes]]) -> pa.RecordBatch:
        flat = np.empty(sum(map(len, cut)), dtype=object)
        flat[:] = [w for ws in cut for w in ws]
        numbers = pd.factorize(flat)[0]
        found = find_runs(np.split(numbers, np.cumsum([len(ws) for ws in cut])[:-1]), least, exponent)
        rows = [[{"start": a, "length": n, "period": q} for a, n, q in runs] for runs in found]
        shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), pa.array([len(ws) for ws in cut], pa.int64()), pa.array(rows, shape),
             pa.array([collapse(ws, runs) for ws, runs in zip(cut, found)], pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, cut = 0, 0, []
            for k, t in enumerate(batch.column(1)):
                t = t.as_py()
                cut.append(split_words(t))
                size += len(t or "")
                if size >= BATCH_BYTES or k + 1 == batch.num_rows:
                    yield flush([batch.column(0).slice(begin, len(cut))], cut)
                    begin, size, cut = k + 1, 0, []
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def longest(runs: Column) -> Column:
    """The run of greatest length; ties: smallest start, then smallest period. NULL if there is none."""
    ranked = F.sort_array(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    best = F.get(ranked, F.lit(0))
    return F.when(F.size(runs) > 0, F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period")))
