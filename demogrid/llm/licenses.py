"""License scans: winnowed fingerprints of license templates in an inverted index pick candidates,
a banded sequence alignment measures how much of the template a text has, and where.

Words that tell a template from a similar one have to match (version numbers, "Lesser", "NonCommercial"), and no word of
the other may be put in; a negated notice is none. A variant that is not listed is thus not reported under the name
of a listed one. The index (a parameter of fixed size) is broadcast; every text is read once, whole, in linear time."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

GRAM, WINDOW = 3, 4  # words of a fingerprint; of so many neighbouring ones the smallest is kept
LEAST_COVERAGE = 0.7  # of a template's words
MATCH, MISMATCH, GAP = 2, -1, -1
_TOKEN = re.compile(r"\w+(?:[.'’]\w+)*")
_NEGATIONS = frozenset("not no non never without isn't aren't".split())

#: Notices and license texts that are looked for (fixed values).
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                  "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
                  "agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
                  "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
           "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
           "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
           "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
                    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                    "documentation and/or other materials provided with the distribution.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
               "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "All rights reserved": "All rights reserved.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
                    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                    "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
                    "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
           "copyright notice and this permission notice appear in all copies.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS "
            "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
            "freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the "
            "original software.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                 "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
               "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
               "https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
               "http://www.boost.org/LICENSE_1_0.txt)",
}
_GNU = ("{what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
        "either version {version} of the License, or (at your option) any later version.")
_GNU_NAMES = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_GNU_VERSIONS = {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}
#: Licenses by the names that one-line notices use (fixed values).
_NAMED = {"MIT": "MIT License", "ISC": "ISC License", "Zlib": "zlib License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License",
          "BSD": "BSD License", "Apache-2.0": "Apache License 2.0", "MPL-2.0": "Mozilla Public License 2.0", "EPL-2.0": "Eclipse Public License 2.0",
          "BSL-1.0": "Boost Software License 1.0"}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _notices() -> list[tuple[str, str]]:
    """(license, one-line notice) of all variants, by rule."""
    out = [(f"{k} notice", f"{verb} under the {name}.") for k, name in _NAMED.items() for verb in ("Licensed", "Released")]
    for kind, name in _GNU_NAMES.items():
        for version in _GNU_VERSIONS[kind]:
            key = f"{kind}-{version if '.' in version else version + '.0'}"
            out += [(key, _GNU.format(what=what, name=name, version=version)) for what in ("This program", "This library")]
            out += [(f"{key} notice", f"This work is licensed under the {name}, version {version}."),
                    (f"{key} notice", f"Released under the {name} version {version}.")]
    for kind, name in _CC.items():
        for version, port in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
            out += [(f"CC-{kind}-{version}", f"This work is licensed under a Creative Commons {name} {version} {port} License."),
                    (f"CC-{kind}-{version}", f"This work is licensed under {'the' if version == '4.0' else 'a'} Creative Commons {name} {version} License."),
                    (f"CC-{kind}-{version} notice", f"Licensed under CC {kind} {version}.")]
    return out


#: What the scan looks for beside TEMPLATES; several notices may name one license.
NOTICES = _notices()


def fingerprint(gram: tuple[int, ...]) -> int:
    return xxhash.xxh3_64_intdigest(np.array(gram, dtype=np.int64).tobytes())


def winnow(prints: list[int], window: int = WINDOW) -> set[int]:
    """Positions kept: the smallest (rightmost among equals) of every window, so no run of window + GRAM - 1 words goes unseen."""
    kept = set()
    for a in range(max(1, len(prints) - window + 1)):
        part = prints[a:a + window]
        if part:
            low = min(part)
            kept.add(a + max(i for i, x in enumerate(part) if x == low))
    return kept


@dataclass
class Index:
    names: list[str]
    words: dict[str, int]  # template word -> number
    texts: list[list[int]]
    places: dict[int, list[tuple[int, int]]]  # fingerprint -> (template, position)
    telling: list[list[frozenset[int]]]  # of each template: sets of positions (all; numbers; differences), of each the least share has to match
    foreign: list[frozenset[int]]  # of each template: words of similar ones that must not be put in


def _numbers(words: list[str]) -> frozenset[int]:
    return frozenset(i for i, w in enumerate(words) if any(c.isdigit() for c in w))


def build_index(templates: dict[str, str], notices: Iterable[tuple[str, str]] = (), least: float = LEAST_COVERAGE) -> Index:
    """Templates by name, then further (name, text) pairs; a text that is already there is left out.

    Two templates are similar if one has at least ``least`` of the other's words in its order."""
    words: dict[str, int] = {}
    names, told, seen = [], [], set()
    for name, text in [*templates.items(), *notices]:
        tokens = _TOKEN.findall(text.lower())
        if len(tokens) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {name}")
        if tuple(tokens) not in seen:
            seen.add(tuple(tokens))
            names.append(name)
            told.append(tokens)
    texts = [[words.setdefault(w, len(words)) for w in t] for t in told]
    for w in _NEGATIONS:
        words.setdefault(w, len(words))
    places = defaultdict(list)
    for k, ids in enumerate(texts):
        prints = [fingerprint(tuple(ids[i:i + GRAM])) for i in range(len(ids) - GRAM + 1)]
        for i in winnow(prints):
            places[prints[i]].append((k, i))
    telling, foreign = [], []
    for k, ids in enumerate(texts):
        sets, others = {frozenset(range(len(ids))), _numbers(told[k])}, set()
        for m, rival in enumerate(texts):
            if names[m] == names[k]:
                continue
            blocks = SequenceMatcher(None, ids, rival, autojunk=False).get_matching_blocks()
            same = {i for x in blocks for i in range(x.a, x.a + x.size)}
            if len(same) < least * len(ids):
                continue
            sets.add(frozenset(range(len(ids))) - same)
            extra = set(rival) - set(ids)
            if len(rival) - len(same) <= GRAM:
                others |= extra
        telling.append([s for s in sets if s])
        foreign.append(frozenset(others))
    return Index(names, words, texts, dict(places), telling, foreign)


def align(template: list[int], doc: list[int], shift: int, band: int) -> tuple[int, list[tuple[int, int]]]:
    """(score, pairs) of the best local alignment with word j of ``doc`` within ``band`` of i + shift.

    The pairs are the equal words (place in the template, place in ``doc``), in order; all of the template and the document
    part around the diagonal take part."""
    best: tuple = (0, None)
    above: dict[int, tuple] = {}
    for i, want in enumerate(template):
        row: dict[int, tuple] = {}
        for j in range(max(0, i + shift - band), min(len(doc), i + shift + band + 1)):
            s, path = above.get(j - 1, (0, None))
            cell = (s + MATCH, (i, j, path)) if doc[j] == want else (s + MISMATCH, path)
            for s, path in (above.get(j, (0, None)), row.get(j - 1, (0, None))):
                if s + GAP > cell[0]:
                    cell = (s + GAP, path)
            if cell[0] > 0:
                row[j] = cell
                if cell[0] > best[0]:  # only an equal word raises a score
                    best = cell
        above = row
    pairs, path = [], best[1]
    while path is not None:
        pairs.append(path[:2])
        path = path[2]
    return best[0], pairs[::-1]


def _holds(index: Index, k: int, ids: list[int], pairs: list[tuple[int, int]], least: float) -> bool:
    """Whether an alignment has what tells its template from others, with no word between that changes its meaning."""
    met = {i for i, _ in pairs}
    if any(len(s & met) < least * len(s) for s in index.telling[k]):
        return False
    negations = {index.words[w] for w in _NEGATIONS}
    first = pairs[0][1]
    if first and ids[first - 1] in negations:
        return False
    put_in = {w for (i, j), (m, n) in zip(pairs, pairs[1:]) if m == i + 1 for w in ids[j + 1:n]}
    return not put_in & (negations | index.foreign[k])


class _Reach:
    """Intervals by their start: the farthest end among those that start at or before a place (a tree of prefix maxima)."""

    def __init__(self, size: int):
        self.tree = [-1] * (size + 1)

    def add(self, first: int, last: int) -> None:
        at = first + 1
        while at < len(self.tree):
            self.tree[at] = max(self.tree[at], last)
            at += at & -at

    def end(self, start: int) -> int:
        at, out = start + 1, -1
        while at:
            out = max(out, self.tree[at])
            at -= at & -at
        return out


def scan(text: str | None, index: Index, least: float = LEAST_COVERAGE) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of every template found in a text, by position; spans are code points.

    Of finds that lie within another find only the one with more matched words stays (ties: the better covered, the
    first, the template listed first)."""
    if not text:
        return []
    get = index.words.get
    low = text.lower()
    ids = [get(w, -1) for w in _TOKEN.findall(low)]
    a = np.array(ids, dtype=np.int64)
    runs = np.flatnonzero((a[:-2] >= 0) & (a[1:-1] >= 0) & (a[2:] >= 0)) if len(a) >= GRAM else ()
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p in runs:
        for k, i in index.places.get(fingerprint(tuple(ids[p:p + GRAM])), ()):
            hits[k].append((int(p), int(p) - i))
    found = []
    for k, at in hits.items():
        template = index.texts[k]
        band = max(3, len(template) // 8)
        done: list[tuple[int, int]] = []  # finds of this template that do not end before the place
        for p, shift in sorted(at):
            done = [x for x in done if x[1] >= p]
            if any(x[0] <= p for x in done):
                continue
            near = set(ids[max(0, shift - band):max(0, shift + len(template) + band)])
            if any(sum(template[i] in near for i in t) < least * len(t) for t in index.telling[k]):
                continue  # no alignment in the band can have these words
            _, pairs = align(template, ids, shift, band)
            if pairs:
                done.append((pairs[0][1], pairs[-1][1]))
                if _holds(index, k, ids, pairs, least):
                    found.append((len(pairs), k, *done[-1]))
    if not found:
        return []
    found.sort(key=lambda f: (-f[0], len(index.texts[f[1]]), f[2], f[1]))
    reach, kept = _Reach(len(ids)), []
    for f in found:
        if reach.end(f[2]) < f[3]:
            reach.add(f[2], f[3])
            kept.append(f)
    spans = [m.span() for m in _TOKEN.finditer(text)]
    exact = len(spans) == len(ids)  # lower-casing may change the number of characters; positions are those of the text
    spans = spans if exact else [m.span() for m in _TOKEN.finditer(low)]
    return sorted([(index.names[k], matched / len(index.texts[k]), spans[first][0], spans[last][1]) for matched, k, first, last in kept],
                  key=lambda f: (f[2], f[0]))


MATCHES = "array<struct<license:string,coverage:double,start:int,end:int>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text", least: float = LEAST_COVERAGE,
                  notices: Iterable[tuple[str, str]] = tuple(NOTICES)) -> DataFrame:
    """Every row with ``licenses``: array of (license, coverage, start, end) in the order of the text.

    Case and punctuation do not matter. NULL and '' have no finds. Other columns stay, one named ``licenses`` is replaced."""
    docs = docs.drop("licenses")
    shared = docs.sparkSession.sparkContext.broadcast(build_index(templates, notices, least))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", licenses {MATCHES}"
    names = ("license", "coverage", "start", "end")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for pdf in parts:
            yield pdf.assign(licenses=[[dict(zip(names, f)) for f in scan(t, index, least)] for t in pdf[text]])

    return docs.mapInPandas(run, schema)
