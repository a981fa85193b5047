"""License notices in texts: winnowed fingerprints, then banded alignments, chained.

The templates' word k-gram hashes are winnowed: of each window of hashes the
least is kept, so any shared run of words as long as a window holds a kept one.
Of templates of fewer than ``SHORT`` words, every pair of words is a fingerprint.
An inverted index maps these fingerprints to (template, place). A text's k-gram
hashes are looked up in it by binary search; each hit names a template and a
diagonal. A banded local alignment of words around the diagonals of a
candidate gives a matched piece of the template and its span in the text;
pieces that follow each other in both are summed, whatever stands between them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordHash, mix64, odd_multipliers, slices, texts

# Public license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-line": "Released under the MIT License.",
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
GRAM, WINDOW, SEED = 3, 3, 20_240_317
#: Templates of fewer words are found by every run of SHORT_GRAM words.
SHORT, SHORT_GRAM = 12, 2
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Whether a byte is a word's.
WORD_BYTES = np.array([c != 32 for c in FOLD])


def word_hashes(text: bytes, words: WordHash) -> np.ndarray:
    ws = text.translate(FOLD).split()
    return np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))


def gram_hashes(h: np.ndarray, gram: int = GRAM) -> np.ndarray:
    if len(h) < gram:
        return np.zeros(0, np.uint64)
    mult = odd_multipliers(gram, SEED)
    out = h[: len(h) - gram + 1] * mult[0]
    for k in range(1, gram):
        out = out + h[k : len(h) - gram + 1 + k] * mult[k]
    return mix64(out)


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the rightmost least hash of each window; all of a shorter input's least."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + window - 1 - view.argmin(1))


class Index:
    """Fingerprint -> (template, place), as sorted arrays for each length of gram."""

    def __init__(self, templates: dict[str, str], words: WordHash):
        self.names = list(templates)
        self.words = [word_hashes(t.encode(), words) for t in templates.values()]
        self.parts = []
        for gram in (GRAM, SHORT_GRAM):
            keys, ids, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, w in enumerate(self.words):
                if (len(w) < SHORT) == (gram == SHORT_GRAM):
                    g = gram_hashes(w, gram)
                    at = winnow(g) if gram == GRAM else np.arange(len(g))
                    keys.append(g[at]), ids.append(np.full(len(at), k)), places.append(at)
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            if len(order):
                self.parts.append((gram, key[order], np.concatenate(ids)[order], np.concatenate(places)[order]))

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, diagonal) of each place where a gram of a text's words is a fingerprint."""
        of, diagonals = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for gram, key, template, place in self.parts:
            grams = gram_hashes(h, gram)
            lo = np.searchsorted(key, grams)
            at = np.flatnonzero(key[np.minimum(lo, len(key) - 1)] == grams)
            lo = lo[at]
            n = np.searchsorted(key, grams[at], "right") - lo
            entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            of.append(template[entry]), diagonals.append(np.repeat(at, n) - place[entry])
        return np.concatenate(of), np.concatenate(diagonals)


def align(template: np.ndarray, text: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """(matched words, start, end, start and end in the template) of the best local alignment in each band.

    Band k holds the diagonals low[k] .. low[k] + width - 1; all bands go through the
    template side by side. A match scores 2, a mismatch or gap -1.
    """
    n = len(low)
    shape = (n, width + 2)  # padded: index d + 1 for diagonal low + d
    score, match, begin = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.full(shape, -1, np.int64)
    best = np.zeros((n, 5), np.int64)  # score, matched, begin, end, last
    d, each = np.arange(width), np.arange(n)
    for i, word in enumerate(template):
        j = i + low[:, None] + d
        inside = (j >= 0) & (j < len(text))
        same = inside & (text[np.clip(j, 0, len(text) - 1)] == word)
        s = score[:, 1:-1] + np.where(same, 2, -1)
        m, b = match[:, 1:-1] + same, np.where((score[:, 1:-1] > 0) | ~same, begin[:, 1:-1], j + (i << 40))
        up = score[:, 2:] - 1  # the template word is missing in the text
        take = up > s
        s, m, b = np.where(take, up, s), np.where(take, match[:, 2:], m), np.where(take, begin[:, 2:], b)
        # text words of their own, along the row: the best place to come from, the nearest of equals
        top = np.maximum.accumulate(s + d, axis=1)
        to = np.maximum.accumulate(np.where(s + d == top, d, 0), axis=1)
        s, m, b = top - d, np.take_along_axis(m, to, 1), np.take_along_axis(b, to, 1)
        dead = (s <= 0) | ~inside
        score[:, 1:-1], match[:, 1:-1], begin[:, 1:-1] = np.where(dead, 0, s), np.where(dead, 0, m), np.where(dead, -1, b)
        k = score[:, 1:-1].argmax(1)
        new = score[each, k + 1] > best[:, 0]
        at = k[new]
        best[new] = np.stack([score[new, at + 1], match[new, at + 1], begin[new, at + 1], j[new, at] + 1, np.full(len(at), i + 1)], 1)
    return np.stack([best[:, 1], best[:, 2] & (1 << 40) - 1, best[:, 3], best[:, 2] >> 40, best[:, 4]], 1)


def bands(diagonals: np.ndarray, slack: int) -> np.ndarray:
    """The lowest diagonals of bands of width 4 * slack + 1 over groups of near diagonals:
    at most ``slack`` from one to the next and 2 * slack from the first to the last."""
    low, first, last = [], None, None
    for d in np.unique(diagonals).tolist():
        if first is None or d - last > slack or d - first > 2 * slack:
            low.append(d - slack)
            first = d
        last = d
    return np.array(low, np.int64)


def pieces_of(template: np.ndarray, text: np.ndarray, diagonals: np.ndarray, slack: int) -> np.ndarray:
    """The distinct matched pieces of all bands."""
    slack = min(slack, len(template) // 4 + 1)  # two notices of few words lie near each other
    low = bands(diagonals, slack)
    found = [align(template, text, low[x : x + 4096], 4 * slack + 1) for x in range(0, len(low), 4096)]
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 5), np.int64)


def beside(left: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The pieces ``left`` of which at most half lies under ``used`` ones, in the text."""
    if not len(left) or not len(used):
        return left
    edges = np.zeros(int(max(left[:, 2].max(), used[:, 2].max())) + 1, np.int64)
    np.add.at(edges, used[:, 1], 1), np.add.at(edges, used[:, 2], -1)
    under = np.concatenate([[0], np.cumsum(np.cumsum(edges) > 0)])
    return left[2 * (under[left[:, 2]] - under[left[:, 1]]) <= left[:, 2] - left[:, 1]]


def chains(pieces: np.ndarray, least: float, whole: int) -> list[tuple[int, int, int]]:
    """(matched words, start, end) of the notices that ``pieces`` of one template of ``whole`` words make up.

    A chain's pieces follow each other in the text and in the template. Where two
    overlap, by half of the smaller one at most, the overlap counts once. Pieces
    that match the whole template are notices of their own. Of all chains of the
    others the one that matches most is taken, the shortest of equals, and so on
    with the pieces left, while a chain matches ``least`` words. A piece that lies
    half or more under a taken one is another view of it and goes.
    """
    left = pieces[pieces[:, 0] > 0]
    left = left[np.lexsort((left[:, 2], left[:, 1]))]
    out, used, end_ = [], [], 0
    for p in left[left[:, 0] >= whole].tolist():
        if p[1] >= end_:
            out.append((p[0], p[1], p[2]))
            used.append(p)
            end_ = p[2]
    left = beside(left[left[:, 0] < whole], np.array(used, np.int64).reshape(-1, 5))
    while len(left):
        matched, start, end, first, last = left.T
        edges = np.zeros(int(last.max()) + 1, np.int64)
        np.add.at(edges, first, 1), np.add.at(edges, last, -1)
        if (np.cumsum(edges) > 0).sum() < least:
            break
        # of the best chain to each piece: words, where it starts, and the piece before
        total, begin, before = matched.copy(), start.copy(), np.full(len(left), -1)
        for i in range(1, len(left)):
            shared = np.maximum(np.maximum(end[:i] - start[i], last[:i] - first[i]), 0)
            fits = (first[:i] < first[i]) & (last[:i] < last[i]) & (start[:i] < start[i]) & (end[:i] < end[i])
            k = np.flatnonzero(fits & (2 * shared <= np.minimum(matched[:i], matched[i])))
            if len(k):
                words = total[k] + matched[i] - shared[k]
                to = np.lexsort((begin[k], words))[-1]
                if words[to] > matched[i]:
                    total[i], begin[i], before[i] = words[to], begin[k[to]], k[to]
        taken = np.zeros(len(left), bool)
        for i in np.lexsort((start, end - begin, -total)).tolist():
            chain, k = [], i
            while k >= 0:
                chain.append(k)
                k = before[k]
            if total[i] < least or taken[chain].any():  # what taken pieces have reached is to be found anew
                break
            if len(beside(left[chain], left[taken])) < len(chain):
                continue
            taken[chain] = True
            out.append((int(total[i]), int(begin[i]), int(end[i])))
        if not taken.any():
            break
        left = beside(left[~taken], left[taken])
    return out


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends, in code points."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], WORD_BYTES[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return chars[edge[::2]], chars[edge[1::2]]


def _scanned(templates: dict[str, str], coverage: float, slack: int):
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        words = WordHash()
        index = Index(templates, words)
        for b in batches:
            raw = b.column(1).cast(pa.binary())
            for x, y in slices(pa.compute.binary_length(raw).to_pylist(), 4_000_000):
                out = []
                for text in raw.slice(x, y - x).to_pylist():
                    h = word_hashes(text, words)
                    t, diag = index.hits(h)
                    found = []
                    if len(t):
                        places = None
                        for k in np.unique(t).tolist():
                            w = index.words[k]
                            for m, s, e in chains(pieces_of(w, h, diag[t == k], slack), coverage * len(w), len(w)):
                                places = places or word_places(text)
                                found.append({"license": index.names[k], "coverage": m / len(w), "matched": m, "start": int(places[0][s]), "end": int(places[1][e - 1])})
                    out.append(sorted(found, key=lambda f: (f["start"], f["end"], f["license"])))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(map(len, out), pa.int64()), pa.array(out, kind)], ["doc_id", "n_licenses", "found"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.7, slack: int = 4) -> DataFrame:
    """doc_id, n_licenses and found (license, coverage, matched words, start, end in
    characters) of each row of ``docs``: chains of alignments that match ``coverage`` of a template.

    Null and empty texts find nothing. Rows stay as they are, repeated or not; ids may
    be null or repeat; an empty table gives none; extra columns are not read, whatever
    their names. A notice found twice in a text is listed twice. A notice that a
    longer one holds is found as well. The work is linear in a text's length, but for
    chains of partial pieces, whose number squared counts.
    """
    schema = "doc_id long, n_licenses long, found array<struct<license:string,coverage:double,matched:bigint,start:bigint,end:bigint>>"
    return docs.select("doc_id", texts().alias("text")).mapInArrow(_scanned(TEMPLATES if templates is None else templates, coverage, slack), schema)
