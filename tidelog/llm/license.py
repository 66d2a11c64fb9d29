"""License scans: a generalised suffix automaton of licence tokens, matching statistics, chained template spans.

The templates' word sequences form one automaton. A document's words are streamed through it; after each word
the automaton knows the longest run of words ending there that stands in some template. Runs that can't be
extended become matches; for each template the heaviest chain of matches that keep their order in both texts is found
by dynamic programming over all places of a match, and the share of the template's words that it covers is its score. Words that no template has end a run, so only
stretches of known words are streamed; everything else is found by vectorised lookups.

Short phrases (see ``PHRASES``) are sequences of the same automaton: one stands wherever the longest run that ends
at a word is in the phrase's state or below it in the tree of suffix links, so each is found exactly, at every place.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import runtime
from . import textkit as K

# The phrases and the labels they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Well-known licence wordings (public texts) and the labels they give.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

#: Words that a match must have to count towards a span; shorter templates must match whole.
LONG_MATCH = 6
#: Neighbours of a chain start at most so many times the template's words apart.
APART = 4
#: Share of a template's words that must be covered for its label.
COVERED = 0.6


class Span(NamedTuple):
    label: str
    first: int
    last: int
    coverage: float


class Automaton:
    """Suffix automaton of several sequences of word numbers; a state knows all places where its runs end in each sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[int, list[int]]] = [{}]
        for t, sequence in enumerate(sequences):
            last = 0
            for w in sequence:
                last = self._extend(last, w)
        for t, sequence in enumerate(sequences):
            state = 0
            for i, w in enumerate(sequence):
                state = at = self.edges[state][w]
                while at > 0:
                    self.places[at].setdefault(t, []).append(i + 1)
                    at = self.link[at]

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.edges.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.places.append({})
        return len(self.link) - 1

    def _split(self, p: int, w: int) -> int:
        """The state that holds the run of ``p`` and ``w`` as its longest."""
        q = self.edges[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, self.link[q], dict(self.edges[q]))
        self.link[q] = twin
        while p >= 0 and self.edges[p].get(w) == q:
            self.edges[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: int) -> int:
        if w in self.edges[last]:
            return self._split(last, w)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.edges[p]:
            self.edges[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, w)
        return state

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of each longest run that the next word doesn't extend, of ``least`` words at least."""
        state = length = 0
        for i, w in enumerate(words):
            if w not in self.edges[state]:
                if length >= least:
                    yield i, length, state
                while state > 0 and w not in self.edges[state]:
                    state = self.link[state]
                    length = self.length[state]
            if w in self.edges[state]:
                state, length = self.edges[state][w], length + 1
            else:
                state = length = 0
        if length >= least:
            yield len(words), length, state

    def run_ends(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest run that ends at each word."""
        state = length = 0
        for w in words:
            while state > 0 and w not in self.edges[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.edges[state]:
                state, length = self.edges[state][w], length + 1
            else:
                state = length = 0
            yield length, state

    def endings(self, sequences: list[list[int]]) -> list[list[tuple[int, int]]]:
        """For each state, (number, length) of those ``sequences`` that its runs of at least that length end with."""
        found: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for t, sequence in enumerate(sequences):
            state = 0
            for w in sequence:
                state = self.edges[state][w]
            found[state].append((t, len(sequence)))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            found[state] += found[self.link[state]]
        return found


class Scanner:
    def __init__(self):
        split = lambda text: [w for w in "".join(c.lower() if c.isascii() and c.isalnum() else " " if c.isascii() else c for c in text).split(" ") if w]
        texts = [(label, split(text)) for label, text in TEMPLATES]
        phrases = [(label, split(text)) for text, label in PHRASES.items()]
        vocabulary = sorted({w for _, t in texts + phrases for w in t})
        number = {w: i for i, w in enumerate(vocabulary)}
        hashes = np.array([K.hash_text(w) for w in vocabulary], K.U64)
        order = np.argsort(hashes)
        self._hashes, self._numbers = hashes[order], order
        sequences = [[number[w] for w in t] for _, t in phrases]
        self._phrases = [label for label, _ in phrases]
        self._shortest = min(map(len, sequences))
        self.labels = [label for label, _ in texts]
        self.sizes = [len(t) for _, t in texts]
        self.least = min(LONG_MATCH, *self.sizes)
        self._automaton = Automaton([[number[w] for w in t] for _, t in texts] + sequences)
        self._endings = self._automaton.endings(sequences)

    def scan(self, s: K.Slice) -> list[tuple[int, int, int | None, int | None, list[str], list[Span]]]:
        """Of each row: words, base places, first and last base place, base labels, template spans."""
        n = s.hi - s.lo
        a, b = K.spans(s, K.ALNUM)
        h = K.span_hash(K.prefix_hash(s.buf, K.LOWER_VALUES), a, b)
        at = np.minimum(np.searchsorted(self._hashes, h), len(self._hashes) - 1)
        word = np.where(self._hashes[at] == h, self._numbers[at], -1)
        rows = s.rows_of(a)
        begins = np.searchsorted(rows, np.arange(n + 1))
        counts = np.diff(begins)
        stretches = self._stretches(word, rows)
        base, found = self._base(stretches, begins), self._runs(stretches, begins)
        out = []
        for i in range(n):
            places = base.get(i, [])
            starts = [p for p, _ in places]
            out.append((int(counts[i]), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places}), self._chain(found.get(i, []))))
        return out

    def _stretches(self, word: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(row, first place, words) of the stretches of known words that may hold a phrase or a match."""
        known = word >= 0
        edge = np.zeros(len(word) + 1, bool)
        edge[1:-1] = (known[1:] != known[:-1]) | (rows[1:] != rows[:-1])
        edge[0] = edge[-1] = True
        cuts = np.flatnonzero(edge)
        keep = (np.diff(cuts) >= min(self._shortest, self.least)) & known[cuts[:-1]] if len(word) else np.zeros(0, bool)
        return [(int(rows[a]), a, word[a:b].tolist()) for a, b in zip(cuts[:-1][keep].tolist(), cuts[1:][keep].tolist(), strict=True)]

    def _base(self, stretches: list[tuple[int, int, list[int]]], begins: np.ndarray) -> dict[int, list[tuple[int, str]]]:
        """Phrases of each row: (start, label)."""
        base: dict[int, list[tuple[int, str]]] = {}
        for row, a, words in stretches:
            for i, (length, state) in enumerate(self._automaton.run_ends(words)):
                for t, k in self._endings[state]:
                    if length >= k:
                        base.setdefault(row, []).append((a + i + 1 - k - int(begins[row]), self._phrases[t]))
        return base

    def _runs(self, stretches: list[tuple[int, int, list[int]]], begins: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Matches of each row: (start, length, state)."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for row, a, words in stretches:
            if len(words) >= self.least:
                for end, length, state in self._automaton.matches(words, self.least):
                    found.setdefault(row, []).append((a + end - length - int(begins[row]), length, state))
        return found

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[Span]:
        """The template spans of a row; see :func:`chains`."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, length, state in matches:
            for t, ends in self._automaton.places[state].items():
                if t < len(self.sizes) and length >= min(LONG_MATCH, self.sizes[t]):
                    by.setdefault(t, []).extend((start, length, end - length) for end in ends)
        spans = []
        for t, own in by.items():
            spans += [Span(self.labels[t], first, last, min(1.0, weight / self.sizes[t])) for first, last, weight in chains(own, APART * self.sizes[t]) if weight >= COVERED * self.sizes[t]]
        return sorted(spans, key=lambda x: (x.first, x.last, x.label))


def chains(matches: list[tuple[int, int, int]], reach: int) -> list[tuple[int, int, int]]:
    """(first, last, weight) of chains of matches (start, length, place in the template), the heaviest first.

    In a chain, starts and places grow, and what a match shares with the one before it counts once; neighbours start
    at most ``reach`` words apart. The first chain is the heaviest of all; each further one is what the heaviest
    chain that ends elsewhere has besides the matches of earlier ones, if it lies outside their spans.
    """
    own = sorted(matches)
    best, before = [length for _, length, _ in own], [-1] * len(own)
    for j, (start, length, place) in enumerate(own):
        for i in range(j - 1, -1, -1):
            a, n, p = own[i]
            if start - a > reach:
                break
            gain = length - max(0, a + n - start, p + n - place)
            if a < start and p < place and gain > 0 and best[i] + gain > best[j]:
                best[j], before[j] = best[i] + gain, i
    used, out = [False] * len(own), []
    for j in sorted(range(len(own)), key=lambda j: (-best[j], j)):
        if used[j]:
            continue
        i = first = j
        while i >= 0 and not used[i]:
            used[i], first, i = True, i, before[i]
        a, z = own[first][0], own[j][0] + own[j][1]
        if all(z <= x or y <= a for x, y, _ in out):
            out.append((a, z, best[j] - (best[i] if i >= 0 else 0)))
    return out


_scanners: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanners:
        _scanners.append(Scanner())
    return _scanners[0]


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,coverage:double>>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """What each row of ``docs`` (doc_id, text) has of licence wordings; ``spans`` are template spans in words.

    ``score`` is 1 where a base phrase stands, else the largest coverage of a template's span, 0 without one.
    A null text is empty: no words, empty labels, score 0. Repeated rows are each answered, a row without a doc_id under
    a null one; an empty table gives an empty one. A very long text is read in one piece. No shuffle.
    """
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        for batch in batches:
            for s in K.slices(batch.column(1)):
                words, base, first, last, labels, spans = zip(*scan(s), strict=True)
                every = [",".join(sorted({*x, *(p.label for p in y)})) for x, y in zip(labels, spans, strict=True)]
                score = [1.0 if x else max((p.coverage for p in y), default=0.0) for x, y in zip(labels, spans, strict=True)]
                columns = [pa.array(c, pa.int64()) for c in (words, base, first, last)] + [pa.array([",".join(x) for x in labels], pa.string()), pa.array(every, pa.string()), pa.array(score, pa.float64())]
                kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))
                columns.append(pa.array([[p._asdict() for p in y] for y in spans], kind))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo).cast(pa.int64()), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(runtime.tidy(run), SCHEMA)
