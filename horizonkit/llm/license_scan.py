"""License scans with a generalised suffix automaton of template words.

The automaton accepts every word sequence of every template. Streaming a text
through it gives the matching statistics: at each word, the longest suffix read
so far that occurs in a template. Maximal long matches are chained, in the order
of both text and template, into the covered span of the template.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from horizonkit.llm.common import keyed_text

#: License notices as their publishers word them.
TEMPLATES = {
    "mit": [
        "released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.",
    ],
    "apache": [
        "licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "this work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer.",
    ],
    "cc-by-nc": ["licensed under CC BY-NC 4.0"],
}
PHRASES = {"mit": (b"mit", b"license"), "apache": (b"apache", b"license"), "gpl": (b"general", b"public", b"license")}
LONG_MATCH = 5
MAX_GAP = 12
COVERED = 0.6

# A-Z to lower case, every other ASCII byte but letters and digits to space.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton of integer sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: per state: sequence number to one end position of the state's strings there
        self.ends: list[dict[int, int]] = [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].setdefault(number, at + 1)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            above = self.ends[self.link[state]]
            for number, end in self.ends[state].items():
                above.setdefault(number, end)

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.length.append(length)
        self.link.append(self.link[state])
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, source: int, symbol: int) -> int:
        """The state reached from ``source`` whose longest string is one longer than source's."""
        target = self.next[source][symbol]
        if self.length[target] == self.length[source] + 1:
            return target
        clone = self._copy(target, self.length[source] + 1)
        self.link[target] = clone
        while source >= 0 and self.next[source].get(symbol) == target:
            self.next[source][symbol] = clone
            source = self.link[source]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        self.ends.append({})
        made = len(self.next) - 1
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = made
            last = self.link[last]
        if last >= 0:
            self.link[made] = self._split(last, symbol)
        return made

    def statistics(self, symbols):
        """``(length, state)`` of the longest template match that ends at each symbol."""
        state = length = 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                length += 1
            yield length, state


def chain(matches: list[tuple[int, int, int]], max_gap: int = MAX_GAP) -> tuple[int, int, int, int, int]:
    """Best chain of ``(text start, template start, length)`` matches.

    Returns covered words, then text and template span. Links go forward in
    both orders, do not overlap and skip at most ``max_gap`` words of either.
    """
    best: list[tuple[int, int, int]] = []  # covered, text start, template start of the chain that ends here
    ordered = sorted(matches)
    low = 0
    for i, (at, place, size) in enumerate(ordered):
        top = (size, at, place)
        while ordered[low][0] + ordered[low][2] + max_gap < at and low < i:
            low += 1
        for j in range(low, i):
            a, p, n = ordered[j]
            cut = max(0, a + n - at, p + n - place)  # words shared with the previous match
            if cut < size and at > a and place > p and at - a - n <= max_gap and place - p - n <= max_gap:
                top = max(top, (best[j][0] + size - cut, best[j][1], best[j][2]))
        best.append(top)
    at = max(range(len(best)), key=lambda i: (best[i][0], -i))
    covered, start, place = best[at]
    a, p, n = ordered[at]
    return covered, start, a + n, place, p + n


class Scanner:
    """Templates, their vocabulary and automaton; ``scan`` takes one text."""

    _made: Scanner | None = None

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, long_match: int = LONG_MATCH):
        self.names = [name for name, texts in templates.items() for _ in texts]
        word_lists = [words_of(text) for texts in templates.values() for text in texts]
        self.vocabulary: dict[bytes, int] = {}
        for words in word_lists:
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        self.sizes = [len(words) for words in word_lists]
        self.long_match = long_match
        self.automaton = SuffixAutomaton([[self.vocabulary[w] for w in words] for words in word_lists])

    @classmethod
    def shared(cls) -> Scanner:
        """The default scanner, once per Python worker."""
        cls._made = cls._made or cls()
        return cls._made

    def matches(self, words: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """Maximal long matches per template: (text start, template start, length).

        Words outside the templates reset the automaton, so only runs of
        template words of the least length are streamed.
        """
        symbols = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], symbols > 0, [False]))))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start < self.long_match:
                continue
            previous = (0, 0)
            stream = self.automaton.statistics(symbols[start:end].tolist())
            for at, (length, state) in enumerate([*stream, (0, 0)], start):
                if length <= previous[0] >= self.long_match:  # the match before could not be extended
                    size = previous[0]
                    for number, place in self.automaton.ends[previous[1]].items():
                        found.setdefault(number, []).append((at - size, place - size, size))
                previous = (length, state)
        return found

    def scan(self, text: str) -> tuple[int, list[tuple[str, int]], dict[str, tuple[float, int, int]]]:
        """Word count, base places (label, first word) and per label (coverage, text span)."""
        data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
        words = data.split()
        places = []
        if b"license" in data:
            for at, word in enumerate(words):
                if word == b"license":
                    for label, phrase in PHRASES.items():
                        start = at + 1 - len(phrase)
                        if start >= 0 and tuple(words[start : at + 1]) == phrase:
                            places.append((label, start))
        labels: dict[str, tuple[float, int, int]] = {}
        for number, matches in self.matches(words).items():
            covered, start, end, _, _ = chain(matches)
            entry = (covered / self.sizes[number], start, end)
            labels[self.names[number]] = max(labels.get(self.names[number], entry), entry)
        return len(words), places, labels


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", covered: float = COVERED) -> DataFrame:
    """License findings per row.

    ``labels`` has the base labels and those of templates covered to at least
    ``covered``; ``score`` is the largest coverage of a template, at least 0.5
    where a base phrase stands. ``spans`` lists ``label:first word:end word`` of
    covered templates. Null and empty texts have no words, empty labels and
    score 0; repeated rows and null ids keep a row each.
    """

    def compute(batches):
        scanner = Scanner.shared()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n, places, labels = scanner.scan(text)
                starts = [s for _, s in places]
                base = {label for label, _ in places}
                added = {k: v for k, v in labels.items() if v[0] >= covered}
                top = max([v[0] for v in labels.values()] + [0.5] * bool(base), default=0.0)
                rows.append((
                    n, len(places), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base | added.keys())), min(1.0, top),
                    ",".join(f"{k}:{a}:{b}" for k, (_, a, b) in sorted(added.items())),
                ))
            columns = zip(*rows) if rows else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return keyed_text(docs, id_col, text_col).mapInArrow(
        compute, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                 "base_labels string, labels string, score double, spans string"
    )
