"""License scan by template-markup matching.

A template is wording with marked regions: ``[[ ... ]]`` may be left out and
``{{name|lo-hi}}`` stands for lo to hi words of any kind. Everything else is mandatory and
must agree word by word. Templates compile into automata over tokens; a text carries a
license where an automaton accepts a run of its words. Short base phrases are counted
beside, at every place where their words stand consecutively.

Cases: a null text is empty; texts without words have zero counts, null places, empty
labels and score 0. ``score`` is the largest share of fixed (not replaced) words over the
accepted runs; a base phrase is a run of fixed words, so it scores 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from .common import WORD, folded, map_columns

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_MIT_GRANT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software
[[the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
in no event shall {{holder|1-12}} be liable for any claim damages or other liability
[[whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software]]]]"""
_BSD_START = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_END = """this software is provided by {{holder|1-12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""
_GPL_END = "as published by the free software foundation either version {v} of the license or at your option any later version"
_FREE = "{{work|1-6}} is free software you can redistribute it and or modify it under the terms of the gnu "

# The public wording of well-known license notices, with marked regions.
TEMPLATES = {
    "mit": ["[[this {{work|1-4}} is]] [[licensed]] [[released]] [[distributed]] under the [[terms of the]] mit license", _MIT_GRANT],
    "apache-2": [
        "licensed under the apache license version 2 [[0]]",
        "licensed under the apache license version 2 0 the license you may not use {{work|1-6}} except in compliance with the license [[you may obtain a copy of the license at {{place|1-12}}]] [[unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied]]",
    ],
    "cc-by-nc": ["licensed under [[a]] [[the]] cc by nc [[4 0]]", "[[licensed]] under [[a]] [[the]] creative commons attribution noncommercial [[4 0]] [[international]] [[public]] license"],
    "cc-by": ["licensed under [[a]] [[the]] cc by {{version|1-1}} 0 [[license]]", "under [[a]] [[the]] creative commons attribution [[{{version|1-1}} 0]] [[international]] [[unported]] [[public]] license"],
    "cc-by-sa": ["licensed under [[a]] [[the]] cc by sa [[{{version|1-1}} 0]]", "under [[a]] [[the]] creative commons attribution [[share alike]] [[sharealike]] {{version|1-1}} 0 [[international]] [[unported]] [[public]] license"],
    "cc-by-nd": ["licensed under [[a]] [[the]] cc by nd [[{{version|1-1}} 0]]", "under [[a]] [[the]] creative commons attribution noderivatives [[{{version|1-1}} 0]] [[international]] [[public]] license"],
    "cc0": ["[[licensed]] [[released]] [[dedicated]] under [[a]] [[the]] cc0 [[1 0]] [[universal]] [[public domain dedication]]", "to the extent possible under law {{author|1-8}} has waived all copyright and related or neighboring rights to {{work|1-8}}"],
    "gpl-2": [_FREE + "general public license " + _GPL_END.format(v=2), "licensed under the gnu general public license version 2"],
    "gpl-3": ["[[this {{work|1-4}} is]] licensed under the gnu general public license version 3", _FREE + "general public license " + _GPL_END.format(v=3)],
    "lgpl-2.1": [_FREE + "lesser general public license " + _GPL_END.format(v="2 1"), "licensed under the gnu lesser general public license version 2 1"],
    "lgpl-3": [_FREE + "lesser general public license " + _GPL_END.format(v=3), "licensed under the gnu lesser general public license version 3"],
    "agpl-3": [_FREE + "affero general public license " + _GPL_END.format(v=3), "licensed under the gnu affero general public license version 3"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and {{author|1-6}} disclaims all warranties with regard to this software"],
    "bsd-2": [f"{_BSD_START} {_BSD_END}", "licensed under [[the]] bsd 2 clause [[license]]"],
    "bsd-3": [
        f"{_BSD_START} [[3]] neither the name of {{{{holder|1-12}}}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission [[{_BSD_END}]]",
        "licensed under [[the]] bsd 3 clause [[license]]",
    ],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at {{place|1-8}}]]"],
    "epl-2": ["this program and the accompanying materials are made available under the terms of the eclipse public license [[v]] 2 0 [[which is available at {{place|1-8}}]]"],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "boost-1": ["distributed under the boost software license version 1 0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "wtfpl": ["do what the fuck you want to public license"],
}
# Names of the public list of license identifiers, as words.
IDENTIFIERS = {"mit": "mit", "apache 2 0": "apache-2", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3", "agpl 3 0": "agpl-3", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "isc": "isc", "mpl 2 0": "mpl-2", "epl 2 0": "epl-2", "unlicense": "unlicense", "bsl 1 0": "boost-1", "zlib": "zlib", "cc0 1 0": "cc0"}
for _words, _label in IDENTIFIERS.items():
    TEMPLATES[_label].append(f"spdx license identifier {_words}")

MARK = re.compile(r"\[\[|\]\]|\{\{\w+\|(\d+)-(\d+)\}\}|[^\s\[\]{}]+")


class Automaton:
    """A template's automaton over words: states are places, some left without reading a word."""

    def __init__(self, template: str):
        self.read: list[tuple[bytes | None, int] | None] = []  # by state: the word to read (None: any) and the next state
        self.skip: list[list[int]] = []  # by state: states reached without reading
        opened, self.mandatory = [], []
        for m in MARK.finditer(template):
            if m[0] == "[[":
                opened.append(self._state())
            elif m[0] == "]]":
                self.skip[opened.pop()].append(len(self.read))
            elif m[1]:
                lo, hi = int(m[1]), int(m[2])
                ends = []
                for i in range(hi):
                    s = self._state((None, len(self.read) + 1))
                    ends += [s] * (i >= lo)
                for s in ends:
                    self.skip[s].append(len(self.read))
            else:
                word = m[0].lower().encode()
                self._state((word, len(self.read) + 1))
                self.mandatory += [word] * (not opened)
        if opened:
            raise ValueError(f"a region of the template is not closed: {template}")
        self.final = self._state()
        self.close = [self._closure(s) for s in range(len(self.read))]

    def _state(self, read=None) -> int:
        self.read.append(read)
        self.skip.append([] if read else [len(self.read)])
        return len(self.read) - 1

    def _closure(self, s: int) -> frozenset[int]:
        seen, todo = set(), [s]
        while todo:
            x = todo.pop()
            if x not in seen and x <= self.final:
                seen.add(x)
                todo += self.skip[x] if x != self.final else []
        return frozenset(seen)

    @property
    def first(self) -> set[bytes | None]:
        """The words that a run can begin with; None: any."""
        return {self.read[s][0] for s in self.close[0] if self.read[s]}

    def longest(self, words: list[bytes], at: int) -> tuple[int, int] | None:
        """The end of the longest accepted run from ``at``, and how many of its words are fixed."""
        now, best = dict.fromkeys(self.close[0], 0), None
        if self.final in now:
            return None
        i = at
        while now and i < len(words):
            word, then = words[i], {}
            for s, fixed in now.items():
                if (read := self.read[s]) and (read[0] is None or read[0] == word):
                    for x in self.close[read[1]]:
                        then[x] = max(then.get(x, 0), fixed + (read[0] is not None))
            now, i = then, i + 1
            if self.final in now:
                best = i, now[self.final]
        return best


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, templates: dict[str, Iterable[str]] = TEMPLATES):
        self.base = [([w.encode() for w in p.split()], label) for p, label in base.items()]
        self.compiled = [(a, label) for label, ts in templates.items() for a in map(Automaton, ts)]
        #: By template, its longest mandatory word: texts without those words are passed over.
        self.keys = [max(a.mandatory, key=len) for a, _ in self.compiled]

    def base_places(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        found = []
        for phrase, label in self.base:
            rare = max(range(len(phrase)), key=lambda i: len(phrase[i]))
            at = -1
            try:
                while True:
                    at = words.index(phrase[rare], at + 1)
                    start = at - rare
                    if start >= 0 and words[start : start + len(phrase)] == phrase:
                        found.append((start, start + len(phrase), label))
            except ValueError:
                pass
        return sorted(found)

    def template_runs(self, words: list[bytes], low: bytes) -> list[tuple[int, int, str, float]]:
        """(start, end, label, share of fixed words): accepted runs, none inside another of its template."""
        runs = []
        for (auto, label), key in zip(self.compiled, self.keys, strict=True):
            if key not in low:
                continue
            first, end = auto.first, 0
            for at, word in enumerate(words):
                if (None in first or word in first) and at >= end and (got := auto.longest(words, at)):
                    end = got[0]
                    runs.append((at, end, label, got[1] / (end - at)))
        return sorted(runs)


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, Iterable[str]] = TEMPLATES) -> DataFrame:
    """Per document: word count, base places, accepted template runs, labels and score."""

    def task():
        scanner = Scanner(base, templates)
        hints = sorted({max(p, key=len) for p, _ in scanner.base} | set(scanner.keys))

        def each(ids, texts):
            out = {c: [] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "runs")}
            for doc, text in zip(ids, texts, strict=True):
                low = folded(text)
                words = WORD.findall(low)
                places, runs = [], []
                if any(h in low for h in hints):
                    places, runs = scanner.base_places(words), scanner.template_runs(words, low)
                base_labels = {p[2] for p in places}
                row = (
                    doc,
                    len(words),
                    len(places),
                    places[0][0] if places else None,
                    places[-1][0] if places else None,
                    ",".join(sorted(base_labels)),
                    ",".join(sorted(base_labels | {r[2] for r in runs})),
                    1.0 if places else max((r[3] for r in runs), default=0.0),
                    ",".join(f"{r[2]}:{r[0]}:{r[1]}" for r in runs),
                )
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
            return out

        return each

    return map_columns(docs, ["doc_id", "text"], "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, runs string", task)


def op2_licenses(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
