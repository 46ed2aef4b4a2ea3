import random
import re

import pytest

from tessera.llm import licenses as L

from .conftest import ODD


def test_template_regions():
    a = L.Automaton("may [[freely and {{who|1-2}}]] use it")
    read = lambda t: a.longest(t.encode().split(), 0)
    assert read("may use it") == (3, 3)
    assert read("may freely and bob use it now") == (6, 5)
    assert read("may freely and bob ann use it") == (7, 5)
    assert read("may freely and bob ann eve use it") is None
    assert read("may not use it") is None
    with pytest.raises(ValueError):
        L.Automaton("a [[ b")


def test_automata_against_regular_expressions():
    rng = random.Random(3)
    for _ in range(400):
        parts, rx = [], []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice("abc")
            kind = rng.random()
            if kind < 0.5:
                parts.append(w)
                rx.append(w)
            elif kind < 0.75:
                parts.append(f"[[{w}]]")
                rx.append(f"{w}?")
            else:
                parts.append("{{x|0-2}}")
                rx.append(".{0,2}")
        auto, text = L.Automaton(" ".join(parts)), "".join(rng.choice("abc") for _ in range(8))
        ends = [e for e in range(len(text) + 1) if re.fullmatch("".join(rx), text[:e])]
        got = auto.longest([c.encode() for c in text], 0)
        if 0 in ends:  # templates that accept nothing accept no run
            assert got is None
        else:
            assert (got[0] if got else None) == (max(ends) if ends else None)


def test_base_counts_places_and_labels(docs_of, rows):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    got = rows(L.scan(docs_of(["Released under the MIT License. Again: UNDER the\nmit-license!", "Apache License, Version 2.0 and CC BY-NC 4.0", mit, "the license", "This work is licensed under the GNU General Public License, version 3."], extra=True)))
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 1, 6, "mit")
    assert (got[1].base_labels, got[1].n_base, got[1].score) == ("apache-2,cc-by-nc", 2, 1.0)
    assert got[2].labels == "" and got[3].labels == "" and got[3].n_words == 2 and got[3].first_word is None
    assert got[4].labels == "gpl-3" and got[4].base_labels == "" and 0 < got[4].score <= 1


def test_labels_of_notices(docs_of, rows):
    """Optional and replaced wording, and one word of mandatory wording changed."""
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    third = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    end = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
    gpl = "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    want = {
        bsd + end: "bsd-2", bsd + third + end: "bsd-3", bsd + third: "bsd-3", bsd: "", bsd.replace("retain", "keep") + end: "",
        gpl.format("General Public License", "3"): "gpl-3", gpl.format("General Public License", "2"): "gpl-2", gpl.format("Lesser General Public License", "2.1"): "lgpl-2.1",
        gpl.format("Affero General Public License", "3"): "agpl-3", "# SPDX-License-Identifier: BSD-3-Clause": "bsd-3", "SPDX-License-Identifier: Nothing": "",
        "Licensed under CC BY 4.0": "cc-by", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa", "Distributed under the Boost Software License, Version 1.0.": "boost-1",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "unlicense",
    }
    got = rows(L.scan(docs_of(list(want))))
    assert {t: got[i].labels for i, t in enumerate(want)} == want


def test_base_against_plain_search(docs_of, rows):
    rng = random.Random(4)
    vocabulary = "under the mit license apache version 2 cc by nc x".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(300)) for _ in range(20)]
    got = rows(L.scan(docs_of(texts)))
    for i, t in enumerate(texts):
        w = t.split()
        places = sorted(s for p in L.BASE for s in range(len(w)) if w[s : s + len(p.split())] == p.split())
        assert (got[i].n_words, got[i].n_base) == (300, len(places))
        assert (got[i].first_word, got[i].last_word) == ((places[0], places[-1]) if places else (None, None))


def test_odd_texts_and_empty_tables(docs_of, rows):
    got = rows(L.scan(docs_of(ODD)))
    assert len(got) == len(ODD) and got[0].n_words == 0 and got[0].score == 0 and got[7].n_words == 30_000
    assert L.scan(docs_of([])).count() == 0
    assert L.scan(docs_of([(None, "x"), (1, "x"), (1, "x")])).count() == 3
