import sqlite3

import pandas as pd

from tessera.functions.porter import stem

WORDS = """caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky
relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness
callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible
irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generalizations oscillators
archaeology being a is y yes toys enjoying dying singing agreement national nationally apologies""".split()


def test_stems_equal_sqlites():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(w, tokenize = 'porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, instance)")
    db.executemany("insert into t(rowid, w) values (?, ?)", list(enumerate(WORDS)))
    want = {WORDS[r]: s for s, r in db.execute("select term, doc from v")}
    assert {w: stem(w) for w in WORDS} == want
