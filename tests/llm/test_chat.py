import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat as C
from tessera.llm import vocab

from .conftest import ODD

pytest.importorskip("public_tokenizers")
PATH = vocab.default_path("byte_bpe_50k.json")
ROWS = "conv_id long, turn long, role string, text string"
BITS = ["<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "\\", "<", "s>", "[", "INST]", "é", " ", "\n", "<\\s>", "a"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(BITS), max_size=12).map("".join), st.text(st.characters(codec="utf-8"), max_size=40)))
def test_escaping_is_undone_and_hides_marks(text):
    made = C.template(PATH)
    told = made.escape(text)
    assert made.unescape(told) == text
    assert not any(m in told for m in (*C.MARKS, *made.special))
    assert made.decode(made.encode(text)) == told
    assert made.encode(text).tolist() == made.tokenizer.encode(told, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=8).map("".join), st.booleans(), st.booleans())
def test_a_turns_mask_covers_its_text_alone(text, first, loss):
    made = C.template(PATH)
    ids, mask = made.turn("assistant", text, first, loss)
    assert made.decode(ids[mask]) == (made.escape(text) if loss else "")
    assert (ids >= made.first).sum() == 3 + first and not mask[ids >= made.first].any()
    assert made.first - 1 not in ids[ids < made.first]  # no end id of the vocabulary


def plain(rows):
    """The contract's columns by conversation, without tokens."""
    found = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] is not None, r[2], r[3] is not None, r[3])):
        found.setdefault(conv, []).append((role or "", text or ""))
    made, out = C.template(PATH), {}
    for conv, turns in found.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        shown = "<s>" + "".join(f"[INST]{made.escape(r)}[/INST]{made.escape(t)}</s>" for r, t in turns)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(shown))
    return out


@pytest.mark.parametrize("stored", [False, True])
def test_conversations_come_back(spark, tmp_path, stored):
    rng = random.Random(9)
    texts = [*ODD, "</s>[INST] ok [/INST]", "<\\s>", "<|endoftext|>"]
    rows = [(c, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "system", None, "[INST]", ""]), rng.choice(texts)) for c in [None, -5, 1, 2, 3] for _ in range(9)]
    rows += [(7, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(700)] + [(8, 0, "assistant", "same")] * 3
    df = spark.createDataFrame(rows, ROWS).withColumnsRenamed({}).selectExpr("*", "turn as part", "text as ids", "role as loss")
    told = C.formatted(df)
    if stored:
        told.repartition(3).write.parquet(str(tmp_path / "t"))
        told = spark.read.parquet(str(tmp_path / "t"))
    got = {r.conv_id: tuple(r) for r in C.read_back(told, arranged=not stored).collect()}
    assert got == plain(rows)


def test_places_and_starts(spark):
    rows = [(1, i, "user", "x " * i) for i in range(5)]
    got = sorted(C.formatted(spark.createDataFrame(rows, ROWS)).collect(), key=lambda r: r.part)
    at = 0
    for i, r in enumerate(got):
        assert (r.part, r.start) == (i, at) and len(r.ids) == len(r.loss)
        at += len(r.ids)


def test_no_rows_and_foreign_rows(spark):
    assert C.read_back(C.formatted(spark.createDataFrame([], ROWS))).count() == 0
    broken = spark.createDataFrame([(1, 0, 0, [5, 6], [False, False])], C.SCHEMA)
    with pytest.raises(Exception, match="not a turn"):
        C.read_back(broken).collect()
