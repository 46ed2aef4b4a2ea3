import random
import shlex

import pytest

from tessera.operators import redirect as D


def by_characters(command):
    lexer = shlex.shlex(command, posix=True, punctuation_chars=";|&()\n")
    lexer.whitespace, lexer.whitespace_split, lexer.commenters = " \t\r", True, ""
    return list(lexer)


def told(f, command):
    try:
        return f(command)
    except ValueError:
        return "open"


def test_words_are_those_of_the_lexer_by_characters():
    draw = random.Random(7)
    chars = "ab;|&()\n \t\r'\"\\#$=é\x0b\u00a0"
    for _ in range(20_000):
        c = "".join(draw.choices(chars, k=draw.randint(0, 12)))
        assert told(D.lexed, c) == told(by_characters, c), c


def test_only_backslashes_and_open_quotes_go_through_the_lexer_by_characters(monkeypatch):
    def refused(*a, **k):
        raise AssertionError("by characters")

    monkeypatch.setattr(D.shlex, "shlex", refused)
    assert D.programs("cmd /c npm test; X=1 C:/bin/Grep.EXE a | bash -c 'ls -l \"b c\"'") == ["npm", "grep", "ls"]
    for c in ("a\\ b", "echo 'x"):
        with pytest.raises(AssertionError):
            D.programs(c)
