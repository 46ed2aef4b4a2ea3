"""The word-end BPE vocabulary: splitting texts into its words, and their ids.

Files of public tokenizers stay where they are installed; their path is a parameter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import regex

from .common import Memo

#: Texts of these characters split into the same words here as in the library: one-character
#: lower case, no combining, no white space beyond ASCII. Other texts go through the library whole.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-įı-ɏ]*")
# Fixed value: the split pattern of the vocabulary file.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def plain_words() -> re.Pattern:
    """The same split for plain texts, with the classes of their characters spelled out."""
    chars = sorted({form for c in map(chr, range(0x21, 0x250)) if PLAIN.fullmatch(c) for form in (c, c.lower())})
    letters, numbers = ("".join(c for c in chars if unicodedata.category(c)[0] == k) for k in "LN")
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+")


PLAIN_WORDS = plain_words()
#: Words remembered by a worker process, over all its tasks.
MEMO = 300_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def words_of(text: str, path: str) -> list[str]:
    """The words that the vocabulary splits a text into, in lower case."""
    if PLAIN.fullmatch(text) and "<|" not in text:
        return PLAIN_WORDS.findall(text.lower())
    t = tokenizer(path)
    return WORDS.findall(t.normalizer.normalize_str(text))


class IdBytes:
    """Texts to their ids as little-endian unsigned 32-bit bytes; plain texts by their words."""

    def __init__(self, path: str):
        self.path, self.model = path, tokenizer(path).model
        self.letters = {b: ord(c) for c, b in byte_letters().items()}
        self.of = Memo(self.word, MEMO).__getitem__

    def word(self, word: str) -> bytes:
        """One word of a plain text goes to the model as it is, in the letters that stand for its bytes."""
        told = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(told))

    def encode(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.of, PLAIN_WORDS.findall(text.lower())))
        return b"".join(i.to_bytes(4, "little") for i in tokenizer(self.path).encode(text, add_special_tokens=False).ids)


@lru_cache(1)
def id_bytes(path: str) -> IdBytes:
    """The worker process's memo."""
    return IdBytes(path)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def pieces(path: str) -> tuple[tuple[bytes, bool], ...]:
    """The vocabulary's pieces as bytes, each with whether it ends a word."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model["end_of_word_suffix"]
    return tuple((bytes(letters[c] for c in p.removesuffix(end)), p.endswith(end)) for p in model["vocab"])
