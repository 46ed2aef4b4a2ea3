"""Secret scan: base patterns and a token-efficiency test.

Base kinds, each leftmost and non-overlapping: ``assign`` (a name such as password or
api_key, a sign and a value of 6+ characters; the span is the whole match), ``access``
(AKIA...; 20+ characters) and ``hex`` (24+ hex digits). The method adds kind ``random``:
runs of 16 and more key characters whose characters per token under a byte-level BPE
vocabulary are fewer than ``ratio``. Runs in the form of words (letters in one case or
capitalized, with at most four digits at the end) may be words that the vocabulary lacks:
they must hold five consonants in a row as well, or have fewer than ``WORD_RATIO`` of
``ratio``. Known digests (hex of a hash function's length), UUIDs and numbers are left to
the base kinds, and runs that a base span covers are not told twice.

Cases: a null text is empty; offsets are code points of the whole text, ends exclusive;
spans of one kind never overlap. Without spans the string is empty.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_columns
from .vocab import default_path

# The patterns of the contract, with the least length of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
NUMBER = re.compile(r"[0-9+/_=-]+")
ONE_CASE = r"(?:[A-Za-z][a-z]+|[A-Z]{2,})"
WORDY = re.compile(rf"[_/+=-]*{ONE_CASE}(?:[_/+=-]+{ONE_CASE})*[_/+=-]*[0-9]{{0,4}}")
#: Five consonants in a row; letters that are written for one sound count once.
HARSH = re.compile(r"(?:sch|ch|ck|gh|ng|ph|pf|sh|st|th|tz|[b-df-hj-np-tv-xz]){5}", re.IGNORECASE)
WORD_RATIO = 0.8
PIECE = 4096  # characters that are encoded at once
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def known_form(run: str) -> bool:
    """Digests, numbers and UUIDs, which are no secrets by themselves."""
    if NUMBER.fullmatch(run) or UUID.fullmatch(run):
        return True
    return len(run) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run) is not None


def least_ratio(run: str, ratio: float) -> float:
    """What a run's characters per token must stay under."""
    return WORD_RATIO * ratio if WORDY.fullmatch(run) and not HARSH.search(run) else ratio


def characters_per_token(run: str, path: str) -> float:
    return len(run) / sum(len(encoding(path).encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base kinds."""
    found = []
    low = text.encode("utf-8", "replace").lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, base: list[tuple[int, int, int]], path: str, ratio: float) -> list[tuple[int, int, int]]:
    found, at, reach = [], 0, 0  # base spans come by start: the farthest end of those that begin no later decides
    for m in RUN.finditer(text):
        run = m[0]
        while at < len(base) and base[at][0] <= m.start():
            reach = max(reach, base[at][1])
            at += 1
        if m.end() <= reach or known_form(run):
            continue
        if characters_per_token(run, path) < least_ratio(run, ratio):
            found.append((m.start(), m.end(), 3))
    return found


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def scan(docs: DataFrame, path: str | None = None, ratio: float = 2.0) -> DataFrame:
    """Per document: counts of the base kinds, a digest of their spans, and all spans."""
    path = path or default_path("byte_bpe_50k.tiktoken")

    def task():
        def each(ids, texts):
            out = {c: [] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")}
            for doc, text in zip(ids, texts, strict=True):
                text = text or ""
                base = base_spans(text)
                extra = random_spans(text, base, path, ratio)
                kinds = [k for _, _, k in base]
                for c, v in zip(out, (doc, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(told(base).encode()).hexdigest(), told(base + extra), len(extra)), strict=True):
                    out[c].append(v)
            return out

        return each

    return map_columns(docs, ["doc_id", "text"], "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long", task)


def op7_secrets(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
