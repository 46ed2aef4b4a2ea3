"""Redirection of shell commands by rules: patterns over the whole command, then the programs that it runs.

Pattern rules come first, in their order; the first that fits decides, malformed ones are
left out. A rule rewrites if its mode (or the default) says so and its replacement changes
the command; otherwise it denies. Then the first program with a rule decides: it is replaced
only where the command is that one program and nothing around it, and denied elsewhere.
"""

from __future__ import annotations

import re
import shlex
import tomllib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A rule over the whole command; ``rewrite`` in the form of Java's and Spark's replacements ($1)."""

    pattern: str
    rewrite: str = ""
    mode: str | None = None


# What stands before a program, shells that run a string, endings that programs have, and options of a runner that take a value.
PREFIXES, SHELLS = {"sudo", "env", "nohup", "time", "command", "exec", "call"}, {"bash", "sh", "zsh", "dash"}
ENDINGS = (".exe", ".cmd", ".bat", ".ps1")
#: Wrappers of other systems, with the options behind which their command stands.
WRAPPERS = {"cmd": {"/c", "/r"}, "powershell": {"-command", "-c", "/c"}, "pwsh": {"-command", "-c", "/c"}}
RUNNER_VALUES = set(
    "-p --python --with --with-requirements --with-editable --directory --project --index --extra --group --no-group --only-group --config-file --env-file --python-platform"
    " --resolution --index-strategy --keyring-provider --link-mode --refresh-package --upgrade-package --no-binary-package --no-build-package".split()
)


def program_name(word: str) -> str:
    """A program without its folder and ending, in lower case."""
    name = word.replace("\\", "/").rsplit("/", 1)[-1].lower()
    return next((name[: -len(e)] for e in ENDINGS if name.endswith(e)), name)


def rules_of(*texts: str) -> tuple[list[Pattern], dict[str, str], str]:
    """(patterns, {program: replacement}, mode) of rule files in TOML, the later ones on top.

    ``[redirect]`` holds ``mode`` and ``enabled``; ``[[redirect.rules]]`` have a ``pattern`` with
    ``rewrite`` and ``mode``, or a ``program`` with its ``replacement``. A later rule for the same
    pattern or program takes the earlier one's place, one without effect (``enabled = false``)
    takes it away; a file that is not TOML says nothing.
    """
    mode, on, held = "rewrite", True, {}
    for text in texts:
        try:
            told = tomllib.loads(text).get("redirect", {})
        except tomllib.TOMLDecodeError:
            continue
        mode, on = told.get("mode", mode), told.get("enabled", on)
        for r in told.get("rules", []):
            key = ("pattern", r["pattern"]) if r.get("pattern") else ("program", program_name(r.get("program", "")))
            if not key[1]:
                continue
            if r.get("enabled", True):
                held[key] = r
            else:
                held.pop(key, None)
    if not on:
        return [], {}, mode
    patterns = [Pattern(p, r.get("rewrite", ""), r.get("mode")) for (kind, p), r in held.items() if kind == "pattern"]
    return patterns, {p: r.get("replacement", "") for (kind, p), r in held.items() if kind == "program"}, mode


ASSIGNMENT, COMMAND_OPTION = re.compile(r"[A-Za-z_]\w*=.*", re.DOTALL), re.compile(r"-\w*c\w*")
WORDS = re.compile(r"""[;|&()\n]+|(?:[^ \t\r;|&()\n'"]|'[^']*'|"[^"]*")+""")


def lexed(command: str) -> list[str]:
    """The words and runs of separators; ValueError for open quotes. Only commands with backslashes or open quotes go through the lexer by characters."""
    if "'" not in command and '"' not in command and "\\" not in command:
        return WORDS.findall(command)
    if "\\" not in command:
        words, left = [], []
        end = 0
        for m in WORDS.finditer(command):
            left.append(command[end : m.start()])
            end = m.end()
            words.append(re.sub("""'([^']*)'|"([^"]*)\"""", r"\1\2", m[0]))
        left.append(command[end:])
        if not "".join(left).strip(" \t\r"):  # an open quote belongs to no word
            return words
    lexer = shlex.shlex(command, posix=True, punctuation_chars=";|&()\n")
    lexer.whitespace, lexer.whitespace_split, lexer.commenters = " \t\r", True, ""
    return list(lexer)


def segments(command: str) -> list[list[str]]:
    """The words of each part between separators; a command with open quotes is one part of plain words."""
    try:
        words = lexed(command)
    except ValueError:
        return [command.split()]
    out: list[list[str]] = [[]]
    for w in words:
        if w and not w.strip(";|&()\n"):
            out.append([])
        else:
            out[-1].append(w)
    return [s for s in out if s]


def programs(command: str, depth: int = 4) -> list[str]:
    """The programs that a command runs, in order: behind assignments and prefixes, in strings given to shells and wrappers, and behind ``uv run``."""
    out = []
    for words in segments(command):
        at = 0
        while at < len(words) and (ASSIGNMENT.fullmatch(words[at]) or (words[at] in PREFIXES and at + 1 < len(words))):
            at += 1
        words = words[at:]
        if not words:
            continue
        name = program_name(words[0])
        if name in WRAPPERS and depth:
            at = next((i for i, w in enumerate(words[:-1]) if i and w.lower() in WRAPPERS[name]), None)
            out += programs(" ".join(words[at + 1 :]), depth - 1) if at else [name]
            continue
        inner = next((words[i + 1] for i, w in enumerate(words[:-1]) if i and COMMAND_OPTION.fullmatch(w)), None)
        if name in SHELLS and inner is not None and depth:
            out += programs(inner, depth - 1)
        elif name == "uv" and words[1:2] == ["run"]:
            rest = words[2:]
            while rest and rest[0].startswith("-"):
                done = rest[0] == "--"
                rest = rest[2 if rest[0] in RUNNER_VALUES else 1 :]
                if done:
                    break
            out.append(program_name(rest[0]) if rest else name)
        else:
            out.append(name)
    return out


def decisions(command: Column, patterns: list[Pattern], replacements: dict[str, str], mode: str = "rewrite") -> Column:
    """A struct (action, rule, command): rewrite, deny or null; the pattern's place or the program; the new command."""

    @F.arrow_udf("array<string>")
    def run(commands: pa.Array) -> pa.Array:
        each = commands.dictionary_encode()  # equal commands of a batch are read once
        told = pa.array([programs(c) for c in each.dictionary.to_pylist()], pa.list_(pa.string()))
        return told.take(each.indices)

    def told(action: Column, rule: Column, new: Column) -> Column:
        return F.struct(action.alias("action"), rule.alias("rule"), new.alias("command"))

    none = F.lit(None).cast("string")
    ruled = F.filter(run(command), lambda p: p.isin(*replacements)) if replacements else F.array().cast("array<string>")
    first = F.get(ruled, F.lit(0))
    token = F.regexp_extract(command, r"^\s*([^\s;|&()'\"$`<>]+)", 1)
    closed = lambda q: F.length(F.regexp_replace(command, f"[^{q}]", "")) % 2 == 0
    simple = (F.size(ruled) == 1) & (token == first) & ~command.rlike(r"[;|&()\n`$<>]") & closed("'") & closed('"')
    table = F.create_map(*[F.lit(x) for pair in replacements.items() for x in pair]) if replacements else None
    new = F.concat(F.regexp_extract(command, r"^(\s*)", 1), F.try_element_at(table, first), F.regexp_extract(command, r"(?s)^\s*\S+(.*)$", 1)) if replacements else none
    rewrites = simple & F.lit(mode == "rewrite")
    out = F.when(F.size(ruled) > 0, told(F.when(rewrites, "rewrite").otherwise("deny"), first, F.when(rewrites, new)))
    for i, p in reversed(list(enumerate(patterns, 1))):
        try:
            re.compile(p.pattern)
        except re.error:
            continue
        said = F.regexp_replace(command, p.pattern, p.rewrite) if p.rewrite else command
        change = (said != command) & F.lit((p.mode or mode) == "rewrite")
        out = F.when(command.rlike(p.pattern), told(F.when(change, "rewrite").otherwise("deny"), F.lit(str(i)), F.when(change, said))).otherwise(out)
    return out
