"""Rules over triples, given by users as data, to their fixed point by semi-naive joins.

A rule derives triples of one predicate: ``Rule(head, body, unless, unequal)``. Atoms are
(subject, predicate, object); terms that begin with ``?`` are variables, others constants, and
predicates are constants. ``unless`` atoms must not hold, ``unequal`` pairs must differ.

Rules are put in strata, so that a predicate that an ``unless`` asks for is complete before.
Within a stratum each round joins what the last round found new (the delta) with what is
known, once for each place of a body where something new can stand: at places before it with
everything, at places behind it with what was known before, so no combination is met twice.
Each round is a table a predicate; rounds end when nothing new comes. What a round finds is combined
to one row a triple before it is compared with what is known of its predicate.

Provenance: ``via`` names the triples of the body that gave a triple first, in the order of the
body (of several bodies in one round the smallest); a given triple is named by its id, a derived
one by its three terms. So every derivation can be followed down to given triples.

Cases: nulls match nothing; given triples of a derived predicate count as known and are not
told again; rules without variables in common between body atoms, with heads or conditions whose
variables the body does not bind, or with a cycle through ``unless`` are refused.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import kept, only

Atom = tuple[str, str, str]
#: Tables of rounds that are put together when so many have come.
ROUNDS = 8


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]
    unless: tuple[Atom, ...] = ()
    unequal: tuple[tuple[str, str], ...] = ()


# The rules that always hold; the second tells both orders of each pair.
TRANSITIVE = Rule(("?a", "transitively_uses", "?c"), (("?a", "uses", "?b"), ("?b", "uses", "?c")), unequal=(("?a", "?c"),))
CO_OCCURS = Rule(("?a", "co_occurs_with", "?b"), (("?a", "causes", "?c"), ("?b", "causes", "?c")), unequal=(("?a", "?b"),))


def variables(atom: Atom) -> list[str]:
    return [t for t in (atom[0], atom[2]) if t.startswith("?")]


def checked(rules: list[Rule]) -> list[list[Rule]]:
    """The rules by stratum; ValueError for what can't be evaluated."""
    for r in rules:
        if not r.body:
            raise ValueError(f"a rule without a body: {r}")
        if any(a[1].startswith("?") for a in (r.head, *r.body, *r.unless)):
            raise ValueError(f"predicates are constants: {r}")
        bound, first = set(variables(r.body[0])), True
        for a in r.body:
            if not first and not bound & set(variables(a)):
                raise ValueError(f"body atoms without a variable in common: {r}")
            bound, first = bound | set(variables(a)), False
        asked = {v for a in (r.head, *r.unless) for v in variables(a)} | {t for p in r.unequal for t in p if t.startswith("?")}
        if asked - bound:
            raise ValueError(f"variables that the body does not bind: {sorted(asked - bound)}")
    heads = {r.head[1] for r in rules}
    level = dict.fromkeys(heads, 0)
    for _ in range(len(heads) + 1):
        before = dict(level)
        for r in rules:
            needs = [level[a[1]] for a in r.body if a[1] in heads] + [level[a[1]] + 1 for a in r.unless if a[1] in heads]
            level[r.head[1]] = max([level[r.head[1]], *needs])
        if level == before:
            break
    else:
        raise ValueError("a cycle through unless: the rules have no strata")
    return [[r for r in rules if level[r.head[1]] == k] for k in sorted(set(level.values()))]


def _matches(rows: DataFrame, atom: Atom, names: dict[str, str], name: str | None) -> DataFrame:
    """An atom's bindings in the (subject, object) rows of its predicate: a column a variable and, as ``name``, what the triple is called."""
    s, _, o = atom
    for term, column in ((s, "subject"), (o, "object")):
        if not term.startswith("?"):
            rows = rows.where(F.col(column) == term)
    if s.startswith("?") and s == o:
        rows = rows.where("subject = object")
    cols = [F.col(c).alias(names[t]) for t, c in dict([(o, "object"), (s, "subject")]).items() if t.startswith("?")]
    return rows.select(*cols, *([F.col("name").alias(name)] if name else []))


def _term(term: str, names: dict[str, str]) -> Column:
    return F.col(names[term]) if term.startswith("?") else F.lit(term)


def _fired(rule: Rule, sources: list[DataFrame], held: dict[str, DataFrame], provenance: bool) -> DataFrame:
    """(subject, object) of a rule and, if asked, via; each body atom read from its source, ``held`` by predicate for the conditions."""
    names = {v: f"v{i}" for i, v in enumerate(dict.fromkeys(v for a in rule.body for v in variables(a)))}
    rows = None
    for i, (atom, source) in enumerate(zip(rule.body, sources, strict=True)):
        got = _matches(source, atom, names, f"via{i}" if provenance else None)
        on = [] if rows is None else [c for c in got.columns if c in rows.columns]
        rows = got if rows is None else rows.join(got, on)
    for p, q in rule.unequal:
        rows = rows.where(_term(p, names) != _term(q, names))
    for atom in rule.unless:
        if atom[1] not in held:
            continue
        stand = _matches(held[atom[1]], atom, names, None).distinct()
        if stand.columns:
            rows = rows.join(stand, stand.columns, "left_anti")
        else:  # a fact that stands or not: one row at most
            rows = rows.join(F.broadcast(stand.select(F.lit(1).alias("held")).limit(1)), F.col("held") == 1, "left_anti")
    told = [_term(rule.head[0], names).alias("subject"), _term(rule.head[2], names).alias("object")]
    if provenance:  # a derived triple is named here, behind the joins, by its own terms
        told.append(F.array(*[F.coalesce(f"via{i}", F.concat_ws(" ", _term(a[0], names), F.lit(a[1]), _term(a[2], names))) for i, a in enumerate(rule.body)]).alias("via"))
    return rows.select(*told)


def derived(facts: DataFrame, rules: list[Rule], most_rounds: int | None = None, provenance: bool = True) -> DataFrame:
    """(subject, predicate, object, via, round) of all triples that the rules add to ``facts`` (id, subject, predicate, object).

    ``most_rounds`` bounds the rounds of a stratum, for programs whose fixed point is not wanted.
    Without ``provenance`` there is no ``via``, and no name of a triple is made, sent or stored.
    """
    strata = checked(rules)
    return only(lambda: _derived(facts, strata, most_rounds, provenance))


def _derived(facts: DataFrame, strata: list[list[Rule]], most_rounds: int | None, provenance: bool) -> DataFrame:
    key = ["subject", "object"]
    asked = {a[1] for rules in strata for r in rules for a in (r.head, *r.body, *r.unless)}
    given = facts.where(F.col("predicate").isin(*asked) & F.col("subject").isNotNull() & F.col("object").isNotNull())
    if provenance:
        given = kept(given.groupBy("subject", "predicate", "object").agg(F.min(F.col("id").cast("string")).alias("name")))
    else:
        given = kept(given.select("subject", "predicate", "object").distinct())
    stated = [r["predicate"] for r in given.select("predicate").distinct().collect()]  # those of the rules at most
    columns = [*key, "name"] if provenance else key
    told: list[DataFrame] = []
    known, done = {p: [given.where(F.col("predicate") == p).select(*columns)] for p in stated}, 0
    whole = lambda parts: reduce(DataFrame.unionByName, parts)
    for rules in strata:
        heads = list(dict.fromkeys(r.head[1] for r in rules))
        first, rounds = True, 0
        delta: dict[str, DataFrame] = {}
        while most_rounds is None or rounds < most_rounds:
            fired: dict[str, list[DataFrame]] = {}
            every = {p: whole(parts) for p, parts in known.items()}
            before = {p: whole(rest) for p, parts in known.items() if (rest := parts[:-1] if p in delta else parts)}
            for r in rules:
                atoms = [a[1] for a in r.body]
                for k, p in enumerate(atoms[:1] if first else atoms):
                    source = [every] * len(atoms) if first else [every] * k + [delta] + [before] * (len(atoms) - k - 1)
                    if all(a in rows for a, rows in zip(atoms, source, strict=True)):
                        fired.setdefault(r.head[1], []).append(_fired(r, [rows[a] for a, rows in zip(atoms, source, strict=True)], every, provenance))
            if not fired:
                break
            rounds += 1
            delta, first = {}, False
            for p in heads:
                if p not in fired:
                    continue
                new = whole(fired[p])
                new = new.groupBy(*key).agg(F.min("via").alias("via")) if provenance else new.distinct()
                new = kept(new.join(every[p].select(*key), key, "left_anti") if p in every else new)
                if not new.isEmpty():
                    delta[p] = new.select(*key, F.lit(None).cast("string").alias("name")) if provenance else new
                    told.append(new.withColumn("predicate", F.lit(p)).withColumn("round", F.lit(done + 1)))
            if not delta:
                break
            done += 1
            for p, new in delta.items():
                parts = known.setdefault(p, [])
                if len(parts) > ROUNDS:
                    parts[:] = [kept(whole(parts))]
                parts.append(new)
    columns = ["subject", "predicate", "object", *(["via"] if provenance else []), "round"]
    if told:
        return whole(told).select(*columns)
    types = {"via": "array<string>", "round": "int"}
    return facts.sparkSession.createDataFrame([], ", ".join(f"{c} {types.get(c, 'string')}" for c in columns))
