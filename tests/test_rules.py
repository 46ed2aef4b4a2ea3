import itertools
import random

import pytest

from tessera.operators import rules as R
from tessera.operators.rules import Rule

FACTS = "id long, subject string, predicate string, object string"


def naive(facts, strata):
    """Whole sets until nothing is new, stratum by stratum."""
    known = {(s, p, o) for _, s, p, o in facts if None not in (s, o)}
    start = set(known)
    for rules in strata:
        while True:
            new = set()
            for r in rules:
                bindings = [{}]
                for s, p, o in r.body:
                    grown = []
                    for b in bindings:
                        for x, q, y in known:
                            c = dict(b)
                            if p == q and all(c.setdefault(t, v) == v if t.startswith("?") else t == v for t, v in ((s, x), (o, y))):
                                grown.append(c)
                    bindings = grown
                for b in bindings:
                    val = lambda t, b=b: b.get(t, t)
                    if all(val(p) != val(q) for p, q in r.unequal) and not any((val(s), p, val(o)) in known for s, p, o in r.unless):
                        new.add((val(r.head[0]), r.head[1], val(r.head[2])))
            if new <= known:
                break
            known |= new
    return known - start


CLOSURE = [Rule(("?a", "path", "?b"), (("?a", "edge", "?b"),)), Rule(("?a", "path", "?c"), (("?a", "path", "?b"), ("?b", "path", "?c")))]
PROGRAMS = [
    [R.TRANSITIVE, R.CO_OCCURS],
    CLOSURE,
    [*CLOSURE, Rule(("?a", "apart", "?b"), (("?a", "likes", "?b"),), unless=(("?a", "path", "?b"),)), Rule(("?a", "loop", "?a"), (("?a", "path", "?a"),))],
    [Rule(("?x", "even", "?y"), (("?x", "edge", "?z"), ("?z", "odd", "?y"))), Rule(("?x", "odd", "?y"), (("?x", "edge", "?y"),)), Rule(("?x", "odd", "?y"), (("?x", "edge", "?z"), ("?z", "even", "?y")))],
    [Rule(("n1", "starts", "?b"), (("n1", "edge", "?b"), ("?b", "likes", "?c"), ("?a", "edge", "?c")), unequal=(("?a", "n2"),), unless=(("n0", "edge", "n0"),))],
]


@pytest.mark.parametrize("program", range(len(PROGRAMS)))
def test_programs_against_whole_sets(spark, program):
    rng = random.Random(program)
    nodes = [f"n{i}" for i in range(9)]
    facts = [(i, rng.choice(nodes), rng.choice(["edge", "likes", "uses", "causes"]), rng.choice(nodes)) for i in range(45)]
    facts += [(90, None, "edge", "n1"), (91, "n1", "edge", None), (92, "n1", "path", "n2"), (93, "n1", "edge", "n3"), (94, "n1", "edge", "n3"), (95, "n1", "edge", "n5"), (96, "n5", "likes", "n6"), (97, "n4", "edge", "n6")]
    facts = [f for f in facts if f[1:] != ("n0", "edge", "n0")]
    rules = PROGRAMS[program]
    got = R.derived(spark.createDataFrame(facts, FACTS), rules).collect()
    told = [(r.subject, r.predicate, r.object) for r in got]
    assert len(told) == len(set(told)) and set(told) == naive(facts, R.checked(rules)) and told
    # provenance: each triple's named body gives it by one of the rules, from what was known before its round
    names = {}
    for i, s, p, o in facts:
        if None not in (s, o):
            names.setdefault((s, p, o), str(i))
            names[s, p, o] = min(names[s, p, o], str(i))
    of = {n: t for t, n in names.items()}
    rounds = dict.fromkeys(of, 0)
    for r in got:
        n = f"{r.subject} {r.predicate} {r.object}"
        of[n], rounds[n] = (r.subject, r.predicate, r.object), r["round"]
    for r in got:
        assert all(rounds[v] < r["round"] for v in r.via)
        fits = []
        for rule in rules:
            if rule.head[1] == r.predicate and len(rule.body) == len(r.via):
                b = {}
                fits.append(all(q == of[v][1] and all(b.setdefault(t, x) == x if t.startswith("?") else t == x for t, x in ((s, of[v][0]), (o, of[v][2]))) for (s, q, o), v in zip(rule.body, r.via, strict=True)))
        assert any(fits)


def test_long_chains_and_round_bounds(spark):
    chain = spark.createDataFrame([(i, f"a{i:02d}", "edge", f"a{i + 1:02d}") for i in range(20)], FACTS)
    step = [CLOSURE[0], Rule(("?a", "path", "?c"), (("?a", "path", "?b"), ("?b", "edge", "?c")))]
    got = R.derived(chain, step).collect()
    assert {(r.subject, r.object) for r in got} == {(f"a{i:02d}", f"a{j:02d}") for i, j in itertools.combinations(range(21), 2)}
    assert max(r["round"] for r in got) == 20
    assert {int(r.object[1:]) - int(r.subject[1:]) for r in R.derived(chain, step, most_rounds=3).collect()} == {1, 2, 3}
    assert R.derived(chain.limit(0), step).count() == 0


@pytest.mark.parametrize("rules", [
    [Rule(("?a", "p", "?b"), (("?a", "q", "?b"),), unless=(("?a", "p", "?b"),))],
    [Rule(("?a", "p", "?b"), (("?a", "e", "?b"),), unless=(("?a", "q", "?b"),)), Rule(("?a", "q", "?b"), (("?a", "p", "?b"),))],
    [Rule(("?a", "p", "?z"), (("?a", "e", "?b"),))],
    [Rule(("?a", "p", "?b"), (("?a", "e", "?b"), ("?c", "e", "?d")))],
    [Rule(("?a", "p", "?b"), (("?a", "e", "?b"),), unequal=(("?a", "?z"),))],
    [Rule(("?a", "?p", "?b"), (("?a", "e", "?b"),))],
    [Rule(("a", "p", "b"), ())],
])
def test_programs_that_are_refused(rules):
    with pytest.raises(ValueError):
        R.checked(rules)


def test_without_provenance_the_same_triples_and_nothing_of_their_names(spark):
    facts = [(i, f"n{i}", "in", f"n{i // 2}") for i in range(2, 20)] + [(90, "n3", "under", "n9"), (91, None, "in", "n1"), (92, "n2", "in", None)]
    table = spark.createDataFrame(facts, "id long, subject string, predicate string, object string")
    rules = [
        R.Rule(("?a", "under", "?b"), (("?a", "in", "?b"),)),
        R.Rule(("?a", "under", "?c"), (("?a", "under", "?b"), ("?b", "under", "?c")), unequal=(("?a", "?c"),)),
        R.Rule(("?a", "deep", "?b"), (("?a", "under", "?b"),), unless=(("?a", "in", "?b"), ("?b", "nowhere", "?a"))),
    ]
    whole, bare = R.derived(table, rules), R.derived(table, rules, provenance=False)
    assert bare.columns == ["subject", "predicate", "object", "round"] and whole.columns == ["subject", "predicate", "object", "via", "round"]
    told = lambda df: sorted(df.select(*bare.columns).collect())
    assert told(whole) == told(bare) and len(told(bare)) > 40
    assert all(len(r.via) in (1, 2) and None not in r.via for r in whole.collect())
    assert R.derived(table.limit(0), rules, provenance=False).columns == bare.columns
