import math
import random
import statistics

import pytest

from tessera.operators import selection
from tessera.operators.selection import at_ranks, percentiles


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(4)
    hot = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e12), float(rng.randint(-3, 3)), 5e-324, -1e308]) for _ in range(3000)]
    return {"hot": hot, "one": [7.5], "two": [1.0, -1.0], "same": [2.0] * 9, None: [3.0, 1.0, 2.0], "": [-0.0, 0.0, 4.0, math.inf, -math.inf]}


@pytest.fixture(scope="module")
def rows(spark, groups):
    told = [(g, v, "x") for g, vs in groups.items() for v in vs] + [("hot", None, "x"), ("hot", math.nan, "x"), ("none", None, "x")]
    random.Random(1).shuffle(told)
    return spark.createDataFrame(told, "g string, v double, n string").repartition(5)


@pytest.fixture(params=[selection.FEW, 20, 0])
def few(request, monkeypatch):
    """Passes: none, some, all."""
    monkeypatch.setattr(selection, "FEW", request.param)


def test_every_rank(rows, groups, few):
    got = at_ranks(rows, ["g"], "v", lambda n: {"first": n * 0 + 1, "third": n * 0 + 3, "last": n, "beyond": n + 5, "half": n / 2}).collect()
    want = {}
    for g, vs in groups.items():
        s, n = sorted(vs), len(vs)
        want |= {(g, n, k): s[max(1, min(int(r), n)) - 1] for k, r in (("first", 1), ("third", 3), ("last", n), ("beyond", n), ("half", n / 2))}
    assert {(r.g, r.n, r.name): r.x for r in got} == want and len(got) == len(want)


def test_percentiles_of_both_kinds(rows, groups, few):
    ps = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in percentiles(rows, ["g"], "v", ps).collect()}
    open_ = {r.g: r.p95 for r in percentiles(rows, ["g"], "v", {"p95": 0.95}, exclusive=True).collect()}
    for g, vs in groups.items():
        s = sorted(vs)
        for name, p in ps.items():
            at = p * (len(s) - 1)
            lo = math.floor(at)
            want = s[lo] if at == lo else s[lo] + (at - lo) * (s[lo + 1] - s[lo])
            assert got[g][name] == pytest.approx(want, nan_ok=True)
        if g != "":
            assert open_[g] == (pytest.approx(statistics.quantiles(s, n=20)[18]) if len(s) > 1 else 0.0)


def test_whole_table_and_no_rows(spark, rows, groups):
    every = sorted(v for vs in groups.values() for v in vs)
    got = percentiles(rows, [], "v", {"p50": 0.5}).collect()
    assert len(got) == 1 and got[0].p50 == statistics.median(every)
    assert percentiles(rows.where("false"), ["g"], "v", {"p50": 0.5}).count() == 0
