import random

from tessera.operators import entities as E


def test_ways_against_plain_search(spark):
    rng = random.Random(6)
    nodes = [f"n{i:02d}" for i in range(40)]
    links = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(55)} | {(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30, 39)} | {("n05", "n05")}
    terms = [(f"Place {i // 2}", f"n{i:02d}") for i in range(40)] + [("alias  seven", "n07"), (None, "n01"), ("", "n02")]
    asks = [(k, f"place  {rng.randrange(21)}", rng.choice(["Place 3", "PLACE 19", "place 11", "alias seven", "nowhere", "", None])) for k in range(80)] + [(90, "Place 4", " place   4"), (91, None, "place 1"), (92, "place 15", "place 19")]
    up = {}
    for a, b in links:
        up.setdefault(a, set()).add(b)
    of = {}
    for t, n in terms:
        of.setdefault(" ".join((t or "").lower().split()), set()).add(n)
    of.pop("", None)

    def plain(source, target, depth):
        s, t = (" ".join((x or "").lower().split()) for x in (source, target))
        if not s or not t:
            return False, "empty", []
        if s == t:
            return True, "same", [s]
        if s not in of:
            return False, "source_not_found", []
        if t not in of:
            return False, "target_not_found", []
        paths = [[n] for n in sorted(of[s])]
        for _ in range(depth + 1):
            hit = sorted(p for p in paths if p[-1] in of[t])
            if hit:
                return True, "path", hit[0]
            paths = [[*p, q] for p in paths for q in sorted(up.get(p[-1], ()))]
        return False, "no_path", []

    df = lambda rows, schema: spark.createDataFrame(sorted(rows, key=str), schema)
    for depth in (3, 6):
        got = E.ratified(df(asks, "ask_id long, source string, target string"), df(terms, "term string, node string"), df(links, "child string, parent string"), depth).collect()
        assert {r.ask_id: (r.ratified, r.reason, r.path) for r in got} == {k: plain(s, t, depth) for k, s, t in asks} and len(got) == len(asks)
        assert {r.reason for r in got} == {"empty", "same", "source_not_found", "target_not_found", "no_path", "path"}


def test_bundles_by_hand(spark):
    f = lambda no, p, h, o=None, a=None, v=None, u=None, usd=None, d=None: (no, "s1" if no % 2 else None, p, h, o, a, v, u, usd, d)
    rows = [
        f(1, "coreference", "lamp", "the lamp"), f(2, "coreference", "lamp", "old lamp"), f(3, "distinct", "old lamp", "lamp"), f(4, "value", "the lamp", a="price", v="10", u="usd", usd=10.0),
        f(5, "value", "lamp", a="price", v="12", u="usd", usd=12.0), f(6, "value", "lamp", a="Brand", v="Lux"), f(7, "value", "the lamp", a="name", v="Late"), f(8, "event", "tune-up", d="April 1"),
        f(9, "event", "tune-up", d="April 20"), f(10, "relation", "tune-up", "the lamp", "included"), f(11, "relation", "tune-up", "old lamp", "near"), f(12, "status", "lamp", v="new"),
        f(13, "action", "lamp", a="bought", v="done"), f(14, "object_type", "lamp", v="light"), f(15, "quantity", "lamp", a="n", v="3", usd=None), f(16, "value", None, a="x", v="y"),
    ]
    extra = spark.createDataFrame([("old lamp", "desk light"), ("tune-up", "service"), ("lamp", "old lamp"), ("old lamp", "tune-up")], "a string, b string")
    got = {r.root: r.asDict() for r in E.bundles(spark.createDataFrame(rows, E.FACTS), extra).collect()}
    lamp = got["lamp"]
    assert lamp["handles"] == ["lamp", "the lamp"] and lamp["usd"] == 12.0 and lamp["name"] == "Lux" and lamp["dates"] == ["April 20"]
    assert lamp["values"] == ["Brand|Lux|", "name|Late|", "price|10|usd", "price|12|usd"] and lamp["types"] == ["light"] and lamp["statuses"] == ["new"] and lamp["actions"] == ["bought|done"]
    # a tie that a distinct pair forbids is not made by an extra one either; others are, where both handles are known
    assert got["old lamp"]["handles"] == ["old lamp", "tune-up"] and got["old lamp"]["dates"] == ["April 1", "April 20"] and len(got) == 2
    assert got["old lamp"]["relations"] == ["included|the lamp", "near|old lamp"]
    assert E.bundles(spark.createDataFrame([], E.FACTS)).count() == 0


def test_what_lies_below_a_target_is_told_once(spark, monkeypatch):
    """Questions for one target share its frontier: no table of the search has a row for each question and place."""
    kept, sizes = E.kept, []

    def counted(df):
        out = kept(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(E, "kept", counted)
    n = 60
    up = spark.createDataFrame([(f"s{i}", "mid") for i in range(n)] + [("mid", "top")] + [(f"b{i}", "other") for i in range(n)], "child string, parent string")
    terms = spark.createDataFrame([(f"s{i}", f"s{i}") for i in range(n)] + [("top", "top"), ("other", "other")], "term string, node string")
    asks = spark.createDataFrame([(i, f"s{i}", "top" if i % 2 else "other") for i in range(n)], "ask_id long, source string, target string")
    got = E.ratified(asks, terms, up).collect()
    assert {r.ask_id: (r.reason, r.path) for r in got} == {i: ("path", [f"s{i}", "mid", "top"]) if i % 2 else ("no_path", []) for i in range(n)}
    assert max(sizes) <= 3 * n
