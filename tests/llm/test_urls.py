import itertools
import math
import re

from tessera.llm import urls as U

P = "page_id long, url string, html string"


def test_viterbi_against_all_splits():
    seg = U.Segmenter(U.ranked_counts("a an ab abc bc c cheap pills he ap".split()))

    def cost(parts):
        return sum(seg.cost[p] if p in seg.cost else seg.unknown_start + seg.unknown_letter * len(p) for p in parts)

    for name in ("abcab", "cheappills", "xxabyy", "cheapq", "zz", "a", ""):
        best = math.inf
        for cuts in itertools.product((0, 1), repeat=max(len(name) - 1, 0)):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(name)]
            best = min(best, cost([name[a:b] for a, b in zip(at, at[1:]) if b > a]))
        got = seg.split(name)
        assert "".join(got) == name and abs(cost(got) - (0 if not name else best)) < 1e-9


def test_rules_hosts_and_paths(spark):
    urls = ["http://A.Example.NET/en/1?x", "https://x.example.net/fr/1", "http://b.example.com/de/", "http://b.example.com/de", "ftp://org/fr/x#y", "http://wikipedia.org/en/", None, "no scheme", "http://internet/x", "http://q.net", "x://h?u://z/", "http://cheappills.example.com/buy", "http://a.b://net/c"]
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], P).withColumn("host", U.F.lit("clash"))
    got = {r.page_id: r for r in U.judge(df).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        assert (got[i].host, got[i].path) == ((m[1].lower(), m[2]) if m else ("", ""))
    assert [got[i].rule for i in range(6)] == ["example.net/en/", "net/", "example.com/de/", None, "org/fr/", None]
    assert [got[i].verdict for i in (0, 1, 2, 4, 5, 6, 7)] == ["allow", "block", "block", "allow", "allow", "allow", "allow"]
    assert got[8].rule is None and got[9].rule is None and got[11].verdict == "block" and got[11].words.startswith("cheap pills")


def test_bayes_counts(spark):
    rows = [("http://spam-pills.test/buy", 1), ("http://pills.test/buy", 1), ("http://news.test/daily", 0), ("http://city-news.test/daily", 0)]
    model = U.fit_table(spark.createDataFrame(rows, "url string, label int"), min_rows=1)
    same = U.fit([(u.split("/")[2], "/" + u.split("/")[3], y) for u, y in rows])
    assert model.weight.keys() == same.weight.keys() and all(abs(model.weight[w] - same.weight[w]) < 1e-12 for w in model.weight)
    assert model.evidence("pills.test", "/buy") > 0 > model.evidence("news.test", "/daily")


def test_the_segmenter_learns_the_input_s_words(spark):
    urls = ["http://zorbel.test/a", "http://zorbel.test/b", "http://quinta.test/zorbel", "http://quinta.test/", "http://zorbelquinta.test/", "http://cheappills.test/", None]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], P)
    counts = U.counted_words(pages)
    assert (counts["zorbel"], counts["quinta"], counts["test"], counts["cheap"], counts["pills"]) == (4, 3, 6, 1, 1)
    assert not {"cheappills", "zorbelquinta"} & set(counts) and set(U.counted_words(pages, 2)) == {"test", "zorbel"}
    assert U.seed_model(counts).words("zorbelquinta.test", "")[:2] == ["zorbel", "quinta"]


def test_words_of_any_alphabet_and_digits(spark):
    pages = spark.createDataFrame([(0, "http://казино.test/x", ""), (1, "http://a.test/%D0%BA%D0%B0%D0%B7%D0%B8%D0%BD%D0%BE", ""), (2, "http://xn--80aswg.test/", ""), (3, "http://b.test/新闻/777", "")], P)
    got = {r.page_id: r for r in U.judge(pages).collect()}
    assert [got[i].verdict for i in (0, 1, 3)] == ["block", "block", "allow"]
    assert "казино" in got[1].words and "сайт" in got[2].words and got[3].words.endswith("新闻 777")
    rows = spark.createDataFrame([("http://a.test/777", 1), ("http://b.test/777", 1), ("http://c.test/5", 0), ("http://d.test/5", 0)], "url string, label int")
    model = U.fit_table(rows)
    assert model.weight["777"] > 0 > model.weight["5"]


def test_hosts_that_are_no_seeds_are_judged_by_their_words(spark):
    blocked, allowed = ["free-bets", "adult-shop", "ads-server", "onlinegambling"], ["city-news", "tionble", "en", "librarybooks"]
    seeds = {u.partition(".")[0] for u in U.SEED_BLOCK + U.SEED_ALLOW}
    assert not seeds & {*blocked, *allowed}
    pages = spark.createDataFrame([(i, f"http://m.{h}.example.org/en/12.html", "") for i, h in enumerate(blocked + allowed)], P)
    got = {r.page_id: r.verdict for r in U.judge(pages).collect()}
    assert [got[i] for i in range(8)] == ["block"] * 4 + ["allow"] * 4


def test_judge_against_a_plain_loop(spark):
    """Hosts, paths, rules, words and evidence of random URLs, each split tried by hand."""
    import random
    from urllib.parse import unquote

    rng = random.Random(12)
    parts = ["net", "example.net", "a.example.net", "example.com", "org", "x.org", "cheappills.test", "cityNEWS.Test", "internet", "winbet.example.org", "", "h-1.test"]
    paths = ["", "/", "/en/", "/en/x", "/de/y?z", "/fr/#a", "/fr", "/buy/slots", "/news?q", "?en/", "/a%20b/c"]
    urls = [rng.choice(("http://", "HTTPS://", "x", "a://b://", "")) + rng.choice(parts) + rng.choice(paths) for _ in range(150)] + [None]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], P)
    model = U.seed_model(U.counted_words(pages))
    got = {r.page_id: r for r in U.judge(pages, model=model).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(r, v) for r, v in U.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule, said = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
        words = [w for run in re.findall(r"[^\W\d_]+|\d+", f"{host} {unquote(path)}".lower()) for w in ([run] if run.isdecimal() else model.segmenter.split(run))]
        evidence = model.prior + sum(model.weight.get(w, 0.0) for w in words)
        want = (host, path, rule, said or ("block" if evidence > 0 else "allow"), " ".join(words))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict, got[i].words) == want and abs(got[i].evidence - evidence) < 1e-9


def test_empty_table(spark):
    assert U.judge(spark.createDataFrame([], P)).count() == 0
