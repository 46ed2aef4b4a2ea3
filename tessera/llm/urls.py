"""URL filter: host word segmentation and multinomial naive Bayes over host and path words.

Concatenated host names are split into words by a unigram model: Viterbi takes the split
with the highest product of word probabilities, unknown stretches paying for each letter.
Its counts are those of all the input's host and path words, from one aggregation, mixed
in equal parts with a lexicon. The words of host and path feed a naive Bayes model with two
classes, learned from labelled URLs (a table, or the seeds and word lists below, which are
not taken from the input); a listed rule decides first.

Words are runs of letters of any alphabet, and runs of digits. Percent escapes of paths
and punycode labels of hosts are read as what they stand for.

Cases: a null URL or one without ``://`` has an empty host and path, no words and so no
evidence: it is allowed unless the prior blocks. The longest fitting rule wins; a rule
fits its host and subdomains if the path starts with the rule's path.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, written

# The rules of the contract, words with rough ranks, and seed URLs.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
LEXICON = """the of and to in for on with by from is at as an be this that it we you all new more home page news blog web site online free
search info shop store best top world my your time day one about us get now go up out how who what live life health sport sports
travel food music game games video photo book books school science tech data cloud code open wiki forum news daily local city
house car cars art design garden recipes weather market money bank job jobs work green blue red star sun sea river mountain
spam farm cheap pills casino win winner bet bets betting poker slots slot jackpot bonus viagra cialis pharmacy pharma drug drugs meds
loan loans payday credit debt cash prize lottery click clicks ads adult sex sexy porn xxx hot nude dating cams escort replica fake
rolex crack cracked keygen warez torrent download serial hack cheat cheats diet weight loss miracle cure deal deals discount
buy sale sell traffic seo backlink backlinks link links crypto coin profit rich quick easy university library museum journal press
paper research org gov edu archive docs help support learn learning course example main www mail static media image images""".split()
SEED_BLOCK = """winbig-casino.test/slots onlinepoker.test/jackpot
freeviagra.test/buy cialis-pharmacy.test/cheap payday-loans.test/quick fastcash-loan.test/easy hotsex-cams.test/xxx adultdating.test/sexy
replica-rolex.test/discount keygen-crack.test/download warez-torrent.test/serial lottery-prize.test/winner betting-bonus.test/slots
miracle-diet.test/weight cheapmeds.test/pills spamlinks.test/seo backlink-traffic.test/buy cryptoprofit.test/rich fake-drugs.test/sale
slotcasino.test/jackpot bestpills.test/cheap linkfarm.test/backlinks""".split()
SEED_ALLOW = """city-library.test/books university.test/research science-journal.test/paper localnews.test/daily weather.test/city
music-school.test/course garden-recipes.test/food opendata.test/docs code-forum.test/help mountain-travel.test/photo
museum-archive.test/art health-info.test/support sports-news.test/page wiki.test/learn dailypress.test/news techblog.test/code
river-house.test/design bookstore.test/books jobs-market.test/work green-world.test/blog schoolweb.test/learning
statemedia.test/images homegarden.test/page bluesea.test/travel""".split()
#: Words that speak for a class by themselves, each counted LISTED times.
BLOCK_WORDS = """spam casino pills bet bets betting poker slots slot jackpot bonus viagra cialis loan loans payday lottery ads adserver adult
sex sexy porn xxx nude escort replica fake rolex crack cracked keygen warez torrent hack cheat cheats backlink backlinks tracker
tracking popup gambling roulette bingo malware phishing hentai webcam camgirls hookup milf erotic kasino glücksspiel казино ставки 赌场 博彩""".split()
ALLOW_WORDS = """news sport sports travel food music book books school science tech data code open wiki forum weather garden recipes university
library museum journal press paper research gov edu archive docs help support learn learning course health history nature
theatre government council church hospital academy dictionary encyclopedia conference software bibliothek universität новости 新闻 大学""".split()
LISTED = 3
KNOWN = [*LEXICON, *BLOCK_WORDS, *ALLOW_WORDS]
#: The segmenter keeps at most so many counted words, the most frequent: it is sent to every worker.
VOCABULARY = 200_000

HOST = r"(?s)^.*?://([^/?#]*)"
WORDS = re.compile(r"[^\W\d_]+|\d+")
LONGEST = 64  # letters of a word in the segmenter
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


class Segmenter:
    """Unigram Viterbi. ``counts`` orders words by frequency; unknown letters cost a fixed log-probability each."""

    def __init__(self, counts: dict[str, float]):
        total = sum(counts.values())
        self.cost = {w: -math.log(c / total) for w, c in counts.items()}
        self.longest = max(map(len, counts), default=1)
        floor = max(self.cost.values(), default=1.0)
        self.unknown_start, self.unknown_letter = floor + 1.0, 2.5

    def split(self, name: str) -> list[str]:
        """The cheapest split; neighbouring unknown letters stay together. Linear in the name's length."""
        n = len(name)
        #: By end: (cost, start of the last word, whether it is unknown), once for known and once for unknown endings.
        known, unknown = [(math.inf, 0)] * (n + 1), [(math.inf, 0)] * (n + 1)
        known[0] = (0.0, 0)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                if (c := self.cost.get(name[start:end])) is not None:
                    best = min(known[start][0], unknown[start][0]) + c
                    if best < known[end][0]:
                        known[end] = (best, start)
            fresh, more = known[end - 1][0] + self.unknown_start + self.unknown_letter, unknown[end - 1][0] + self.unknown_letter
            unknown[end] = (more, unknown[end - 1][1]) if more <= fresh else (fresh, end - 1)
        out, end = [], n
        while end:
            is_known = known[end][0] <= unknown[end][0]
            start = known[end][1] if is_known else unknown[end][1]
            out.append(name[start:end])
            end = start
        return out[::-1]


def ranked_counts(words: Iterable[str]) -> dict[str, float]:
    """Zipf counts by first place; single letters are no words."""
    return {w: 1000.0 / (i + 10) for i, w in enumerate(dict.fromkeys(words)) if len(w) > 1}


def _unescaped(label: str) -> str:
    if not label.startswith("xn--"):
        return label
    try:
        return label[4:].encode("ascii").decode("punycode")
    except UnicodeError:
        return label


def raw_words(host: str, path: str) -> list[str]:
    """Runs of letters, and runs of digits, before they are split."""
    host = ".".join(map(_unescaped, host.split("."))) if "xn--" in host else host
    return WORDS.findall(f"{host} {unquote(path)}".lower())


def counted_words(pages: DataFrame, limit: int = VOCABULARY) -> dict[str, int]:
    """How often each word stands in hosts and paths, the most frequent ``limit`` (with all of the last's equals, or none).

    A name that the lexicon splits without rest counts for its parts. Words are counted where the rows are.
    """

    def run(batches):
        known, held = Segmenter(ranked_counts(KNOWN)), Counter()

        def told():
            out = Counter()
            for w, n in held.items():
                parts = known.split(w) if len(w) <= LONGEST else [w]
                for x in parts if all(x in known.cost for x in parts) else [w]:
                    if 1 < len(x) <= LONGEST:
                        out[x] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for host, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.update(w for w in raw_words(host or "", path or "") if not w.isdecimal())
                if len(held) > 100_000:
                    yield told()
        yield told()

    host, path = host_and_path(F.col("url"))
    rows = pages.select(host.alias("host"), path.alias("path")).mapInArrow(run, "word string, n long")
    counts = written(rows.groupBy("word").agg(F.sum("n").alias("n")), "url-words")
    least, total = 1, 0
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        total += r["count"]
        if total > limit:
            least = r["n"] + 1
            break
    return parted({r["word"]: r["n"] for r in counts.where(F.col("n") >= least).toLocalIterator()})


def parted(counts: dict[str, int]) -> dict[str, int]:
    """Words that split into words of three and more letters, each counted more often, count for those."""
    known = Segmenter({w: float(n) for w, n in counts.items() if len(w) > 2})
    out = Counter()
    for w, n in counts.items():
        cost = known.cost.pop(w, None)
        parts = known.split(w) if len(w) > 5 else [w]
        for x in parts if all(counts.get(x, 0) > n and x in known.cost for x in parts) else [w]:
            out[x] += n
        if cost is not None:
            known.cost[w] = cost
    return dict(out)


def mixed_counts(counts: dict[str, int]) -> dict[str, float]:
    """Counted words and the lexicon in equal parts, at any size of the input."""
    lexicon = ranked_counts(KNOWN)
    scale, total = sum(lexicon.values()), sum(counts.values())
    out = {w: c / scale for w, c in lexicon.items()}
    for w, n in counts.items():
        out[w] = out.get(w, 0.0) + n / total
    return out


@dataclass
class UrlModel:
    segmenter: Segmenter
    weight: dict[str, float] = field(default_factory=dict)  # log P(word | block) - log P(word | allow)
    prior: float = 0.0

    def words(self, host: str, path: str) -> list[str]:
        return [w for p in raw_words(host, path) for w in self._split(p)]

    def _split(self, part: str) -> list[str]:
        memo = self.__dict__.get("_memo")
        if memo is None:
            memo = self.__dict__["_memo"] = Memo(lambda p: [p] if p.isdecimal() else self.segmenter.split(p), 200_000)
        return memo[part]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_memo"}

    def of(self, words: list[str]) -> float:
        return self.prior + sum(self.weight.get(w, 0.0) for w in words)

    def evidence(self, host: str, path: str) -> float:
        return self.of(self.words(host, path))


def fit(labelled: Iterable[tuple[str, str, int]], counts: dict[str, float] | None = None, smooth: float = 0.5, lists: dict[int, list[str]] | None = None) -> UrlModel:
    """From (host, path, 1 to block) rows and words listed by class: word counts by class with additive smoothing."""
    model = UrlModel(Segmenter(counts or ranked_counts(LEXICON)))
    seen: dict[int, dict[str, int]] = {0: {}, 1: {}}
    rows = {0: 0, 1: 0}
    for host, path, label in labelled:
        rows[label] += 1
        for w in model.words(host, path):
            seen[label][w] = seen[label].get(w, 0) + 1
    for label, words in (lists or {}).items():
        for w in words:
            seen[label][w] = seen[label].get(w, 0) + LISTED
    return from_counts(model, seen, rows, smooth)


def from_counts(model: UrlModel, seen: dict[int, dict[str, int]], rows: dict[int, int], smooth: float = 0.5) -> UrlModel:
    vocabulary = set(seen[0]) | set(seen[1])
    total = {k: sum(seen[k].values()) + smooth * len(vocabulary) for k in seen}
    model.weight = {w: math.log((seen[1].get(w, 0) + smooth) / total[1]) - math.log((seen[0].get(w, 0) + smooth) / total[0]) for w in vocabulary}
    model.prior = math.log((rows[1] + 1) / (rows[0] + 1)) - 1.0  # blocking needs evidence
    return model


def fit_table(labelled: DataFrame, counts: dict[str, float] | None = None, min_rows: int = 2) -> UrlModel:
    """From a table (url, label): words are counted where the rows are; words of fewer than ``min_rows`` rows say nothing."""
    model = UrlModel(Segmenter(counts or ranked_counts(LEXICON)))

    @F.pandas_udf("array<string>")
    def split(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([model.words(h or "", p or "") for h, p in zip(host, path, strict=True)], dtype=object)

    rows = labelled.where("label in (0, 1)").select("label", split(*host_and_path(F.col("url"))).alias("words"))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    seen: dict[int, dict[str, int]] = {0: {}, 1: {}}
    per = rows.select("label", F.explode("words").alias("w")).groupBy("w").agg(F.count_if(F.col("label") == 1).alias("b"), F.count_if(F.col("label") == 0).alias("a")).where(F.col("a") + F.col("b") >= min_rows)
    for r in per.toLocalIterator():
        seen[1][r["w"]], seen[0][r["w"]] = r["b"], r["a"]
    return from_counts(model, seen, {k: n.get(k, 0) for k in (0, 1)})


def seed_model(counts: dict[str, int] | None = None) -> UrlModel:
    """From the seeds and word lists; ``counts`` of the input's words are the segmenter's."""
    split = lambda u: (u.partition("/")[0].removesuffix(".test"), "/" + u.partition("/")[2])
    return fit([(*split(u), 1) for u in SEED_BLOCK] + [(*split(u), 0) for u in SEED_ALLOW], mixed_counts(counts or {}), lists={1: BLOCK_WORDS, 0: ALLOW_WORDS})


def host_and_path(url):
    """The host with A-Z lower-cased, and the path up to ? or #; both empty without ://."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.when(has, F.translate(F.regexp_extract(url, HOST, 1), upper, lower)).otherwise("")
    return host, F.when(has, F.regexp_extract(url, PATH, 1)).otherwise("")


def rule_of(host, path, rules: list[tuple[str, str]]):
    """The longest fitting rule, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        out = F.when(((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest)), F.lit(rule)).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, model: UrlModel | None = None, threshold: float = 0.0) -> DataFrame:
    """Every page with host, path, its rule, the verdict, the evidence for blocking and the host's words."""
    model = model or seed_model(counted_words(pages))
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))

    @F.pandas_udf("evidence double, words string")
    def evidence(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        words = [model.words(h, p) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame({"evidence": [model.of(ws) for ws in words], "words": [" ".join(ws) for ws in words]})

    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("nb", evidence("host", "path"))
    verdict = F.when(F.col("nb.evidence") > threshold, "block").otherwise("allow")
    for rule, said in rules:
        verdict = F.when(F.col("rule") == rule, said).otherwise(verdict)
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("nb.evidence").alias("evidence"), F.col("nb.words").alias("words"))


def op5_urls(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
