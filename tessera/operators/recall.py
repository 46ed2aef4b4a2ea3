"""Recall: the arms of a search over memories, folded, rescored and cut, for a set of questions at once.

Roles: ``asks`` (query_id, text, vec_id, embedding; vec_id is the row whose vector it is, or
null), ``memories`` (id, content, type, project, session, created_at, confidence), ``vectors``
(id, embedding), ``usage`` (memory_id, strength, dormant), ``phrases`` (phrase_id, memory_id,
text). Every stage takes and returns (query_id, id, ..., rank) rows of at most a pool a
question; only the searches of the arms read all memories. Stages run when they are asked for,
each once; ``graph.only`` around one keeps its rows and takes the others' tables away. Rows of
pools are tables before they meet the memories: their size is known then, so they are sent to the
memories while they are small and no content is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexicon as X
from tessera.functions import text as T
from tessera.operators import bm25, filters, fusion, graph, models, planning, vector

# Fixed value: questions about several points in time, which a scorer of single rows would spoil.
ENDPOINTS = (
    r"\b(?:days?|weeks?|months?|years?|hours?)\b.*\b(?:between|after|before|since|apart)\b|\bbetween\b[^?]*\band\b"
    r"|\bhow long\b.*\b(?:after|before|since|between)\b|\bwhich\b[^?]*\b(?:first|earlier|later|come|came|happened)\b[^?]*\bor\b"
    r"|\b(?:first|last)\b[^?]*\bor\b[^?]*\?"
)
TOKEN = r"%?[A-Za-z0-9][A-Za-z0-9_.]*"
RUN = r"[a-z0-9_.%]+"


@dataclass(frozen=True)
class Settings:
    """What a recall may be told; widths and floors of a question come from its plan."""

    rrf_k: int = 20
    terms: int = 12
    centroid: int = 3  # rows whose mean vector stands for the question's expansion
    phrases: int = 20
    sessions: int = 3
    per_session: int = 12
    seeds: int = 5
    max_df: int = 40
    bridged: int = 10
    walked: int = 10
    steps: int = 2
    head: int = 20
    bits: float = 5.0
    budget: int = 6000


def best(rows: DataFrame, k: int | Column, *order) -> DataFrame:
    """The first k rows of each question, with their rank."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_arm(asks: DataFrame, vectors: DataFrame, memories: DataFrame, floor: float | None = None, allowed=None, most: int = 80) -> DataFrame:
    """(query_id, id, similarity, rank): three pools of neighbours first, then the filters, then one pool.

    ``asks`` also has ``pool`` and, unless one is given, ``floor``.
    """
    own = F.coalesce("vec_id", -F.col("query_id") - 1)
    near = vector.topk(asks.select(own.alias("id"), "embedding"), vectors, 3 * most, id_col="id").select(F.col("query_id").alias("own"), F.col("vec_id").alias("id"), "similarity", F.col("rank").alias("r"))
    near = graph.kept(near).join(memories, "id").join(asks.drop("embedding").withColumn("own", own), "own").where(F.col("r") <= 3 * F.col("pool"))
    rows = near.where((F.col("type") != "SYSTEM") & (F.col("similarity") >= (F.col("floor") if floor is None else F.lit(floor))))
    rows = rows.where(allowed) if allowed is not None else rows
    return best(rows.select("query_id", "id", "similarity", "pool"), F.col("pool"), F.desc("similarity"), "id").drop("pool")


def focus(asks: DataFrame, most: int) -> DataFrame:
    """(query_id, term): the most salient words of each question, lower case; words of letters and digits only."""
    rows = asks.select("query_id", F.posexplode(T.focus_candidates(F.col("text"))).alias("pos", "word"))
    rows = rows.groupBy("query_id", F.lower("word").alias("term")).agg(F.min_by("word", "pos").alias("word"), F.min("pos").alias("pos"))
    rows = best(rows.withColumn("s", T.salience(F.col("word"))), most, F.desc("s"), "pos")
    return rows.where(F.col("term").rlike("^[a-z0-9]+$")).select("query_id", "term")


def wanted(parts: Column) -> Column:
    """What a question's inline filters ask of (type, project): an array of allowed values each, null where any will do."""
    of = lambda key: F.try_element_at(F.filter(parts, lambda p: p["key"] == key), F.lit(-1))["value"]
    types = F.filter(F.transform(F.split(F.upper(of("type")), ","), F.trim), lambda t: t != "")
    return F.array(types, F.when(of("project").isNotNull(), F.array(of("project"))))


def keyword_arm(asks: DataFrame, terms: DataFrame, memories: DataFrame, parts: Column | None = None, most: int = 80) -> DataFrame:
    """(query_id, id, rank): the pool of each question by keywords. Filters stand before the pool: the search passes over what they leave out."""
    facets, wants = ([F.col("type"), F.col("project")], asks.select("query_id", wanted(parts).alias("wants"))) if parts is not None else (None, None)
    found = bm25.search(memories, terms, most, "id", F.col("content"), may=F.col("type") != "SYSTEM", facets=facets, wants=wants)
    return found.join(asks.select("query_id", "pool"), "query_id").where("rank <= pool").select("query_id", "id", "rank")


def expansion(keyword: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """(query_id, embedding): the mean vector of the n best keyword rows that have one, in place of an embedded expansion."""
    rows = best(keyword.join(vectors, "id").withColumnRenamed("rank", "r"), n, "r").select("query_id", F.posexplode("embedding").alias("pos", "x"))
    mean = rows.groupBy("query_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("embedding"))


def phrase_arm(terms: DataFrame, phrases: DataFrame, memories: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, rank): memories by their best phrase among a question's first ``limit`` phrases."""
    top = bm25.search(phrases, terms, limit, id_col="phrase_id").withColumnRenamed("id", "phrase_id")
    of = graph.kept(top.join(phrases.select("phrase_id", F.col("memory_id").alias("id")), "phrase_id").groupBy("query_id", "id").agg(F.min("rank").alias("r")))
    return best(of.join(memories.where("type <> 'SYSTEM'").select("id"), "id", "left_semi"), 2**31 - 1, "r").select("query_id", "id", "rank")


def session_arm(ranked: DataFrame, memories: DataFrame, sessions: int, per_session: int) -> DataFrame:
    """(query_id, id, rank): the first rows of the sessions that the best rows touch, session by session."""
    first = ranked.join(memories.select("id", "session"), "id").where("session <> ''").groupBy("query_id", "session").agg(F.min("rank").alias("r"))
    first = graph.kept(best(first, sessions, "r").withColumnRenamed("rank", "s"))
    asked = first.select("session").distinct()
    rows = memories.select("id", "session", "type").join(asked, "session", "left_semi")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy("id"))).where(F.col("n") <= per_session)
    rows = first.select("query_id", "session", "s").join(rows, "session").where("type <> 'SYSTEM'")
    return best(rows, 2**31 - 1, "s", "n").select("query_id", "id", "rank")


def members(memories: DataFrame, max_df: int) -> DataFrame:
    """(item, entity): capitalized names of memories, without those that more than ``max_df`` memories hold."""
    m = memories.select(F.col("id").alias("item"), F.explode(T.entity_spans(F.col("content"))).alias("entity"))
    common = m.groupBy("entity").agg(F.count("*").alias("df"))
    return m.join(common.where(F.col("df") <= max_df).select("entity"), "entity", "left_semi")


def bridge_arm(ranked: DataFrame, named: DataFrame, seeds: int, most: int) -> DataFrame:
    """(query_id, id, rank): memories that share names with the first rows, by how many."""
    out = graph.bridged(named, ranked.where(F.col("rank") <= seeds).select("query_id", F.col("id").alias("item")), 1)
    return best(out.withColumnRenamed("item", "id"), most, F.desc("shared"), "id").select("query_id", "id", "rank")


def walk_arm(asks: DataFrame, named: DataFrame, most: int, steps: int) -> DataFrame:
    """(query_id, id, rank): memories by the largest mass of their names, walking from the question's names over memories and names."""
    seeds = asks.select("query_id", F.explode(T.entity_spans(F.col("text"))).alias("node"))
    item = F.concat(F.lit("#"), F.col("item").cast("string"))
    one = named.select(F.col("entity").alias("src"), item.alias("dst"))
    links = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    mass = graph.pageranks(links, seeds, steps)
    of = mass.join(named.select(F.col("entity").alias("node"), F.col("item").alias("id")), "node").groupBy("query_id", "id").agg(F.round(F.max("mass"), 9).alias("mass"))
    return best(of, most, F.desc("mass"), "id").select("query_id", "id", "rank")


def rare_terms(asks: DataFrame, memories: DataFrame, bits: float) -> DataFrame:
    """(query_id, term, bits): words in the form of identifiers or outside the stop words, with at least ``bits`` of surprisal."""
    rows = asks.select("query_id", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("word"))
    w, low = F.col("word"), F.lower("word")
    shaped = w.rlike(r"[0-9._%]") | w.rlike(r"^..*[A-Z]") | (w.rlike("^[A-Z]{2,}$"))
    terms = rows.where(shaped | ~low.isin(X.STOP_WORDS)).select("query_id", low.alias("term")).distinct()
    found = bm25.counted(memories, terms, "id", [F.col("content")], bm25.by_runs(TOKEN.replace("A-Za-z", "a-z"), bm25.ALNUM + "%_."))
    if found is None:
        return terms.withColumn("bits", F.lit(0.0)).limit(0)
    df = bm25.frequencies(found).withColumnRenamed("n", "df")
    n = memories.agg(F.count("*").alias("n"))
    told = terms.join(df, "term", "left").join(F.broadcast(n))  # one row
    return told.select("query_id", "term", F.round(T.surprisal(F.coalesce("df", F.lit(0)), F.col("n")), 6).alias("bits")).where(F.col("bits") >= bits)


def exact_boost(rows: DataFrame, terms: DataFrame, memories: DataFrame) -> DataFrame:
    """Rows move up by the summed surprisal of the terms that they hold as whole words; ties keep their order."""
    ids = rows.select("id").distinct()
    words = memories.join(ids, "id", "left_semi").select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(RUN), F.lit(0)))).alias("term"))
    words = words.join(terms.select("term").distinct(), "term", "left_semi")
    boost = rows.select("query_id", "id").join(terms, "query_id").join(words, ["id", "term"]).groupBy("query_id", "id").agg(F.round(F.sum("bits"), 6).alias("boost"))
    out = rows.withColumnRenamed("rank", "before").join(boost, ["query_id", "id"], "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("boost"), "before"))).drop("before")


@dataclass
class Recall:
    """The stages of one recall, each a DataFrame, so that any of them can be asked for."""

    asks: DataFrame
    memories: DataFrame
    vectors: DataFrame
    usage: DataFrame
    phrases: DataFrame
    now: str
    settings: Settings = Settings()
    parts: Column | None = None  # inline filters of the asks that narrow the arms
    embed: Callable[[], Callable] | None = None  # makes a model of texts; its vectors stand for the questions' expansions
    score: Callable[[], Callable] | None = None  # makes a model of (questions, contents) whose values reorder the head

    def __post_init__(self):
        mode, k, pool, floor = planning.plan_columns(F.col("text"))
        self.asks = graph.kept(self.asks.select("*", mode, k, pool, floor))
        self.allowed = None if self.parts is None else filters.allowed(self.parts, filters.SEARCH_KEYS, F.col("content"), F.col("created_at"), F.col("type"), F.col("project"))

    @cached_property
    def terms(self) -> DataFrame:
        return graph.kept(focus(self.asks, self.settings.terms))

    @cached_property
    def by_vector(self) -> DataFrame:
        return graph.only(lambda: vector_arm(self.asks, self.vectors, self.memories, allowed=self.allowed))

    @cached_property
    def by_keyword(self) -> DataFrame:
        return graph.kept(keyword_arm(self.asks, self.terms, self.memories, self.parts))

    @cached_property
    def by_expansion(self) -> DataFrame:
        asks = self.asks.drop("embedding", "vec_id")
        if self.embed is None:
            told = asks.join(expansion(self.by_keyword, self.vectors, self.settings.centroid), "query_id")
        else:
            told = models.applied(asks, ["text"], self.embed, "embedding", "array<double>").where("embedding is not null").drop("embedding_error")
        extra = graph.kept(told.withColumn("vec_id", F.lit(None).cast("long")))
        return graph.only(lambda: vector_arm(extra, self.vectors, self.memories, allowed=self.allowed))

    @cached_property
    def named(self) -> DataFrame:
        return graph.kept(members(self.memories, self.settings.max_df))

    def narrowed(self, arm: DataFrame) -> DataFrame:
        """An arm's rows that the question's own filters allow, in their order."""
        if self.allowed is None:
            return arm
        rows = graph.kept(arm.withColumnRenamed("rank", "r")).join(self.memories, "id").join(self.asks.drop("embedding"), "query_id").where(self.allowed)
        return best(rows.select("query_id", "id", "r"), 2**31 - 1, "r").select("query_id", "id", "rank")

    @cached_property
    def _fused(self) -> DataFrame:
        return graph.kept(fusion.rrf([self.by_vector, self.by_expansion, self.by_keyword], self.settings.rrf_k))

    def fused(self) -> DataFrame:
        return self._fused

    def with_phrases(self) -> DataFrame:
        return fusion.fold_arm(self.fused(), self.narrowed(phrase_arm(self.terms, self.phrases, self.memories, self.settings.phrases)), self.settings.rrf_k)

    def with_sessions(self) -> DataFrame:
        now = graph.kept(self.with_phrases())
        return fusion.fold_arm(now, self.narrowed(session_arm(now, self.memories, self.settings.sessions, self.settings.per_session)), self.settings.rrf_k)

    def with_bridges(self) -> DataFrame:
        now = graph.kept(self.with_sessions())
        return fusion.fold_arm(now, self.narrowed(bridge_arm(now, self.named, self.settings.seeds, self.settings.bridged)), self.settings.rrf_k, add_only=True)

    def with_walks(self) -> DataFrame:
        arm = walk_arm(self.asks, self.named, self.settings.walked, self.settings.steps)
        return fusion.fold_arm(self.with_bridges(), self.narrowed(arm), self.settings.rrf_k, existing=self.memories.select("id"))

    def rescored(self) -> DataFrame:
        """composite and final_rank over all folded rows."""
        rows = graph.kept(self.with_walks()).join(self.memories.select("id", "created_at", "confidence"), "id").join(self.usage.select(F.col("memory_id").alias("id"), "strength"), "id", "left")
        age = (F.unix_micros(F.lit(self.now).cast("timestamp")) - F.unix_micros("created_at")) / 86400e6
        return fusion.composite(rows, age, F.col("confidence"), F.col("strength"))

    def reranked(self) -> DataFrame:
        """(query_id, id, composite, rank): the head by a score, where the question's form allows: ``score``'s, or how many of the question's terms a row holds."""
        rows = graph.kept(self.rescored().select("query_id", "id", "composite", F.col("final_rank").alias("rank")))
        text = F.col("text")
        head = rows.where(F.col("rank") <= self.settings.head).select("query_id", "id")
        held = self.memories.join(head.select("id").distinct(), "id", "left_semi").select("id", "content")
        if self.score is None:
            words = held.select("id", F.explode(F.array_distinct(T.tokens(F.col("content")))).alias("term"))
            told = head.join(self.terms, "query_id").join(words, ["id", "term"]).groupBy("query_id", "id").agg(F.count("*").alias("value"))
        else:
            pairs = head.join(self.asks.select("query_id", F.col("text").alias("question")), "query_id").join(held, "id")
            told = models.applied(pairs, ["question", "content"], self.score, "value", "double").select("query_id", "id", "value")
        plain = self.asks.select("query_id", (planning.intents(text)["counting"] | planning.has(text, ENDPOINTS)).alias("as_is"))
        rows = rows.join(plain, "query_id").join(told, ["query_id", "id"], "left")
        scorer = F.when(F.col("as_is"), 0).otherwise(F.coalesce("value", F.lit(0)))
        return fusion.rerank_head(rows, scorer, self.settings.head).select("query_id", "id", "composite", F.col("new_rank").alias("rank"))

    def boosted(self) -> DataFrame:
        """Dormant rows out, then rows with rare words of the question up."""
        rows = graph.kept(filters.not_dormant(self.reranked(), self.usage))
        return exact_boost(rows, graph.kept(rare_terms(self.asks, self.memories, self.settings.bits)), self.memories)

    def recalled(self) -> DataFrame:
        """(query_id, id, composite, boost, similarity, rank) within the token budget; similarity is 0 for rows of other arms alone."""
        rows = graph.kept(self.boosted()).join(self.memories.select("id", F.length("content").alias("chars")), "id")
        rows = filters.within_budget(rows, self.settings.budget, F.col("chars"))
        near = self.by_vector.unionByName(self.by_expansion).groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"))
        rows = rows.join(near, ["query_id", "id"], "left")
        return rows.select("query_id", "id", "composite", "boost", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "rank")


def superseded_last(rows: DataFrame, replaced: DataFrame) -> DataFrame:
    """Rows that another memory replaced go last and name it; ``replaced`` (id, by)."""
    out = rows.join(replaced.select("id", F.col("by").alias("superseded_by")), "id", "left")
    w = Window.partitionBy("query_id").orderBy(F.col("superseded_by").isNotNull().cast("int"), "rank")
    return out.withColumn("place", F.row_number().over(w))


def route(recall: Recall, replaced: DataFrame, threshold: float) -> DataFrame:
    """The recall route after the search: the gate on the first row's similarity, result filters, superseded rows last."""
    rows = filters.rejection_gate(recall.recalled(), threshold, score="similarity")
    if recall.parts is not None:
        m = recall.memories
        keep = filters.allowed(recall.parts, filters.RESULT_KEYS, F.col("content"), F.col("created_at"), F.col("type"), F.col("project"))
        rows = graph.kept(rows).join(m, "id").join(recall.asks.drop("embedding"), "query_id").where(keep).select("query_id", "id", "similarity", "rank")
    return superseded_last(rows, replaced).select("query_id", "id", F.round("similarity", 2).alias("similarity"), "superseded_by", "place")
