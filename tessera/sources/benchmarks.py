"""Benchmark files as tables: a corpus (dataset, id, content, session) and cases with their gold.

Each reader takes JSON in a benchmark's own layout and gives ``(corpus, cases)``; cases are
(dataset, id, query, relevant_ids, intent, answer). Gold that no corpus row resolves is left
out, and so are cases without any. Texts carry the speaker and the session's date in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# LoCoMo's category codes, and the type of HaluMem's questions that memory cannot answer.
LOCOMO_CATEGORIES = {1: "multi-hop", 2: "single-hop", 3: "open-domain", 4: "single-hop-factual", 5: "adversarial"}
BOUNDARY = "Memory Boundary"


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)


def _told(date: Column, speaker: Column, text: Column) -> Column:
    """``[date] speaker: text``, without what is missing."""
    some = lambda c, out: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", out).otherwise("")
    return F.concat(some(date, F.concat(F.lit("["), F.trim(date), F.lit("] "))), some(speaker, F.concat(speaker, F.lit(": "))), F.trim(text))


def _resolved(cases: DataFrame, corpus: DataFrame) -> DataFrame:
    """Cases (dataset, id, query, gold, intent, answer) with the gold that the dataset's corpus has, in its order."""
    gold = cases.select("dataset", F.col("id").alias("case"), F.posexplode("gold").alias("pos", "id")).join(corpus.select("dataset", "id").distinct(), ["dataset", "id"])
    gold = gold.groupBy("dataset", F.col("case").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("relevant_ids"))
    return cases.join(gold, ["dataset", "id"]).select("dataset", "id", "query", "relevant_ids", "intent", "answer")


def locomo(spark: SparkSession, path: str, include_adversarial: bool = True) -> tuple[DataFrame, DataFrame]:
    """Conversations in numbered sessions; a question's evidence are ids of turns."""
    raw = _json(spark, path, "sample_id string, conversation map<string,string>, qa array<struct<question string, answer string, evidence array<string>, category int>>")
    turns = raw.select(F.col("sample_id").alias("dataset"), "conversation", F.explode("conversation").alias("session", "told")).where(F.col("session").rlike(r"^session_\d+$"))
    turns = turns.withColumn("date", F.try_element_at("conversation", F.concat("session", F.lit("_date_time"))))
    turns = turns.select("dataset", "session", "date", F.explode(F.from_json("told", "array<struct<dia_id string, text string, speaker string>>")).alias("t"))
    turns = turns.where("t.dia_id is not null and trim(t.text) <> ''")
    corpus = turns.select("dataset", F.col("t.dia_id").alias("id"), _told(F.col("date"), F.col("t.speaker"), F.col("t.text")).alias("content"), "session")
    qa = raw.select(F.col("sample_id").alias("dataset"), F.posexplode("qa").alias("i", "q"))
    qa = qa if include_adversarial else qa.where("q.category is null or q.category <> 5")
    names = F.create_map(*[F.lit(x) for pair in LOCOMO_CATEGORIES.items() for x in pair])
    intent = F.coalesce(F.try_element_at(names, "q.category"), F.coalesce("q.category", F.lit(0)).cast("string"))
    cases = qa.select("dataset", F.concat("dataset", F.lit("_q"), "i").alias("id"), F.col("q.question").alias("query"), F.col("q.evidence").alias("gold"), intent.alias("intent"), F.coalesce("q.answer", F.lit("")).alias("answer"))
    return corpus, _resolved(cases, corpus)


def longmemeval(spark: SparkSession, path: str, include_abstention: bool = False) -> tuple[DataFrame, DataFrame]:
    """A haystack of sessions for each question; turns marked as holding the answer are its gold."""
    raw = _json(spark, path, "question_id string, question string, question_type string, answer string, question_date string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role string, content string, has_answer boolean>>>")
    raw = raw.withColumnRenamed("question_id", "dataset")
    raw = raw if include_abstention else raw.where(~F.endswith("dataset", F.lit("_abs")))
    sessions = raw.select("dataset", F.explode(F.arrays_zip(F.col("haystack_session_ids").alias("sid"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))).alias("s")).where("s.sid is not null")
    turns = sessions.select("dataset", F.col("s.sid").alias("session"), F.col("s.date").alias("date"), F.posexplode("s.turns").alias("i", "t")).where("trim(t.content) <> ''")
    turns = turns.select("dataset", F.concat("session", F.lit("#"), "i").alias("id"), _told(F.col("date"), F.col("t.role"), F.col("t.content")).alias("content"), "session", "i", F.coalesce("t.has_answer", F.lit(False)).alias("gold"))
    gold = turns.where("gold").groupBy("dataset").agg(F.transform(F.array_sort(F.collect_list(F.struct("session", "i", "id"))), lambda x: x["id"]).alias("relevant_ids"))
    cases = raw.join(gold, "dataset").select("dataset", F.col("dataset").alias("id"), F.col("question").alias("query"), "relevant_ids", F.coalesce("question_type", F.lit("")).alias("intent"), F.coalesce("answer", F.lit("")).alias("answer"))
    return turns.select("dataset", "id", "content", "session"), cases


def hotpotqa(spark: SparkSession, path: str, pooled: bool = False) -> tuple[DataFrame, DataFrame]:
    """Paragraphs by title for each question; ``pooled``: one corpus of all questions, each title once."""
    raw = _json(spark, path, "_id string, question string, type string, answer string, context array<array<string>>, supporting_facts array<array<string>>").withColumnRenamed("_id", "dataset")
    parts = raw.select("dataset", F.posexplode("context").alias("i", "c")).where("size(c) > 0 and c[0] is not null")
    sentences = F.filter(F.transform(F.coalesce(F.from_json(F.get("c", F.lit(1)), "array<string>"), F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "")
    body = F.array_join(sentences, " ")
    rows = parts.select("dataset", "i", F.col("c")[0].alias("id"), F.when(body != "", F.concat(F.col("c")[0], F.lit(". "), body)).otherwise(F.col("c")[0]).alias("content"))
    corpus = rows.groupBy("dataset", "id").agg(F.min_by("content", "i").alias("content")).withColumn("session", F.lit(""))
    gold = F.array_distinct(F.transform(F.filter("supporting_facts", lambda s: F.size(s) > 0), lambda s: s[0]))
    cases = raw.select("dataset", F.col("dataset").alias("id"), F.col("question").alias("query"), gold.alias("gold"), F.coalesce("type", F.lit("")).alias("intent"), F.coalesce("answer", F.lit("")).alias("answer"))
    cases = _resolved(cases, corpus)
    if pooled:
        name = F.lit("hotpotqa-pooled")
        corpus = corpus.join(cases.select("dataset"), "dataset", "left_semi").groupBy("id").agg(F.min_by("content", "dataset").alias("content")).select(name.alias("dataset"), "id", "content", F.lit("").alias("session"))
        cases = cases.withColumn("dataset", name)
    return corpus, cases


def halumem(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A user a line: memory points are the corpus, a question's evidence names their contents; questions without any are boundary cases with empty gold."""
    point = "struct<memory_content string, memory_type string>"
    raw = _json(spark, path, f"uuid string, sessions array<struct<start_time string, memory_points array<{point}>, questions array<struct<question string, answer string, evidence array<struct<memory_content string>>, question_type string>>>>", lines=True)
    s = raw.select(F.col("uuid").alias("dataset"), F.posexplode("sessions").alias("n", "s"))
    points = s.select("dataset", F.concat(F.lit("s"), "n").alias("session"), F.posexplode("s.memory_points").alias("i", "p"))
    corpus = points.select("dataset", F.concat("session", F.lit("_"), "i").alias("id"), F.col("p.memory_content").alias("content"), "session")
    q = s.select("dataset", "n", F.posexplode("s.questions").alias("i", "q"))
    key = F.concat("dataset", F.lit("_"), "n", F.lit("_"), "i")
    told = q.select("dataset", key.alias("case"), F.explode("q.evidence").alias("e")).select("dataset", "case", F.col("e.memory_content").alias("content")).where("content <> ''").distinct()
    gold = told.join(corpus.select("dataset", "id", "content"), ["dataset", "content"]).groupBy("dataset", F.col("case").alias("id")).agg(F.array_sort(F.collect_set("id")).alias("relevant_ids"))
    empty = F.array().cast("array<string>")
    cases = q.select("dataset", key.alias("id"), F.col("q.question").alias("query"), F.when((F.coalesce("q.question_type", F.lit("")) == BOUNDARY) | (F.size(F.coalesce("q.evidence", F.array())) == 0), BOUNDARY).otherwise(F.col("q.question_type")).alias("intent"), F.coalesce("q.answer", F.lit("")).alias("answer"))
    return corpus, cases.join(gold, ["dataset", "id"], "left").select("dataset", "id", "query", F.coalesce("relevant_ids", empty).alias("relevant_ids"), "intent", "answer")


def subtlememory(spark: SparkSession, history: str, instances: str, persona: str) -> tuple[DataFrame, DataFrame]:
    """A persona's sessions and questions; a question's gold is every turn of its sessions."""
    h = _json(spark, history, "session_id string, timestamp string, history array<struct<role string, content string>>")
    turns = h.select("session_id", "timestamp", F.posexplode("history").alias("i", "t")).where("trim(t.content) <> ''")
    corpus = turns.select(F.lit(persona).alias("dataset"), F.concat("session_id", F.lit("_"), "i").alias("id"), _told(F.col("timestamp"), F.col("t.role"), F.col("t.content")).alias("content"), F.col("session_id").alias("session"), "i")
    b = _json(spark, instances, "instance_id string, session_ids array<string>, relation_type string, qas array<struct<query string, gold string>>")
    asked = b.select("instance_id", F.posexplode("session_ids").alias("p", "session"))
    gold = asked.join(corpus, "session").groupBy("instance_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "i", "id"))), lambda x: x["id"]).alias("relevant_ids"))
    q = b.join(gold, "instance_id").select("instance_id", "relation_type", "relevant_ids", F.posexplode("qas").alias("i", "q")).where("trim(q.query) <> ''")
    cases = q.select(F.lit(persona).alias("dataset"), F.concat(F.lit(persona + "_"), "instance_id", F.lit("_"), "i").alias("id"), F.col("q.query").alias("query"), "relevant_ids", F.col("relation_type").alias("intent"), F.coalesce("q.gold", F.lit("")).alias("answer"))
    return corpus.drop("i"), cases
