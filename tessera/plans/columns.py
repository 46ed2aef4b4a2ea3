"""Scalar functions and the plain joins, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import dates as D
from tessera.functions import scoring as S
from tessera.functions import values as V
from tessera.sources.tables import SQL_MEMORIES, SQL_USAGE, memories, messages, table, usage_events


@query("fn_parse_epoch", "select event_id, epoch_us(ts) / 1e6::double as exact, floor(epoch_us(ts) / 1e6)::double as whole, null::double as bad from events")
def fn_parse_epoch(spark, sf_dir):
    """ISO texts of both precisions, and one that is none."""
    e = table(spark, sf_dir, "events")
    exact, whole = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select("event_id", D.parsed_epoch(exact).alias("exact"), D.parsed_epoch(whole).alias("whole"), D.parsed_epoch(F.concat(F.lit("x"), exact)).alias("bad"))


@query("fn_month_status", "select o_orderkey, case when o_orderdate::date between date '1998-02-01' and date '1998-02-28' then 'must' when o_orderdate::date between date '1998-01-29' and date '1998-03-03' then 'possible' else 'outside' end as status from orders")
def fn_month_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", D.month_status(F.to_date("o_orderdate"), 1998, 2, 3).alias("status"))


@query("fn_money_and_durations", "select l_orderkey, l_linenumber, l_partkey, l_extendedprice as usd, (l_linenumber * case l_linenumber % 4 when 0 then 1 when 1 then 7 when 2 then 30 else 365 end)::double as days from lineitem")
def fn_money(spark, sf_dir):
    """Amounts and durations written out and read back."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    unit = F.element_at(F.array(*map(F.lit, ("days", "weeks", "months", "years"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    told = F.concat(F.lit("paid $"), F.format_number("l_extendedprice", 2), F.lit(" over "), F.col("l_linenumber"), F.lit(" "), unit)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", V.usd(told).alias("usd"), V.duration_days(told).alias("days"))


@query("fn_whole_token", "select doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_.%])(the)([^a-z0-9_.%]|$)') as has_the from documents")
def fn_whole_token(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.whole_token(F.col("text"), "the").alias("has_the"))


@query("fn_head_tail", "select conv_id, turn, case when length(text) <= 60 then text else substr(text, 1, 40) || ' ... ' || substr(text, length(text) - 19, 20) end as short from conversations")
def fn_head_tail(spark, sf_dir):
    return messages(spark, sf_dir).select(F.col("session_id").alias("conv_id"), F.col("message_index").alias("turn"), V.head_tail(F.col("text"), 40, 20).alias("short"))


@query("fn_marked_block", "select page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) as title from pages where regexp_matches(html, '(?s)<title>.*?</title>')")
def fn_marked_block(spark, sf_dir):
    """Block marks set around the title and read back."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    marked = F.concat(F.lit("x <!-- begin t -->"), title, F.lit("<!-- end t --> y"))
    return table(spark, sf_dir, "pages").where(F.col("html").rlike("(?s)<title>.*?</title>")).select("page_id", V.marked_block(marked, "t").alias("title"))


@query("fn_first_json", "select event_id, (props->>'k')::int as k from events")
def fn_first_json(spark, sf_dir):
    told = F.concat(F.lit("the answer is "), "props", F.lit(" as asked {\"k\": 0}"))
    return table(spark, sf_dir, "events").select("event_id", V.first_json(told, "k int")["k"].alias("k"))


@query("fn_age_text", "select o_orderkey, case when d < 1 then 'today' when d < 2 then 'yesterday' when d < 7 then floor(d)::int || ' days ago' when d < 60 then floor(d / 7)::int || ' weeks ago' else floor(d / 30)::int || ' months ago' end as age from (select o_orderkey, date_diff('day', o_orderdate::date, date '2002-01-01')::double as d from orders)")
def fn_age_text(spark, sf_dir):
    days = F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", V.age_text(days).alias("age"))


@query("fn_decay_and_trust", f"with {SQL_USAGE} select event_id, round(pow(0.5, (value / 10) / 30), 6) as decay, round(1 - exp(-value / 5), 6) as reinforced, least(pow(2.0, (event_id % 20)::double), 3600.0) as wait from ev")
def fn_decay(spark, sf_dir):
    e = usage_events(spark, sf_dir)
    return e.select("event_id", F.round(S.decay(F.col("value") / 10), 6).alias("decay"), F.round(S.reinforcement(F.col("value")), 6).alias("reinforced"), V.backoff((F.col("event_id") % 20).cast("double")).alias("wait"))


@query("fn_vector_functions", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) as total from embeddings")
def fn_vector(spark, sf_dir):
    from tessera.operators.vector import norm

    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("fn_cache_keys", "select sha256('v1|' || lower(trim(event_type)) || '|' || props) as key, count(*)::bigint as n from events group by 1")
def fn_cache_keys(spark, sf_dir):
    """Keys of a recall cache: equal requests share one."""
    key = F.sha2(F.concat_ws("|", F.lit("v1"), F.lower(F.trim("event_type")), "props"), 256)
    return table(spark, sf_dir, "events").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("sc5_replace_by_transcript", "with fresh as (select conv_id, turn, upper(role) as role from conversations where conv_id in (select item_id from benchmark)) select conv_id, turn, role from conversations where conv_id not in (select conv_id from fresh) union all select * from fresh")
def sc5(spark, sf_dir):
    """A transcript's new rows replace all its former ones; the sink overwrites its partition likewise."""
    old = messages(spark, sf_dir).select(F.col("session_id").alias("conv_id"), F.col("message_index").alias("turn"), "role")
    new = old.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("conv_id")).distinct(), "conv_id", "left_semi").withColumn("role", F.upper("role"))
    return old.join(new.select("conv_id").distinct(), "conv_id", "left_anti").unionByName(new)


@query("sc12_results_log", "select event_id as run, (props->>'k')::int as score from events where event_id % 7 <> 0")
def sc12(spark, sf_dir):
    """JSON lines, some of them broken: those are dropped."""
    line = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"run": '), "event_id", F.lit(", "), F.substring("props", F.lit(2), F.length("props") - 1)))
    parsed = F.from_json(line, "run long, k int")
    return table(spark, sf_dir, "events").select(parsed.alias("p")).where("p.run is not null").select("p.run", F.col("p.k").alias("score"))


@query("j1_lookup_join", f"with {SQL_MEMORIES}, {SQL_USAGE} select m.id, m.type, count(*)::bigint as n from mem m join ev on ev.memory_id = m.id group by all")
def j1(spark, sf_dir):
    """Counted by memory first, so that the join sees one row a memory."""
    n = usage_events(spark, sf_dir).groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n"))
    return memories(spark, sf_dir).select("id", "type").join(n, "id")


@query("j2_left_default", f"with {SQL_MEMORIES}, {SQL_USAGE}, u as (select memory_id, count(*) filter (kind = 'use') as uses from ev group by 1) select id, coalesce(uses, 0)::bigint as uses, case when uses is null then 1.0 else least(1.0, uses / 20.0) end::double as strength from mem left join u on memory_id = id")
def j2(spark, sf_dir):
    u = usage_events(spark, sf_dir).groupBy(F.col("memory_id").alias("id")).agg(F.count_if(F.col("kind") == "use").alias("uses"))
    return memories(spark, sf_dir).select("id").join(u, "id", "left").select("id", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce(F.least(F.lit(1.0), F.col("uses") / 20), F.lit(1.0)).alias("strength"))


@query("j3_anti_join", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def j3(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j4_semi_join", "select p_partkey, p_brand from part where p_partkey in (select l_partkey from lineitem where l_discount > 0.09)")
def j4(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@query("j5_index_join", "with t as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{10,}')) as term from documents), q as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]{10,}')) as term from benchmark) select d.doc_id, d.lang, count(*)::bigint as terms from t join q using (term) join documents d using (doc_id) group by all")
def j5(spark, sf_dir):
    """Index hits joined back to their rows."""
    words = lambda: F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{10,}"), F.lit(0)))).alias("term")
    q = table(spark, sf_dir, "benchmark").select(words()).distinct()
    hits = table(spark, sf_dir, "documents").select("doc_id", words()).join(q, "term", "left_semi").groupBy("doc_id").agg(F.count("*").alias("terms"))
    return hits.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "terms")


@query("j14_relevance_join", "select b.item_id as case_id, d.doc_id, l.quality from benchmark b join documents d on d.doc_id // 5 = b.item_id join labels l on l.doc_id = d.doc_id")
def j14(spark, sf_dir):
    """Cases, their candidates and the judgements."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 5").alias("item_id"))
    return table(spark, sf_dir, "benchmark").select("item_id").join(d, "item_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select(F.col("item_id").alias("case_id"), "doc_id", "quality")


@query("a17_envelope_labels", "with b as (select l_suppkey as grp, case when l_returnflag = 'R' then 'Excluded' when l_linestatus = 'F' then 'In' else 'Possible' end as tag, p_brand as label, l_quantity as v from lineitem join part on l_partkey = p_partkey) select grp, list_sort(list_distinct(list(label) filter (tag = 'In'))) as certain_labels, count(distinct label) filter (tag <> 'Excluded')::bigint as possible_labels, count(*) filter (tag = 'In')::bigint as certain_instances, max(v) filter (tag = 'In') as stated_total from b group by grp having count(*) filter (tag = 'In') > 0")
def a17l(spark, sf_dir):
    """Label sets, instance counts and the largest stated total of each envelope."""
    tag = F.when(F.col("l_returnflag") == "R", "Excluded").when(F.col("l_linestatus") == "F", "In").otherwise("Possible")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("label"))
    b = table(spark, sf_dir, "lineitem").join(p, "l_partkey").select(F.col("l_suppkey").alias("grp"), tag.alias("tag"), "label", F.col("l_quantity").alias("v"))
    sure = F.col("tag") == "In"
    out = b.groupBy("grp").agg(F.sort_array(F.collect_set(F.when(sure, F.col("label")))).alias("certain_labels"), F.countDistinct(F.when(F.col("tag") != "Excluded", F.col("label"))).alias("possible_labels"), F.count_if(sure).alias("certain_instances"), F.max(F.when(sure, F.col("v"))).alias("stated_total"))
    return out.where("certain_instances > 0")


@query("a17_sum_value")
def a17v(spark, sf_dir):
    """Values retold in overlapping words count once; the order decides, so tests hold it against a plain loop."""
    from tessera.operators.uncertain import distinct_value_sums

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.split("p_name", " ").alias("words"))
    rows = table(spark, sf_dir, "lineitem").join(p, "l_partkey").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("at"), "l_quantity", "l_returnflag", "words")
    return distinct_value_sums(rows, "l_suppkey", "at", "l_quantity", "l_returnflag", "words")


@query("a20_brand_sets", "select p_brand, count(*) filter (p_type in ('ECONOMY', 'SMALL'))::bigint as lower, count(*) filter (p_type in ('ECONOMY', 'SMALL', 'STANDARD') or p_size < 10)::bigint as upper from part group by 1")
def a20s(spark, sf_dir):
    """A strict and a lenient reading of a set question: the bounds of its answer."""
    strict = F.col("p_type").isin("ECONOMY", "SMALL")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(strict).alias("lower"), F.count_if(strict | (F.col("p_type") == "STANDARD") | (F.col("p_size") < 10)).alias("upper"))


@query("g14_pair_votes", "with v as (select least(l_partkey, l_suppkey) || ':' || greatest(l_partkey, l_suppkey) as r_key, l_linenumber % 3 as vote, l_orderkey * 10 + l_linenumber as seq from lineitem) select r_key, arg_max(vote, struct_pack(s := seq, v := vote)) as verdict from v where vote in (0, 1) group by 1")
def g14v(spark, sf_dir):
    """Votes on pairs of edges: only 0 and 1 are votes, the last one of a pair counts."""
    key = F.concat_ws(":", F.least("l_partkey", "l_suppkey"), F.greatest("l_partkey", "l_suppkey"))
    v = table(spark, sf_dir, "lineitem").select(key.alias("r_key"), (F.col("l_linenumber") % 3).alias("vote"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return v.where("vote in (0, 1)").groupBy("r_key").agg(F.max_by("vote", F.struct("seq", "vote")).alias("verdict"))


@query("fn_map_arguments", "select event_id, event_type as predicate, user_id::varchar as entity, coalesce(json_extract_string(props, '$.k'), 'none') as argument, 2::int as n_keys from events")
def fn_map(spark, sf_dir):
    """A fact's arguments as a map: its keys looked up by name, a missing one by a default."""
    args = F.create_map(F.lit("entity"), F.col("user_id").cast("string"), F.lit("value"), F.get_json_object("props", "$.k"))
    e = table(spark, sf_dir, "events").select("event_id", "event_type", args.alias("args"))
    return e.select("event_id", F.col("event_type").alias("predicate"), F.try_element_at("args", F.lit("entity")).alias("entity"), F.coalesce(F.try_element_at("args", F.lit("value")), F.lit("none")).alias("argument"), F.size(F.map_keys("args")).alias("n_keys"))
