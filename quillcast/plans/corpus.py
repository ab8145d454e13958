"""Selection, dedup, sampling and counts over documents and dated rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import ordering as O
from .registry import query, read


@query("t1_exact_dedup", "SELECT source, min(doc_id) AS doc_id, md5(coalesce(text, '')) AS hash FROM documents GROUP BY source, md5(coalesce(text, ''))")
def _(spark, sf):
    d = read(spark, sf, "documents").select("source", "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))
    return O.keep_first(d, ["source", "hash"], "doc_id")


@query(
    "flagship_dedup_share",
    """WITH d AS (SELECT DISTINCT ON (md5(coalesce(text, ''))) lang, source, text FROM documents ORDER BY md5(coalesce(text, '')), doc_id),
    k AS (SELECT lang, source FROM d WHERE len(list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) >= 50)
    SELECT lang, source, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY lang, source""",
)
def flagship(spark, sf):
    d = read(spark, sf, "documents")
    d = d.select("lang", "source", "doc_id", F.size(X.words(F.col("text"))).alias("words"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))
    kept = O.keep_first(d, ["hash"], "doc_id").where("words >= 50").groupBy("lang", "source").agg(F.count("*").alias("n"))
    # the window runs over one row for each language and source
    return kept.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query("a1_counts_by_grouping", "SELECT year(ts) AS y, month(ts) AS m, event_type, count(*) AS n FROM events GROUP BY GROUPING SETS ((year(ts)), (year(ts), month(ts)), (event_type), (event_type, year(ts), month(ts)))")
def _(spark, sf):
    e = read(spark, sf, "events").select(F.year("ts").alias("y"), F.month("ts").alias("m"), "event_type")
    return e.groupingSets([["y"], ["y", "m"], ["event_type"], ["event_type", "y", "m"]], "y", "m", "event_type").agg(F.count("*").alias("n"))


@query("a2_large_sources", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 60")
def _(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 60")


@query(
    "a3_delay_stats",
    """WITH d AS (SELECT l_returnflag, epoch(l_shipdate - o_orderdate) / 3600.0 AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_returnflag, round(avg(h), 6) AS mean, median(h) AS median, quantile_cont(h, 0.25) AS p25, quantile_cont(h, 0.75) AS p75, min(h) AS lo, max(h) AS hi FROM d GROUP BY 1""",
)
def _(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    d = read(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate").join(o, "l_orderkey")
    h = ((F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 3.6e9).alias("h")
    return d.select("l_returnflag", h).groupBy("l_returnflag").agg(
        F.round(F.avg("h"), 6).alias("mean"), F.expr("percentile(h, 0.5)").alias("median"), F.expr("percentile(h, 0.25)").alias("p25"),
        F.expr("percentile(h, 0.75)").alias("p75"), F.min("h").alias("lo"), F.max("h").alias("hi"),
    )


@query("a5_share_by_source", "SELECT source, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def _(spark, sf):
    g = read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))  # a row for each source


@query("a6_word_count_stats", """WITH w AS (SELECT lang, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS n FROM documents)
    SELECT lang, sum(n)::BIGINT AS total, min(n) AS lo, max(n) AS hi, round(avg(n), 6) AS mean, list_sort(list(n))[len(list(n)) // 2 + 1] AS upper_median FROM w GROUP BY lang""")
def _(spark, sf):
    w = read(spark, sf, "documents").select("lang", F.size(X.words(F.col("text"))).alias("n"))
    # percentile keeps a count for each distinct value, never the rows: the upper median is the value at rank floor(n / 2)
    g = w.groupBy("lang").agg(F.sum("n").alias("total"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.round(F.avg("n"), 6).alias("mean"), F.count("*").alias("rows"))
    counts = w.groupBy("lang", "n").agg(F.count("*").alias("k"))
    run = counts.withColumn("run", F.sum("k").over(W.partitionBy("lang").orderBy("n"))).join(g.select("lang", "rows"), "lang")
    upper = run.where(F.col("run") > F.floor(F.col("rows") / 2)).groupBy("lang").agg(F.min("n").alias("upper_median"))
    return g.join(upper, "lang").drop("rows")


@query("a15_probability_stats", "SELECT event_type, round(avg(value / 500), 6) AS mean, round(median(value / 500), 6) AS median, round(stddev_pop(value / 500), 6) AS std, round(min(value / 500), 6) AS lo, round(max(value / 500), 6) AS hi, count(*) AS n FROM events WHERE value / 500 BETWEEN 0 AND 1 GROUP BY event_type")
def _(spark, sf):
    e = read(spark, sf, "events").select("event_type", (F.col("value") / 500).alias("p")).where(F.col("p").between(0, 1))
    r = lambda c: F.round(c, 6)
    return e.groupBy("event_type").agg(r(F.avg("p")).alias("mean"), r(F.expr("percentile(p, 0.5)")).alias("median"), r(F.stddev_pop("p")).alias("std"), r(F.min("p")).alias("lo"), r(F.max("p")).alias("hi"), F.count("*").alias("n"))


@query("a20_distinct_sources", "SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").agg(F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"))


@query("p14_cutoff_filter", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-15' AND year(ts) IN (2023, 2024)")
def _(spark, sf):
    return read(spark, sf, "events").where((F.col("ts") < F.lit("2024-01-15").cast("timestamp")) & F.year("ts").isin(2023, 2024)).select("event_id")


@query("p5_strict_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE o_orderkey % 7 <> 0")
def _(spark, sf):
    k = F.col("o_orderkey")
    raw = F.when(k % 7 == 0, F.date_format("o_orderdate", "yyyy-M-d/")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = read(spark, sf, "orders").select(k, D.strict_date(raw).alias("d"))
    return o.where("d is not null").select("o_orderkey", F.date_format("d", "yyyy-MM-dd").alias("d"))


@query("p1_epoch_seconds", "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events")
def _(spark, sf):
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    raw = F.when(k == 0, F.unix_seconds(ts).cast("string")).when(k == 1, (F.unix_seconds(ts) * 1000).cast("string")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return read(spark, sf, "events").select("event_id", D.epoch_seconds(raw).alias("s"))


@query("p16_answer_type_filter", "SELECT p_partkey FROM part WHERE NOT regexp_matches(lower(p_type), 'any|steel|number') AND regexp_matches(lower(p_type), 'o')")
def _(spark, sf):
    t = F.lower("p_type")
    return read(spark, sf, "part").where(~t.rlike("any|steel|number") & t.rlike("o")).select("p_partkey")


@query(
    "p18_filter_funnel",
    """SELECT count(*) AS total, count(*) FILTER (v) AS dated, count(*) FILTER (v AND c) AS in_time, count(*) FILTER (v AND c AND t) AS kept
    FROM (SELECT o_orderkey % 11 <> 0 AS v, o_orderdate >= TIMESTAMP '1995-01-01' AS c, o_orderpriority NOT LIKE '%LOW%' AS t FROM orders)""",
)
def _(spark, sf):
    v, c, t = F.col("o_orderkey") % 11 != 0, F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp"), ~F.col("o_orderpriority").contains("LOW")
    n = lambda x: F.count_if(x)
    return read(spark, sf, "orders").agg(F.count("*").alias("total"), n(v).alias("dated"), n(v & c).alias("in_time"), n(v & c & t).alias("kept"))


@query("p29_row_index", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS idx FROM documents")
def _(spark, sf):
    return O.row_index(read(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id").select("doc_id", "idx")


@query("w1_keep_latest", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) = 1")
def _(spark, sf):
    return O.keep_latest(read(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("w5_chronological_split", "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM events")
def _(spark, sf):
    return O.chronological_split(read(spark, sf, "events").select("event_id", "ts"), "ts", "event_id", 0.8).select("event_id", "split")


@query("w6_round_robin", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('s' || doc_id::VARCHAR), doc_id) AS turn FROM documents) SELECT doc_id, source FROM (SELECT * FROM r ORDER BY turn, source LIMIT 70)")
def _(spark, sf):
    return O.round_robin(read(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 70).select("doc_id", "source")


@query("w7_hash_sample", "SELECT doc_id FROM documents ORDER BY md5('s' || doc_id::VARCHAR), doc_id LIMIT 100")
def _(spark, sf):
    return O.hash_sample(read(spark, sf, "documents").select("doc_id"), "doc_id", 100)


@query("u4_repeat_interleaved", "SELECT r_regionkey, i FROM region, range(1, 4) t(i)")
def _(spark, sf):
    return read(spark, sf, "region").select("r_regionkey", F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<long>")).alias("i"))


@query("u5_repeat_by_count", "SELECT s_suppkey, unnest(range(s_suppkey % 4)) AS i FROM supplier")
def _(spark, sf):
    n = (F.col("s_suppkey") % 4).cast("int")
    return read(spark, sf, "supplier").where(n > 0).select("s_suppkey", F.explode(F.sequence(F.lit(0), n - 1).cast("array<long>")).alias("i"))


@query("u12_components_to_rows", "SELECT c_custkey, unnest(['name', 'segment']) AS field, unnest([c_name, c_mktsegment]) AS value FROM customer")
def _(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.expr("stack(2, 'name', c_name, 'segment', c_mktsegment) AS (field, value)"))


@query("u15_mini_batches", "SELECT idx // 64 AS batch, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents) GROUP BY 1")
def _(spark, sf):
    d = O.row_index(read(spark, sf, "documents").select("doc_id"), "doc_id")
    return d.groupBy(F.floor(F.col("idx") / 64).alias("batch")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("t4_leakage", "SELECT doc_id FROM documents WHERE contains(lower(text), lower(trim(lang))) OR contains(lower(source), lower(trim(lang)))")
def _(spark, sf):
    return read(spark, sf, "documents").where(X.leaks(F.col("lang"), F.col("text"), F.col("source"))).select("doc_id")


@query("x1_last_tag", "SELECT p_partkey, trim(p_name) AS got, '' AS none FROM part")
def _(spark, sf):
    t = F.concat(F.lit("<answer>old</answer> <answer> "), "p_name", F.lit(" </answer></answer>"))
    return read(spark, sf, "part").select("p_partkey", X.last_tag(t, "answer").alias("got"), X.last_tag(t, "title").alias("none"))


@query("x2_answer_and_probability", "SELECT p_partkey, trim(p_brand) AS answer, (p_size / 100.0)::DOUBLE AS p, NULL::DOUBLE AS bad FROM part")
def _(spark, sf):
    p = (F.col("p_size") / 100).cast("string")
    t = F.concat(F.lit("<answer>thought</answer></think><answer>x</answer><answer> "), "p_brand", F.lit(" </answer><probability> "), p, F.lit("</probability>"))
    return read(spark, sf, "part").select("p_partkey", X.answer_of(t).alias("answer"), X.probability_of(t).alias("p"), X.probability_of(F.lit("<probability>high</probability>")).alias("bad"))


@query("x6_last_verdict", "SELECT event_id, nullif(regexp_extract(event_id::VARCHAR, '.*([01])', 1), '')::INT AS v FROM events")
def _(spark, sf):
    return read(spark, sf, "events").select("event_id", X.verdict(F.col("event_id").cast("string")).alias("v"))


@query("x15_normal_answers", r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ', the A. ' || p_type), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS a FROM part""")
def _(spark, sf):
    return read(spark, sf, "part").select("p_partkey", X.normal_answer(F.concat("p_name", F.lit(", the A. "), "p_type")).alias("a"))


@query("x16_last_number", "SELECT p_partkey, p_size::VARCHAR AS n FROM part")
def _(spark, sf):
    return read(spark, sf, "part").select("p_partkey", X.last_number(F.concat(F.lit("first 1,000 then "), F.col("p_size").cast("string"))).alias("n"))


@query(
    "x20_word_windows",
    """WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS n FROM documents)
    SELECT doc_id, CASE WHEN n <= 512 THEN 1 ELSE ceil((n - 512) / 448.0)::INT + 1 END AS chunks FROM w""",
)
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(X.word_windows(F.coalesce("text", F.lit("")))).alias("chunks"))


@query("f17_pages_by_domain", r"SELECT regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)', 1), '^www\.', '') AS domain, count(*) AS n FROM pages GROUP BY 1")
def _(spark, sf):
    return read(spark, sf, "pages").groupBy(X.domain_of(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query("s1_json_properties", "SELECT event_id, json_valid(props) AS valid FROM events")
def _(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").isNotNull().alias("valid"))
