"""Normalisers and filters of articles and questions. Orders and events stand for dated articles, conversations for tagged texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import articles as A
from ..functions import dates as D
from ..functions import text as X
from ..operators import tokens as T
from .registry import query, read


def orders(spark, sf):
    o = read(spark, sf, "orders")
    return o.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"), "o_orderpriority", "o_orderstatus", "o_totalprice")


@query("p3_many_formats", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("d", "MMMM d, yyyy")).when(k == 2, F.concat(F.date_format("d", "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00"))).otherwise("soon")
    return orders(spark, sf).select("o_orderkey", F.date_format(A.parse_stamp(raw), "yyyy-MM-dd").alias("d"))


@query("p4_dates_in_words", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN strftime(o_orderdate, '%Y-%m') WHEN 4 THEN 'mid year' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders")
def _(spark, sf):
    k, f = F.col("o_orderkey") % 5, lambda p: F.date_format("d", p)
    raw = F.when(k == 0, F.concat(F.lit("on "), f("MMMM d, yyyy"), F.lit(" onwards"))).when(k == 1, F.concat(f("d"), F.lit("th "), f("MMM yyyy"))).when(k == 2, f("dd/MM/yyyy")).when(k == 3, f("MMMM yyyy")).otherwise(" mid year ")
    return orders(spark, sf).select("o_orderkey", A.normal_date(raw).alias("d"))


@query("p6_first_date", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def _(spark, sf):
    return orders(spark, sf).where("d >= TIMESTAMP '1996-01-01'").select("o_orderkey")


@query("p7_open_interval", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') > '1994-03-01' AND strftime(o_orderdate, '%Y-%m-%d') < '1996-02-01'")
def _(spark, sf):
    return orders(spark, sf).where(A.between_open(F.date_format("d", "yyyy-MM-dd"), "1994-03-01", "1996-02-01")).select("o_orderkey")


@query("p9_last_of_dates", "SELECT l_orderkey, l_linenumber, strftime(greatest(l_shipdate, o_orderdate), '%Y-%m-%d') AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, sf):
    l = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("s"))  # noqa: E741
    return l.join(orders(spark, sf), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.date_format(F.greatest("s", "d"), "yyyy-MM-dd").alias("d"))


@query(
    "p10_document_date",
    """WITH a AS (SELECT o_orderkey AS k, o_orderdate AS p, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL 3 DAY END AS m, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL 5 DAY END AS dl FROM orders)
    SELECT k, strftime(greatest(CASE WHEN k % 5 = 0 THEN p ELSE coalesce(dl, p) END, m), '%Y-%m-%d') AS d FROM a""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    m, dl = F.when(k % 3 != 0, F.expr("d + INTERVAL 3 DAYS")), F.when(k % 4 != 0, F.expr("d + INTERVAL 5 DAYS"))
    return orders(spark, sf).select(k.alias("k"), F.date_format(A.last_date(F.col("d"), m, dl, k % 5 == 0), "yyyy-MM-dd").alias("d"))


@query("p12_language_then_date", "SELECT doc_id FROM documents WHERE lang = 'en' AND source IS NOT NULL")
def _(spark, sf):
    return read(spark, sf, "documents").where("lang = 'en' AND source IS NOT NULL").select("doc_id")


@query("p13_years", "SELECT o_orderkey, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) IN (1995, 1993)")
def _(spark, sf):
    return orders(spark, sf).select("o_orderkey", F.year("d").alias("y")).where(F.col("y").isin(1995, 1993))


@query("p15_least_words", r"SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(coalesce(text, ''), '[\s\p{Z}]+'), lambda w: w <> '')) + len(list_filter(string_split_regex(coalesce(source, ''), '[\s\p{Z}]+'), lambda w: w <> '')) >= 120")
def _(spark, sf):
    return read(spark, sf, "documents").where(A.word_count(F.col("text"), F.col("source")) >= 120).select("doc_id")


@query("p17_numeric_answer_type", "SELECT p_partkey, regexp_matches(lower(p_type), 'num|date|steel') AS numeric FROM part")
def _(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.lower("p_type").rlike("num|date|steel").alias("numeric"))


@query("p19_valid_if_present", "SELECT doc_id FROM labels WHERE (quality IS NULL OR quality = 1) AND (toxic IS NULL OR toxic = 0)")
def _(spark, sf):
    return read(spark, sf, "labels").where(A.valid_if_present((F.col("quality"), F.col("quality") == 1), (F.col("toxic"), F.col("toxic") == 0))).select("doc_id")


@query("p20_relevance_gate", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(l.quality, 1) <> 0 AND coalesce(l.toxic, 0) <> 1")
def _(spark, sf):
    joined = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")
    return joined.where(A.is_relevant(F.col("quality"), F.lit(None).cast("int"), F.col("toxic"))).select("doc_id")


@query(
    "p21_components",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'tag ' || c_custkey::VARCHAR END AS title, c_mktsegment AS type FROM customer WHERE c_custkey % 7 <> 0""",
)
def _(spark, sf):
    k = F.col("c_custkey")
    c = read(spark, sf, "customer").withColumn("text", F.when(k % 7 != 0, F.concat(F.lit("<title> tag "), k.cast("string"), F.lit(" </title>"))))
    flat = {"title": F.when((k % 2 == 0) & (k % 7 != 0), F.col("c_name")).otherwise(" "), "type": F.col("c_mktsegment")}
    parts = A.components_of(flat, F.col("text"), {"title": "title", "type": "type"})
    return c.select(k, *[v.alias(n) for n, v in parts.items()]).where(A.components_present([F.col("title"), F.col("type")], 2))


@query("p22_standard_names", "SELECT doc_id AS article_id, source AS news_source, text AS article_maintext, lang AS language FROM documents")
def _(spark, sf):
    names = {"doc_id": "article_id", "source": "news_source", "text": "article_maintext", "lang": "language"}
    return read(spark, sf, "documents").withColumnsRenamed(names).select(*names.values())


@query("p23_fields", "SELECT s_suppkey, s_name AS name FROM supplier")
def _(spark, sf):
    return read(spark, sf, "supplier").drop("s_acctbal", "s_nationkey").withColumnRenamed("s_name", "name")


@query("p24_resolutions", "SELECT doc_id, CASE toxic WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS answer, coalesce(toxic, -1) AS back FROM labels")
def _(spark, sf):
    a = A.answer_of_resolution(F.col("toxic"))
    return read(spark, sf, "labels").select("doc_id", a.alias("answer"), A.resolution_of_answer(a).alias("back"))


@query("p25_assembled_text", "SELECT doc_id, md5(replace(concat_ws(chr(10), CASE WHEN trim(coalesce(lang, '')) <> '' THEN lang END, CASE WHEN trim(coalesce(text, ''), ' ') <> '' THEN text END), chr(10) || chr(10), chr(10))) AS hash FROM documents WHERE trim(coalesce(text, ''), ' ') <> ''")
def _(spark, sf):
    d = read(spark, sf, "documents").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return d.select("doc_id", F.md5(A.assembled(F.col("lang"), F.lit(" "), F.col("text")).cast("binary")).alias("hash"))


@query("p26_length_limits", "SELECT doc_id FROM documents WHERE length(text) + length(coalesce(source, '')) <= 2000 AND n_chars >= 100")
def _(spark, sf):
    return read(spark, sf, "documents").where((F.length("text") + F.length(F.coalesce("source", F.lit(""))) <= 2000) & (F.col("n_chars") >= 100)).select("doc_id")


@query("p28_shared_columns", "SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels")
def _(spark, sf):
    a, b = read(spark, sf, "documents"), read(spark, sf, "labels")
    shared = [c for c in a.columns if c in b.columns]
    return a.select(*shared).unionByName(b.select(*shared))


@query(
    "p30_binary_resolutions",
    """SELECT l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic IN (0, 1)
    AND strftime(DATE '2024-01-01' + (d.n_chars % 366)::INT, '%Y-%m-%d') >= '2024-02-01' AND strftime(DATE '2024-01-01' + (d.n_chars % 366)::INT, '%Y-%m-%d') < '2024-11-15'""",
)
def _(spark, sf):
    """Labels are 0 or 1 and their document's day is within the half-open range of strings. Documents have no date here: it is made from their length."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 366).cast("int")), "yyyy-MM-dd")
    docs = read(spark, sf, "documents").where((day >= "2024-02-01") & (day < "2024-11-15")).select("doc_id")
    return read(spark, sf, "labels").where(F.col("toxic").cast("string").isin("1", "1.0", "0", "0.0")).join(docs, "doc_id").select("doc_id")


@query("p31_gates_and_clamped_start", "SELECT l_orderkey, l_linenumber, strftime(least(o_orderdate::DATE, l_shipdate::DATE - 30), '%Y-%m-%d') AS start FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CASE WHEN l_linenumber <> 3 THEN l_returnflag = 'A' ELSE l_linestatus = 'O' END")
def _(spark, sf):
    l = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("s"))  # noqa: E741
    model = F.when(F.col("l_linenumber") != 3, F.col("l_returnflag") == "A")
    kept = l.where(F.coalesce(model, F.col("l_linestatus") == "O"))
    return kept.join(orders(spark, sf), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.date_format(A.start_before(F.to_date("d"), F.col("s"), 30), "yyyy-MM-dd").alias("start"))


@query("p32_least_dates", "SELECT l_orderkey, l_linenumber, strftime(least(l_shipdate, o_orderdate), '%Y-%m-%d') AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, sf):
    l = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("s"))  # noqa: E741
    return l.join(orders(spark, sf), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.date_format(F.least("s", "d", F.lit(None).cast("timestamp")), "yyyy-MM-dd").alias("d"))


@query("p33_cut_start_date", "SELECT o_orderkey, strftime(o_orderdate, '%d %B %Y') AS start, 'Known facts. . ' || o_orderpriority AS rest FROM orders")
def _(spark, sf):
    text = F.concat(F.lit("Known facts. Question Start Date: "), F.date_format("d", "dd MMMM yyyy"), F.lit(". "), "o_orderpriority")
    start, rest = A.cut_start_date(text)
    return orders(spark, sf).select("o_orderkey", start.alias("start"), rest.alias("rest"))


@query("p34_prompt_rows", "SELECT conv_id, turn, 'tagged_' || role AS data_source, length(text) AS chars FROM conversations WHERE length(text) > 0")
def _(spark, sf):
    c = read(spark, sf, "conversations").where(F.length("text") > 0)
    return c.select("conv_id", "turn", F.concat(F.lit("tagged_"), "role").alias("data_source"), F.length("text").cast("long").alias("chars"))


@query("p27_overlong_prompts", r"SELECT conv_id, turn FROM conversations WHERE len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) <= 40")
def _(spark, sf):
    return read(spark, sf, "conversations").where(F.size(X.words(F.col("text"))) <= 40).select("conv_id", "turn")


@query("p2_question_seconds", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE epoch(date_trunc('day', o_orderdate))::BIGINT END AS s FROM orders")
def _(spark, sf):
    raw = F.when(F.col("o_orderkey") % 3 == 0, " unknown ").otherwise(F.date_format("d", "yyyy-MM-dd"))
    return orders(spark, sf).select("o_orderkey", D.question_seconds(raw).alias("s"))


@query("p8_max_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') END AS d FROM orders")
def _(spark, sf):
    """Compared as strings; the date of publication is not looked at."""
    later = F.when(F.col("o_orderkey") % 2 != 0, F.date_format(F.expr("d + INTERVAL 9 DAYS"), "yyyy-MM-dd")).otherwise("")
    return orders(spark, sf).select("o_orderkey", D.latest_string(F.date_format("d", "yyyy-MM-dd"), later).alias("d"))


@query("p11_latest_date", "SELECT l_orderkey, l_linenumber, strftime(greatest(l_shipdate, o_orderdate), '%Y-%m-%d %H:%M:%S') AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, sf):
    l = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("s"))  # noqa: E741
    both = l.join(orders(spark, sf), "o_orderkey")
    return both.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", F.date_format(F.greatest("s", "d"), "yyyy-MM-dd HH:mm:ss").alias("d"))


#: Where the tokenizers are.
TOKENIZERS = "/opt/tokenizers"


def byte_tokens(name="byte_bpe_50k.json"):
    with open(f"{TOKENIZERS}/{name}", "rb") as f:
        return f.read()


@query("p27b_prompts_within_tokens")
def _(spark, sf):
    """Conversations whose messages, each behind its role, have at most 256 tokens in all. Tests hold it against whole texts tokenised one by one."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda t: t["line"])
    prompts = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(turns, "\n").alias("prompt"))
    return T.within_tokens(prompts, F.col("prompt"), byte_tokens(), 256)


@query("x20b_token_windows")
def _(spark, sf):
    """Every document in windows of 512 tokens that share 64. Tests hold it against whole texts tokenised one by one."""
    return T.token_windows(read(spark, sf, "documents"), "doc_id", "text", byte_tokens())
