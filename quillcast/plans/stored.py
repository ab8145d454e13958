"""Sources, sinks and streaming forms, each as a round trip through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import sources as IO
from .. import streaming as ST
from ..operators.ordering import shared_folder
from .forecasts import BM25_SQL
from .registry import query, read


def path_for(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


LINE = "doc_id bigint, text string, source string"


@query("s2_strict_json_lines", "SELECT item_id, text, md5(text) AS hash FROM benchmark")
def _(spark, sf):
    path = path_for(spark, "strict")
    b = read(spark, sf, "benchmark")
    lines = b.select(F.to_json(F.struct("item_id", "text")).alias("value"))
    lines.unionByName(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(path)
    return IO.read_json_lines_strict(spark, path, "item_id bigint, text string", {"hash": F.md5(F.col("text").cast("binary"))})


@query("s3_json_lines_folders", "SELECT source AS folder, doc_id FROM documents WHERE source IS NOT NULL")
def _(spark, sf):
    path = path_for(spark, "folders")
    d = read(spark, sf, "documents").select("doc_id", "text", "source").where("source IS NOT NULL")
    IO.write_json_lines(d.withColumn("folder", F.col("source")), path, "folder")
    back = IO.read_json_lines(spark, path, LINE, recursive=True, file_column="file")
    return back.select(F.url_decode(F.regexp_extract("file", "folder=([^/]+)/", 1)).alias("folder"), "doc_id")


@query("s4_json_document", "SELECT n_nationkey::VARCHAR AS key, n_name FROM nation")
def _(spark, sf):
    path = path_for(spark, "document")
    n = read(spark, sf, "nation")  # one object holds the whole table: 25 rows
    entry = F.struct(F.col("n_nationkey").cast("string"), F.struct("n_name"))
    n.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.text(path)
    return IO.read_json_document(spark, path, "n_name string")


@query("s6_concat_files", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(spark, sf):
    one = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return one.unionByName(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("s8_warc_records", "SELECT page_id, url, md5(coalesce(html, '')) AS hash FROM pages")
def _(spark, sf):
    """All pages written as compressed records and read back, by ranges that begin within them."""
    path = path_for(spark, "warc")
    p = read(spark, sf, "pages")
    made = p.select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("uri"), F.lit("2024-05-01T00:00:00Z").alias("date"), F.col("html").cast("binary").alias("payload"))
    IO.write_warc(made, path)
    return IO.read_warc(spark, path, split=1 << 20).select(F.col("id").cast("long").alias("page_id"), F.col("uri").alias("url"), F.md5("payload").alias("hash"))


@query("s9_json_lines_sink", "SELECT doc_id, md5(coalesce(text, '')) AS hash, source FROM documents")
def _(spark, sf):
    path = path_for(spark, "lines")
    IO.write_json_lines(read(spark, sf, "documents").select("doc_id", "text", "source"), path)
    return IO.read_json_lines(spark, path, LINE).select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"), "source")


@query("s10_json_lines_append", "SELECT source, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT source FROM documents) GROUP BY source")
def _(spark, sf):
    path = path_for(spark, "append")
    d = read(spark, sf, "documents").select("doc_id", "text", "source")
    IO.write_json_lines(d, path)
    IO.append_json_lines(d, path)
    return IO.read_json_lines(spark, path, LINE).groupBy("source").agg(F.count("*").alias("n"))


@query("s11_nested_parquet", "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def _(spark, sf):
    path = path_for(spark, "nested")
    c = read(spark, sf, "conversations")
    prompt = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    c.groupBy("conv_id").agg(prompt.alias("prompt")).write.parquet(path)
    back = spark.read.parquet(path)
    return back.select("conv_id", F.size("prompt").cast("long").alias("n"), F.array_join(F.transform("prompt", lambda m: m["role"]), ",").alias("roles"))


@query(
    "s12_upsert",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders
    UNION ALL SELECT -1 - o_orderkey, 'new' FROM orders WHERE o_orderkey % 5 = 0""",
)
def _(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(0).alias("seq"))
    hit = o.where("o_orderkey % 5 = 0").withColumn("status", F.lit("new"))
    changes = hit.withColumn("seq", F.lit(2)).unionByName(hit.withColumn("status", F.lit("stale")).withColumn("seq", F.lit(1)))
    changes = changes.unionByName(hit.withColumn("o_orderkey", -1 - F.col("o_orderkey")).withColumn("seq", F.lit(2)))
    return IO.upsert(o, changes, "o_orderkey", "seq").drop("seq")


@query(
    "s12b_bucket_upsert",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders
    UNION ALL SELECT -1 - o_orderkey, 'new' FROM orders WHERE o_orderkey % 5 = 0""",
)
def _(spark, sf):
    """The same changes to a stored table, in two batches, one of them run again; only touched buckets are rewritten."""
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    table = IO.BucketTable(spark, path_for(spark, "buckets"), o.schema, "o_orderkey", buckets=16)
    table.upsert(o, batch=0)
    hit = o.where("o_orderkey % 5 = 0").withColumn("status", F.lit("new"))
    changes = hit.withColumn("seq", F.lit(2)).unionByName(hit.withColumn("status", F.lit("stale")).withColumn("seq", F.lit(1)))
    changes = changes.unionByName(hit.withColumn("o_orderkey", -1 - F.col("o_orderkey")).withColumn("seq", F.lit(2)))
    for _ in range(2):
        table.upsert(changes, "seq", batch=1)
    return table.rows()


_H = "('0x' || substr(md5(doc_id::VARCHAR), {}, 8))::BIGINT"
_SHARD = "0"
for _at in (1, 9, 17, 25):
    _SHARD = f"(({_SHARD} * 4294967296 + {_H.format(_at)}) % 12)"


@query("s13_shards", f"SELECT doc_id, {_SHARD}::INT AS shard FROM documents")
def _(spark, sf):
    path = path_for(spark, "shards")
    IO.write_shards(read(spark, sf, "documents").select("doc_id", "text"), path, "doc_id", 12)
    return spark.read.parquet(path).select("doc_id", F.col("shard").cast("int").alias("shard"))


WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"


@query("s14_term_index", f"WITH t AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents) SELECT term, doc_id, count(*) AS tf FROM t GROUP BY 1, 2")
def _(spark, sf):
    return IO.index_terms(read(spark, sf, "documents"), "doc_id", "text")


CHANGED = """(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(text, ' of the third edition') ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 5 = 0
UNION ALL SELECT -1 - doc_id, text FROM documents WHERE doc_id % 3 = 0)"""


def changed_index(spark, sf):
    """The full-text index of all documents after deletes, replacements, a merge and additions."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    index = IO.TextIndex(spark, path_for(spark, "index"))
    index.insert(docs)
    index.delete(docs.where("id % 7 = 0"))
    index.insert(docs.where("id % 5 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" of the third edition"))))
    index.merge()
    index.insert(docs.where("id % 3 = 0").withColumn("id", -1 - F.col("id")))
    return index, read(spark, sf, "benchmark").select(F.col("item_id").alias("q"), "text")


@query("s14b_all_words", f"WITH d AS (SELECT doc_id AS id, {WORDS} AS w FROM {CHANGED}), q AS (SELECT item_id AS q, {WORDS} AS w FROM benchmark) SELECT q, id FROM q JOIN d ON list_has_all(d.w, q.w) WHERE len(q.w) > 0")
def _(spark, sf):
    index, asked = changed_index(spark, sf)
    return index.all_of(asked)


@query(
    "s14c_phrases",
    f"WITH d AS (SELECT doc_id AS id, ' ' || array_to_string({WORDS}, ' ') || ' ' AS t FROM {CHANGED}), q AS (SELECT item_id AS q, ' ' || array_to_string({WORDS}, ' ') || ' ' AS t FROM benchmark) SELECT q, id FROM q JOIN d ON contains(d.t, q.t) WHERE trim(q.t) <> ''",
)
def _(spark, sf):
    index, asked = changed_index(spark, sf)
    return index.phrase(asked).select("q", "id")


@query("s14d_ranked", BM25_SQL.replace("FROM documents)", f"FROM {CHANGED})").replace("item_id, rank", "item_id AS q, rank"))
def _(spark, sf):
    index, asked = changed_index(spark, sf)
    return index.ranked(asked, 3).select("q", "rank", "score")


@query("s15_point_and_range", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09' OR event_type = 'purchase'")
def _(spark, sf):
    e = read(spark, sf, "events")
    between = F.col("ts").between(F.lit("2024-01-05").cast(e.schema["ts"].dataType), F.lit("2024-01-09").cast(e.schema["ts"].dataType))
    return e.where(between | (F.col("event_type") == "purchase")).select("event_id")


@query("s16_month_folders", "SELECT coalesce(strftime(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END, '%Y-%m'), 'unknown') AS month, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    path = path_for(spark, "months")
    o = read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("p"))
    IO.write_by_month(o.withColumn("m", F.lit(None).cast("timestamp")).withColumn("p", F.col("p").cast("timestamp")), path, "m", "p")
    return spark.read.option("basePath", path).schema("o_orderkey bigint, month string").parquet(path).groupBy("month").agg(F.count("*").alias("n"))


@query("s17_stamped_cache", "SELECT source, count(*) AS n, sum(len(text))::BIGINT AS chars FROM documents GROUP BY source")
def _(spark, sf):
    """Computed once and read the second time, as the input has not changed."""
    build = lambda: read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    folder = path_for(spark, "stamped")
    for _ in range(2):
        kept = IO.stamped(spark, folder, [f"{sf}/documents.parquet"], build)
    return kept


@query("s18_last_record", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _(spark, sf):
    return IO.latest_per_key(read(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("st1_counts_by_window", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    """All rows of the table arrive in one trigger; the closed and open windows go to a table."""
    e = spark.readStream.schema(read(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    counts = ST.counts_by_window(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", late="0 seconds")
    out = path_for(spark, "windows")

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/table")

    counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/table").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("st2_upsert_stream", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _(spark, sf):
    e = spark.readStream.schema(read(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*").select("user_id", "event_id", "event_type")
    out, versions = path_for(spark, "merged"), []
    ST.upsert_stream(e, f"{out}/table", f"{out}/state", "user_id", "event_id", then=versions.append).awaitTermination()
    return spark.read.parquet(versions[-1])


@query("st2b_bucket_stream", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _(spark, sf):
    e = spark.readStream.schema(read(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*").select("user_id", "event_id", "event_type")
    out = path_for(spark, "dealt")
    ST.bucket_stream(e, f"{out}/table", f"{out}/state", "user_id", "event_id", buckets=16).awaitTermination()
    return IO.BucketTable(spark, f"{out}/table", e.schema, "user_id").rows()


@query("st3_first_copies", "SELECT md5(coalesce(event_type, '')) AS hash FROM events GROUP BY 1")
def _(spark, sf):
    e = spark.readStream.schema(read(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    first = ST.first_copies(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", late="60 days").select("hash")
    out = path_for(spark, "copies")
    first.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/table").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/table")
