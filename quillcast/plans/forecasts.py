"""Scores, group statistics, joins and retrieval. Forecasts are events: user asks, value / 500 is p, a purchase is right."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import groups as G
from ..operators import scoring as S
from ..operators.ordering import shared_folder
from .registry import query, read

R = lambda c: F.round(c, 6)
LONG = "WITH f AS (SELECT event_id, user_id AS q, event_id % 4 AS g, CASE WHEN event_id % 9 = 0 THEN 0 ELSE value / 500 END AS p, (event_type = 'purchase')::INT AS c FROM events) "


def long(spark, sf):
    p = F.when(F.col("event_id") % 9 == 0, 0.0).otherwise(F.col("value") / 500)
    return read(spark, sf, "events").select("event_id", F.col("user_id").alias("q"), (F.col("event_id") % 4).alias("g"), p.alias("p"), (F.col("event_type") == "purchase").cast("int").alias("correct"))


TERM = "CASE WHEN c = 1 THEN -(1-p)*(1-p) ELSE -p*p END"
GEN = "SELECT q, g, sum(" + TERM + ") - CASE WHEN max(c) = 1 THEN 0 ELSE 1 END + 1 AS brier FROM f {where} GROUP BY q, g"


@query("f2_generation_brier", LONG + "SELECT q, g, round(brier, 6) AS brier FROM (" + GEN.format(where="WHERE p <> 0") + ")")
def _(spark, sf):
    return S.generation_brier(long(spark, sf), ["q", "g"]).withColumn("brier", R("brier"))


@query("f2b_generation_brier_with_zero", LONG + "SELECT q, g, round(brier, 6) AS brier FROM (" + GEN.format(where="") + ")")
def _(spark, sf):
    return S.generation_brier(long(spark, sf), ["q", "g"], skip_zero=False).withColumn("brier", R("brier"))


@query("f3_model_brier", LONG + ", s AS (" + GEN.format(where="WHERE p <> 0") + "), m AS (SELECT g, avg(brier) AS m FROM s GROUP BY g) SELECT round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m) / sqrt(count(*)), 0), 6) AS se, count(*) AS generations FROM m")
def _(spark, sf):
    s = S.over_generations(S.generation_brier(long(spark, sf), ["q", "g"]), "g", "brier")
    return s.select(R("mean").alias("mean"), R("se").alias("se"), "generations")


@query("f4_accuracy", LONG + ", s AS (SELECT q, g, max(c) AS ok FROM f GROUP BY q, g), m AS (SELECT g, avg(ok) AS m FROM s GROUP BY g) SELECT round(100 * avg(m), 6) AS mean, round(100 * stddev_samp(m) / sqrt(count(*)), 6) AS se FROM m")
def _(spark, sf):
    s = long(spark, sf).groupBy("q", "g").agg(F.max("correct").alias("ok"))
    return S.over_generations(s, "g", "ok").select(R(F.col("mean") * 100).alias("mean"), R(F.col("se") * 100).alias("se"))


@query("f6_question_brier", LONG + ", s AS (" + GEN.format(where="") + ") SELECT q, round(avg(brier), 6) AS brier FROM s GROUP BY q")
def _(spark, sf):
    return S.generation_brier(long(spark, sf), ["q", "g"], skip_zero=False).groupBy("q").agg(R(F.avg("brier")).alias("brier"))


@query("f8_pass_at_k", LONG + ", r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY event_id) AS r FROM f), k AS (SELECT q, max(c) FILTER (r <= 1) AS a, max(c) FILTER (r <= 2) AS b, max(c) FILTER (r <= 4) AS d, max(c) FILTER (r <= 8) AS e FROM r GROUP BY q) SELECT round(avg(a), 6) AS pass_1, round(avg(b), 6) AS pass_2, round(avg(d), 6) AS pass_4, round(avg(e), 6) AS pass_8 FROM k")
def _(spark, sf):
    p = S.pass_at_k(long(spark, sf), "q", "event_id", "correct")
    return p.select(*[R(c).alias(c) for c in p.columns])


@query("f9_majority_vote", "WITH a AS (SELECT user_id, lower(trim(event_type)) AS answer, count(*) AS votes, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, answer, votes FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) = 1")
def _(spark, sf):
    return S.majority(read(spark, sf, "events"), "user_id", "event_type", "event_id")


@query("f10_calibration", LONG + "SELECT floor(p * 10 / (1 + 1e-8))::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(c), 6) AS rate, round(sqrt(avg(c) * (1 - avg(c)) / count(*)), 6) AS se FROM f WHERE p BETWEEN 0 AND 1 GROUP BY 1 HAVING count(*) >= 5")
def _(spark, sf):
    c = S.calibration(long(spark, sf), "p", "correct", 10, 5)
    return c.select("bin", "n", *[R(x).alias(x) for x in ("mean_p", "rate", "se")])


@query("f12_binary_scores", LONG + "SELECT g, round(avg((p - c) * (p - c)), 6) AS brier, round(avg(((p >= 0.5)::INT = c)::INT), 6) AS accuracy FROM f GROUP BY g")
def _(spark, sf):
    f = long(spark, sf)
    right = ((F.col("p") >= 0.5).cast("int") == F.col("correct")).cast("int")
    return f.groupBy("g").agg(R(F.avg((F.col("p") - F.col("correct")) ** 2)).alias("brier"), R(F.avg(right)).alias("accuracy"))


@query("f14_best_constant", LONG + ", m AS (SELECT avg(c) AS m FROM f), s AS (SELECT round(m * (1 - i / 100.0) ** 2 + (1 - m) * (i / 100.0) ** 2, 12) AS brier, i / 100.0 AS p FROM m, range(101) t(i)) SELECT round(brier, 6) AS brier, p::DOUBLE AS p FROM s ORDER BY s.brier, s.p LIMIT 1")
def _(spark, sf):
    return S.best_constant(long(spark, sf), "correct").select(R("brier").alias("brier"), "p")


@query("f16_monthly_brier", LONG + "SELECT strftime(date_trunc('week', e.ts), '%Y-%m-%d') AS w, round(avg((p - c) * (p - c)), 6) AS brier, count(*) AS n FROM f JOIN events e USING (event_id) GROUP BY 1 HAVING count(*) >= 5")
def _(spark, sf):
    ts = read(spark, sf, "events").select("event_id", "ts")
    g = long(spark, sf).join(ts, "event_id").groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("w"))
    return g.agg(R(F.avg((F.col("p") - F.col("correct")) ** 2)).alias("brier"), F.count("*").alias("n")).where("n >= 5")


@query("k1_freeform_reward", LONG + "SELECT event_id, round(CASE WHEN p = 0 OR p < -0.1 OR p > 1.1 THEN -1 WHEN c = 1 THEN 1 - (1-p)*(1-p) ELSE -p*p END, 6) + 0.0::DOUBLE AS reward FROM f")
def _(spark, sf):
    return long(spark, sf).select("event_id", R(S.freeform_reward(F.col("p"), F.col("correct"))).alias("reward"))


def rewards(spark, sf):
    return read(spark, sf, "events").select("event_id", "user_id", "value", (F.col("event_id") % 50 + 1).alias("len"))


W_ = "OVER (PARTITION BY user_id)"


@query("g1_grpo", f"SELECT event_id, round(CASE WHEN count(*) {W_} = 1 THEN value / (1 + 1e-6) ELSE (value - avg(value) {W_}) / (stddev_samp(value) {W_} + 1e-6) END, 6) AS advantage FROM events")
def _(spark, sf):
    return G.grpo(rewards(spark, sf), "user_id", "value").select("event_id", R("advantage").alias("advantage"))


@query("g3_rloo", f"SELECT event_id, round(CASE WHEN count(*) {W_} = 1 THEN value ELSE (value - avg(value) {W_}) * count(*) {W_} / (count(*) {W_} - 1) END, 6) AS advantage FROM events")
def _(spark, sf):
    return G.rloo(rewards(spark, sf), "user_id", "value").select("event_id", R("advantage").alias("advantage"))


@query("g4_opo", f"SELECT event_id, round(value - CASE WHEN count(*) {W_} = 1 THEN 0 ELSE sum((event_id % 50 + 1) * value) {W_} / sum(event_id % 50 + 1) {W_} END, 4) AS advantage FROM events")
def _(spark, sf):
    return G.opo(rewards(spark, sf), "user_id", "value", "len").select("event_id", F.round("advantage", 4).alias("advantage"))


@query("w12_best_gap", "SELECT event_id, round(CASE WHEN row_number() OVER w = 1 THEN value - lead(value) OVER w ELSE 0 END, 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)")
def _(spark, sf):
    return G.best_gap(rewards(spark, sf), "user_id", "value", "event_id").select("event_id", R("advantage").alias("advantage"))


@query("g9_masked_stats", "SELECT round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS var FROM events WHERE event_type <> 'view'")
def _(spark, sf):
    e = read(spark, sf, "events").withColumn("mask", (F.col("event_type") != "view").cast("int"))
    return G.masked_stats(e, "value", "mask").select(F.round("total", 4).alias("total"), R("mean").alias("mean"), F.round("var", 4).alias("var"))


@query("g13_validation_metrics", """
WITH r AS (SELECT event_type, user_id, value AS x, floor(value)::INT % 3 AS v, event_id AS s, count(*) OVER p AS n, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value) AS i, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC) AS j FROM events WHERE value IS NOT NULL WINDOW p AS (PARTITION BY event_type, user_id)),
a AS (SELECT event_type, user_id, avg(x) AS mean, stddev_pop(x) AS std, sum(x * ((i / n::DOUBLE) ** n - ((i - 1) / n::DOUBLE) ** n)) AS best, sum(x * ((j / n::DOUBLE) ** n - ((j - 1) / n::DOUBLE) ** n)) AS worst FROM r GROUP BY 1, 2),
v AS (SELECT event_type, user_id, v, count(*) AS c, min(s) AS s, arg_min(x, s) AS x FROM r GROUP BY 1, 2, 3),
m AS (SELECT event_type, user_id, x AS maj FROM v QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY c DESC, s) = 1)
SELECT event_type, round(avg(mean), 6) AS mean, round(avg(std), 6) AS std, round(avg(best), 6) AS best, round(avg(worst), 6) AS worst, round(avg(maj), 6) AS maj FROM a JOIN m USING (event_type, user_id) GROUP BY 1
""")
def _(spark, sf):
    e = read(spark, sf, "events").withColumn("vote", F.floor("value").cast("int") % 3)
    made = G.validation_metrics(e, "event_type", "user_id", "value", "vote", "event_id")
    return made.select("event_type", *[R(c).alias(c) for c in ("mean", "std", "best", "worst", "maj")])


@query("g16_informative_groups", "SELECT event_id FROM events QUALIFY stddev_pop(value) OVER (PARTITION BY user_id, event_type) > 0 OR count(*) OVER (PARTITION BY user_id, event_type) = 1")
def _(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.struct("user_id", "event_type").alias("uid"), "value")
    return G.informative(e, "uid", "value").select("event_id")


@query("w10_reverse_cumulative_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING), 4) AS ret FROM events")
def _(spark, sf):
    w = W.partitionBy("user_id").orderBy(F.desc("event_id")).rowsBetween(W.unboundedPreceding, 0)
    return rewards(spark, sf).select("event_id", F.round(F.sum("value").over(w), 4).alias("ret"))


@query("j4_semi_by_id", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(spark, sf):
    rich = read(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey")


@query("j5_lookup_with_default", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(l.quality, 1) = 1")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").where(F.coalesce("quality", F.lit(1)) == 1).select("doc_id")


@query("j6_resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    done = read(spark, sf, "labels").where("quality = 1").select("doc_id")
    return read(spark, sf, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query("j1_as_of_range_join", "SELECT q.event_id AS question, count(a.event_id) AS index_size, max(a.event_id) AS last FROM events q LEFT JOIN events a ON a.user_id = q.user_id AND a.event_type = 'view' AND a.ts BETWEEN q.ts - INTERVAL 3 DAY AND q.ts WHERE q.event_type = 'purchase' GROUP BY 1")
def _(spark, sf):
    """Both ends included. Days are the equi-join key: a question meets the four days that its window can touch."""
    e = read(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01"))
    q = e.where("event_type = 'purchase'").select(F.col("event_id").alias("question"), "user_id", F.col("ts").alias("cut"), F.explode(F.sequence(day - 3, day)).alias("day"))
    a = e.where("event_type = 'view'").select("event_id", "user_id", "ts", day.alias("day"))
    met = q.join(a, ["user_id", "day"], "left")
    inside = F.col("ts").between(F.col("cut") - F.expr("INTERVAL 3 DAYS"), F.col("cut"))
    return met.groupBy("question").agg(F.count_if(inside).alias("index_size"), F.max(F.when(inside, F.col("event_id"))).alias("last"))


BM25_SQL = """
WITH tok AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS term FROM documents),
dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS m FROM q GROUP BY 1, 2),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, round(sum(m * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2)
SELECT item_id, rank, score FROM (SELECT item_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3
"""


@query("r1_bm25_top_k", BM25_SQL)
def _(spark, sf):
    from ..functions.text import words
    from ..operators.retrieval import bm25

    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), words(F.lower("text")).alias("terms"))
    asks = read(spark, sf, "benchmark").select(F.col("item_id"), words(F.lower("text")).alias("terms"))
    return bm25(docs, asks, "item_id", 3).select("item_id", "rank", "score")


AS_OF_SQL = """
WITH d AS (SELECT doc_id, DATE '2024-01-01' + (doc_id % 30)::INT AS day, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS terms FROM documents),
q AS (SELECT item_id, DATE '2024-01-08' + (item_id % 25)::INT AS cut, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS terms FROM benchmark),
w AS (SELECT DISTINCT cut FROM q), tok AS (SELECT doc_id, day, unnest(terms) AS term FROM d), tf AS (SELECT doc_id, day, term, count(*) AS tf FROM tok GROUP BY 1, 2, 3),
st AS (SELECT cut, count(*) AS n, avg(len(terms)) AS avgdl FROM w JOIN d ON day BETWEEN cut - 7 AND cut WHERE len(terms) > 0 GROUP BY 1),
raw AS (SELECT cut, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM w JOIN tf ON day BETWEEN cut - 7 AND cut JOIN st USING (cut) GROUP BY cut, term, n),
idf AS (SELECT cut, term, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY cut) ELSE idf END AS idf FROM raw),
qt AS (SELECT item_id, cut, term, count(*) AS m FROM (SELECT item_id, cut, unnest(terms) AS term FROM q) GROUP BY 1, 2, 3),
s AS (SELECT item_id, tf.doc_id, round(sum(m * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.terms) / avgdl))), 6) AS score FROM qt JOIN tf ON tf.term = qt.term AND tf.day BETWEEN cut - 7 AND cut JOIN idf ON idf.term = qt.term AND idf.cut = qt.cut JOIN st ON st.cut = qt.cut JOIN d ON d.doc_id = tf.doc_id GROUP BY 1, 2)
SELECT item_id, rank, score FROM (SELECT item_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3
"""


@query("j1b_as_of_bm25", AS_OF_SQL)
def _(spark, sf):
    """Each question against an index of the eight days up to its cut. Documents have no date here: it is made from the id."""
    from ..functions.text import words
    from ..operators.retrieval import bm25

    made = lambda first, key, days: F.date_add(F.lit(first).cast("date"), (F.col(key) % days).cast("int"))
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), made("2024-01-01", "doc_id", 30).alias("day"), words(F.lower("text")).alias("terms"))
    asks = read(spark, sf, "benchmark").select("item_id", made("2024-01-08", "item_id", 25).alias("cut"), words(F.lower("text")).alias("terms"))
    return bm25(docs, asks, "item_id", 3, days=7).select("item_id", "rank", "score")


@query("r3_exact_knn", "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[64] AS e FROM embeddings), s AS (SELECT q.vec_id AS q, v.vec_id AS d, round(array_cosine_similarity(q.e, v.e), 6) AS s FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0) SELECT q, d, s FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, d) <= 10")
def _(spark, sf):
    from ..operators.retrieval import knn

    v = read(spark, sf, "embeddings").select("vec_id", "embedding")
    return knn(v.where("vec_id % 50 = 0"), v, "vec_id", "embedding", 10)


@query("r6_stored_dense_top_k")
def _(spark, sf):
    """An index of all vectors, searched in as many cells as hold 0.95 of the true neighbours of audited queries. Approximate, so without SQL: tests hold it against r3's exact neighbours."""
    from ..sources import VectorIndex

    v = read(spark, sf, "embeddings").select("vec_id", "embedding")
    index, asked = VectorIndex(spark, f"{shared_folder(spark)}/dense-{uuid.uuid4().hex}").build(v), v.where("vec_id % 50 = 0")
    return index.search(asked, 10, index.probes_for(asked, 10))
