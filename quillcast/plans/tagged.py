"""Generated texts made from parts and back: what each extractor must give is known from the columns they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas as M
from ..functions import sequences as Q
from ..functions import tagged as X
from .registry import query, read, spread

S = lambda c: F.col(c).cast("string")


@query("x3_numbered_answers", "SELECT p_partkey, 2 AS n, 0.5::DOUBLE AS again, (p_size / 100.0)::DOUBLE AS p FROM part")
def _(spark, sf):
    pair = lambda n, a, p: [F.lit(f"<answer{n}>"), a, F.lit(f"</answer{n}> <probability{n}>"), p, F.lit(f"</probability{n}>\n")]
    t = F.concat(*pair(1, F.lit(" x "), F.lit("0.1")), *pair(2, F.col("p_name"), (F.col("p_size") / 100).cast("string")), *pair(3, F.lit("x"), F.lit("0.5")), *pair(4, F.lit("y"), F.lit("1.5")))
    m = X.numbered_answers(t)
    return read(spark, sf, "part").select("p_partkey", F.size(m).alias("n"), m["x"].alias("again"), F.try_element_at(m, F.trim("p_name")).alias("p"))


@query("x4_nested_box", r"SELECT p_partkey, '\frac{' || p_size::VARCHAR || '}{2}' AS box FROM part")
def _(spark, sf):
    t = F.concat(F.lit(r"\boxed{1} so \boxed{\frac{"), S("p_size"), F.lit("}{2}}"))
    return read(spark, sf, "part").select("p_partkey", X.nested_box(t).alias("box"))


@query("x5_answer_phrases", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN lower(p_brand) ELSE '' END AS a FROM part")
def _(spark, sf):
    k = F.col("p_partkey") % 3
    t = F.when(k == 0, F.concat(F.lit("<answer> "), "p_brand", F.lit(" </answer>"))).when(k == 1, F.concat(F.lit("I think The Answer is "), "p_brand", F.lit(". Done"))).otherwise("none")
    return read(spark, sf, "part").select("p_partkey", X.answer_or_phrase(t).alias("a"))


@query("x7_digit_verdict", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '1' ELSE '' END AS v FROM part")
def _(spark, sf):
    k = F.col("p_partkey") % 4
    t = F.when(k == 0, "1 <answer>so 0 or 1</answer>").when(k == 1, "<answer>yes</answer> 0 then 1 of 10").when(k == 2, "no digit").otherwise("")
    return read(spark, sf, "part").select("p_partkey", X.digit_verdict(t).alias("v"))


@query("x8_final_question", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '<question_title>' || p_name || '</question_title>' || chr(10) || '<answer>' || p_brand || '</answer>' END AS q FROM part")
def _(spark, sf):
    t = F.concat(F.lit("<answer>old</answer> <question_title> "), "p_name", F.lit(" </question_title><answer>"), "p_brand", F.when(F.col("p_partkey") % 3 == 0, " NO GOOD QUESTION").otherwise("</answer>"))
    t = F.concat(t, F.when(F.col("p_partkey") % 3 == 0, "</answer>").otherwise(""))
    return read(spark, sf, "part").select("p_partkey", X.final_question(t, ("question_title", "answer")).alias("q"))


@query("x9_question_blocks", "SELECT p_partkey, i + 1 AS n, CASE i WHEN 0 THEN '<q1>' || chr(10) || p_name || chr(10) || '</q1>' ELSE '<q1>' || chr(10) || '<question_id>1</question_id>' || chr(10) || p_brand || chr(10) || '</q1>' END AS q FROM part, range(2) t(i)")
def _(spark, sf):
    t = F.concat(F.lit("<q1> "), "p_name", F.lit(" </q1> <question_id>1</question_id> "), "p_brand", F.lit("\n"))
    return read(spark, sf, "part").select("p_partkey", F.posexplode(X.question_blocks(t, 3)).alias("i", "q")).select("p_partkey", (F.col("i") + 1).alias("n"), "q")


@query("x11_source_of_file", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'example' WHEN 1 THEN 'herald' WHEN 2 THEN 'planet' ELSE 'supplier' || s_suppkey::VARCHAR END AS source FROM supplier")
def _(spark, sf):
    k = F.col("s_suppkey") % 4
    t = F.when(k == 0, "news/www.example.com_2024.jsonl").when(k == 1, "daily-herald-a.jsonl").when(k == 2, "planet_2024_x.jsonl").otherwise(F.concat(F.lit("in/Supplier"), S("s_suppkey"), F.lit(".json")))
    return read(spark, sf, "supplier").select("s_suppkey", X.source_of_file(t, ("herald",)).alias("source"))


@query("x12_run_of_file", "SELECT s_suppkey, 'Model-4B-sft' AS model, s_suppkey::INT AS checkpoint, 5 AS generations, 'sft' AS variant FROM supplier")
def _(spark, sf):
    r = X.run_of_file(F.concat(F.lit("out/Model-4B-sft_checkpoint_"), S("s_suppkey"), F.lit("_size_20_generations_5.jsonl")))
    return read(spark, sf, "supplier").select("s_suppkey", *[c.alias(n) for n, c in r.items()])


@query("x13_strip_thinking", "SELECT p_partkey, p_name || ' end' AS t FROM part")
def _(spark, sf):
    from ..functions.text import strip_thinking

    return read(spark, sf, "part").select("p_partkey", strip_thinking(F.concat(F.lit("<think>a\n<b></think>  "), "p_name", F.lit("\n  end "))).alias("t"))


@query("x14_simple_tokens", r"WITH t AS (SELECT doc_id, list_transform(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+'), lambda w: regexp_replace(w, '[^a-z]', '', 'g')) AS w FROM documents WHERE lang = 'en') SELECT doc_id, len(list_filter(w, lambda x: length(x) > 2 AND x NOT IN ('the', 'and'))) AS n FROM t")
def _(spark, sf):
    return read(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.size(X.simple_tokens(F.col("text"), ("the", "and"))).alias("n"))


@query("x17_normal_math", r"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '\frac{' || p_size::VARCHAR || '}{7}' WHEN 1 THEN '0.' || p_size::VARCHAR ELSE '\sqrt{2}' || p_size::VARCHAR END AS m FROM part WHERE p_size <> 5")
def _(spark, sf):
    k = F.col("p_partkey") % 3
    t = F.when(k == 0, F.concat(F.lit("x = "), S("p_size"), F.lit("/7"))).when(k == 1, F.concat(F.lit(r"\$ ."), S("p_size"), F.lit(r"\%"))).otherwise(F.concat(F.lit(r"\left\sqrt2 "), S("p_size")))
    t = F.when(k == 0, F.regexp_replace(t, " ", "")).when(k == 1, F.regexp_replace(t, r"\$ ", r"\$")).otherwise(t)
    return read(spark, sf, "part").where("p_size <> 5").select("p_partkey", X.normal_math(t).alias("m"))


@query("x17b_same_formula", "SELECT p_partkey, p_partkey % 2 = 0 AS same FROM part")
def _(spark, sf):
    """Products, fractions and decimals beside another form of the same, or of one more."""
    k, s, more = F.col("p_partkey") % 3, F.col("p_size").cast("long"), F.col("p_partkey") % 2
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    one = F.when(k == 0, text(s + 1, "(x + ", s, ")")).when(k == 1, text(r"\frac{x^2 - ", s * s, "}{x - ", s, "}")).otherwise(text("y = ", s, ".5"))
    other = F.when(k == 0, text(s * (s + 1) + more, r" + x\cdot ", s + 1)).when(k == 1, text("x+", s + more)).otherwise(text(r"\dfrac{", 2 * s + 1 + more, "}{2}"))
    return spread(read(spark, sf, "part").select("p_partkey", "p_size")).select("p_partkey", M.same_formula(one, other).alias("same"))


@query("x18_article_prompt", "SELECT o_orderkey, 'Title: ' || o_orderpriority || chr(10) || 'Authors: 1, 2, 3, 4, 5' || chr(10) || 'Date: ' || strftime(o_orderdate, '%B %d, %Y') || chr(10) || 'Passage: ' || o_orderstatus AS p FROM orders")
def _(spark, sf):
    a = F.sequence(F.lit(1), F.lit(7)).cast("array<string>")
    o = read(spark, sf, "orders")
    return o.select("o_orderkey", X.article_prompt(F.col("o_orderpriority"), a, F.col("o_orderdate"), F.lit(" "), F.col("o_orderstatus")).alias("p"))


@query("x19_article_identity", "SELECT page_id, url || '_' || page_id::VARCHAR AS identity FROM pages")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.concat_ws("_", "url", S("page_id")).alias("identity"))


@query("x21_tails_and_heads", "SELECT doc_id, md5(right(text, 200)) AS tail, md5(left(text, 100)) AS head FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    d = read(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.md5(F.right("text", F.lit(200)).cast("binary")).alias("tail"), F.md5(F.left("text", F.lit(100)).cast("binary")).alias("head"))


@query("x22_divergences", "SELECT event_id, round(d, 6) AS k1, round(abs(d), 6) AS a, round(0.5 * d * d, 6) AS k2, round(least(greatest(exp(least(greatest(-d, -20), 20)) - least(greatest(-d, -20), 20) - 1, -10), 10), 6) AS k3 FROM (SELECT event_id, value / 97 - value / 61 AS d FROM events)")
def _(spark, sf):
    p, r = F.col("value") / 97, F.col("value") / 61
    kinds = {"k1": "k1", "abs": "a", "k2": "k2", "k3": "k3"}
    return read(spark, sf, "events").select("event_id", *[F.round(Q.divergence(p, r, k), 6).alias(n) for k, n in kinds.items()])


@query(
    "x23_entropy",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), z AS (SELECT vec_id, e, list_max(e) + ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))) AS z FROM v)
    SELECT vec_id, round(z - list_sum(list_transform(e, lambda x: exp(x - z) * x)), 6) AS entropy, round(e[3] - z, 6) AS logp FROM z""",
)
def _(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where("e IS NOT NULL")
    return v.select("vec_id", F.round(Q.entropy(F.col("e")), 6).alias("entropy"), F.round(Q.log_prob_at(F.col("e"), F.lit(2)), 6).alias("logp"))


@query("x24_selected_question", "SELECT l_orderkey, max(s) AS score, arg_max(l_linenumber, s * 10 - l_linenumber) AS n FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN 100 WHEN l_returnflag = 'N' THEN 50 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 80 ELSE 40 END AS s FROM lineitem) GROUP BY 1 HAVING max(s) >= 80")
def _(spark, sf):
    c = F.col
    s = X.choice_score(c("l_returnflag") == "A", c("l_returnflag") == "N", c("l_linestatus") == "F", F.lit(True))
    best = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct(s.alias("score"), (-c("l_linenumber")).alias("n"))).alias("b"))
    return best.select("l_orderkey", "b.score", (-c("b.n")).alias("n")).where("score >= 80")


@query("x25_data_source_tags", "SELECT doc_id, CASE WHEN toxic IN (0, 1) THEN 'binary' ELSE 'freeform' END || CASE WHEN quality = 1 THEN '_good' ELSE '' END AS tag FROM labels")
def _(spark, sf):
    kind = F.when(F.col("toxic").isin(0, 1), "binary").otherwise("freeform")
    return read(spark, sf, "labels").select("doc_id", F.concat(kind, F.when(F.col("quality") == 1, "_good").otherwise("")).alias("tag"))


@query("t5_leak_in_tagged", "SELECT p_partkey, contains(lower(p_name), lower(split_part(p_name, ' ', 1))) AND p_partkey % 2 = 0 AS leaks FROM part WHERE split_part(p_name, ' ', 1) <> ''")
def _(spark, sf):
    a = F.when(F.col("p_partkey") % 2 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise("zzz9")
    t = F.concat(F.lit("<title>"), "p_name", F.lit("</title><answer>"), a, F.lit("</answer>"))
    return read(spark, sf, "part").where(F.split_part("p_name", F.lit(" "), F.lit(1)) != "").select("p_partkey", X.leaks_in_tagged(t).alias("leaks"))


@query("t6_examples_removed", "SELECT p_partkey, 'Name a part (' || CASE p_partkey % 4 WHEN 0 THEN ' or so). Done.' WHEN 1 THEN ' Done.' WHEN 2 THEN 'yes. ' || p_brand || ').' ELSE 'no ' || p_brand || ').' END AS t FROM part")
def _(spark, sf):
    text, answer = exemplified()
    return read(spark, sf, "part").select("p_partkey", X.without_examples(text, answer).alias("t"))


def exemplified():
    """A text with an example that carries the answer, or without one, and the answer."""
    b, k = F.col("p_brand"), F.col("p_partkey") % 4
    middle = F.when(k == 0, F.concat(F.lit("e.g., "), b, F.lit(" or so). Done."))).when(k == 1, F.concat(F.lit("In Other Words, one\nof "), F.lower(b), F.lit("! Done.")))
    middle = middle.when(k == 2, F.concat(F.lit("yes. "), b, F.lit(").Such as "), b)).otherwise(F.concat(F.lit("no "), b, F.lit(").")))
    return F.concat(F.lit("Name a part ("), middle), b


@query("t6b_removed_examples", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'e.g., ' || p_brand WHEN 1 THEN 'In Other Words, one' || chr(10) || 'of ' || lower(p_brand) || '!' WHEN 2 THEN 'Such as ' || p_brand ELSE '' END AS gone FROM part")
def _(spark, sf):
    text, answer = exemplified()
    return spread(read(spark, sf, "part").select("p_partkey", "p_brand")).select("p_partkey", F.array_join(X.removed_examples(text, answer), "|").alias("gone"))


@query("t7_needs_removal", "SELECT doc_id FROM documents WHERE contains(lower(text), lower(source)) AND lang IS NOT NULL")
def _(spark, sf):
    from ..functions.text import leaks

    return read(spark, sf, "documents").where("lang IS NOT NULL").where(leaks(F.col("source"), F.col("text"))).select("doc_id")
