"""The queries of this subpackage, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_chats, read_content, read_role, read_turns, text_part, unescape
from .decontaminate import find_contamination
from .embedding_dedup import near_vectors
from .exact_search import top_k, whole_vectors
from .html_extract import extract_pages
from .language_id import identify, train_text
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .ppm import ppm_scores
from .simhash_dedup import simhash_groups
from .token_alignment import ByteLevel, Pieces, align
from .toxicity import toxicity_scores, train
from .whitening import whiten

#: Where the vocabularies of op12 are.
TOKENIZERS = "/opt/tokenizers"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, shared.k IS NOT NULL AND shared.keeper <> doc_id AS lost FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op7_ppm_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(_read(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_read(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity_scores(docs, train(docs, _read(spark, sf_dir, "labels")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM docs GROUP BY source
), w AS (
  SELECT source, s, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w FROM src
), level AS (
  SELECT *, sum(s) OVER () AS total, coalesce(sum(3 * s) OVER o, 0) AS caps, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS share
  FROM w WINDOW o AS (ORDER BY 3 * s / w::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT total - caps AS l, share FROM level WHERE 3 * s >= w * (total - caps) / share ORDER BY 3 * s / w::DOUBLE, source LIMIT 1
), target AS (
  SELECT source, s, least((3 * s)::DOUBLE, (w * l)::DOUBLE / share) AS target FROM w, cut
), parts AS (
  SELECT docs.*, s, target, floor(target)::BIGINT AS budget, (sum(size) OVER (PARTITION BY docs.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM docs JOIN target ON docs.source IS NOT DISTINCT FROM target.source
), whole AS (SELECT *, CASE WHEN s > 0 THEN budget // s ELSE 0 END AS n FROM parts)
SELECT doc_id, source, size, s AS source_size, target, (n * size + greatest(0, least(size, budget - n * s - before)))::BIGINT AS taken FROM whole
"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    made = format_chats(chats.unionByName(own).withColumn("parts", text_part("text")))
    pieces = made.select("conv_id", "formatted", "loss", read_turns(F.col("formatted")).alias("pieces"))
    nl = F.lit("\n")
    turns = F.array_join(F.transform("pieces", lambda p: F.concat(read_role(p), nl, read_content(p), nl)), "")
    learnt = F.array_join(F.transform("loss", lambda x: unescape(F.substring(F.element_at("pieces", x["turn"] + 1), x["start"] + 1, x["chars"]))), "")
    back = pieces.select("conv_id", F.size("pieces").cast("long").alias("n_turns"), turns.alias("turns"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return back.select("conv_id", "n_turns", digest("turns").alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), digest("learnt").alias("loss_sha256"), "formatted_chars")


OP5_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(15 + 2 * length(role || text) - length(translate(role || text, '\<>', '')))::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by all four witnesses, and every document by its text and its source's prior."""
    docs = _read(spark, sf_dir, "documents")
    langs, table = train_text(docs)
    pages = identify(_read(spark, sf_dir, "pages"), langs, table, "page_id", "html", "url")
    texts = identify(docs.withColumn("address", F.lit(None).cast("string")), langs, table, "doc_id", "text", "address", host="source", markup=False)
    return texts.unionByName(pages, allowMissingColumns=True)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return top_k(vectors, vectors.where("id % 50 = 0"), 5)


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.r AS q, q.vec_id AS query_id, v.r, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON v.r <> q.r WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS FIRST, r)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    with open(f"{tokenizers}/byte_bpe_50k.json", "rb") as a, open(f"{tokenizers}/piece_bpe_32k.model", "rb") as b:
        aligned = align(_read(spark, sf_dir, "documents"), ByteLevel(a.read()), Pieces(b.read()))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return aligned.select(*[c for c in aligned.columns if c != "groups"], digest.alias("groups_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(whole_vectors(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024, 100_000), 8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_toxicity": op3_toxicity,
    "op4_source_mixing": op4_source_mixing,
    "op5_chat_format": op5_chat_format,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_ppm_lm_score": op7_ppm_lm_score,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_language_id": op9_language_id,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_token_alignment": op12_token_alignment,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op4_source_mixing": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op11_exact_top_k": OP11_SQL,
}
