"""A corpus pipeline of five operators: what each stage decides takes effect in the rows or texts it returns.

Every stage takes (spark, docs, sf_dir) and returns a table, which is written
as Parquet and read back as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast.llm.decontaminate import drop_contaminated
from quillcast.llm.line_dedup import dedup_lines
from quillcast.llm.mixing import mix_sources
from quillcast.llm.simhash_dedup import simhash_groups
from quillcast.llm.tables import stash
from quillcast.llm.toxicity import drop_toxic, train

#: The near-duplicate stage links texts that share 0.8 of their distinct shingles of five words. At that share about ten
#: of 64 bits differ; candidates may differ in thirteen.
WORDS, RADIUS, SHARE = 5, 13, 0.8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. Null texts count as empty, null ids are scored like others. Empty table: empty result."""
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drop_toxic(docs, machine)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the last of them; a document that loses all its lines stays, empty. A null text becomes empty; a null id is smaller than all others. Empty table: empty result."""
    hidden = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}  # whatever their names
    kept = dedup_lines(docs.withColumnsRenamed(hidden), keep=tuple(hidden.values()))
    made = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")} | {c: F.col(own) for c, own in hidden.items()}
    return kept.select(*[made.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies stays. Rows with a null id stay; rows with one id stay or go together; null texts are copies of empty ones. Empty table: empty result."""
    groups = simhash_groups(docs, width=WORDS, radius=RADIUS, least=SHARE)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null texts hold none; rows with a null id go together. Empty tables: nothing goes."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes. Null texts have size 0, null sources are one source. Empty table: empty result."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can't express the learnt score, the fingerprints or the template search; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
