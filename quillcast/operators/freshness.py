"""Which index a question may use when indexes are made in order of their cut-offs and each is reused for some days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import materialise, row_index

#: Distinct days in a block at least.
BLOCK = 1024


def _last_from(days: Column, entry: Column, apart: int) -> Column:
    """The last day that gets an index, if the first in the block to get one is at position entry."""
    rest = F.slice(days, entry + 1, F.size(days) + 1)
    return F.aggregate(rest, F.lit(None).cast("int"), lambda last, d: F.when(last.isNull() | (d - last > apart), d).otherwise(last))


def reused_cutoffs(questions: DataFrame, cutoff: str, days: int, block: int = BLOCK) -> DataFrame:
    """Adds index_cutoff: the day of the index that a question uses. In order of the cut-offs, an index is made for the first and
    then for each that is more than so many days after the last index; the others reuse the last. Null cut-offs have none; ``days`` is 0 or more.

    Each choice depends on the one before, but only through where it enters
    the next days. Distinct days are numbered and cut into blocks; from a block the next
    is entered at one of its first days + 1 days, so that a block is a small
    table from entries to entries. These tables are composed by pointer
    doubling, and all blocks are then walked apart, each from its true entry.
    """
    day = F.datediff(F.to_date(cutoff), F.lit("1970-01-01"))
    ways, size = days + 1, max(block, days + 1)
    distinct = questions.select(day.alias("day")).where("day is not null").distinct()
    blocks = row_index(distinct, "day", name="i").groupBy(F.floor(F.col("i") / size).alias("block")).agg(F.sort_array(F.collect_list("day")).alias("days"))  # size days each
    blocks = materialise(blocks)
    heads = blocks.select((F.col("block") - 1).alias("block"), F.slice("days", 1, ways).alias("heads"))
    entries = F.sequence(F.lit(0), F.lit(ways - 1))
    out = F.transform(entries, lambda e: F.size(F.filter("heads", lambda h: h - _last_from(F.col("days"), e, days) <= days)))
    steps = materialise(blocks.join(heads, "block").select((F.col("block") + 1).alias("block"), out.alias("to")))  # how block is entered, by how the one before was
    reach, count = 1, blocks.count()
    while reach < count:
        before = steps.select((F.col("block") + reach).alias("block"), F.col("to").alias("first"))
        both = F.when(F.col("first").isNull(), F.col("to")).otherwise(F.transform("first", lambda e: F.get("to", e)))
        steps = materialise(steps.join(before, "block", "left").select("block", both.alias("to")))
        reach *= 2
    entered = blocks.join(steps, "block", "left").select("block", "days", F.coalesce(F.get("to", F.lit(0)), F.lit(0)).alias("entry"))
    entered = materialise(entered.withColumn("last", _last_from(F.col("days"), F.col("entry"), days)))
    earlier = entered.select((F.col("block") + 1).alias("block"), F.col("last").alias("earlier"))
    start = F.struct(F.col("earlier").cast("int").alias("last"), F.array().cast("array<struct<day:int,chosen:int>>").alias("out"))

    def walk(state: Column, d: Column) -> Column:
        chosen = F.when(state["last"].isNull() | (d - state["last"] > days), d).otherwise(state["last"])
        return F.struct(chosen.alias("last"), F.concat(state["out"], F.array(F.struct(d.alias("day"), chosen.alias("chosen")))).alias("out"))

    walked = entered.join(earlier, "block", "left").select(F.explode(F.aggregate("days", start, walk, lambda s: s["out"])).alias("d"))
    index = walked.select(F.col("d.day").alias("__day"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("d.chosen")).alias("index_cutoff"))
    return questions.withColumn("__day", day).join(index, "__day", "left").drop("__day")
