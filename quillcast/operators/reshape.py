"""Concatenation, repetition, chunks, padding and zips of row batches whose order is given by an index column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import row_index


def chunks(df: DataFrame, k: int, *order: str, pad: bool = False) -> DataFrame:
    """Adds chunk, 0 to k - 1, in equal parts by order; a count that k does not divide is an error unless pad is set."""
    indexed = row_index(df, *order)
    n = indexed.count()
    if n % k and not pad:
        raise ValueError(f"{n} rows can't be cut into {k} equal chunks")
    return indexed.withColumn("chunk", F.floor(F.col("idx") / max(1, -(-n // k))).cast("int"))


def pad_to_multiple(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Rows repeated from the head until size divides their number; idx tells the copies (idx >= the old count) from the rest."""
    indexed = row_index(df, *order)
    n = indexed.count()
    lack = -n % size if n else 0
    turns = F.floor((F.lit(n + lack - 1) - F.col("idx")) / max(n, 1))  # how often the row comes again
    turn = F.explode(F.sequence(F.lit(0).cast("long"), turns.cast("long"))).alias("__turn")
    return indexed.select("*", turn).withColumn("idx", F.col("__turn") * n + F.col("idx")).drop("__turn")


def unpad(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("idx") < n)


def tiled(df: DataFrame, times: int) -> DataFrame:
    """Adds copy, 0 to times - 1; by (copy, idx) the rows come as abab, by (idx, copy) as aabb."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def reorder(df: DataFrame, places: DataFrame) -> DataFrame:
    """Rows with idx by places (idx, to): each gets its new index."""
    return df.join(places, "idx").withColumn("idx", F.col("to")).drop("to")


def inverse(places: DataFrame) -> DataFrame:
    return places.select(F.col("to").alias("idx"), F.col("idx").alias("to"))


def fold(df: DataFrame, size: int, *columns: str) -> DataFrame:
    """One row for each size rows by idx, with arrays of their values."""
    group = F.floor(F.col("idx") / size).alias("idx")
    ordered = F.array_sort(F.collect_list(F.struct("idx", *columns)))
    return df.groupBy(group).agg(ordered.alias("rows")).select("idx", *[F.col(f"rows.{c}").alias(c) for c in columns])


def unfold(df: DataFrame, size: int, *columns: str) -> DataFrame:
    each = F.posexplode(F.arrays_zip(*columns)).alias("at", "row")
    return df.select("idx", each).select((F.col("idx") * size + F.col("at")).alias("idx"), *[F.col(f"row.{c}").alias(c) for c in columns])


def zip_equal(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The columns of two batches side by side; columns that both have must be equal (null and NaN equal themselves), or the job fails."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in shared})
    joined = left.join(renamed, key, "full")
    for c in shared:
        joined = joined.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"__{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs"))))
    return joined.drop(*[f"__{c}" for c in shared])


def hash_split(df: DataFrame, key: str, shares: dict[str, float], seed: str = "s") -> DataFrame:
    """Adds split by the rank of a hash of the key: exact shares in shuffled order; the last name takes the remainder."""
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    indexed = row_index(df.withColumn("__h", h), "__h", key)
    n, column, upto = indexed.count(), None, 0
    names = list(shares)
    for name in names[:-1]:
        upto += int(n * shares[name])
        test = F.col("idx") < upto
        column = F.when(test, name) if column is None else column.when(test, name)
    return indexed.withColumn("split", F.lit(names[-1]) if column is None else column.otherwise(names[-1])).drop("__h")


def first_end_mask(ended: Column) -> Column:
    """1 up to and with the first end token of an array of 0 and 1, then 0."""
    first = F.array_position(ended, 1)
    return F.transform(ended, lambda e, i: F.when((first == 0) | (i < first), 1).otherwise(0))


def ids_beside(rows: DataFrame, taken: DataFrame, key: str, start: int = 1, seed: int = 0, stop: int | None = None) -> DataFrame:
    """Adds new_id: distinct numbers from start on that are not in taken (one column), in hash order of the key: alike in every run.
    With stop all numbers are below it, and rows for which none is left are not returned.

    The i-th free number is found from the gaps between taken ones by intervals
    keyed by blocks of ranks, so no range of numbers is made.
    """
    used = taken.select(F.col(taken.columns[0]).cast("long").alias("t")).where(F.col("t") >= start).distinct()
    gaps = row_index(used, "t", name="before")  # below t lie t - start - before free numbers
    free = gaps.select((F.col("t") - start - F.col("before")).alias("free")).groupBy("free").agg(F.count("*").alias("n"))
    ranked = row_index(rows.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))), "__h", key, name="rank").drop("__h")
    # a taken number with as many free ones below it as the rank, or fewer, pushes the rank up by one
    steps = free.select(F.col("free").alias("rank"), "n", F.lit(None).cast(rows.schema[key].dataType).alias(key)).unionByName(ranked.select("rank", F.lit(0).cast("long").alias("n"), key))
    block = F.floor(F.col("rank") / (1 << 16))
    per = steps.groupBy(block.alias("__b")).agg(F.sum("n").alias("__n"))
    before = per.select("__b", (F.sum("__n").over(W.orderBy("__b")) - F.col("__n")).alias("__before"))
    own = F.sum("n").over(W.partitionBy("__b").orderBy("rank").rangeBetween(W.unboundedPreceding, 0))
    shifted = steps.withColumn("__b", block).withColumn("__own", own).join(before, "__b")
    new = shifted.where(F.col(key).isNotNull()).select(key, (F.col("rank") + start + F.col("__own") + F.col("__before")).alias("new_id"))
    return rows.join(new if stop is None else new.where(F.col("new_id") < stop), key)
