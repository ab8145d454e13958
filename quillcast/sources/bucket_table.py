"""A table of one row a key, upserted by rewriting only the buckets that a change touches.

Rows are dealt to buckets by a hash of the key. A change writes the new state of
its buckets as Parquet, reads a sample of it back, and then writes one file that
names, for each bucket, the folder that now holds it: that is when the change
takes effect. A change that broke off before leaves the table as it was, and
rows that equal those in the table rewrite nothing. There is one writer at a
time; a reader keeps the state that it opened until ``clean`` removes what no
bucket uses.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ordering import keep_last, materialise

#: Buckets of a new table, and files of a bucket at most.
BUCKETS, FILES = 64, 4

_MANIFEST = "batch long, buckets int, bucket int, folder string, n long"


class BucketTable:
    """Rows of the given schema, one for each key. Changes without a key are left out; of several for one key the last in order counts. Columns of a map type cannot be compared and are not taken."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, buckets: int = BUCKETS, files: int = FILES):
        self.spark, self.path, self.key, self.files = spark, path, key, files
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        self._new = buckets

    # -- the manifest: a folder for each version, with a row for each bucket

    def _find(self, pattern: str) -> list[str]:
        """Paths below the table; in name only, so that nothing is read."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        return [str(s.getPath().toString()) for s in where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []]

    def versions(self) -> list[int]:
        """Versions whose one file is there, oldest first."""
        return sorted({int(found.split("/version-")[1].split("/")[0]) for found in self._find("manifest/version-*/part-*")})

    def parts(self) -> list:
        """(batch, buckets, bucket, folder, n) of the last version: a row for each bucket at most."""
        last = self.versions()[-1:]
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version-{last[0]}").collect() if last else []

    def _commit(self, batch: int, buckets: int, held: dict[int, tuple[str, int]]) -> None:
        rows = [f"({batch}L, {buckets}, {b}, '{folder}', {n}L)" for b, (folder, n) in sorted(held.items())] or [f"({batch}L, {buckets}, -1, '', 0L)"]
        version = (self.versions() or [0])[-1] + 1
        self.spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(batch, buckets, bucket, folder, n)").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest/version-{version}")

    # -- rows

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _rows(self, parts: list) -> DataFrame:
        paths = [f"{self.path}/data/{p.folder}/bucket__={p.bucket}" for p in parts if p.bucket >= 0]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        return self._rows(self.parts())

    def lookup(self, key: object) -> DataFrame:
        """The rows of one key, from its bucket alone."""
        parts = self.parts()
        if not parts:
            return self._rows([])
        value = F.lit(key).cast(self.schema[self.key].dataType)
        mine = self.spark.range(1).select(value.alias(self.key)).select(self._bucket(parts[0].buckets)).first()[0]
        return self._rows([p for p in parts if p.bucket == mine]).where(F.col(self.key) == value)

    # -- changes

    def _write(self, rows: DataFrame, buckets: int) -> tuple[str, dict[int, tuple[str, int]]]:
        """Writes whole buckets; gives the folder, and for each bucket the folder and its rows."""
        folder = uuid.uuid4().hex
        placed = rows.select(*self.schema.names, self._bucket(buckets).alias("bucket__"))
        dealt = placed.repartition("bucket__", F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(self.files)))
        dealt.sortWithinPartitions("bucket__", self.key).write.partitionBy("bucket__").parquet(f"{self.path}/data/{folder}")
        if not self._find(f"data/{folder}/bucket__=*"):
            return folder, {}
        counts = self.spark.read.parquet(f"{self.path}/data/{folder}").groupBy("bucket__").agg(F.count("*").alias("n")).collect()  # a row for each bucket
        return folder, {int(r["bucket__"]): (folder, r["n"]) for r in counts}

    def _verify(self, wanted: DataFrame, folder: str, share: float) -> None:
        """Read a hash-chosen share of the changed rows back; an error if one is not as wanted."""
        chosen = F.pmod(F.xxhash64(self.key, F.lit(2)), F.lit(1_000_000)) < F.lit(share * 1_000_000)
        row = F.struct(*self.schema.names)
        there = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}").where(chosen).select(self.key, row.alias("there__"))
        lost = wanted.where(chosen).select(self.key, row.alias("wanted__")).join(there, self.key, "left").where(~F.col("wanted__").eqNullSafe(F.col("there__")))
        if lost.limit(1).count():
            raise OSError(f"rows read back from {folder} are not those written; the table stays as it was")

    def upsert(self, changes: DataFrame, *order: Column | str, batch: int | None = None, verified: float = 0.01) -> int:
        """Put changes in place of their keys' rows, or add them; the number of rows that changed.

        A batch at or below the table's last one has been done already and
        changes nothing. ``verified`` is the share of changed rows that is read back.
        """
        parts = self.parts()
        done, buckets = (parts[0].batch, parts[0].buckets) if parts else (-1, self._new)
        if batch is not None and batch <= done:
            return 0
        held = {p.bucket: (p.folder, p.n) for p in parts if p.bucket >= 0}
        last = keep_last(changes.where(F.col(self.key).isNotNull()), self.key, *order).select(*self.schema.names)
        dealt = materialise(last.select(F.col(self.key), F.struct(*self.schema.names).alias("new__"), self._bucket(buckets).alias("bucket__")))
        met = {r[0] for r in dealt.select("bucket__").distinct().collect()}  # as many as there are buckets
        now = self._rows([p for p in parts if p.bucket in met]).select(self.key, F.struct(*self.schema.names).alias("now__"))
        real = materialise(dealt.join(now, self.key, "left").where(~F.col("new__").eqNullSafe(F.col("now__"))).select("new__", "bucket__"))
        touched = {r["bucket__"]: r.n for r in real.groupBy("bucket__").agg(F.count("*").alias("n")).collect()}
        if touched:
            new = real.select("new__.*")
            kept = self._rows([p for p in parts if p.bucket in touched]).join(new.select(self.key), self.key, "left_anti").select(*self.schema.names)
            folder, written = self._write(kept.unionByName(new), buckets)
            self._verify(new, folder, verified)
            held |= written
        if touched or batch is not None or not parts:
            self._commit(done if batch is None else batch, buckets, held)
        return sum(touched.values())

    def rebucket(self, buckets: int) -> None:
        """Deal all rows anew, as when the table has outgrown its buckets."""
        parts = self.parts()
        _, written = self._write(self._rows(parts), buckets)
        self._commit(parts[0].batch if parts else -1, buckets, written)

    def clean(self) -> int:
        """Remove older versions and the bucket folders that the last one does not name; how many went. Readers of an older state lose it."""
        used = {f"{p.folder}/bucket__={p.bucket}" for p in self.parts()}
        old = [f"manifest/version-{v}" for v in self.versions()[:-1]] + [name for name in ("data/" + found.split("/data/")[-1] for found in self._find("data/*/bucket__=*")) if name[5:] not in used]
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in old:
            where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            where.getFileSystem(conf).delete(where, True)
        return len(old)
