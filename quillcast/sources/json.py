"""JSON lines, JSON documents and folders of one record a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_BAD = "_corrupt_record"


def _schema(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str, recursive: bool = False, file_column: str | None = None) -> DataFrame:
    """Records of files, folders or globs; blank and malformed lines are left out."""
    s = _schema(schema)
    with_bad = StructType([*s.fields, StructField(_BAD, StringType())])
    reader = spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).option("recursiveFileLookup", recursive)
    names = [F.col(f"`{f.name}`") for f in s.fields]
    lines = reader.json(path)
    return lines.where(F.col(_BAD).isNull()).select(*names, *([F.input_file_name().alias(file_column)] if file_column else []))


def read_json_lines_strict(spark: SparkSession, path: str, schema: StructType | str, transform: dict[str, Column] | None = None, comment: str = "#") -> DataFrame:
    """Records of one file or folder. Blank lines and comment lines are skipped; a malformed line fails the job, naming its start.

    transform gives columns that are set from each record, in the order given.
    """
    lines = spark.read.text(path).withColumn("line", F.trim("value")).where((F.col("line") != "") & ~F.col("line").startswith(comment))
    s = _schema(schema)
    with_bad = StructType([*s.fields, StructField(_BAD, StringType())])
    parsed = lines.select(F.from_json("line", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("r"), "line")
    held = F.when(F.col(f"r.{_BAD}").isNull(), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.left("line", F.lit(200)))))
    out = parsed.select(held.alias("r")).select(*[F.col(f"r.`{f.name}`") for f in s.fields])
    for name, column in (transform or {}).items():
        out = out.withColumn(name, column)
    return out


def read_json_document(spark: SparkSession, path: str, schema: StructType | str, key: str = "key") -> DataFrame:
    """Files that hold one JSON array of records, or one object of records by id; key is the position or the id.

    Digit keys can be sorted by their cast to long. Each file is one task: the
    format cannot be split.
    """
    ddl = _schema(schema).simpleString()
    text = spark.read.text(path, wholetext=True)
    arrays = text.where(F.ltrim("value").startswith("[")).select(F.posexplode(F.from_json("value", f"array<{ddl}>")).alias(key, "r"))
    objects = text.where(F.ltrim("value").startswith("{")).select(F.explode(F.from_json("value", f"map<string,{ddl}>")).alias(key, "r"))
    return arrays.withColumn(key, F.col(key).cast("string")).unionByName(objects).select(key, "r.*")


def read_file_per_record(spark: SparkSession, path: str, schema: StructType | str, done: DataFrame | None = None) -> DataFrame:
    """A folder tree of one JSON object a file: the records with id (file stem) and domain (folder). Ids in done are not returned."""
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.input_file_name()
    rows = text.select(F.regexp_extract(name, r"([^/]+)\.[^./]+$", 1).alias("id"), F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("domain"), F.from_json("value", _schema(schema)).alias("r"))
    rows = rows.where(F.col("r").isNotNull()).select("id", "domain", "r.*")
    return rows if done is None else rows.join(done.select("id").distinct(), "id", "left_anti").select(*rows.columns)


def write_json_lines(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite; by names columns that become folders."""
    df.write.mode("overwrite").partitionBy(*by).option("ignoreNullFields", False).json(path)


def append_json_lines(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("append").partitionBy(*by).option("ignoreNullFields", False).json(path)
