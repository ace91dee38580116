"""Readers: parquet tables, tolerant JSON lines, and JSON documents with their file facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"
#: Rows and bytes of a batch that Python gets at most: a task holds few batches at a time, in the JVM and in Python.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
#: While it is set, a statement's shuffle files go when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """From here on the session sends Python small batches. Entry points call this; operators leave the session as it is."""
    for name, most in BATCHES.items():
        now = spark.conf.get(name).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def reread(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read back. The shuffle files that made the table go with the statement that writes it."""
    spark = df.sparkSession
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: StructType, tolerant: bool = True) -> DataFrame:
    """One row a line; blank lines are skipped, and bad ones too if tolerant (else they fail)."""
    if not tolerant:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kept = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    # the corrupt column alone can't be filtered on before the rows are parsed
    rows = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.select("*").filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def json_documents(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """One row for each *.json file of a folder, with path, bytes and time of change; unreadable files are skipped."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(folder)
    return rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified_at"))


def exploded_entries(manifest: DataFrame, column: str = "entries") -> DataFrame:
    """The rows inside an envelope's array of structs."""
    return manifest.select(F.inline(column))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def text_documents(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """path, text of each text file of a folder, whole."""
    return spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def last_rows(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The last n rows in an order: the end of a log."""
    return rows.orderBy(*[F.desc(c) for c in by]).limit(n)


def first_usable(candidates: DataFrame, key: str, priority: str, usable: str) -> DataFrame:
    """Of each key's candidate sources the one of least priority that is usable, as its row; keys without one are left out."""
    best = candidates.filter(F.col(usable)).groupBy(key).agg(F.min(F.struct(F.col(priority), F.struct("*"))).alias("best"))
    return best.select("best.col2.*")
