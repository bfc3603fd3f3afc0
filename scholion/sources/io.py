"""Readers and writers of the formats in use: tables by format, whole files, lines, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, form: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A table of one of FORMATS; a schema spares the pass that infers one."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}; known are {', '.join(FORMATS)}")
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, bytes, content): a row for every file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")


def file_kind(content):
    """pdf, zip, html or text, by the first bytes of a file's content."""
    head = F.substring(content, 1, 5)
    text = F.lower(F.ltrim(F.substring(content, 1, 200).cast("string")))
    return F.when(head == F.lit(b"%PDF-"), "pdf").when(F.substring(content, 1, 2) == F.lit(b"PK"), "zip").when(text.rlike(r"^<(!doctype html|html)"), "html").otherwise("text")


def write(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """The table written in one of FORMATS, in folders by the columns of `by` if any."""
    writer = df.write.format(form).mode(mode)
    (writer.partitionBy(*by) if by else writer).save(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same key, and new keys added."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
