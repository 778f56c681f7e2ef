"""Sources: text and CSV files of several encodings as rows."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import split_lines
from . import scratch


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text: a byte order mark or valid UTF-8, else Big5 with what it lacks replaced. Spark's own decode has no Big5."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return bytes(b).decode("utf-8-sig")
        except UnicodeDecodeError:
            return bytes(b).decode("big5", errors="replace")

    return content.map(one)


def text_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, pos, line) of text files. A file is one row of at most 2 GB: larger ones are for spark.read.text."""
    files = spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("text"))
    return files.select("path", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))


def csv_records(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """Rows of CSV files with a header, quoted fields of several lines included, all columns as text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).option("inferSchema", False).csv(path)


@F.pandas_udf(StringType())
def encoding_of(content: pd.Series) -> pd.Series:
    """UTF-8 if the bytes are, else Big5."""

    def one(b: bytes | None) -> str:
        try:
            bytes(b or b"").decode("utf-8-sig")
            return "UTF-8"
        except UnicodeDecodeError:
            return "Big5"

    return content.map(one)


def csv_of_any(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """csv_records of files that are UTF-8, with or without a byte order mark, or Big5, told file by file; columns that a file lacks are null.

    The names and encodings of the files come to the driver, a short row for each. Spark's reader has no Big5: such files are written again as UTF-8, each
    one whole, to the shared folder.
    """
    files = spark.read.format("binaryFile").load(path)
    told = files.select("path", encoding_of("content").alias("encoding")).collect()
    plain, other = ([r["path"] for r in told if (r["encoding"] == "UTF-8") is is_plain] for is_plain in (True, False))
    parts = [csv_records(spark, plain)] if plain else []
    if other:
        again = scratch.folder(spark, "csv")
        spark.read.format("binaryFile").load(other).select(decoded("content").alias("value"), F.monotonically_increasing_id().alias("_file")).write.partitionBy("_file").text(again)
        parts.append(csv_records(spark, again).drop("_file"))
    if not parts:
        raise ValueError(f"no files in {path}")
    out = [p.toDF(*(c.lstrip("\ufeff") for c in p.columns)) for p in parts]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def json_records(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """Objects of JSON arrays or lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def listing(spark: SparkSession, path: str | Sequence[str], pattern: str = "*") -> DataFrame:
    """(path, size, modified) of all files under a folder, whose contents are not read; Spark leaves out files without a byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def usage_by_folder(files: DataFrame, root: str) -> DataFrame:
    """(owner, files, bytes, oldest) of a listing: the owner is the folder right under root, '' for files that lie in root itself."""
    inner = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", "")
    owner = F.when(inner.contains("/"), F.substring_index(inner, "/", 1)).otherwise("")
    return files.groupBy(owner.alias("owner")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.min("modified").alias("oldest"))
