"""File sources: recursive listings, text files, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import glob_to_regex

PRUNED = r"/(\.git|node_modules|__pycache__|\.venv|dist|build)/"


def listing(spark: SparkSession, root: str, exclude: list[str] = (), glob: str = "*") -> DataFrame:
    """(path, length, modified) below a root, without pruned directories and excluded globs. Contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    df = df.select("path", "length", F.col("modificationTime").alias("modified")).where(~F.col("path").rlike(PRUNED))
    for g in exclude:
        df = df.where(~F.element_at(F.split("path", "/"), -1).rlike(glob_to_regex(g)))
    return df


def text_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(file, text) of whole text files."""
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; malformed ones are dropped."""
    schema = "ts string, actor string, name string, outcome string, score int"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def extensions(files: DataFrame) -> DataFrame:
    """Distinct lower-cased suffixes with counts."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("files")).where("ext <> ''")
