"""File inventory, checksums and configuration drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def find_files(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """Files below ``path`` with an extension; no content is read."""
    return _files(spark, path, f"*.{extension}").select("path", "length", F.col("modificationTime").alias("modified_at"))


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    )


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size, modification time, SHA-256 and an empty flag of every file."""
    return _files(spark, path, pattern).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        "path",
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.sha2("content", 256).alias("sha256"),
        (F.col("length") == 0).alias("empty"),
    )


def config_drift(start: DataFrame, end: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Settings whose value at the end of a run differs from that at its start."""
    a = start.select(key, F.col(value).alias("at_start"))
    b = end.select(key, F.col(value).alias("at_end"))
    return a.join(b, key, "full_outer").filter(~F.col("at_start").eqNullSafe(F.col("at_end")))
