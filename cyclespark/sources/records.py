"""Record scans: cycler exports to the canonical record table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclespark.operators.clean import tidy_steps
from cyclespark.schema import CANONICAL, EXPORT_SCHEMA


def read_exports(spark: SparkSession, path: str, extension: str = "csv") -> DataFrame:
    """All exports below ``path``; every column is text, the cell is named by its file."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}")
    if extension == "csv":
        raw = reader.option("header", "true").schema(EXPORT_SCHEMA).csv(path)
    else:
        raw = reader.schema(EXPORT_SCHEMA).parquet(path)
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    return raw.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("cell_id"), "*")


def scan_records(export: DataFrame) -> DataFrame:
    """Canonical names and types; text that is not a number (or a NaN) becomes NULL."""

    def typed(source: str, kind: str):
        c = F.col(f"`{source}`")
        if kind == "string":
            return c
        if kind == "timestamp":
            return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))
        value = c.try_cast(kind)
        return F.when(~F.isnan(value), value) if kind == "double" else value

    names = [
        (typed(s, k) if s in export.columns else F.lit(None).cast(k)).alias(n) for s, (n, k) in CANONICAL.items()
    ]
    return tidy_steps(export.select("cell_id", *names))


def write_records(records: DataFrame, path: str) -> None:
    """Store records by cycle bucket, so that cycle filters prune files."""
    (
        records.withColumn("cycle_bucket", F.floor(F.col("cycle") / 100).cast("int"))
        .write.mode("overwrite")
        .partitionBy("cycle_bucket")
        .parquet(path)
    )
