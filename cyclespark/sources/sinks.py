"""Table sinks; every writer is a plain partitioned DataFrame write."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition: str | None = None) -> None:
    """Write a result table; one directory per ``partition`` value when given."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition:
        writer = writer.partitionBy(partition)
    writer.save(path)


def write_cell_tables(integrity: DataFrame, terminations: DataFrame, path: str, fmt: str = "csv") -> None:
    """Integrity and early-termination tables, one directory per cell."""
    write_table(integrity.repartition("cell_id"), f"{path}/integrity", fmt, "cell_id")
    write_table(terminations.repartition("cell_id"), f"{path}/early_terminations", fmt, "cell_id")


def write_summaries(run_summary: DataFrame, replicate_summary: DataFrame, path: str, fmt: str = "csv") -> None:
    write_table(run_summary, f"{path}/run_summary", fmt)
    write_table(replicate_summary, f"{path}/replicate_summary", fmt)
