"""Ordered-sequence building blocks that survive a hot half-cycle.

Record order matters inside a half-cycle, and a window over a half-cycle puts
it into one task.  ``with_slices`` first checks sizes.  When every half-cycle
is ordinary the operators use plain windows: one shuffle, one sort.  When some
half-cycle is above ``SLICE_RECORDS`` the records get a ``slice`` column (a
range of the order), windows run inside a slice, and what crosses a slice
border (previous record, running total, last flagged record) is carried by a
table with one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cyclespark.schema import HALF, SLICED

SLICE_RECORDS = 4_000_000


_SIZES: dict[tuple, tuple[int, int]] = {}


def uncut(records: DataFrame) -> DataFrame:
    """Records as one piece per half-cycle.

    For orders other than the record order (voltage, charge): a plateau puts
    nearly all records at a few values, so ranges of such an order don't split
    it; these operators sort a half-cycle in one task, which spills.
    """
    return records.drop("slice").withColumn("n_slices", F.lit(1))


def _sizes(records: DataFrame) -> DataFrame:
    return records.groupBy(*HALF).agg(F.count("seq").alias("n"), F.min("seq").alias("slice_lo"), F.max("seq").alias("slice_hi"))


def _most(records: DataFrame) -> tuple[int, int]:
    """Records of the longest half-cycle, and of the longest one that can be cut: one aggregation over the key columns per input."""
    key = (records.sparkSession.sparkContext.applicationId, records.select(*HALF, "seq").semanticHash())
    if key not in _SIZES:
        most = _sizes(records).agg(F.max("n"), F.max(F.when(F.col("slice_hi") > F.col("slice_lo"), F.col("n")))).first()
        _SIZES[key] = (most[0] or 0, most[1] or 0)
    return _SIZES[key]


def longest(records: DataFrame) -> int:
    """Records of the longest half-cycle."""
    return _most(uncut(records).drop("n_slices"))[0]


def with_slices(records: DataFrame, limit: int = SLICE_RECORDS) -> DataFrame:
    """Add ``n_slices``, and ``slice`` when some half-cycle has more than ``limit`` records.

    The size check is one aggregation over the key columns, done once per
    input.  The broadcast side of the cut has one short row per half-cycle
    above the limit, so never more than (all records / limit) rows.  Slices are
    ranges of the record number, which runs on without gaps in a half-cycle.
    """
    by = "seq"
    records = uncut(records).drop("n_slices")
    if _most(records)[1] <= limit:
        return records.withColumn("n_slices", F.lit(1))
    parts = F.ceil(F.col("n") / F.lit(limit)).cast("int")
    hot = (
        _sizes(records)
        .filter((F.col("n") > limit) & (F.col("slice_hi") > F.col("slice_lo")))
        .select(*HALF, "slice_lo", "slice_hi", parts.alias("parts"))
    )
    position = (F.col(by) - F.col("slice_lo")) / (F.col("slice_hi") - F.col("slice_lo"))
    cut = F.least(F.floor(position * F.col("parts")), F.col("parts") - 1)
    return (
        records.join(F.broadcast(hot), HALF, "left")
        .withColumn("slice", F.coalesce(cut, F.lit(0)).cast("int"))
        .withColumn("n_slices", F.coalesce(F.col("parts"), F.lit(1)).cast("int"))
        .drop("slice_lo", "slice_hi", "parts")
    )


def sliced(df: DataFrame) -> DataFrame:
    return df if "n_slices" in df.columns else with_slices(df)


def is_cut(df: DataFrame) -> bool:
    return "slice" in df.columns


def parts(df: DataFrame) -> list[str]:
    """Partition keys of the ordered windows over ``df``."""
    return SLICED if is_cut(df) else HALF


def _over_slices():
    return Window.partitionBy(*HALF).orderBy("slice")


def _hot(df: DataFrame) -> DataFrame:
    return df.filter(F.col("n_slices") > 1)


def with_previous(df: DataFrame, columns: dict[str, str], by: tuple = ("seq",)) -> DataFrame:
    """Add the previous record's value of each column (``{source: new name}``).

    ``has_previous`` tells a first record from a NULL value.
    """
    w = Window.partitionBy(*parts(df)).orderBy(*by)
    lags = [F.lag(s).over(w).alias(n) for s, n in columns.items()]
    if not is_cut(df):
        return df.select("*", *lags, (F.row_number().over(w) > 1).alias("has_previous"))
    last = (
        _hot(df)
        .groupBy(*SLICED)
        .agg(F.max_by(F.struct(*columns), F.struct(*by)).alias("edge"))
        .select(*SLICED, F.lag("edge").over(_over_slices()).alias("edge"))
    )
    out = df.select("*", *lags, F.row_number().over(w).alias("_rn")).join(last, SLICED, "left")
    first = F.col("_rn") == 1
    return out.withColumns(
        {n: F.when(first, F.col("edge")[s]).otherwise(F.col(n)) for s, n in columns.items()}
        | {"has_previous": ~first | F.col("edge").isNotNull()}
    ).drop("_rn", "edge")


def with_running(df: DataFrame, fold: str, source: str, name: str, by: tuple = ("seq",)) -> DataFrame:
    """Add the inclusive running ``sum``, ``max`` or ``min`` of ``source`` in record order."""
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[fold]
    w = Window.partitionBy(*parts(df)).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn(name, agg(source).over(w))
    if not is_cut(df):
        return out
    carry = (
        _hot(df)
        .groupBy(*SLICED)
        .agg(agg(source).alias("_t"))
        .select(*SLICED, agg("_t").over(_over_slices().rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    )
    out = out.join(carry, SLICED, "left")
    if fold == "sum":
        total = F.when(F.col("_c").isNull(), F.col(name)).otherwise(F.coalesce(F.col(name), F.lit(0)) + F.col("_c"))
    else:
        total = (F.greatest if fold == "max" else F.least)(name, "_c")
    return out.withColumn(name, total).drop("_c")


def with_totals(df: DataFrame, **aggs: Column) -> DataFrame:
    """Add half-cycle aggregates to every record.

    Ordinary data: a window over the half-cycle, sharing the shuffle of the
    ordered windows.  Cut data: a partial aggregation joined back per slice.
    """
    if not is_cut(df):
        w = Window.partitionBy(*HALF)
        return df.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    return attach(df, df.groupBy(*HALF).agg(slices(), *[a.alias(n) for n, a in aggs.items()]))


def attach(df: DataFrame, scalars: DataFrame, how: str = "inner") -> DataFrame:
    """Join a one-row-per-half-cycle table (holding ``n_slices``) back to the records.

    On cut data the table is repeated once per slice and joined on the slice,
    so a hot half-cycle stays spread out and the window shuffle is reused.
    """
    if not is_cut(df):
        return df.join(scalars.drop("n_slices"), HALF, how)
    repeated = scalars.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1))).drop("n_slices")
    return df.join(repeated, SLICED, how)


def slices() -> Column:
    """Add this to a per-half-cycle aggregation whose result will be attached."""
    return F.max("n_slices").alias("n_slices")


def scan_in_order(df: DataFrame, keys: list[str], order: list[str], start, step, schema: str) -> DataFrame:
    """Sequential scan of each key's rows with a small state (cycle-level tables).

    For rules where each row depends on decisions about earlier rows.  Rows
    stream through in Arrow batches, so memory is the state, not the group.
    ``start()`` makes a state; ``step(state, row)`` returns the output row.
    """
    columns = [f.split()[0] for f in schema.split(",")]

    def run(batches):
        import pandas as pd

        key, state = None, None
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                this = tuple(getattr(row, k) for k in keys)
                if this != key:
                    key, state = this, start()
                rows.append(step(state, row))
            yield pd.DataFrame(rows, columns=columns)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
