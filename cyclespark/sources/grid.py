"""Metadata and step plans from label/value grids (cell_id, r, c, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclespark.functions.scalars import leading_number
from cyclespark.schema import CELL

GRID_ROWS, GRID_COLUMNS = 10, 15


def cell_value(grid: DataFrame, wanted: DataFrame) -> DataFrame:
    """Value at each requested (cell_id, r, c); NULL outside the grid or when blank."""
    return wanted.join(_present(grid), ["cell_id", "r", "c"], "left")


def _present(grid: DataFrame) -> DataFrame:
    blank = F.lower(F.trim("value")).isin("", "nan")
    return grid.select("cell_id", "r", "c", F.when(~blank, F.col("value")).alias("value")).filter("value IS NOT NULL")


def cell_metadata(grid: DataFrame) -> DataFrame:
    """Mass, limits, cycle count, barcode and start time of each cell.

    A label at (r, c) is answered by (r, c+2), else (r, c+1); the last match
    wins.  Each value is sent to the labels it can answer, so one grouping by
    label position replaces three self-joins.
    """
    present = _present(grid)
    offers = present.select(
        "cell_id", "r", "value",
        F.inline(F.array(*[F.struct((F.col("c") - k).alias("c"), F.lit(k).alias("k")) for k in (0, 1, 2, 3)])),
    ).filter((F.col("c") >= 0) & (F.col("r") < GRID_ROWS) & (F.col("c") < GRID_COLUMNS - 2))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    labels = (
        offers.groupBy("cell_id", "r", "c")
        .agg(at(0).alias("label"), at(1).alias("v1"), at(2).alias("v2"), at(3).alias("v3"))
        .filter("label IS NOT NULL")
        .withColumn("label", F.lower(F.trim("label")))
        .withColumn("value", F.coalesce("v2", "v1"))
    )
    label = F.col("label")
    both = lambda a, b: label.contains(a) & label.contains(b)
    kind = (
        F.when(label.contains("active material"), "mass")
        .when(both("volt", "upper"), "upper")
        .when(both("volt", "lower"), "lower")
        .when(both("cycle", "count"), "cycles")
        .when(label.contains("barcode"), "barcode")
        .when(label.contains("start time"), "start")
    )
    number = leading_number(F.col("value"))
    long_enough = lambda c: F.when(F.length(F.trim(c)) > 3, F.trim(c))
    barcode = F.coalesce(long_enough("v2"), long_enough("v1"), long_enough("v3"))
    position = F.struct("r", "c")

    def last(of: str, value: Column, keep: Column | None = None) -> Column:
        ok = (F.col("kind") == of) & value.isNotNull()
        return F.max_by(value, F.when(ok & keep if keep is not None else ok, position))

    return (
        labels.withColumn("kind", kind)
        .groupBy(*CELL)
        .agg(
            last("mass", number, number > 0).alias("active_mass_mg"),
            last("upper", number).alias("voltage_upper_v"),
            last("lower", number).alias("voltage_lower_v"),
            last("cycles", F.col("value").try_cast("double").cast("int")).alias("cycle_count"),
            last("barcode", barcode).alias("barcode"),
            last("start", F.trim("value")).alias("test_start_date"),
        )
    )


def step_plan(grid: DataFrame) -> DataFrame:
    """C-rate and currents from the plan rows below the "step ... index" header.

    Column roles come from the header row.  A discharge step is recognised
    before a charge step, because "chg" is also part of "dchg".
    """
    present = _present(grid).withColumn("text", F.lower("value"))
    header = (
        present.filter(F.col("text").contains("step") & F.col("text").contains("index") & (F.col("c") < 3))
        .groupBy(*CELL)
        .agg(F.min("r").alias("header_r"))
    )
    below = present.join(header, CELL).filter("r >= header_r")
    t = F.col("text")
    role = (
        F.when((t.contains("c-rate") | t.contains("c_rate")) & ~t.contains("cut"), "rate")
        .when(t.contains("current") & ~t.contains("cut"), "current")
        .when(t.contains("step name") | t.contains("step_name"), "name")
    )
    roles = (
        below.filter((F.col("r") == F.col("header_r")) & (F.col("c") < GRID_COLUMNS))
        .withColumn("role", role)
        .filter("role IS NOT NULL")
        .groupBy(*CELL, "role")
        .agg(F.max("c").alias("c"))
    )
    values = below.filter("r > header_r").join(roles, ["cell_id", "c"])
    pick = lambda r: F.max(F.when(F.col("role") == r, F.col("text")))
    rows = values.groupBy("cell_id", "r").agg(pick("name").alias("name"), pick("rate").alias("rate"), pick("current").alias("current"))
    name = F.coalesce(F.col("name"), F.lit(""))
    discharge = name.contains("dchg") | name.contains("discharge")
    charge = ~discharge & (name.contains("chg") | name.contains("charge"))
    rate, current = F.col("rate").try_cast("double"), F.col("current").try_cast("double")
    last = lambda v, keep: F.max_by(v, F.when(keep & v.isNotNull(), F.col("r")))
    return rows.groupBy(*CELL).agg(
        F.coalesce(last(rate, charge), last(rate, discharge)).alias("c_rate"),
        last(current, charge).alias("charge_current_a"),
        last(current, discharge).alias("discharge_current_a"),
    )
