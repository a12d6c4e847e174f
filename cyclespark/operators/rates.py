"""Rate blocks, rate capability and recovery after a rate excursion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cyclespark.functions.scalars import c_rate, format_c_rate
from cyclespark.operators.cycles import MIN_CYCLES_PER_RATE, unusable
from cyclespark.operators.ordered import scan_in_order
from cyclespark.schema import CELL, CYCLE

GROUPING_TOLERANCE = 0.05


def by_block():
    return Window.partitionBy(*CELL).orderBy("block")


def discharge_current(records: DataFrame, scale: float = 1.0) -> DataFrame:
    """Mean absolute discharge current of each cycle, in ampere after ``scale``."""
    return (
        records.filter("step = 'Discharge' AND current_a IS NOT NULL")
        .groupBy(*CYCLE)
        .agg((F.avg(F.abs("current_a")) * scale).alias("avg_current_a"))
    )


def group_by_rate(current: DataFrame, tolerance: float = GROUPING_TOLERANCE) -> DataFrame:
    """Number the runs of cycles whose current stays within ``tolerance`` of the run's mean."""

    def start():
        return {"sum": 0.0, "n": 0, "block": -1}

    def step(state, row):
        value = row.avg_current_a
        mean = state["sum"] / state["n"] if state["n"] else 0.0
        if state["n"] and mean > 0 and abs(value - mean) / mean <= tolerance:
            state["sum"] += value
            state["n"] += 1
        else:
            state.update(sum=value, n=1, block=state["block"] + 1)
        return row.cell_id, row.cycle, value, state["block"]

    return scan_in_order(
        current.select(*CYCLE, "avg_current_a"), CELL, ["cycle"], start, step,
        "cell_id string, cycle int, avg_current_a double, block int",
    )


def rate_groups(grouped: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per run of cycles at one rate with its C-rate."""
    groups = grouped.groupBy(*CELL, "block").agg(
        F.min("cycle").alias("first_cycle"),
        F.max("cycle").alias("last_cycle"),
        F.count(F.lit(1)).alias("n_cycles"),
        F.avg("avg_current_a").alias("mean_current_a"),
    )
    rate = c_rate(F.col("mean_current_a"), F.col("active_mass_mg"), F.col("theoretical_mAh_g"))
    return (
        groups.join(cells.select(*CELL, "active_mass_mg", "theoretical_mAh_g"), CELL, "left")
        .withColumn("c_rate", rate)
        .drop("active_mass_mg", "theoretical_mAh_g")
        .withColumn("is_block", F.col("n_cycles") >= MIN_CYCLES_PER_RATE)
    )


def rate_blocks(groups: DataFrame) -> DataFrame:
    """Rate groups of at least two cycles, labelled."""
    return groups.filter("is_block").drop("is_block").withColumn("label", format_c_rate(F.col("c_rate")))


def rate_protocol(groups: DataFrame, tolerance: float = GROUPING_TOLERANCE) -> DataFrame:
    """Per cell: number of blocks, variable or not, label, return to the first rate."""
    rate = F.when(F.col("is_block"), F.col("c_rate"))
    block = F.when(F.col("is_block"), F.col("block"))
    agg = groups.groupBy(*CELL).agg(
        F.count(block).alias("n_blocks"),
        F.sum(F.when(~F.col("is_block"), F.col("n_cycles")).otherwise(0)).alias("n_transition_cycles"),
        F.min(rate).alias("low"),
        F.max(rate).alias("high"),
        F.min_by("c_rate", block).alias("first_rate"),
        F.max_by("c_rate", block).alias("last_rate"),
    )
    variable = F.col("n_blocks") > 1
    return agg.select(
        *CELL,
        "n_blocks",
        "n_transition_cycles",
        variable.alias("is_variable"),
        F.when(
            variable & F.col("low").isNotNull(),
            F.concat(format_c_rate(F.col("low")), F.lit(" to "), format_c_rate(F.col("high"))),
        )
        .when(F.col("n_blocks") > 0, format_c_rate(F.col("first_rate")))
        .alias("label"),
        F.coalesce(
            (F.col("first_rate") > 0)
            & (F.abs(F.col("last_rate") - F.col("first_rate")) / F.col("first_rate") <= 2 * tolerance),
            F.lit(False),
        ).alias("returns_to_start"),
    )


def rate_block_labels(table: DataFrame, groups: DataFrame) -> DataFrame:
    """Block of each cycle of the cells with a variable rate; NULL on a transition cycle.

    The ranges are opened into cycles, so the join is an equi-join.
    """
    variable = rate_protocol(groups).filter("is_variable").select(*CELL)
    spans = rate_blocks(groups).select(
        *CELL, "block", F.explode(F.sequence("first_cycle", "last_cycle")).alias("cycle")
    )
    return table.select(*CYCLE).join(variable, CELL, "left_semi").join(spans, CYCLE, "left")


def describe_rate(protocol: DataFrame, cells: DataFrame) -> DataFrame:
    """Rate wording: the measured protocol first, the stated rate otherwise."""
    joined = cells.select(*CELL, "charge_rate_c").join(protocol, CELL, "left")
    stated = F.concat(F.col("charge_rate_c").cast("string"), F.lit(" C"))
    described = F.when(
        F.col("is_variable"), F.concat("label", F.lit(" ("), F.col("n_blocks").cast("string"), F.lit(" rate blocks)"))
    ).otherwise(F.col("label"))
    phrase = F.when(F.col("is_variable"), F.concat(F.lit("rates from "), "label")).otherwise(F.col("label"))
    return joined.select(
        *CELL,
        F.coalesce(phrase, stated, F.lit("an unstated rate")).alias("rate_phrase"),
        F.coalesce(described, stated).alias("rate_description"),
    )


def distinct_rates(groups: DataFrame, tolerance: float = GROUPING_TOLERANCE) -> DataFrame:
    """Number of rates of a cell that differ by more than ``tolerance`` (first seen wins)."""

    def step(seen, row):
        value = row.mean_current_a
        if not any(abs(value - s) / max(s, 1e-9) <= tolerance for s in seen):
            seen.append(value)
        return row.cell_id, row.block, len(seen)

    scanned = scan_in_order(
        groups.select(*CELL, "block", "mean_current_a"), CELL, ["block"], list, step,
        "cell_id string, block int, n int",
    )
    return scanned.groupBy(*CELL).agg(F.max("n").alias("n_distinct"))


def capacity_with_current(table: DataFrame, current: DataFrame) -> DataFrame:
    return table.filter(~unusable() & F.col("discharge_mAh_g").isNotNull()).select(*CYCLE, "discharge_mAh_g").join(
        current, CYCLE
    )


def rate_capability(table: DataFrame, grouped: DataFrame, cells: DataFrame) -> DataFrame:
    """Capacity statistics per rate block, share of the first block, and recovery."""
    groups = rate_groups(grouped, cells)
    several = distinct_rates(groups).filter("n_distinct >= 2").select(*CELL)
    merged = capacity_with_current(table, grouped.select(*CYCLE, "block")).groupBy(*CELL, "block").agg(
        F.avg("discharge_mAh_g").alias("mean_capacity"),
        F.stddev_samp("discharge_mAh_g").alias("sd_capacity"),
        F.count(F.lit(1)).alias("n_cycles"),
        F.min("cycle").alias("first_cycle"),
        F.max("cycle").alias("last_cycle"),
    )
    kept = (
        merged.filter(F.col("n_cycles") >= MIN_CYCLES_PER_RATE)
        .join(several, CELL, "left_semi")
        .join(groups.select(*CELL, "block", "mean_current_a", "c_rate"), [*CELL, "block"])
        .withColumn("n_kept", F.count(F.lit(1)).over(Window.partitionBy(*CELL)))
        .filter("n_kept >= 2")
        .withColumn("ref", F.first("mean_capacity").over(by_block()))
        .withColumn("first_rate", F.first("c_rate").over(by_block()))
        .withColumn("is_last", F.lead("block").over(by_block()).isNull())
    )
    share = F.col("mean_capacity") / F.col("ref") * 100.0
    back = F.abs(F.col("c_rate") - F.col("first_rate")) / F.greatest("first_rate", F.lit(1e-9)) <= 2 * GROUPING_TOLERANCE
    return kept.select(
        *CELL, "block", "mean_current_a", "c_rate", "mean_capacity", "sd_capacity", "n_cycles", "first_cycle",
        "last_cycle", share.alias("rate_capability_pct"),
        F.when(F.col("is_last") & back, share).alias("recovery_pct"),
    )


def rate_recovery(table: DataFrame, grouped: DataFrame, cells: DataFrame, formation: DataFrame | None = None) -> DataFrame:
    """Shared fade slope across rate blocks and what is left after the excursion.

    Log capacity is regressed on the cycle with one intercept per rate label
    and one common slope; demeaning per label gives the same slope without
    building a design matrix.
    """
    groups = rate_groups(grouped, cells)
    protocol = rate_protocol(groups).filter("is_variable AND returns_to_start AND n_blocks >= 3").select(*CELL)
    order = Window.partitionBy(*CELL).orderBy("block")
    blocks = (
        rate_blocks(groups)
        .join(protocol, CELL, "left_semi")
        .withColumn("from_start", F.row_number().over(order))
        .withColumn("from_end", F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("block"))))
    )
    role = F.when(F.col("from_start") == 1, "pre").when(F.col("from_end") == 1, "post").otherwise("ramp")
    points = (
        table.filter("discharge_mAh_g > 0")
        .select(*CYCLE, "discharge_mAh_g")
        .join(grouped.select(*CYCLE, "block"), CYCLE)
        .join(blocks.select(*CELL, "block", "label", "first_cycle", "last_cycle", role.alias("role")), [*CELL, "block"])
    )
    if formation is not None:
        points = points.join(formation.select(*CELL, "formation_end"), CELL, "left")
    else:
        points = points.withColumn("formation_end", F.lit(None).cast("int"))
    cell = Window.partitionBy(*CELL)
    points = points.withColumn(
        "f_end",
        F.coalesce("formation_end", F.max(F.when(F.col("role") == "pre", F.col("last_cycle"))).over(cell)),
    )
    fit = points.filter((F.col("role") == "ramp") & (F.col("cycle") > F.col("f_end")))
    label = Window.partitionBy(*CELL, "label")
    y = F.log("discharge_mAh_g")
    centred = fit.select(
        *CELL, "label", (y - F.avg(y).over(label)).alias("y"), (F.col("cycle") - F.avg("cycle").over(label)).alias("x")
    )
    sums = centred.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_fit"),
        F.countDistinct("label").alias("n_labels"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum(F.col("x") * F.col("y")).alias("sxy"),
        F.sum(F.col("y") * F.col("y")).alias("syy"),
    ).filter("n_labels >= 2 AND n_fit >= n_labels + 3 AND sxx > 0")
    pre_rank = Window.partitionBy(*CELL).orderBy("cycle")
    pre = points.filter("role = 'pre'").select(
        *CYCLE, "discharge_mAh_g", "last_cycle", "formation_end",
        F.row_number().over(pre_rank).alias("r"),
        F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("cycle"))).alias("r_end"),
    )
    body = lambda c: F.avg(F.when((F.col("n_pre") == 1) | (F.col("r") > 1), F.col(c)))
    pre = pre.withColumn("n_pre", F.count(F.lit(1)).over(cell))
    before = pre.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_pre"),
        F.avg("discharge_mAh_g").alias("pre_mean"),
        body("cycle").alias("body_cycle"),
        body("discharge_mAh_g").alias("body_capacity"),
        F.max(F.when(F.col("r_end") == 2, F.struct("cycle", "discharge_mAh_g"))).alias("second"),
        F.max(F.when(F.col("r_end") == 1, F.struct("cycle", "discharge_mAh_g"))).alias("final"),
        F.max("last_cycle").alias("pre_last"),
        F.max("formation_end").alias("formation_end"),
    )
    after = points.filter("role = 'post'").groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_post"),
        F.avg("discharge_mAh_g").alias("observed"),
        F.avg("cycle").alias("observed_cycle"),
    )
    joined = sums.join(before, CELL).join(after, CELL).filter("n_pre >= 2 AND n_post >= 2")
    slope = F.col("sxy") / F.col("sxx")
    dof = F.greatest(F.col("n_fit") - F.col("n_labels") - 1, F.lit(1))
    sd = F.sqrt(F.greatest(F.col("syy") - F.col("sxy") * slope, F.lit(0.0)) / dof)

    def ratio(cycle: Column, capacity: Column) -> Column:
        return 100.0 * F.col("observed") / (capacity * F.exp(slope * (F.col("observed_cycle") - cycle)))

    ratios = [
        ratio(F.col("body_cycle"), F.col("body_capacity")),
        ratio(F.col("second.cycle"), F.col("second.discharge_mAh_g")),
        ratio(F.col("final.cycle"), F.col("final.discharge_mAh_g")),
    ]
    return joined.select(
        *CELL,
        ((F.exp(slope) - 1) * 100.0).alias("fade_pct_per_cycle"),
        (sd / F.sqrt("sxx") * 100.0).alias("fade_se_pct"),
        (sd * 100.0).alias("residual_sd_pct"),
        "n_fit",
        (100.0 * F.col("observed") / F.col("pre_mean")).alias("q_recovery_pct"),
        "observed",
        "observed_cycle",
        F.least(*ratios).alias("bound_low_pct"),
        F.greatest(*ratios).alias("bound_high_pct"),
        F.coalesce(F.col("pre_last") <= F.col("formation_end"), F.lit(True)).alias("anchor_in_formation"),
    )
