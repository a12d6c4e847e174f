"""Per-cycle capacity, efficiency, energy, power, retention and fade tables."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cyclespark.operators.ordered import scan_in_order, uncut, with_previous
from cyclespark.schema import CELL, CYCLE, HALF

RETENTION_REFERENCE_CYCLE = 2
DIAGNOSTIC_START_CYCLE = 4
VISUAL_OUTLIER_FRACTION = 0.30
ROLLING_WINDOW = 100
MIN_CYCLES_PER_RATE = 2


def by_cycle():
    return Window.partitionBy(*CELL).orderBy("cycle")


def median(column: str | Column) -> Column:
    """Exact median; partial aggregation keeps (value, count) pairs."""
    return F.percentile(column, 0.5)


def used_capacity() -> Column:
    """Charge passed, as an aggregate over the records of a half-cycle."""
    return F.when(F.count("capacity") >= 2, F.max("capacity") - F.min("capacity"))


def half_capacity(records: DataFrame) -> DataFrame:
    """Charge passed in a half-cycle by the step's own counter."""
    return records.groupBy(*HALF).agg(used_capacity().alias("capacity_mAh_g"))


def delivered_capacity(records: DataFrame) -> DataFrame:
    """Charge and discharge capacity of each cycle, side by side."""

    def span(step: str, column: str) -> Column:
        value = F.when(F.col("step") == step, F.col(column))
        return F.max(value) - F.min(value)

    return (
        records.filter("charge_capacity IS NOT NULL OR discharge_capacity IS NOT NULL")
        .groupBy(*CYCLE)
        .agg(
            span("Charge", "charge_capacity").alias("charge_mAh_g"),
            span("Discharge", "discharge_capacity").alias("discharge_mAh_g"),
        )
    )


def coulombic_efficiency(discharge: str = "discharge_mAh_g", charge: str = "charge_mAh_g") -> Column:
    d, c = F.col(discharge), F.col(charge)
    return F.when((c > 0) & (d > 0), d / c * 100.0)


def unusable() -> Column:
    return F.coalesce("incomplete", F.lit(False)) | F.coalesce("partial_final", F.lit(False))


def cycling_summary(records: DataFrame, in_progress: DataFrame | None = None) -> DataFrame:
    """Cycle table: capacities, efficiency, flags, retention and charge excess.

    ``in_progress`` holds the half-cycles still running at export
    (cell_id, cycle, step).
    """
    table = delivered_capacity(records).select(
        "*",
        coulombic_efficiency().alias("ce_pct"),
        F.coalesce(F.col("discharge_mAh_g") <= 0, F.lit(True)).alias("incomplete"),
    )
    if in_progress is None:
        table = table.withColumn("partial_final", F.lit(False))
    else:
        running = in_progress.select(*CYCLE).distinct().withColumn("partial_final", F.lit(True))
        table = table.join(running, CYCLE, "left").withColumn(
            "partial_final", F.coalesce("partial_final", F.lit(False))
        )
    complete = F.when(~F.col("incomplete"), F.col("discharge_mAh_g"))
    reference = table.groupBy(*CELL).agg(
        F.coalesce(
            F.max(F.when(F.col("cycle") == RETENTION_REFERENCE_CYCLE, complete)),
            F.min_by(complete, F.when(~F.col("incomplete"), F.col("cycle"))),
        ).alias("reference_mAh_g")
    )
    return table.join(reference, CELL, "left").select(
        *CYCLE,
        "charge_mAh_g",
        "discharge_mAh_g",
        "ce_pct",
        "incomplete",
        "partial_final",
        F.when(F.col("reference_mAh_g") > 0, F.col("discharge_mAh_g") / F.col("reference_mAh_g") * 100.0).alias(
            "retention_pct"
        ),
        (F.col("charge_mAh_g") - F.col("discharge_mAh_g")).alias("charge_excess_mAh_g"),
    )


def energy_by_half(records: DataFrame) -> DataFrame:
    """Trapezoidal energy (integral of V dQ, ordered by charge) per half-cycle."""
    points = uncut(records.filter("voltage IS NOT NULL AND capacity IS NOT NULL"))
    pairs = with_previous(points, {"voltage": "v0", "capacity": "q0"}, by=("capacity", "seq"))
    area = (F.col("voltage") + F.col("v0")) / 2 * (F.col("capacity") - F.col("q0"))
    return pairs.groupBy(*HALF).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.sum(area).alias("energy"),
        (F.max("capacity") - F.min("capacity")).alias("span"),
    )


def mean_discharge_voltage(records: DataFrame) -> DataFrame:
    """Energy-weighted mean discharge voltage, from at least three points."""
    return (
        energy_by_half(records.filter("step = 'Discharge'"))
        .filter("n_points >= 3 AND span > 0")
        .select(*CYCLE, (F.col("energy") / F.col("span")).alias("avg_discharge_voltage_v"))
    )


def energy_efficiency(records: DataFrame) -> DataFrame:
    """Energies, energy and voltage efficiency, mean voltages and the CE-EE gap."""
    energy = F.when(F.col("n_points") >= 3, F.abs("energy"))
    energies = (
        energy_by_half(records)
        .groupBy(*CYCLE)
        .agg(
            F.max(F.when(F.col("step") == "Discharge", energy)).alias("discharge_energy"),
            F.max(F.when(F.col("step") == "Charge", energy)).alias("charge_energy"),
        )
    )
    joined = energies.join(delivered_capacity(records), CYCLE, "left")

    def ratio(a: str, b: str, scale: float = 1.0) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b) * scale)

    return (
        joined.withColumn("energy_efficiency_pct", ratio("discharge_energy", "charge_energy", 100.0))
        .withColumn("ce_pct", coulombic_efficiency())
        .withColumn("avg_charge_voltage_v", ratio("charge_energy", "charge_mAh_g"))
        .withColumn("avg_discharge_voltage_v", ratio("discharge_energy", "discharge_mAh_g"))
        .withColumn("voltage_efficiency_pct", ratio("avg_discharge_voltage_v", "avg_charge_voltage_v", 100.0))
        .withColumn("ce_ee_gap_pct", F.col("ce_pct") - F.col("energy_efficiency_pct"))
    )


def discharge_voltage_drift(records: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Mean discharge voltage with delivered capacity and drift from cycle 2."""
    base = (
        energy_by_half(records.filter("step = 'Discharge'"))
        .filter("n_points >= 3 AND span > 0")
        .select(
            *CYCLE,
            (F.col("energy") / F.col("span")).alias("avg_discharge_voltage_v"),
            F.col("span").alias("discharge_mAh_g"),
        )
    )
    if table is not None:
        base = base.join(table.filter(unusable()).select(*CYCLE), CYCLE, "left_anti")
    reference = base.groupBy(*CELL).agg(
        F.max(F.when(F.col("cycle") == RETENTION_REFERENCE_CYCLE, F.col("avg_discharge_voltage_v"))).alias("v_ref")
    )
    drift = (F.col("avg_discharge_voltage_v") - F.col("v_ref")) * 1000.0
    span = F.col("cycle") - RETENTION_REFERENCE_CYCLE
    return base.join(reference, CELL, "left").select(
        *CYCLE,
        "avg_discharge_voltage_v",
        "discharge_mAh_g",
        drift.alias("drift_mv"),
        F.when(F.col("v_ref").isNotNull(), F.when(span > 0, drift / span).otherwise(F.lit(0.0))).alias(
            "drift_mv_per_cycle"
        ),
    )


def active_fraction(blend: str = "blend") -> Column:
    """First part of an "80/10/10" blend over its sum; 0.8 when it cannot be read."""
    parts = F.transform(F.split(F.col(blend), "/"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.when(total > 0, F.element_at(parts, 1) / total), F.lit(0.8))


def electrode_area_cm2(diameter_mm: str = "electrode_diameter_mm", default_mm: float = 12.0) -> Column:
    radius = F.coalesce(F.col(diameter_mm), F.lit(default_mm)) / 2 / 10
    return F.lit(3.141592653589793) * radius * radius


def power_and_energy(records: DataFrame, cells: DataFrame) -> DataFrame:
    """Peak specific energy and power of each discharge on three bases."""
    peak = (
        records.filter("step = 'Discharge' AND discharge_energy IS NOT NULL AND power_w IS NOT NULL")
        .groupBy(*CYCLE)
        .agg(F.max(F.abs("discharge_energy")).alias("e"), F.max(F.abs("power_w")).alias("p"))
    )
    dims = cells.select(
        *CELL,
        (F.col("active_mass_mg") / 1000.0).alias("mass_g"),
        active_fraction().alias("fraction"),
        electrode_area_cm2().alias("area"),
    )
    return peak.join(dims, CELL, "left").select(
        *CYCLE,
        F.col("e").alias("energy_wh_kg_active"),
        F.when(F.col("mass_g").isNotNull(), F.col("e") * F.col("fraction")).alias("energy_wh_kg_electrode"),
        (F.col("e") * F.col("mass_g") / F.col("area")).alias("energy_mwh_cm2"),
        F.col("p").alias("power_w"),
        (F.col("p") / F.col("mass_g") * 1000.0).alias("power_mw_g_active"),
        (F.col("p") / (F.col("mass_g") / F.col("fraction")) * 1000.0).alias("power_mw_g_electrode"),
        (F.col("p") / F.col("area") * 1000.0).alias("power_mw_cm2"),
    )


RAGONE_BASIS = {
    "active": ("energy_wh_kg_active", "power_mw_g_active"),
    "electrode": ("energy_wh_kg_electrode", "power_mw_g_electrode"),
    "area": ("energy_mwh_cm2", "power_mw_cm2"),
}


def ragone_points(power: DataFrame, cells: DataFrame, basis: str = "active") -> DataFrame:
    """Energy/power pairs on one basis with key cycles marked."""
    e, p = RAGONE_BASIS[basis]
    return (
        power.filter(F.col(e).isNotNull() & F.col(p).isNotNull())
        .join(cells.select(*CELL, "key_cycles"), CELL, "left")
        .select(
            *CYCLE,
            F.col(e).alias("energy"),
            F.col(p).alias("power"),
            F.coalesce(F.array_contains("key_cycles", F.col("cycle")), F.lit(False)).alias("is_key_cycle"),
        )
    )


def areal_capacity(table: DataFrame, cells: DataFrame) -> DataFrame:
    """Discharge capacity per electrode area from usable cycles."""
    dims = cells.select(*CELL, (F.col("active_mass_mg") / 1000.0).alias("mass_g"), electrode_area_cm2().alias("area"))
    return (
        table.filter(~unusable() & F.col("discharge_mAh_g").isNotNull())
        .join(dims, CELL)
        .select(*CYCLE, (F.col("discharge_mAh_g") * F.col("mass_g") / F.col("area")).alias("areal_mAh_cm2"))
    )


def cell_health_flags(table: DataFrame, records: DataFrame) -> DataFrame:
    """One row per health flag: trends of CE and charge excess, contact failure, death."""
    good = table.filter(~F.col("incomplete") & ~F.col("partial_final") & (F.col("cycle") >= DIAGNOSTIC_START_CYCLE))
    recent = Window.partitionBy(*CELL).orderBy(F.desc("cycle"))
    with_ce = good.filter("ce_pct IS NOT NULL").select(
        *CYCLE,
        "ce_pct",
        F.lag("ce_pct").over(by_cycle()).alias("ce_before"),
        F.row_number().over(recent).alias("from_end"),
    )
    ce = with_ce.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_ce"),
        F.regr_slope("ce_pct", "cycle").alias("ce_slope"),
        F.sum(F.when((F.col("from_end") <= 4) & (F.col("ce_pct") < F.col("ce_before")), 1).otherwise(0)).alias("falls"),
    )
    excess = good.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_good"),
        F.count("charge_excess_mAh_g").alias("n_excess"),
        F.regr_slope("charge_excess_mAh_g", "cycle").alias("excess_slope"),
    )
    trend = excess.join(ce, CELL, "left").filter("n_good >= 4")
    monotone = F.col("falls") >= F.least(F.lit(5), F.col("n_ce")) - 1
    flags_ce = trend.filter("n_ce >= 4 AND ce_slope < -0.3").select(
        *CELL,
        F.when((F.col("ce_slope") < -0.5) & monotone, "CRITICAL").otherwise("WARNING").alias("severity"),
        F.lit("ce_trend").alias("flag"),
        F.col("ce_slope").alias("value"),
    )
    flags_excess = trend.filter("n_excess >= 4 AND excess_slope > 0.1").select(
        *CELL,
        F.when(F.col("excess_slope") > 0.3, "CRITICAL").otherwise("WARNING").alias("severity"),
        F.lit("charge_excess_trend").alias("flag"),
        F.col("excess_slope").alias("value"),
    )
    last = table.groupBy(*CELL).agg(
        F.max("cycle").alias("cycle"),
        F.max_by(F.struct("charge_mAh_g", "discharge_mAh_g", unusable().alias("bad")), "cycle").alias("r"),
    ).filter("NOT r.bad")
    died = last.filter("r.charge_mAh_g > 0 AND (r.discharge_mAh_g IS NULL OR r.discharge_mAh_g < 1.0)").select(
        *CELL, F.lit("FAILURE").alias("severity"), F.lit("died_on_discharge").alias("flag"),
        F.col("r.charge_mAh_g").alias("value"),
    )
    ends = records.groupBy(*HALF).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("voltage", "seq").alias("v_first"),
        F.max_by("voltage", "seq").alias("v_last"),
    )
    spike = (
        last.select(*CYCLE)
        .join(ends.filter("step = 'Discharge' AND n <= 3").select(*CYCLE, "v_first"), CYCLE)
        .join(ends.filter("step = 'Charge'").select(*CYCLE, "v_last"), CYCLE)
        .filter(F.col("v_first") > F.col("v_last") + 0.1)
        .select(
            *CELL, F.lit("FAILURE").alias("severity"), F.lit("open_circuit").alias("flag"),
            F.col("v_first").alias("value"),
        )
    )
    return flags_ce.unionByName(flags_excess).unionByName(spike).unionByName(died)


def headline_metrics(table: DataFrame) -> DataFrame:
    """First-cycle loss, last capacity and retention against cycles 1 and 2 per cell."""
    ok = ~unusable()
    at = lambda n, column, keep: F.max(F.when((F.col("cycle") == n) & keep, F.col(column)))
    last_cycle = F.max(F.when(ok, F.col("cycle")))
    base = table.groupBy(*CELL).agg(
        at(1, "charge_mAh_g", ~F.col("incomplete")).alias("q1"),
        at(1, "discharge_mAh_g", ~F.col("incomplete")).alias("d1"),
        at(1, "discharge_mAh_g", ok).alias("r1"),
        at(RETENTION_REFERENCE_CYCLE, "discharge_mAh_g", ok).alias("r2"),
        last_cycle.alias("last_cycle"),
        F.max_by("discharge_mAh_g", F.when(ok, F.col("cycle"))).alias("last_mAh_g"),
    )
    loss = F.when(F.col("q1") > 0, F.col("q1") - F.col("d1"))
    return base.select(
        *CELL,
        loss.alias("first_cycle_loss_mAh_g"),
        (loss / F.col("q1") * 100.0).alias("first_cycle_loss_pct"),
        F.when(F.col("q1") > 0, F.col("d1") / F.col("q1") * 100.0).alias("first_cycle_ce_pct"),
        "last_cycle",
        "last_mAh_g",
        F.when(F.col("r1") != 0, 100.0 * F.col("last_mAh_g") / F.col("r1")).alias("retention_vs_1_pct"),
        F.when(F.col("r2") != 0, 100.0 * F.col("last_mAh_g") / F.col("r2")).alias("retention_vs_2_pct"),
    )


def stable_efficiency(table: DataFrame, formation: DataFrame, fallback_start: int = 2) -> DataFrame:
    """Mean and sd of CE and linear fade rate after formation (cell_id, formation_end)."""
    start = F.coalesce(F.col("formation_end"), F.lit(fallback_start))
    stable = (
        table.filter(~unusable())
        .join(formation.select(*CELL, "formation_end"), CELL, "left")
        .withColumn("start", start)
        .filter(F.col("cycle") >= F.col("start"))
    )
    agg = stable.groupBy(*CELL, "start").agg(
        F.avg("ce_pct").alias("mean_ce_pct"),
        F.stddev_samp("ce_pct").alias("sd_ce_pct"),
        F.max("cycle").alias("last_cycle"),
        F.count("discharge_mAh_g").alias("n"),
        F.regr_slope("discharge_mAh_g", "cycle").alias("slope"),
        F.min_by("discharge_mAh_g", F.when(F.col("discharge_mAh_g").isNotNull(), F.col("cycle"))).alias("base"),
    )
    enough = F.col("n") >= 3
    return agg.select(
        *CELL,
        F.col("start").alias("start_cycle"),
        "last_cycle",
        "mean_ce_pct",
        "sd_ce_pct",
        F.when(enough, F.col("slope")).alias("fade_mAh_g_per_cycle"),
        F.when(enough & (F.col("base") > 0), F.col("slope") / F.col("base") * 100.0).alias("fade_pct_per_cycle"),
    )


def capacity_retention_pct(table: DataFrame, reference_cycle: int | None = None) -> DataFrame:
    """Median of the last three over median of the first three good discharges, %."""
    good = table.filter(~F.col("incomplete") & (F.col("discharge_mAh_g") > 0))
    if reference_cycle is not None:
        good = good.filter(F.col("cycle") >= reference_cycle)
    ranked = good.select(
        *CELL,
        "discharge_mAh_g",
        F.row_number().over(by_cycle()).alias("first"),
        F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("cycle"))).alias("last"),
    )
    agg = ranked.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"),
        median(F.when(F.col("first") <= 3, F.col("discharge_mAh_g"))).alias("a"),
        median(F.when(F.col("last") <= 3, F.col("discharge_mAh_g"))).alias("b"),
    )
    return agg.select(
        *CELL, F.when((F.col("n") >= 2) & (F.col("a") > 0), F.col("b") / F.col("a") * 100.0).alias("retention_pct")
    )


def flag_prefix_outliers(table: DataFrame, fraction: float = VISUAL_OUTLIER_FRACTION) -> DataFrame:
    """Flag a capacity below ``fraction`` of the median of the values accepted before it."""

    def step(accepted, row):
        value = row.discharge_mAh_g
        missing = value is None or value != value
        flag = missing
        if not missing:
            n = len(accepted)
            if n >= 3:
                mid = accepted[n // 2] if n % 2 else (accepted[n // 2 - 1] + accepted[n // 2]) / 2
                flag = value < fraction * mid
            if not flag:
                bisect.insort(accepted, value)
        return row.cell_id, row.cycle, None if missing else value, bool(flag)

    return scan_in_order(
        table.select(*CYCLE, "discharge_mAh_g"), CELL, ["cycle"], list, step,
        "cell_id string, cycle int, discharge_mAh_g double, is_outlier boolean",
    )


def flag_block_outliers(table: DataFrame, labels: DataFrame, fraction: float = VISUAL_OUTLIER_FRACTION) -> DataFrame:
    """Flag a capacity below ``fraction`` of the median of the other cycles of its rate block.

    ``labels`` gives the block of each cycle; NULL (a rate transition) is never
    flagged.  The leave-one-out median follows from the value's rank in the
    sorted block, so no pairs are formed.
    """
    group = Window.partitionBy(*CELL, "block")
    value = F.col("discharge_mAh_g")
    ranked = (
        table.select(*CYCLE, "discharge_mAh_g")
        .join(labels.select(*CYCLE, "block"), CYCLE)
        .withColumn("n", F.count(value).over(group))
        .withColumn(
            "r", F.when(value.isNotNull(), F.row_number().over(group.orderBy(value.asc_nulls_last(), "cycle")))
        )
    )
    # Without the value itself the middle ranks are floor(n/2) and ceil(n/2).
    lo, hi = F.floor(F.col("n") / 2), F.ceil(F.col("n") / 2)
    at = lambda k: F.max(F.when(F.col("r") == k, value)).over(group)
    middle = ranked.select(
        "*", at(lo).alias("lo0"), at(lo + 1).alias("lo1"), at(hi).alias("hi0"), at(hi + 1).alias("hi1")
    )
    others = (
        F.when(F.col("r") > lo, F.col("lo0")).otherwise(F.col("lo1"))
        + F.when(F.col("r") > hi, F.col("hi0")).otherwise(F.col("hi1"))
    ) / 2
    judged = F.col("block").isNotNull() & (F.col("n") >= 4) & (value < fraction * others)
    return middle.select(*CYCLE, value, (value.isNull() | F.coalesce(judged, F.lit(False))).alias("is_outlier"))


def flag_visual_outliers(table: DataFrame, labels: DataFrame) -> DataFrame:
    """Block rule for cells with a variable rate (those in ``labels``), prefix rule for the rest."""
    steady = table.join(labels.select(*CELL).distinct(), CELL, "left_anti")
    return flag_prefix_outliers(steady).unionByName(flag_block_outliers(table, labels))


def cycle_life(table: DataFrame) -> DataFrame:
    """Capacities and efficiency of the usable cycles."""
    return table.filter(~unusable()).select(*CYCLE, "charge_mAh_g", "discharge_mAh_g", "ce_pct")


def plotted_cycles(table: DataFrame, labels: DataFrame) -> DataFrame:
    """Usable cycles with a discharge capacity, visual outliers removed."""
    usable = table.filter(~unusable() & F.col("discharge_mAh_g").isNotNull())
    return flag_visual_outliers(usable, labels).filter(~F.col("is_outlier")).select(*CYCLE, "discharge_mAh_g")


def comparative_capacity(table: DataFrame, labels: DataFrame, cells: DataFrame) -> DataFrame:
    return plotted_cycles(table, labels).join(cells.select(*CELL, "composition"), CELL, "left")


def _with_reference(points: DataFrame, reference_cycle: int) -> DataFrame:
    reference = points.groupBy(*CELL).agg(
        F.coalesce(
            F.max(F.when(F.col("cycle") == reference_cycle, F.col("discharge_mAh_g"))),
            F.min_by("discharge_mAh_g", "cycle"),
        ).alias("reference_mAh_g")
    )
    return points.join(reference.filter("reference_mAh_g > 0"), CELL)


def capacity_retention(table: DataFrame, labels: DataFrame, reference_cycle: int = 2) -> DataFrame:
    """Retention curve against the reference cycle."""
    return _with_reference(plotted_cycles(table, labels), reference_cycle).select(
        *CYCLE, "discharge_mAh_g", (F.col("discharge_mAh_g") / F.col("reference_mAh_g") * 100.0).alias("retention_pct")
    )


def fade_table(
    table: DataFrame, labels: DataFrame, reference_cycle: int = 2, window: int = ROLLING_WINDOW
) -> DataFrame:
    """Loss against the reference, change per cycle, and loss over a rolling window."""
    points = _with_reference(plotted_cycles(table, labels), reference_cycle)
    loss = (F.col("reference_mAh_g") - F.col("discharge_mAh_g")) / F.col("reference_mAh_g") * 100.0
    with_loss = points.withColumn("capacity_loss_pct", loss)
    return with_loss.select(
        *CYCLE,
        "discharge_mAh_g",
        "capacity_loss_pct",
        (
            (F.col("discharge_mAh_g") - F.lag("discharge_mAh_g").over(by_cycle())) / F.col("reference_mAh_g") * 100.0
        ).alias("per_cycle_change_pct"),
        (F.col("capacity_loss_pct") - F.lag("capacity_loss_pct", window - 1).over(by_cycle())).alias(
            "per_window_loss_pct"
        ),
    )


def voltage_profile_points(records: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Voltage against counter for every record, or only for each cell's key cycles."""
    points = records.filter("voltage IS NOT NULL AND capacity IS NOT NULL")
    if cells is not None:
        keys = cells.select(*CELL, F.explode("key_cycles").alias("cycle")).distinct()
        points = points.join(keys, CYCLE, "left_semi")
    return points.select(*HALF, "seq", "capacity", "voltage")


def profile_end_points(records: DataFrame, cells: DataFrame) -> DataFrame:
    """Voltage at the largest counter value of each key cycle's half-cycles (first on ties)."""
    points = voltage_profile_points(records, cells)
    return (
        points.groupBy(*HALF)
        .agg(F.max_by(F.struct("capacity", "voltage"), F.struct("capacity", -F.col("seq"))).alias("p"))
        .select(*HALF, "p.capacity", "p.voltage")
    )


def wide_cycle_table(table: DataFrame, cell_ids: list[str] | None = None) -> DataFrame:
    """Cycle tables of all cells side by side, columns prefixed by the cell."""
    pivot = table.groupBy("cycle").pivot("cell_id", cell_ids)
    return pivot.agg(F.first("charge_mAh_g").alias("charge_mAh_g"), F.first("discharge_mAh_g").alias("discharge_mAh_g"))


def key_cycle_capacities(table: DataFrame, cells: DataFrame) -> DataFrame:
    """Capacity at each key cycle and its share of the first one present."""
    keys = cells.select(*CELL, F.explode("key_cycles").alias("cycle")).distinct()
    hits = table.join(keys, CYCLE, "left_semi").filter("discharge_mAh_g IS NOT NULL")
    return hits.select(
        *CYCLE,
        "discharge_mAh_g",
        F.when(
            F.first("discharge_mAh_g").over(by_cycle()) > 0,
            F.col("discharge_mAh_g") / F.first("discharge_mAh_g").over(by_cycle()) * 100.0,
        ).alias("pct_of_first"),
    )
