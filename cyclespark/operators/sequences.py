"""Ordered rules over half-cycles: reversals, integrity, termination, formation, death."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cyclespark.operators.clean import step_direction, with_direction
from cyclespark.operators.ordered import parts, sliced, with_previous, with_running, with_totals
from cyclespark.schema import CELL, CYCLE, HALF

PLATEAU_FRACTION = 0.05
LIMIT_TOLERANCE_V = 0.050
ANOMALOUS_FRACTION = 0.02
MIN_RECORDS = 20
OVER_THEORETICAL = 1.2
FORMATION_CYCLES = 5
DEAD_FRACTION = 0.02
DEAD_RUN = 3
TERMINATION_TOLERANCE_MV = 20.0
TERMINATION_SPREADS = 5.0
TERMINATION_PEERS = 10
TERMINATION_DURATION = 0.9


def by_cycle():
    return Window.partitionBy(*CELL).orderBy("cycle")


def record_spacing(records: DataFrame, min_records: int = 50) -> DataFrame:
    """Median and smallest non-zero voltage step in mV, and share of repeated voltages, per cell."""
    rows = with_previous(sliced(records.filter("voltage IS NOT NULL")), {"voltage": "v0"})
    dv = F.abs(F.col("voltage") - F.col("v0"))
    rows = with_totals(rows, n=F.count(F.lit(1)))
    steps = rows.filter(F.col("n") >= min_records).filter("has_previous").withColumn("mv", dv * 1000.0)
    moved = F.when(F.col("mv") > 0, F.col("mv"))
    # Voltages have a fixed resolution, so a cell has few distinct steps: the count per step is small.
    return steps.groupBy(*CELL).agg(
        F.percentile(moved, 0.5).alias("median_mv"),
        F.min(moved).alias("min_mv"),
        F.avg((F.col("mv") == 0).cast("int")).alias("duplicate_fraction"),
    )


def half_cycle_seconds(records: DataFrame, time_columns: tuple[str, ...] = ("time_s",)) -> DataFrame:
    """Duration from the first time column with at least two values."""

    def duration(c: str) -> Column:
        return F.when(F.count(c) >= 2, F.greatest(F.max(c), F.max(c) - F.min(c)))

    return records.groupBy(*HALF).agg(F.coalesce(*[duration(c) for c in time_columns]).alias("duration_s"))


def step_end_reason(records: DataFrame) -> DataFrame:
    """Last non-NULL end reason of a half-cycle; blank and placeholder text counts as none."""
    last = records.filter("end_reason IS NOT NULL").groupBy(*HALF).agg(F.trim(F.max_by("end_reason", "seq")).alias("r"))
    none = F.lower("r").isin("", "nan", "none", "-")
    keys = records.select(*HALF).distinct()
    return keys.join(last, HALF, "left").select(*HALF, F.when(~none, F.col("r")).alias("end_reason"))


def classify_profile(records: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """Profile class of each cell from the spread of its early half-cycles.

    ``cycles`` is a kept table of the records' cycles, one row each: then only
    records between the first and last chosen cycle are shuffled.
    """
    kept = cycles is not None
    cycles = cycles.select(*CYCLE) if kept else records.select(*CYCLE).distinct()
    cell = Window.partitionBy(*CELL)
    ranked = cycles.select(
        *CYCLE,
        F.count(F.lit(1)).over(cell).alias("n"),
        F.count(F.when(F.col("cycle") >= 2, 1)).over(cell).alias("n_late"),
        F.row_number().over(cell.orderBy("cycle")).alias("r"),
        F.sum((F.col("cycle") >= 2).cast("int")).over(cell.orderBy("cycle")).alias("r_late"),
    )
    chosen = ranked.filter(
        F.when(F.col("n") < 2, F.col("r") == 1)
        .when(F.col("n_late") > 0, (F.col("cycle") >= 2) & (F.col("r_late") <= 4))
        .otherwise(F.col("r").between(2, 5))
    ).select(*CYCLE)
    ends = chosen.agg(F.min("cycle"), F.max("cycle")).first() if kept else (None, None)
    if ends[0] is not None:
        records = records.filter(F.col("cycle").between(*ends))
    # Count per distinct voltage first: the counts of a half-cycle stay small however long it is.
    counts = (
        records.filter("voltage IS NOT NULL AND step IN ('Charge', 'Discharge')")
        .groupBy(*HALF, "voltage")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(chosen, CYCLE, "left_semi")
    )
    quartiles = counts.groupBy(*HALF).agg(
        F.sum("n").alias("total"),
        (F.max("voltage") - F.min("voltage")).alias("range"),
        F.percentile("voltage", [0.25, 0.5, 0.75], F.col("n")).alias("q"),
    ).filter("total >= 20 AND range >= 0.01")
    near = counts.join(quartiles, HALF).groupBy(*HALF).agg(
        F.first((F.col("q")[2] - F.col("q")[0]) / F.col("range")).alias("iqr"),
        (
            F.sum(
                F.when(
                    (F.col("voltage") >= F.col("q")[1] - 0.020) & (F.col("voltage") <= F.col("q")[1] + 0.020), F.col("n")
                ).otherwise(0)
            )
            / F.first("total")
        ).alias("plateau"),
    )
    means = near.groupBy(*CELL).agg(F.avg("iqr").alias("iqr_fraction"), F.avg("plateau").alias("plateau_fraction"))
    profile = (
        F.when((F.col("iqr_fraction") < 0.08) | (F.col("plateau_fraction") > 0.6), "sharp")
        .when((F.col("iqr_fraction") < 0.20) | (F.col("plateau_fraction") > 0.35), "moderate")
        .otherwise("broad")
    )
    cells = cycles.select(*CELL).distinct()
    return cells.join(means, CELL, "left").select(*CELL, profile.alias("profile"), "iqr_fraction", "plateau_fraction")


def reversals(records: DataFrame, min_records: int = 1) -> DataFrame:
    """Contiguous runs of records whose voltage moves against the half-cycle.

    A run belongs to the last forward record before it (its anchor), found as
    a running maximum, so runs that cross a slice border stay whole.
    """
    # Slices of all records serve for some of them, and their sizes are known already.
    rows = with_previous(sliced(records).filter("voltage IS NOT NULL"), {"voltage": "v0", "capacity": "q0"})
    rows = with_totals(with_direction(rows), n=F.count(F.lit(1)), mi=F.percentile(F.abs("current_a"), 0.5)).filter("n >= 3")
    rows = rows.withColumn("back", F.coalesce((F.col("voltage") - F.col("v0")) * F.col("direction") < 0, F.lit(False)))
    rows = with_running(rows.withColumn("_f", F.when(~F.col("back"), F.col("seq"))), "max", "_f", "anchor_seq")
    # Only reversed records and the anchor before them go on: the group count follows the reversals.
    ahead = F.lead("back").over(Window.partitionBy(*parts(rows)).orderBy("seq"))
    rows = rows.withColumn("_ahead", ahead).filter("back OR _ahead IS NULL OR _ahead").drop("_ahead")
    back = F.col("back")
    time_s = F.col("time_s") if "time_s" in records.columns else F.lit(None).cast("double")
    runs = rows.groupBy(*HALF, "anchor_seq").agg(
        F.sum(back.cast("int")).alias("n_records"),
        F.sum(F.when(back, F.abs(F.col("capacity") - F.col("q0")))).alias("charge"),
        F.min_by("v0", F.when(back, F.col("seq"))).alias("v_start"),
        F.max_by("voltage", "seq").alias("v_end"),
        (F.max_by(time_s, "seq") - F.min_by(time_s, "seq")).alias("seconds"),
        F.coalesce(
            (F.first("mi") > 0) & (F.percentile(F.abs("current_a"), 0.5) > 0.99 * F.first("mi")), F.lit(False)
        ).alias("at_full_current"),
    )
    return runs.filter(F.col("n_records") >= min_records).select(
        *HALF, "anchor_seq", "n_records", "charge", "v_start", "v_end",
        (F.abs(F.col("v_end") - F.col("v_start")) * 1000.0).alias("span_mv"), "seconds", "at_full_current",
    )


def reversal_totals(runs: DataFrame) -> DataFrame:
    """Reversed charge at full current and widest reversal of each half-cycle."""
    return runs.groupBy(*HALF).agg(
        F.count(F.lit(1)).alias("n_reversals"),
        F.coalesce(F.sum(F.when(F.col("at_full_current"), F.col("charge"))), F.lit(0.0)).alias("reversed_charge_at_current"),
        F.max("span_mv").alias("widest_reversal_mv"),
    )


def classify_reversals(runs: DataFrame, curves: DataFrame, window: DataFrame | None = None) -> DataFrame:
    """Mechanism of each reversal from the height of the nearest bin of its own curve.

    Curves are uniform grids, so the nearest bin is arithmetic. ``curves`` is
    what ``curves.histogram_arrays`` makes, one row per half-cycle with its
    window, or has a row per bin; then the lookup is an equi-join on the bin
    number, and ``window`` has the window of each cell.
    """
    arrays = isinstance(curves.schema["dqdv"].dataType, T.ArrayType)
    if arrays:
        at = lambda i: F.col("lo") + F.col("width") * (i + 0.5)
        grid = curves.select(
            *HALF, "window_low_v", "window_high_v", "lo", "width", "dqdv", at(F.lit(0)).alias("c0"), at(F.size("dqdv") - 1).alias("c1"), (F.size("dqdv") - 1).alias("last_bin"),
            F.array_max(F.transform("dqdv", F.abs)).alias("tallest"),
        ).filter("tallest > 0")
    else:
        grid = curves.groupBy(*HALF).agg(
            F.min("voltage").alias("c0"), F.max("voltage").alias("c1"), F.max("bin").alias("last_bin"),
            F.max(F.abs("dqdv")).alias("tallest"),
        ).filter("tallest > 0").join(window, CELL)
    mid = (F.col("v_start") + F.col("v_end")) * 0.5
    step = (F.col("c1") - F.col("c0")) / F.col("last_bin")
    placed = (
        runs.join(grid, HALF)
        .withColumn("voltage", mid)
        .withColumn("step_v", step)
        .withColumn(
            "bin",
            F.greatest(
                F.lit(0), F.least(F.col("last_bin"), F.ceil((F.col("voltage") - F.col("c0")) / F.col("step_v") - 0.5).cast("int"))
            ),
        )
    )
    if arrays:
        placed = placed.withColumns({"bin_v": at(F.col("bin")), "height": F.abs(F.get("dqdv", F.col("bin")))}).drop("lo", "width", "dqdv")
    else:
        bins = curves.select(*HALF, "bin", F.col("voltage").alias("bin_v"), F.abs("dqdv").alias("height"))
        placed = placed.join(bins, [*HALF, "bin"], "left")
    near = F.abs(F.col("bin_v") - F.col("voltage")) <= 5.0 * F.col("step_v")
    share = F.when(near, F.col("height") / F.col("tallest"))
    at_limit = (F.col("voltage") >= F.col("window_high_v") - LIMIT_TOLERANCE_V) | (
        F.col("voltage") <= F.col("window_low_v") + LIMIT_TOLERANCE_V
    )
    mechanism = (
        F.when(at_limit, "cv_hold")
        .when(~F.col("at_full_current"), "current_taper")
        .when(F.col("dqdv_share") >= PLATEAU_FRACTION, "plateau")
        .when(F.col("dqdv_share").isNull(), "outside_window")
        .otherwise("parasitic")
    )
    return (
        placed.withColumn("dqdv_share", share)
        .select(
            *HALF, "anchor_seq", "n_records", "charge", "v_start", "v_end", "span_mv", "seconds", "at_full_current",
            "voltage", "dqdv_share", mechanism.alias("mechanism"),
        )
    )


def integrity(halves: DataFrame, events: DataFrame, cells: DataFrame) -> DataFrame:
    """Integrity table: charge per mechanism, over-theoretical ratio, band and reason.

    ``halves`` has one row per half-cycle with ``capacity_mAh_g``,
    ``n_records`` and ``has_curve``.
    """
    m = F.col("mechanism")
    bucket = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("charge"))), F.lit(0.0))
    charges = events.groupBy(*HALF).agg(
        F.count(F.lit(1)).alias("n_reversals"),
        bucket(m == "plateau").alias("plateau_charge"),
        bucket(m.isin("cv_hold", "current_taper")).alias("cv_charge"),
        bucket(m == "parasitic").alias("parasitic_charge"),
        bucket(m == "outside_window").alias("outside_window_charge"),
        F.count(F.when(F.col("charge").isNull(), 1)).alias("n_unknown"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = halves.join(charges, HALF, "left").join(cells.select(*CELL, "theoretical_mAh_g"), CELL, "left").select(
        *HALF,
        "n_records",
        "has_curve",
        F.col("capacity_mAh_g").alias("capacity"),
        F.when(F.col("theoretical_mAh_g") > 0, F.col("theoretical_mAh_g")).alias("theoretical"),
        *[zero(c) for c in ("n_reversals", "plateau_charge", "cv_charge", "parasitic_charge", "n_unknown")],
    )
    few = (F.col("n_records") < MIN_RECORDS) | ~F.col("has_curve")
    blank = lambda c: F.when(~few, F.col(c))
    counted = joined.select(
        *HALF, "n_records", "capacity", few.alias("few"), "n_unknown", "has_curve",
        blank("theoretical").alias("theoretical_mAh_g"),
        F.when(few, 0).otherwise(F.col("n_reversals")).alias("n_reversals"),
        *[F.when(few, 0.0).otherwise(F.col(c)).alias(c) for c in ("plateau_charge", "cv_charge", "parasitic_charge")],
    ).withColumn("capacity_ratio", F.col("capacity") / F.col("theoretical_mAh_g")).withColumn(
        "parasitic_fraction", F.when(F.col("capacity") > 0, F.col("parasitic_charge") / F.col("capacity"))
    )
    over = F.coalesce(F.col("capacity_ratio") > OVER_THEORETICAL, F.lit(False))
    band = (
        F.when(F.col("few"), "too few records")
        .when(over, "ANOMALOUS")
        .when(F.col("n_unknown") > 0, "unknown")
        .when(F.col("parasitic_fraction").isNull(), "unknown")
        .when((F.col("parasitic_charge") <= 0) & (F.col("capacity_ratio") > 1.0), "suspect")
        .when(F.col("parasitic_charge") <= 0, "clean")
        .when(F.col("parasitic_fraction") >= ANOMALOUS_FRACTION, "ANOMALOUS")
        .otherwise("suspect")
    )
    reason = (
        F.when(F.col("few") & (F.col("n_records") < MIN_RECORDS), "too few records")
        .when(F.col("few"), "no usable curve")
        .when(over, "more charge passed than the material can hold")
        .when(F.col("n_unknown") > 0, "reversals without a charge figure")
        .when(F.col("parasitic_fraction").isNull(), "no counter capacity to compare against")
        .when((F.col("parasitic_charge") <= 0) & (F.col("capacity_ratio") > 1.0), "above the theoretical capacity, within tolerance")
        .when(F.col("parasitic_charge") <= 0, "no charge passed backwards away from a redox process")
        .when(F.col("parasitic_fraction") >= ANOMALOUS_FRACTION, "charge passed at full current where the curve is flat")
        .otherwise("some charge unaccounted for")
    )
    return counted.select(
        *HALF, "capacity", "theoretical_mAh_g", "capacity_ratio", over.alias("over_theoretical"), "n_records", "n_reversals",
        "plateau_charge", "cv_charge", "parasitic_charge", "parasitic_fraction", band.alias("band"), reason.alias("reason"),
    )


def integrity_rollup(table: DataFrame) -> DataFrame:
    """Counts per band, parasitic total and plateau/hold medians per cell."""
    count = lambda b: F.count(F.when(F.col("band") == b, 1))
    return table.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_half_cycles"),
        count("clean").alias("n_clean"),
        count("suspect").alias("n_suspect"),
        count("ANOMALOUS").alias("n_anomalous"),
        count("too few records").alias("n_too_few"),
        F.coalesce(F.sum(F.when(F.col("band") == "ANOMALOUS", F.col("parasitic_charge"))), F.lit(0.0)).alias("parasitic_total"),
        F.count(F.when(F.col("over_theoretical"), 1)).alias("n_over_theoretical"),
        F.max(F.when(F.col("over_theoretical"), F.col("capacity_ratio"))).alias("worst_ratio"),
        F.percentile(F.when(~F.col("over_theoretical") & (F.col("plateau_charge") > 0), F.col("plateau_charge")), 0.5).alias(
            "plateau_median"
        ),
        F.percentile(F.when(F.col("cv_charge") > 0.01, F.col("cv_charge")), 0.5).alias("cv_median"),
    )


def worst_half_cycles(table: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` anomalous half-cycles of each cell with the largest parasitic share."""
    w = Window.partitionBy(*CELL).orderBy(F.desc_nulls_last("parasitic_fraction"), "cycle", "step")
    return (
        table.filter("band = 'ANOMALOUS'")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= n)
        .select(*HALF, "rank", "capacity", "parasitic_charge", "parasitic_fraction")
    )


def integrity_verdict(table: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Cell verdict from the pattern of flagged cycles."""
    ratio = F.col("capacity_ratio")
    flagged = (F.col("band") == "ANOMALOUS") | F.coalesce(ratio > 1.0, F.lit(False))
    totals = table.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.max("cycle").alias("n_cycles"),
        F.count(F.when(flagged, 1)).alias("n_flagged"),
        F.max(F.when(flagged, ratio)).alias("worst_ratio"),
        F.min_by("cycle", F.when(flagged & ratio.isNotNull(), F.struct(-ratio, F.col("cycle")))).alias("worst_cycle"),
        F.count(F.when(ratio > 1.0, 1)).alias("n_over_theoretical"),
        F.count(F.when(ratio > OVER_THEORETICAL, 1)).alias("n_escalated"),
    )
    cycles = table.filter(flagged).select(*CYCLE).distinct()
    gaps = cycles.select(*CYCLE, (F.col("cycle") - F.lag("cycle").over(by_cycle())).alias("gap"))
    late_after = F.greatest(F.coalesce(F.col("reference_cycle"), F.lit(FORMATION_CYCLES)), F.lit(FORMATION_CYCLES))
    if reference is None:
        gaps = gaps.withColumn("reference_cycle", F.lit(FORMATION_CYCLES))
    else:
        gaps = gaps.join(reference.select(*CELL, "reference_cycle"), CELL, "left")
    pattern = gaps.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_cycles_flagged"),
        F.min("cycle").alias("first_flagged"),
        F.max("cycle").alias("last_flagged"),
        F.floor(F.percentile("gap", 0.5)).alias("typical_gap"),
        F.count(F.when(F.col("cycle") > late_after, 1)).alias("n_late"),
    )
    span = F.col("last_flagged") - F.col("first_flagged")
    verdict = (
        F.when(F.col("n_flagged") == 0, "sound")
        .when(F.col("n_late") == 0, "formation")
        .when((F.col("n_cycles_flagged") >= 3) & (F.col("n_cycles") > 0) & (span >= 0.5 * F.col("n_cycles")), "recurring")
        .when(F.col("n_cycles_flagged") >= 3, "clustered")
        .otherwise("isolated")
    )
    return totals.join(pattern, CELL, "left").select(
        *CELL, verdict.alias("verdict"), "n_flagged", "n_total", "first_flagged", "last_flagged",
        F.coalesce(span, F.lit(0)).alias("span"), "typical_gap", "worst_ratio", "worst_cycle", "n_over_theoretical", "n_escalated",
    )


def last_useful_cycle(table: DataFrame, fraction: float = DEAD_FRACTION, run: int = DEAD_RUN) -> DataFrame:
    """Cycle before the first ``run`` consecutive discharges below ``fraction`` of the 90th percentile."""
    good = table.filter("discharge_mAh_g IS NOT NULL").select(*CYCLE, "discharge_mAh_g")
    reference = good.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("discharge_mAh_g", 0.9).alias("reference"), F.min("cycle").alias("first_cycle")
    )
    judged = good.join(reference, CELL).withColumn("dead", F.col("discharge_mAh_g") < fraction * F.col("reference"))
    w = by_cycle()
    runs = judged.select(
        *CYCLE,
        F.lag("cycle").over(w).alias("before"),
        (F.min(F.col("dead").cast("int")).over(w.rowsBetween(0, run - 1)) == 1).alias("all_dead"),
        F.count(F.lit(1)).over(w.rowsBetween(0, run - 1)).alias("k"),
    ).filter((F.col("k") == run) & F.col("all_dead"))
    first = runs.groupBy(*CELL).agg(F.min_by(F.coalesce("before", F.col("cycle")), "cycle").alias("last_useful_cycle"))
    usable = (F.col("n") >= run + 1) & (F.col("reference") > 0)
    return reference.join(first, CELL, "left").select(
        *CELL,
        F.when(usable, F.col("last_useful_cycle")).alias("last_useful_cycle"),
        F.when(F.col("n") < run + 1, "too few cycles to judge")
        .when(~(F.col("reference") > 0), "no usable reference capacity")
        .when(F.col("last_useful_cycle").isNotNull(), "dead")
        .otherwise("alive")
        .alias("state"),
        (F.col("reference") * fraction).alias("floor_mAh_g"),
    )


def termination_check(records: DataFrame, tolerance_mv: float = TERMINATION_TOLERANCE_MV) -> DataFrame:
    """End voltage of each half-cycle against its ten nearest peers of the same direction.

    The ten nearest in order lie within ten places on either side, so a
    bounded window replaces a join of all pairs.
    """
    voltage_ends = records.filter("voltage IS NOT NULL").groupBy(*HALF).agg(F.max_by("voltage", "seq").alias("v_end"))
    last = records.groupBy(*CELL).agg(F.max_by(F.struct("cycle", "step"), "seq").alias("last"))
    halves = (
        voltage_ends.join(step_direction(records), HALF)
        .join(half_cycle_seconds(records), HALF)
        .join(step_end_reason(records), HALF)
        .join(last, CELL)
        .withColumn("is_last", (F.col("cycle") == F.col("last.cycle")) & (F.col("step") == F.col("last.step")))
        .withColumn("place", F.row_number().over(Window.partitionBy(*CELL).orderBy("cycle", "step")))
    )
    side = Window.partitionBy(*CELL, "direction").orderBy("place")
    peer = F.struct("place", "v_end", "duration_s")
    k = TERMINATION_PEERS
    near = F.concat(
        F.collect_list(peer).over(side.rowsBetween(-k, -1)), F.collect_list(peer).over(side.rowsBetween(1, k))
    )
    keyed = F.transform(
        "near",
        lambda p: F.struct(
            F.abs(p["place"] - F.col("place")).alias("far"), p["place"].alias("place"), p["v_end"].alias("v_end"),
            p["duration_s"].alias("duration_s"),
        ),
    )
    peers = halves.withColumn("near", near).withColumn("peers", F.slice(F.array_sort(keyed), 1, k))
    judged = peers.withColumn("v", F.array_sort(F.col("peers.v_end"))).withColumn(
        "d", F.array_sort(F.filter(F.col("peers.duration_s"), lambda x: x.isNotNull()))
    )

    def quantile(a: str, q: float) -> Column:
        at = (F.size(a) - 1) * F.lit(q)
        lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
        return F.get(a, lo) + (F.get(a, hi) - F.get(a, lo)) * (at - lo)

    enough = F.size("v") >= 2
    spread = F.when(F.size("v") >= 4, quantile("v", 0.75) - quantile("v", 0.25)).otherwise(
        F.array_max("v") - F.array_min("v")
    )
    short = F.col("direction") * (F.col("v_limit") - F.col("v_end")) * 1000.0
    out = (
        judged.withColumn("v_limit", F.when(enough, quantile("v", 0.5)))
        .withColumn("short_mv", short)
        .withColumn("tolerance", F.greatest(F.lit(tolerance_mv), TERMINATION_SPREADS * spread * 1000.0))
        .withColumn("reached", F.coalesce(F.col("short_mv") <= F.col("tolerance"), F.lit(True)))
        .withColumn("typical", F.when(enough & (F.size("d") >= 2), quantile("d", 0.5)))
        .withColumn("duration_frac", F.when(F.col("typical") > 0, F.col("duration_s") / F.col("typical")))
    )
    in_flight = F.col("is_last") & (F.col("duration_frac").isNull() | (F.col("duration_frac") < TERMINATION_DURATION))
    cls = (
        F.when(F.col("reached"), "reached the cut-off")
        .when(F.length("end_reason") > 0, F.concat(F.lit("ended on: "), "end_reason"))
        .when(in_flight, "still running when exported")
        .otherwise("terminated early, not on voltage")
    )
    return out.select(
        *HALF, "direction", "v_end", "duration_s", "end_reason", "is_last", "v_limit", "short_mv", "duration_frac", "reached",
        cls.alias("termination_class"),
    )


def in_progress(checked: DataFrame) -> DataFrame:
    """The last half-cycle of a cell when it was caught mid-flight."""
    return checked.filter(
        "is_last AND NOT reached AND short_mv IS NOT NULL AND termination_class LIKE 'still running%'"
    ).select(*HALF)


def early_terminations(checked: DataFrame) -> DataFrame:
    return checked.filter("NOT reached AND termination_class NOT LIKE 'still running%'").select(
        *HALF, "v_end", "v_limit", "short_mv", "duration_frac", "termination_class", "is_last"
    )


def formation_end(
    table: DataFrame, tolerance_pp: float = 0.1, run: int = 3, floor: int = 2, ceiling: int = 15, min_later: int = 5,
    max_ce_pct: float = 105.0,
) -> DataFrame:
    """First cycle whose efficiency stays near the median of all later cycles.

    Only cycles up to ``ceiling`` can be the answer, so each later cycle is
    paired with at most ``ceiling`` early ones.
    """
    good = table.filter("ce_pct IS NOT NULL").select(*CYCLE, "ce_pct")
    w = by_cycle()
    early = good.select(
        *CYCLE,
        F.row_number().over(w).alias("i"),
        F.count(F.lit(1)).over(Window.partitionBy(*CELL)).alias("n"),
        F.max("ce_pct").over(w.rowsBetween(0, run - 1)).alias("run_max"),
        F.min("ce_pct").over(w.rowsBetween(0, run - 1)).alias("run_min"),
    ).filter(F.col("cycle") <= ceiling)
    late = good.select("cell_id", F.col("cycle").alias("late_cycle"), F.col("ce_pct").alias("late_ce"))
    medians = (
        early.select(*CYCLE)
        .join(late, "cell_id")
        .filter(F.col("late_cycle") > F.col("cycle"))
        .groupBy(*CYCLE)
        .agg(F.count(F.lit(1)).alias("n_later"), F.percentile("late_ce", 0.5).alias("later_median"))
    )
    rows = early.join(medians, CYCLE)
    candidates = rows.filter(
        (F.col("n") >= run + 1)
        & (F.col("i") <= F.col("n") - run + 1)
        & (F.col("n_later") >= max(1, min_later))
        & (F.col("cycle") <= ceiling)
        & (F.col("later_median") <= max_ce_pct)
        & (F.abs(F.col("run_max") - F.col("later_median")) <= tolerance_pp)
        & (F.abs(F.col("run_min") - F.col("later_median")) <= tolerance_pp)
    )
    found = candidates.groupBy(*CELL).agg(F.min("cycle").alias("settled"))
    cells = table.select(*CELL).distinct()
    return cells.join(found, CELL, "left").select(*CELL, F.greatest("settled", F.when(F.col("settled").isNotNull(), floor)).alias("formation_end"))


def choose_reference_cycle(
    table: DataFrame, bands: DataFrame, detected: DataFrame, formation: DataFrame, default: int = 2, fallback: int = 6
) -> DataFrame:
    """Reference cycle per cell: first sound and detected cycle from the end of formation on.

    ``bands`` is the integrity table, ``detected`` the (cell_id, cycle) with peaks.
    """
    sound = bands.groupBy(*CYCLE).agg(F.min(F.col("band").isin("clean", "suspect")).alias("sound"))
    cycles = (
        table.select(*CYCLE)
        .distinct()
        .join(sound, CYCLE, "left")
        .join(detected.select(*CYCLE).distinct().withColumn("found", F.lit(True)), CYCLE, "left")
        .join(formation.select(*CELL, "formation_end"), CELL, "left")
        .withColumn("start", F.greatest(F.lit(default), F.coalesce("formation_end", F.lit(fallback))))
        .withColumn("ok", F.coalesce("sound", F.lit(False)) & F.coalesce("found", F.lit(False)))
    )
    w = by_cycle()
    cycles = cycles.withColumn("r", F.row_number().over(w))
    pick = cycles.groupBy(*CELL).agg(
        F.min(F.when(F.col("ok") & (F.col("cycle") >= F.col("start")), F.col("cycle"))).alias("above"),
        F.max(F.when(F.col("ok") & (F.col("cycle") < F.col("start")), F.col("cycle"))).alias("below"),
        F.max(F.when(F.col("cycle") == default, F.col("cycle"))).alias("stated"),
        F.max(F.when(F.col("r") == 2, F.col("cycle"))).alias("second"),
        F.min("cycle").alias("first"),
        F.max("formation_end").alias("formation_end"),
        F.max("start").alias("start"),
    )
    measured = F.col("formation_end").isNotNull()
    return pick.select(
        *CELL,
        F.coalesce("above", "below", "stated", "second", "first").alias("reference_cycle"),
        F.when(F.col("above").isNotNull() & ~measured, "formation not measured; first sound cycle from the fallback on")
        .when((F.col("above") == F.col("start")) & (F.col("start") > default), "formation ended here")
        .when(F.col("above").isNotNull() & (F.col("start") > default), "first sound cycle after formation")
        .when(F.col("above") == F.col("start"), "default, and it passes the integrity check")
        .when(F.col("above").isNotNull(), "first sound cycle above the default")
        .when(F.col("below").isNotNull(), "latest sound cycle below the start")
        .otherwise("no cycle passes the integrity check")
        .alias("reason"),
        F.when(F.col("above").isNotNull() & measured, "ok")
        .when(F.coalesce("above", "below").isNotNull(), "warn")
        .otherwise("bad")
        .alias("severity"),
    )


def voltage_envelope(records: DataFrame) -> DataFrame:
    """Highest and lowest voltage of each half-cycle."""
    return records.groupBy(*HALF).agg(F.max("voltage").alias("v_max"), F.min("voltage").alias("v_min"))


def envelope_movement(envelope: DataFrame, severe_mv: float = 300.0) -> DataFrame:
    """How far each edge moved over the record, per cell and step."""
    agg = envelope.groupBy("cell_id", "step").agg(
        ((F.max("v_max") - F.min("v_max")) * 1000.0).alias("top_range_mv"),
        ((F.max("v_min") - F.min("v_min")) * 1000.0).alias("bottom_range_mv"),
        ((F.max_by("v_max", "cycle") - F.min_by("v_max", "cycle")) * 1000.0).alias("top_shift_mv"),
        ((F.max_by("v_min", "cycle") - F.min_by("v_min", "cycle")) * 1000.0).alias("bottom_shift_mv"),
    )
    return agg.withColumn("is_severe", F.greatest("top_range_mv", "bottom_range_mv") >= severe_mv)


def trailing_partial(table: DataFrame) -> DataFrame:
    """Last capacity before an unfinished final cycle, per cell that has one."""
    partial = table.filter("partial_final").groupBy(*CELL).agg(
        F.max("cycle").alias("partial_cycle"), F.max_by("discharge_mAh_g", "cycle").alias("partial_mAh_g")
    )
    before = table.join(partial, CELL).filter("cycle < partial_cycle AND discharge_mAh_g IS NOT NULL").groupBy(*CELL).agg(
        F.max("cycle").alias("last_full_cycle"), F.max_by("discharge_mAh_g", "cycle").alias("last_full_mAh_g")
    )
    return partial.join(before, CELL, "left")
