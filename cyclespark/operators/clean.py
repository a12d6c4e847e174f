"""Record-level cleaning: tidying, electrode convention, selection, holds, orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cyclespark.operators.ordered import sliced, with_previous, with_totals
from cyclespark.schema import CELL, CYCLE, HALF, STEP_NAMES

CV_CURRENT_FRACTION = 0.99
CV_VOLTAGE_FRACTION = 0.10
CV_MIN_RECORDS = 3


def tidy_steps(df: DataFrame, step: str = "step", drop: str = "rest") -> DataFrame:
    """Trim step names, map them to Charge/Discharge and drop rest records."""
    names = F.create_map(*[F.lit(t) for pair in STEP_NAMES.items() for t in pair])
    trimmed = F.trim(F.col(step))
    return df.withColumn(step, F.coalesce(F.try_element_at(names, trimmed), trimmed)).filter(
        ~F.lower(F.col(step)).contains(drop)
    )


SWAPPED_PAIRS = (
    ("charge_capacity", "discharge_capacity"),
    ("charge_ah", "discharge_ah"),
    ("charge_wh", "discharge_wh"),
    ("charge_energy", "discharge_energy"),
)


def electrode_convention(df: DataFrame, electrode_type: str = "electrode_type", swapped: str | None = None) -> DataFrame:
    """Present the useful half-cycle of a negative electrode as the discharge.

    Swaps labels and counters and negates dQ/dV.  Rows already swapped
    (``swapped`` column) are left alone; asking to un-swap them is an error.
    """
    negative = F.lower(F.col(electrode_type)) == "negative"
    done = F.coalesce(F.col(swapped), F.lit(False)) if swapped else F.lit(False)
    swap = F.coalesce(negative, F.lit(False)) & ~done
    out = {
        "step": F.when(swap & (F.col("step") == "Charge"), "Discharge")
        .when(swap & (F.col("step") == "Discharge"), "Charge")
        .otherwise(F.col("step"))
    }
    for a, b in SWAPPED_PAIRS:
        if a in df.columns and b in df.columns:
            out[a] = F.when(swap, F.col(b)).otherwise(F.col(a))
            out[b] = F.when(swap, F.col(a)).otherwise(F.col(b))
    for c in ("dqdv", "dqdv_abs"):
        if c in df.columns:
            out[c] = F.when(swap, -F.col(c)).otherwise(F.col(c))
    wrong = F.raise_error(F.lit("labels already swapped for a negative electrode; reload with the right type"))
    out["labels_swapped"] = F.when(done & ~F.coalesce(negative, F.lit(False)), wrong.cast("boolean")).otherwise(swap | done)
    return df.withColumns(out)


def truncate_cycles(df: DataFrame, max_cycle: str = "max_cycle") -> DataFrame:
    """Drop cycles beyond ``max_cycle``; NULL or zero keeps everything."""
    limit = F.col(max_cycle)
    return df.filter(limit.isNull() | (limit == 0) | (F.col("cycle") <= limit))


def drop_missing(df: DataFrame, required=("voltage", "cycle", "step", "dqdv")) -> DataFrame:
    return df.dropna(subset=list(required))


def half_cycles(records: DataFrame) -> DataFrame:
    """One row per half-cycle with its record count and sequence range."""
    return records.groupBy(*HALF).agg(
        F.count(F.lit(1)).alias("n_records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


def half_cycle_keys(records: DataFrame) -> DataFrame:
    return records.select(*HALF).distinct()


def half_cycle(records: DataFrame, cycle: int, step: str) -> DataFrame:
    return records.filter((F.col("cycle") == cycle) & (F.col("step") == step))


def voltage_window(records: DataFrame, trim_mv: float = 50.0) -> DataFrame:
    """Analysis window per cell: range shrunk by the trim, or by 10 mV when that inverts it."""
    return window_of(drop_missing(records).select(*CELL, F.col("voltage").alias("lo"), F.col("voltage").alias("hi")), trim_mv)


def cycle_ranges(records: DataFrame) -> DataFrame:
    """Lowest and highest complete voltage (``lo``, ``hi``) of every cycle; NULL where none is complete."""
    known = F.col("step").isNotNull()
    for c in ("voltage", "dqdv"):
        known = known & F.col(c).isNotNull() & ~F.isnan(c)
    whole = F.when(known, F.col("voltage"))
    return records.groupBy(*CYCLE).agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"))


def window_of(ranges: DataFrame, trim_mv: float = 50.0) -> DataFrame:
    """``voltage_window`` from ranges of voltage (``lo``, ``hi``), as those of ``cycle_ranges``."""
    trim = trim_mv / 1000.0
    agg = ranges.filter("lo IS NOT NULL").groupBy(*CELL).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    used = F.when(F.col("lo") + trim >= F.col("hi") - trim, 0.010).otherwise(trim)
    return agg.select(*CELL, (F.col("lo") + used).alias("window_low_v"), (F.col("hi") - used).alias("window_high_v"))


def mark_hold(records: DataFrame) -> DataFrame:
    """Mark the trailing constant-voltage hold of every half-cycle.

    Adds ``hold_rule`` and ``in_hold``.  The hold is every record after the
    last one failing the criterion, which needs no backward scan.
    """
    rows = with_previous(sliced(records), {"voltage": "_v0"}).withColumn("_dv", F.abs(F.col("voltage") - F.col("_v0")))
    current = F.abs("current_a")
    rows = with_totals(
        rows,
        _n=F.count(F.lit(1)),
        _ni=F.count("current_a"),
        _mi=F.percentile(current, 0.5),
        _mdv=F.percentile(F.when(F.col("_dv") > 0, F.col("_dv")), 0.5),
    )
    rule = (
        F.when(F.col("_n") < 2 * CV_MIN_RECORDS, "off")
        .when((F.col("_ni") >= CV_MIN_RECORDS) & (F.col("_mi") > 0), "current decay")
        .when(F.col("_mdv").isNull(), "no criterion")
        .otherwise("voltage stall")
    )
    rows = rows.withColumn("hold_rule", rule)
    low = F.when(F.col("hold_rule") == "current decay", current < F.col("_mi") * CV_CURRENT_FRACTION).when(
        F.col("hold_rule") == "voltage stall", F.col("_dv") < F.col("_mdv") * CV_VOLTAGE_FRACTION
    )
    rows = rows.withColumn("_low", F.coalesce(low, F.lit(False)))
    rows = with_totals(rows, _live=F.max(F.when(~F.col("_low"), F.col("seq"))))
    rows = rows.withColumn("_tail", F.col("_low") & (F.col("_live").isNull() | (F.col("seq") > F.col("_live"))))
    rows = with_totals(rows, _run=F.sum(F.col("_tail").cast("int")))
    return rows.withColumn("in_hold", F.col("_tail") & (F.col("_run") >= CV_MIN_RECORDS)).drop(
        "_v0", "_dv", "has_previous", "_n", "_ni", "_mi", "_mdv", "_low", "_live", "_tail", "_run"
    )


def hold_table(records: DataFrame) -> DataFrame:
    """Rule and length of the trailing hold of each half-cycle."""
    return mark_hold(records).groupBy(*HALF).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.first("hold_rule").alias("hold_rule"),
        F.sum(F.col("in_hold").cast("int")).alias("n_hold"),
    )


def strip_hold(records: DataFrame) -> DataFrame:
    """Records without the trailing hold of their half-cycle."""
    return mark_hold(records).filter("NOT in_hold").drop("in_hold", "hold_rule")


def _direction(swapped: bool) -> Column:
    implied = F.when(F.lower("step").startswith("c"), 1).otherwise(-1) * (-1 if swapped else 1)
    measured = (F.col("_nv") >= 2) & (F.abs("_net") > 1e-4)
    return F.when(measured, F.signum("_net").cast("int")).otherwise(implied)


def _net_change() -> dict[str, Column]:
    known = F.when(F.col("voltage").isNotNull(), F.col("seq"))
    return {"_nv": F.count("voltage"), "_net": F.max_by("voltage", known) - F.min_by("voltage", known)}


def step_direction(records: DataFrame, swapped: bool = False) -> DataFrame:
    """+1 rising, -1 falling: from the net voltage change, else from the label."""
    ends = records.groupBy(*HALF).agg(*[c.alias(n) for n, c in _net_change().items()]).filter("_nv > 0")
    return ends.select(*HALF, _direction(swapped).alias("direction"))


def with_direction(rows: DataFrame, swapped: bool = False) -> DataFrame:
    """The direction of its half-cycle on every record."""
    known = F.when(F.col("voltage").isNotNull(), F.col("seq"))
    ends = with_totals(
        rows, _nv=F.count("voltage"), _va=F.min_by("voltage", known), _vz=F.max_by("voltage", known)
    ).withColumn("_net", F.col("_vz") - F.col("_va"))
    return ends.withColumn("direction", _direction(swapped)).drop("_nv", "_va", "_vz", "_net")


def orient_dqdv(records: DataFrame) -> DataFrame:
    """Give backward records on a plateau the sign of the half-cycle's forward records.

    Only where current and counter still go forward, so a true reversal is
    never turned into a peak.  Adds ``oriented``.
    """
    rows = with_direction(with_previous(sliced(records), {"voltage": "_v0", "capacity": "_q0"}))
    rows = with_totals(rows, _mi=F.percentile("current_a", 0.5), _n=F.count(F.lit(1)))
    moved = F.signum(F.coalesce(F.col("voltage") - F.col("_v0"), F.lit(0.0)))
    rows = rows.withColumn("_fwd", moved == F.col("direction"))
    forward = F.when(F.col("_fwd"), F.col("dqdv"))
    rows = with_totals(rows, _nf=F.count(forward), _mf=F.percentile(forward, 0.5), _sum=F.sum("dqdv"))
    rows = rows.withColumn("_target", F.signum(F.when(F.col("_nf") >= 3, F.col("_mf")).otherwise(F.col("_sum"))))
    fix = (
        (F.col("_n") >= 3)
        & (F.col("_target") != 0)
        & ~F.coalesce(F.col("_fwd"), F.lit(False))
        & (F.signum("dqdv") != F.col("_target"))
        & (F.col("_mi").isNull() | (F.col("_mi") == 0) | F.coalesce(F.signum("current_a") == F.signum("_mi"), F.lit(False)))
        & ~F.coalesce(F.col("capacity") - F.col("_q0") < 0, F.lit(False))
    )
    return (
        rows.withColumn("oriented", F.coalesce(fix, F.lit(False)))
        .withColumn("dqdv", F.when(F.col("oriented"), F.abs("dqdv") * F.col("_target")).otherwise(F.col("dqdv")))
        .drop("_v0", "_q0", "_mi", "_n", "_fwd", "_nf", "_mf", "_sum", "_target", "direction", "has_previous")
    )


def short_half_cycles(records: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Half-cycles whose voltage span is below ``threshold`` of the step's median span."""
    spans = records.groupBy(*HALF).agg((F.max("voltage") - F.min("voltage")).alias("span_v"))
    typical = spans.groupBy("cell_id", "step").agg(F.percentile("span_v", 0.5).alias("median_span_v"))
    return spans.join(typical, ["cell_id", "step"]).withColumn(
        "is_short", F.col("span_v") < F.col("median_span_v") * threshold
    )


def sample_half_cycles(keys: DataFrame, n: int) -> DataFrame:
    """At most ``n`` evenly spaced half-cycles per cell (ranks rounded half to even)."""
    cell = Window.partitionBy(*CELL)
    ranked = keys.select(
        *HALF, (F.row_number().over(cell.orderBy("cycle", "step")) - 1).alias("r"), F.count(F.lit(1)).over(cell).alias("c")
    )
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("c") - 1) / F.lit(max(n - 1, 1))))
    return ranked.filter((F.col("c") <= n) | F.array_contains(wanted, F.col("r").cast("double"))).select(*HALF)


def label_cycles(cycles: DataFrame, most: int = 10) -> DataFrame:
    """Every k-th cycle plus the last one, so that about ``most`` labels remain."""
    cell = Window.partitionBy(*CELL)
    ranked = cycles.select(
        *CYCLE, (F.row_number().over(cell.orderBy("cycle")) - 1).alias("r"), F.count(F.lit(1)).over(cell).alias("c")
    )
    stride = F.greatest(F.lit(1), F.ceil(F.col("c") / most))
    return ranked.filter((F.col("r") % stride == 0) | (F.col("r") == F.col("c") - 1)).select(*CYCLE)


def caption_window(records: DataFrame, cells: DataFrame) -> DataFrame:
    """Stated voltage limits when they are valid, else the measured range."""
    measured = records.groupBy(*CELL).agg(F.min("voltage").alias("v_min"), F.max("voltage").alias("v_max"))
    valid = F.coalesce(F.col("voltage_upper_v") > F.col("voltage_lower_v"), F.lit(False))
    return measured.join(cells.select(*CELL, "voltage_lower_v", "voltage_upper_v"), CELL, "left").select(
        *CELL,
        F.when(valid, F.col("voltage_lower_v")).otherwise(F.col("v_min")).alias("low_v"),
        F.when(valid, F.col("voltage_upper_v")).otherwise(F.col("v_max")).alias("high_v"),
        F.when(valid, "stated").otherwise("measured").alias("source"),
    )


def first_present(df: DataFrame, wanted: tuple[str, ...]) -> Column | None:
    """Column by alias: bare names first, then a single column ending in ``_<name>``."""
    for name in wanted:
        if name in df.columns:
            return F.col(name)
    for name in wanted:
        hits = [c for c in df.columns if c.endswith("_" + name)]
        if hits:
            return F.col(hits[0]) if len(hits) == 1 else None
    return None


def rule_violations(cells: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per (cell, broken rule); a rule is a Column that must be true."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return cells.select(*CELL, F.explode(F.array_compact(broken)).alias("rule"))


def cell_rules() -> dict[str, Column]:
    """Settings every cell must meet before a run."""
    return {
        "composition is given": F.length(F.trim("composition")) > 0,
        "electrode type is positive or negative": F.lower("electrode_type").isin("positive", "negative"),
        "mass is positive": F.col("active_mass_mg") > 0,
        "theoretical capacity is positive": F.col("theoretical_mAh_g") > 0,
        "voltage window is ordered": F.col("voltage_upper_v") > F.col("voltage_lower_v"),
        "max cycle is positive": F.col("max_cycle").isNull() | (F.col("max_cycle") > 0),
    }


def explicit_overrides(cells: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """(cell, setting, value) for settings that differ from automatic and from the default."""
    entries = F.array(
        *[
            F.when(
                F.col(name).isNotNull() & (F.lower(F.col(name).cast("string")) != "auto") & (F.col(name) != F.lit(default)),
                F.struct(F.lit(name).alias("setting"), F.col(name).cast("string").alias("value")),
            )
            for name, default in defaults.items()
        ]
    )
    return cells.select(*CELL, F.inline(F.array_compact(entries)))
