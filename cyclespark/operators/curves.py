"""dQ/dV curves: exact-charge histograms, rebinning, smoothing, reconstruction, trims.

A curve is bounded by (voltage span / bin width) whatever the number of
records behind it, so windows and arrays over one curve are small; everything
before that point works on record slices.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cyclespark.functions.arrays import on_arrays
from cyclespark.functions.scalars import step_sign
from cyclespark.operators.clean import orient_dqdv
from cyclespark.operators.ordered import attach, parts, sliced, slices, uncut, with_previous, with_totals
from cyclespark.operators.peaks import settle
from cyclespark.schema import CELL, HALF

# Settings by profile class (fixed values).
PROFILE_SETTINGS = (
    # profile, bin mV, smoothing half-width, window, spikes removed, spike factor, second window, rebin mV
    ("sharp", 1.0, 1, 5, False, 10.0, 11, 2.0),
    ("moderate", 2.0, 3, 9, True, 6.0, None, None),
    ("broad", 5.0, 16, 15, True, 3.0, None, None),
)
SETTING_COLUMNS = ["smoothing_window", "spike_removal", "spike_factor", "second_window", "rebin_mv"]
#: Records of the longest half-cycle whose increments are kept as one row.
ROW_RECORDS = 20_000
POLYNOMIAL_ORDER = 3
SPIKE_WINDOW = 5


def profile_settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(PROFILE_SETTINGS),
        "profile string, bin_mv double, smooth_bins int, smoothing_window int, spike_removal boolean, "
        "spike_factor double, second_window int, rebin_mv double",
    )


def with_profile_settings(profiles: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Settings of each cell: its profile's defaults, replaced by stated overrides."""
    names = [c for c in profile_settings(profiles.sparkSession).columns if c != "profile"]
    out = profiles.join(F.broadcast(profile_settings(profiles.sparkSession)), "profile", "left")
    if overrides is None:
        return out
    stated = overrides.select(*CELL, *[F.col(c).alias(f"_{c}") for c in names if c in overrides.columns])
    joined = out.join(stated, CELL, "left")
    return joined.select(
        *[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in joined.columns else F.col(c) for c in out.columns]
    )


def along_bins(curve: DataFrame, name: str, value: str, prepare: dict[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Add a column whose value for bin ``i`` is an expression over the whole curve.

    A curve is bounded by its bins, so it travels as one row with the sorted
    array ``_p`` of its points; ``prepare`` names expressions over ``_p`` that
    are computed once per curve.
    """
    others = [c for c in curve.columns if c not in (*HALF, *keys, "bin", name)]
    rows = curve.groupBy(*HALF, *keys).agg(F.array_sort(F.collect_list(F.struct("bin", *others))).alias("_p"))
    for column, expression in prepare.items():
        rows = settle(rows.withColumn(column, F.expr(expression)))
    fields = ", ".join(f"x.{c} AS {c}" for c in ("bin", *others))
    return rows.select(*HALF, *keys, F.inline(F.expr(f"transform(_p, (x, i) -> struct({fields}, {value} AS {name}))")))


#: Weights of the repeated [1/2, 1/2] kernel with _h bins on each side.
BINOMIAL = "aggregate(if(_h > 0, sequence(1, 2 * _h), cast(array() AS array<int>)), array(pow(0.5D, 2 * _h)), (a, k) -> concat(a, array(element_at(a, -1) * (2 * _h - k + 1) / k)))"


def increments(records: DataFrame) -> DataFrame:
    """Charge passed between consecutive records and the voltages it was passed between."""
    rows = sliced(records.filter("voltage IS NOT NULL AND capacity IS NOT NULL"))
    pairs = with_previous(rows.select(*parts(rows), "n_slices", "seq", "voltage", "capacity"), {"voltage": "v0", "capacity": "q0"})
    return pairs.filter("has_previous").select(
        *parts(pairs), "n_slices", "v0", F.col("voltage").alias("v1"), F.abs(F.col("capacity") - F.col("q0")).alias("dq"),
        ((F.col("voltage") + F.col("v0")) * 0.5).alias("v_mid"),
    )


def _median_spacing(steps: DataFrame) -> DataFrame:
    """Median gap between sorted mid-voltages of each half-cycle.

    Measured voltages repeat, so distinct values are counted first; a repeated
    value stands for (count - 1) gaps of zero.
    """
    counts = steps.groupBy(*HALF, "v_mid").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*HALF).orderBy("v_mid")
    gaps = counts.select(*HALF, "k", (F.col("v_mid") - F.lag("v_mid").over(w)).alias("gap")).select(
        *HALF,
        F.inline(
            F.array(
                F.struct("gap", F.lit(1).cast("long").alias("k")),
                F.struct(F.lit(0.0).alias("gap"), (F.col("k") - 1).alias("k")),
            )
        ),
    )
    return gaps.filter("gap IS NOT NULL AND k > 0").groupBy(*HALF).agg(F.percentile("gap", 0.5, F.col("k")).alias("spacing"))


def bin_plan(steps: DataFrame, settings: DataFrame) -> DataFrame:
    """Bin layout of each half-cycle.

    ``settings`` holds per cell: window_low_v, window_high_v, bin_mv,
    smooth_bins.  The window test uses the middle of an increment; the range
    is then clipped to what was visited, and the width widened to the record
    spacing and to one record per bin on average.
    """
    halves = steps.groupBy(*HALF).agg(slices(), F.count(F.lit(1)).alias("n_steps"), F.sum("dq").alias("charge_total"), F.max("dq").alias("dq_max"))
    halves = halves.filter("n_steps >= 4 AND dq_max > 0").join(settings, CELL)
    wanted = halves.select(*HALF, "n_slices", "window_low_v", "window_high_v")
    inside = attach(steps, wanted).filter("v_mid >= window_low_v AND v_mid <= window_high_v")
    seen = inside.groupBy(*HALF).agg(
        F.count(F.lit(1)).alias("n_inside"),
        F.sum("dq").alias("charge_in_window"),
        F.min(F.least("v0", "v1")).alias("seen_lo"),
        F.max(F.greatest("v0", "v1")).alias("seen_hi"),
        F.percentile(F.when(F.col("dq") > 0, F.col("dq")), 0.5).alias("dq_per_record"),
    )
    return _layout(halves.join(seen, HALF).join(_median_spacing(steps), HALF, "left"))


def _layout(plan: DataFrame) -> DataFrame:
    """Range, width and number of the bins, from what was seen of a half-cycle."""
    lo, hi = F.greatest("window_low_v", "seen_lo"), F.least("window_high_v", "seen_hi")
    plan = plan.filter("window_high_v > window_low_v").select(
        "*", F.when(hi > lo, lo).otherwise(F.col("window_low_v")).alias("lo"),
        F.when(hi > lo, hi).otherwise(F.col("window_high_v")).alias("hi"),
    )
    floor = F.greatest(F.coalesce("spacing", F.lit(0.0)), (F.col("hi") - F.col("lo")) / F.col("n_inside"))
    stated = F.col("bin_mv") / 1000.0
    plan = plan.withColumn("width", F.greatest(stated, floor)).withColumn("widened", F.col("width") > stated)
    return plan.withColumn("n_bins", F.greatest(F.lit(4), F.ceil((F.col("hi") - F.col("lo")) / F.col("width"))).cast("int"))


def laid_out(steps: DataFrame, settings: DataFrame) -> DataFrame:
    """The bin plan with the increments it is for, as arrays ``v0``, ``v1``, ``dq``: one row per half-cycle.

    ``steps`` are increments of half-cycles of up to ``ROW_RECORDS`` records. They meet where the windows behind them left them,
    so nothing is shuffled for the plan, nor later for the curves.
    """
    rows = steps.groupBy(*HALF).agg(
        slices(), F.count(F.lit(1)).alias("n_steps"), F.sum("dq").alias("charge_total"), F.max("dq").alias("dq_max"),
        *[F.collect_list(c).alias(c) for c in INCREMENT],
    )
    rows = rows.filter("n_steps >= 4 AND dq_max > 0").join(settings, CELL)
    kind = "n_inside bigint, charge_in_window double, seen_lo double, seen_hi double, dq_per_record double, spacing double"
    rows = rows.withColumn("_s", F.pandas_udf(seen_inside, kind)(*INCREMENT, "window_low_v", "window_high_v"))
    return _layout(rows.select("*", "_s.*").drop("_s").filter("n_inside > 0"))


#: Columns of an increment that a row of ``laid_out`` holds as arrays.
INCREMENT = ("v0", "v1", "dq")


def seen_inside(starts: pd.Series, ends: pd.Series, charges: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.DataFrame:
    """What each half-cycle's increments show inside its window, and the median gap between all their sorted middles."""
    out = []
    for v0, v1, dq, low, high in zip(starts, ends, charges, lows, highs):
        mid = (v1 + v0) * 0.5
        inside = (mid >= low) & (mid <= high)
        a, b, q = np.minimum(v0, v1)[inside], np.maximum(v0, v1)[inside], dq[inside]
        some = q[q > 0]
        out.append((
            len(q), q.sum() if len(q) else None, a.min() if len(q) else None, b.max() if len(q) else None,
            middle(some) if len(some) else None, middle(np.diff(np.sort(mid))) if len(mid) > 1 else None,
        ))
    return pd.DataFrame(out, columns=["n_inside", "charge_in_window", "seen_lo", "seen_hi", "dq_per_record", "spacing"])


def middle(values: np.ndarray) -> float:
    """The median of finite values."""
    ordered, half = np.sort(values), len(values) // 2
    return ordered[half] if len(values) % 2 else (ordered[half - 1] + ordered[half]) / 2


def increment_rows(layouts: DataFrame) -> DataFrame:
    """The increments that rows of ``laid_out`` hold, one row each."""
    rows = layouts.select(*HALF, "n_slices", F.explode(F.arrays_zip(*INCREMENT)).alias("_x"))
    return rows.select(*HALF, "n_slices", "_x.*").withColumn("v_mid", (F.col("v1") + F.col("v0")) * 0.5)


def shift_plan(plan: DataFrame, phase: Column | float) -> DataFrame:
    """The same plan with its bin edges moved down by a fraction of a bin."""
    phase = F.lit(phase) if isinstance(phase, float) else phase
    moved = plan.withColumn("lo", F.col("lo") - phase * F.col("width"))
    return moved.withColumn("n_bins", F.greatest(F.lit(4), F.ceil((F.col("hi") - F.col("lo")) / F.col("width"))).cast("int"))


def _spread(steps: DataFrame, plan: DataFrame, group: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """Charge and record count of the bins that some increment covers.

    Each increment's charge is spread over the bins its voltage span covers
    in proportion to the overlap; an increment without span goes to one bin.
    """
    columns = ["lo", "width", "n_bins", *extra]
    layout = plan.select(*group, "n_slices", "hi", *[c for c in ("window_low_v", "window_high_v") if c not in extra], *columns)
    inside = attach(steps, layout).filter("v_mid >= window_low_v AND v_mid <= window_high_v")
    a, b = F.least("v0", "v1"), F.greatest("v0", "v1")
    at = lambda v: F.floor((v - F.col("lo")) / F.col("width")).cast("int")
    clamp = lambda k: F.greatest(F.lit(0), F.least(F.col("n_bins") - 1, k))
    placed = inside.select(
        *group, *columns, "dq", a.alias("a"), b.alias("b"), clamp(at(a)).alias("first"), clamp(at(b)).alias("last"),
        clamp(at(F.col("v_mid"))).alias("home"),
    )
    spread = placed.select("*", F.explode(F.sequence("first", "last")).alias("bin"))
    low = F.col("lo") + F.col("width") * F.col("bin")
    overlap = F.greatest(F.lit(0.0), F.least("b", low + F.col("width")) - F.greatest("a", low))
    share = F.when(F.col("b") > F.col("a"), F.col("dq") * overlap / (F.col("b") - F.col("a"))).otherwise(F.col("dq"))
    # Every increment covers the bin of its own middle, so one pass gives charge and record count.
    return spread.groupBy(*group, *columns, "bin").agg(
        F.sum(share).alias("charge"), F.sum((F.col("bin") == F.col("home")).cast("int")).alias("occupancy")
    )


def charge_in_bins(steps: DataFrame, plan: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Charge and record count of every bin of the plan, empty bins included."""
    group = [*HALF, *keys]
    charge = _spread(steps, plan, group).select(*group, "bin", "charge", "occupancy")
    spine = plan.select(*group, "lo", "width", "n_bins").withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)))
    return (
        spine.join(charge, [*group, "bin"], "left")
        .select(
            *group, "bin", (F.col("lo") + F.col("width") * (F.col("bin") + 0.5)).alias("voltage"), "width",
            F.coalesce("charge", F.lit(0.0)).alias("charge"), F.coalesce("occupancy", F.lit(0)).alias("occupancy"),
        )
    )


def counted_curves(
    starts: pd.Series, ends: pd.Series, charges: pd.Series, window_lows: pd.Series, window_highs: pd.Series, lows: pd.Series, n_bins: pd.Series, widths: pd.Series
) -> pd.DataFrame:
    """Occupied bins of each half-cycle with the charge and number of the increments whose middle they hold."""
    out = []
    for v0, v1, dq, low, high, lo, n, width in zip(starts, ends, charges, window_lows, window_highs, lows, n_bins, widths):
        mid = (v1 + v0) * 0.5
        inside = (mid >= low) & (mid <= high) & (mid >= lo) & (mid <= lo + width * n)
        home = np.minimum(n - 1, np.floor((mid[inside] - lo) / width)).astype(np.int64)
        count = np.bincount(home, minlength=n)
        at = np.flatnonzero(count)
        out.append((at.astype(np.int32), np.bincount(home, dq[inside], n)[at], count[at]))
    return pd.DataFrame(out, columns=["bin", "charge", "occupancy"])


def counted_charge(steps: DataFrame | None, plan: DataFrame) -> DataFrame:
    """The counting alternative: each increment goes whole into the bin of its middle.

    A plan that holds its increments (``laid_out``) needs no steps, and nothing is shuffled.
    """
    if steps is None:
        counted = on_arrays(counted_curves, "bin array<int>, charge array<double>, occupancy array<bigint>")
        rows = settle(plan.select(*HALF, counted(*INCREMENT, "window_low_v", "window_high_v", "lo", "n_bins", "width").alias("_c")))
        return rows.select(*HALF, F.inline(F.arrays_zip("_c.bin", "_c.charge", "_c.occupancy")))
    layout = plan.select(*HALF, "n_slices", "lo", "hi", "width", "n_bins", "window_low_v", "window_high_v")
    inside = attach(steps, layout).filter(
        "v_mid >= window_low_v AND v_mid <= window_high_v AND v_mid >= lo AND v_mid <= lo + width * n_bins"
    )
    home = F.least(F.col("n_bins") - 1, F.floor((F.col("v_mid") - F.col("lo")) / F.col("width")).cast("int"))
    return inside.groupBy(*HALF, home.alias("bin")).agg(F.sum("dq").alias("charge"), F.count(F.lit(1)).alias("occupancy"))


def smooth_binomial(curve: DataFrame, half_width: str = "half_width", source: str = "raw", keys: tuple[str, ...] = ()) -> DataFrame:
    """Zero-padded binomial smoothing with a half-width per half-cycle (no renormalisation at the ends)."""
    prepare = {
        "_h": f"coalesce(_p[0].{half_width}, 0)", "_n": "size(_p)", "_y": f"transform(_p, x -> cast(x.{source} AS double))",
        "_k": BINOMIAL,
    }
    value = "aggregate(sequence(greatest(0, i - _h), least(_n - 1, i + _h)), 0D, (s, j) -> s + _y[j] * _k[j - i + _h])"
    return along_bins(curve, "dqdv", value, prepare, keys)


def histogram_arrays(steps: DataFrame | None, plan: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Curves as ``histogram_curves`` has them, one row each: arrays ``charge``, ``occupancy``, ``dqdv`` in order of the bins.

    ``plan`` is a bin plan of these steps, so each of its half-cycles has charge.  The bins of a curve meet where its records
    already are, so they pass no shuffle of their own.  A plan that holds its increments (``laid_out``) needs no steps.
    """
    group = [*HALF, *keys]
    half_width = F.least("smooth_bins", F.floor((F.col("n_bins") - 1) / 2).cast("int"))
    layout = plan.filter("n_bins >= 5").withColumn("half_width", half_width)
    # What peaks and reversals need of the settings goes along, so that no curve is shuffled for it.
    extra = ("half_width", "dq_per_record", *[c for c in ("profile", "window_low_v", "window_high_v") if c in plan.columns])
    columns = ["lo", "width", "n_bins", *extra]
    kind = "charge array<double>, occupancy array<bigint>, dqdv array<double>"
    smooth = ("n_bins", "width", "half_width", step_sign(F.col("step")))
    if steps is None:
        full = on_arrays(spread_curves, kind)(*INCREMENT, "window_low_v", "window_high_v", "lo", *smooth)
        # Settled, else a filter on the curve would compute it a second time.
        return settle(layout.withColumn("_c", full).select(*group, "lo", "width", *extra, "_c.*"))
    got = _spread(steps, layout, group, extra).groupBy(*group, *columns).agg(F.collect_list(F.struct("bin", "charge", "occupancy")).alias("_g"))
    full = on_arrays(dense_curves, kind)("_g.bin", "_g.charge", "_g.occupancy", *smooth)
    return settle(got.withColumn("_c", full).select(*group, "lo", "width", *extra, "_c.*"))


def dense_curves(
    bins: pd.Series, charges: pd.Series, counts: pd.Series, n_bins: pd.Series, widths: pd.Series, half_widths: pd.Series, signs: pd.Series
) -> pd.DataFrame:
    """Each curve's bins with the empty ones, and the charge per volt smoothed by the zero-padded binomial kernel."""
    out = []
    for at, q, c, n, width, h, sign in zip(bins, charges, counts, n_bins, widths, half_widths, signs):
        charge, occupancy = np.zeros(n), np.zeros(n, np.int64)
        charge[at], occupancy[at] = q, c
        out.append((charge, occupancy, smoothed(charge, width, h, sign)))
    return pd.DataFrame(out, columns=["charge", "occupancy", "dqdv"])


def smoothed(charge: np.ndarray, width: float, half_width: float, sign: int) -> np.ndarray:
    n, h = len(charge), 0 if pd.isna(half_width) else int(half_width)
    padded, smooth = np.zeros(n + 2 * h), np.zeros(n)
    padded[h : h + n] = charge / width
    weight = 0.5 ** (2 * h)
    for k in range(2 * h + 1):
        weight = weight * (2 * h - k + 1) / k if k else weight
        smooth += padded[k : k + n] * weight
    return smooth * sign


#: Curves that are worked out together, and increments by bins that they cover at most.
CURVES, COVERED = 256, 1_000_000


def smoothed_together(charge: np.ndarray, n_bins: np.ndarray, widths: np.ndarray, half_widths: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Curves that stand one after the other, each as ``smoothed`` has it: those of one kernel pass it together, zeros between them."""
    first, out = np.cumsum(n_bins) - n_bins, np.zeros(len(charge))
    half_widths = np.where(pd.isna(half_widths), 0, half_widths).astype(np.int64)
    for h in np.unique(half_widths):
        which = np.flatnonzero(half_widths == h)
        n = n_bins[which]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, to = np.repeat(first[which], n) + inner, np.repeat(np.cumsum(n + 2 * h) - (n + 2 * h), n) + inner
        padded = np.zeros(int((n + 2 * h).sum()))
        padded[to + h] = charge[at] / np.repeat(widths[which], n)
        smooth, weight = np.zeros(len(padded) - 2 * h), 0.5 ** (2 * h)
        for k in range(2 * h + 1):
            weight = weight * (2 * h - k + 1) / k if k else weight
            smooth += padded[k : k + len(smooth)] * weight
        out[at] = smooth[to] * np.repeat(signs[which], n)
    return out


def spread_curves(
    starts: pd.Series, ends: pd.Series, charges: pd.Series, window_lows: pd.Series, window_highs: pd.Series, lows: pd.Series,
    n_bins: pd.Series, widths: pd.Series, half_widths: pd.Series, signs: pd.Series,
) -> pd.DataFrame:
    """Curves of increments: each one's charge is spread over the bins it covers, as ``_spread`` does, and the bins smoothed."""
    arrays = [c.tolist() for c in (starts, ends, charges)]
    numbers = [c.to_numpy() for c in (window_lows, window_highs, lows, n_bins, widths, half_widths, signs)]
    out = [_spread_together(*[c[k : k + CURVES] for c in (*arrays, *numbers)]) for k in range(0, len(charges), CURVES)]
    return pd.DataFrame([row for rows in out for row in rows], columns=["charge", "occupancy", "dqdv"])


def _spread_together(starts, ends, charges, window_lows, window_highs, lows, n_bins, widths, half_widths, signs) -> list[tuple]:
    v0, v1, dq = (np.concatenate(c) for c in (starts, ends, charges))
    own = np.repeat(np.arange(len(charges)), [len(q) for q in charges])
    mid = (v1 + v0) * 0.5
    inside = (mid >= window_lows[own]) & (mid <= window_highs[own])
    a, b, q, mid, own = np.minimum(v0, v1)[inside], np.maximum(v0, v1)[inside], dq[inside], mid[inside], own[inside]
    lo, width, n = lows[own], widths[own], n_bins[own]
    first, last, home = (np.clip(np.floor((v - lo) / width), 0, n - 1).astype(np.int64) for v in (a, b, mid))
    covered = last - first + 1
    if len(charges) > 1 and covered.sum() > COVERED:
        half = len(charges) // 2
        columns = (starts, ends, charges, window_lows, window_highs, lows, n_bins, widths, half_widths, signs)
        return _spread_together(*[c[:half] for c in columns]) + _spread_together(*[c[half:] for c in columns])
    at, total = np.cumsum(n_bins) - n_bins, int(n_bins.sum())
    charge = np.zeros(total)
    for some in np.array_split(np.arange(len(q)), 1 + int(covered.sum()) // COVERED):
        each = np.repeat(some, covered[some])
        before = np.repeat(np.cumsum(covered[some]) - covered[some], covered[some])
        bins = first[each] + np.arange(len(each)) - before
        edge = lo[each] + width[each] * bins
        overlap = np.maximum(0.0, np.minimum(b[each], edge + width[each]) - np.maximum(a[each], edge))
        span = (b - a)[each]
        share = np.where(span > 0, q[each] * overlap / np.where(span > 0, span, 1.0), q[each])
        charge += np.bincount(at[own[each]] + bins, share, total)
    counts = np.bincount(at[own] + home, minlength=total)
    smooth = smoothed_together(charge, n_bins, widths, half_widths, signs)
    cuts = list(zip(at.tolist(), (at + n_bins).tolist()))
    return [(charge[i:j], counts[i:j], smooth[i:j]) for i, j in cuts]


def curve_rows(arrays: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per bin of curves that are arrays."""
    rows = arrays.select(*HALF, *keys, "lo", "width", "dq_per_record", "half_width", F.posexplode(F.arrays_zip("charge", "occupancy", "dqdv")).alias("bin", "_x"))
    return rows.select(
        *HALF, *keys, "bin", (F.col("lo") + F.col("width") * (F.col("bin") + 0.5)).alias("voltage"), "width", F.col("_x.dqdv").alias("dqdv"),
        F.col("_x.occupancy").alias("occupancy"), F.col("_x.charge").alias("charge"), "half_width", "dq_per_record",
    )


def histogram_curves(steps: DataFrame, plan: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Signed, smoothed dQ/dV curve of every half-cycle with at least five bins."""
    return curve_rows(histogram_arrays(steps, plan, keys), keys)


def rebin(curve: DataFrame, width_mv: Column | float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Uniform grid by the mean of the records in a bin, each weighted by its own voltage span."""
    rows = curve.select(*HALF, *keys, "seq", "voltage", "dqdv") if isinstance(width_mv, (int, float)) else curve
    width = (F.lit(width_mv) if isinstance(width_mv, (int, float)) else width_mv) / 1000.0
    rows = uncut(rows.withColumn("_width", width))
    rows = with_span(rows, Window.partitionBy(*HALF, *keys).orderBy("voltage", "seq"))
    rows = with_totals(rows, lo=F.min("voltage"), hi=F.max("voltage"))
    last = F.greatest(F.lit(0), F.ceil((F.col("hi") - F.col("lo")) / F.col("_width")).cast("int") - 1)
    placed = rows.withColumn("bin", F.least(F.floor((F.col("voltage") - F.col("lo")) / F.col("_width")).cast("int"), last))
    return placed.groupBy(*HALF, *keys, "bin").agg(
        F.first(F.col("lo") + F.col("_width") * (F.col("bin") + 0.5)).alias("voltage"),
        F.when(F.sum("span") > 0, F.sum(F.col("dqdv") * F.col("span")) / F.sum("span")).otherwise(F.avg("dqdv")).alias("dqdv"),
    )


def with_span(curve: DataFrame, w) -> DataFrame:
    """Voltage span belonging to each point of a sorted curve (half-way to both neighbours)."""
    v, before, after = F.col("voltage"), F.lag("voltage").over(w), F.lead("voltage").over(w)
    inner = (after - before) / 2.0
    return curve.withColumn(
        "span",
        F.abs(F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise(inner)),
    )


def rebin_sensitivity(curve: DataFrame, widths: tuple[float, ...] = (1.0, 2.0, 4.0)) -> DataFrame:
    """Apex and area of a curve at several bin widths, with spreads and stability flags."""
    repeated = curve.withColumn("width_mv", F.explode(F.array(*[F.lit(x) for x in widths])))
    binned = rebin(repeated, F.col("width_mv"), ("width_mv",))
    w = Window.partitionBy(*HALF, "width_mv").orderBy("voltage")
    area = (F.abs("dqdv") + F.abs(F.lag("dqdv").over(w))) / 2 * (F.col("voltage") - F.lag("voltage").over(w))
    per_width = (
        binned.select("*", area.alias("slab"))
        .groupBy(*HALF, "width_mv")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max_by("voltage", F.struct(F.abs("dqdv"), -F.col("voltage"))).alias("apex_v"),
            F.sum("slab").alias("area"),
        )
        .filter("n >= 3")
    )
    agg = per_width.groupBy(*HALF).agg(
        ((F.max("apex_v") - F.min("apex_v")) * 1000.0).alias("apex_spread_mv"),
        F.when(F.percentile("area", 0.5) != 0, (F.max("area") - F.min("area")) / F.percentile("area", 0.5)).alias("area_spread"),
    )
    return agg.select(
        "*",
        (F.col("apex_spread_mv") <= 10.0).alias("apex_stable"),
        F.coalesce(F.col("area_spread") <= 0.10, F.lit(False)).alias("area_stable"),
    )


def remove_spikes(curve: DataFrame, factor: Column | float = 3.0, by: tuple = ("voltage",), tallest: str | None = None) -> DataFrame:
    """Replace points far from a 5-point rolling median (in rolling-MAD units) by that median.

    ``tallest`` names a column with the curve's largest absolute value when the
    rows are slices of a longer curve.
    """
    w = Window.partitionBy(*parts(curve)).orderBy(*by)
    near = w.rowsBetween(-(SPIKE_WINDOW // 2), SPIKE_WINDOW // 2)
    factor = F.lit(factor) if isinstance(factor, float) else factor
    top = F.col(tallest) if tallest else F.max(F.abs("dqdv")).over(Window.partitionBy(*parts(curve)))
    a = curve.withColumn("_median", F.percentile("dqdv", 0.5).over(near)).withColumn("_top", top)
    a = a.withColumn("_off", F.abs(F.col("dqdv") - F.col("_median")))
    a = a.withColumn("_mad", F.greatest(F.percentile("_off", 0.5).over(near) * 1.4826, F.col("_top") * 1e-6))
    spike = F.col("_off") > factor * F.col("_mad")
    return (
        a.withColumn("is_spike", F.coalesce(spike, F.lit(False)))
        .withColumn("dqdv", F.when(F.col("is_spike"), F.col("_median")).otherwise(F.col("dqdv")))
        .drop("_median", "_top", "_off", "_mad")
    )


@lru_cache
def savgol_rows(window: int, order: int, derivative: int = 0) -> tuple[tuple[float, ...], ...]:
    """Least-squares polynomial weights: row i evaluates the fit of a window at its point i."""
    x = np.arange(window) - window // 2
    design = np.vander(x, order + 1, increasing=True)
    solve = np.linalg.pinv(design)
    rows = []
    for at in x:
        basis = np.array(
            [0.0 if k < derivative else float(np.prod(range(k - derivative + 1, k + 1))) * at ** (k - derivative) for k in range(order + 1)]
        )
        rows.append(tuple(float(c) for c in basis @ solve))
    return tuple(rows)


def savgol(
    curve: DataFrame, windows: tuple[int, ...], window: Column | None = None, order: int = POLYNOMIAL_ORDER,
    source: str = "dqdv", by: tuple = ("voltage",),
) -> DataFrame:
    """Savitzky-Golay smoothing with one of ``windows`` per curve.

    Even windows count as the next odd one, and one of 1 or less as none.
    Points near an end use the polynomial of the first or last full window.
    A NULL window, or a curve not longer than it, is left unsmoothed; a window
    that is not among ``windows`` is an error.
    """
    windows = tuple(sorted({n | 1 for n in windows if n > 1})) or (3,)
    widest = max(windows)
    stated = F.lit(windows[0]) if window is None else window
    odd = stated + F.when(stated % 2 == 0, 1).otherwise(0)
    known = F.when(odd.isin(*windows), odd).otherwise(F.raise_error(F.concat(F.lit("smoothing window not listed: "), odd.cast("string"))).cast("int"))
    size = F.when(stated > 1, known)
    w = Window.partitionBy(*parts(curve)).orderBy(*by)
    a = curve.select(
        "*",
        size.alias("_w"),
        (F.row_number().over(w) - 1).alias("_i"),
        F.count(F.lit(1)).over(Window.partitionBy(*parts(curve))).cast("int").alias("_n"),
        # A full window on either side, so that border points see the border window too.
        F.collect_list(source).over(w.rowsBetween(1 - widest, widest - 1)).alias("_near"),
    )
    kernels = F.create_map(
        *[
            x
            for n in windows
            for x in (F.lit(n), F.array(*[F.array(*[F.lit(c) for c in r]) for r in savgol_rows(n, min(order, n - 1))]))
        ]
    )
    a = a.withColumn("_start", F.greatest(F.lit(0), F.least(F.col("_i") - F.floor(F.col("_w") / 2).cast("int"), F.col("_n") - F.col("_w"))))
    first = F.greatest(F.lit(0), F.col("_i") - (widest - 1))
    values = F.slice("_near", F.col("_start") - first + 1, F.col("_w"))
    row = F.get(F.try_element_at(kernels, F.col("_w")), F.col("_i") - F.col("_start"))
    smooth = F.aggregate(F.zip_with(values, row, lambda y, c: y * c), F.lit(0.0), lambda s, x: s + x)
    long_enough = F.coalesce(F.col("_n") > F.col("_w"), F.lit(False))
    return a.withColumn(source, F.when(long_enough, smooth).otherwise(F.col(source))).drop("_i", "_n", "_near", "_w", "_start")


def smoothing_windows(overrides: DataFrame, column: str, defaults: tuple[int, ...]) -> tuple[int, ...]:
    """The windows a job needs: the defaults and those stated in ``overrides`` (one row per cell)."""
    if column not in overrides.columns:
        return defaults
    return tuple({*defaults, *(r[0] for r in overrides.select(column).distinct().collect() if r[0] is not None)})


def derivative_curves(records: DataFrame, settings: DataFrame, windows: tuple[int, ...] = (5, 9, 15), second: tuple[int, ...] = (11,)) -> DataFrame:
    """Curves from the cycler's own dQ/dV: oriented, windowed, rebinned where asked, despiked, smoothed.

    ``windows`` and ``second`` are the smoothing windows that the settings may
    hold (see ``smoothing_windows``); a setting outside them is an error.
    """
    rows = uncut(orient_dqdv(records).filter("dqdv IS NOT NULL AND voltage IS NOT NULL").select(*HALF, "seq", "voltage", "dqdv"))
    layout = rows.groupBy(*HALF).agg(slices()).join(settings, CELL)
    inside = attach(
        rows, layout.select(*HALF, "n_slices", "window_low_v", "window_high_v", *SETTING_COLUMNS)
    ).filter("voltage >= window_low_v AND voltage <= window_high_v")
    inside = with_totals(inside, n_kept=F.count(F.lit(1))).filter("n_kept >= 5").drop("n_kept")
    columns = [*parts(rows), "n_slices", "seq", "voltage", "dqdv", *SETTING_COLUMNS]
    grid = rebin(inside.filter("rebin_mv IS NOT NULL"), F.col("rebin_mv")).join(layout.select(*HALF, *SETTING_COLUMNS), HALF)
    grid = grid.withColumns({"n_slices": F.lit(1), "seq": F.col("bin").cast("long")})
    curve = inside.filter("rebin_mv IS NULL").select(*columns).unionByName(grid.select(*columns))
    curve = with_totals(curve, tallest=F.max(F.abs("dqdv"))).withColumn("raw", F.col("dqdv"))
    order = ("voltage", "seq")
    despiked = remove_spikes(curve, F.when(F.col("spike_removal"), F.col("spike_factor")), by=order, tallest="tallest")
    once = savgol(despiked, windows, F.col("smoothing_window"), by=order)
    twice = savgol(once, second, F.col("second_window"), by=order)
    return twice.select(*HALF, "seq", "voltage", "raw", "dqdv", "is_spike")


def trapezoid_area(curve: DataFrame, value: Column) -> DataFrame:
    """Integral of ``value`` over the curve's voltage."""
    w = Window.partitionBy(*HALF).orderBy("voltage")
    slab = (F.col("_y") + F.lag("_y").over(w)) / 2 * (F.col("voltage") - F.lag("voltage").over(w))
    return curve.withColumn("_y", value).select(*HALF, slab.alias("_s")).groupBy(*HALF).agg(
        F.count(F.lit(1)).alias("n_points"), F.sum("_s").alias("area")
    )


def integral_fidelity(curve: DataFrame, capacity: DataFrame) -> DataFrame:
    """Area under the absolute curve over the capacity of the counter."""
    area = trapezoid_area(curve, F.abs("dqdv"))
    return area.join(capacity, HALF, "left").select(
        *HALF, F.when((F.col("n_points") >= 2) & (F.col("capacity_mAh_g") > 0), F.col("area") / F.col("capacity_mAh_g")).alias("fidelity")
    )


def describe_fidelity(fidelity: DataFrame, floor: float = 0.80, ceiling: float = 1.20) -> DataFrame:
    """Median, worst and largest fidelity per cell and step with a verdict."""
    agg = fidelity.filter("fidelity IS NOT NULL").groupBy("cell_id", "step").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("fidelity", 0.5).alias("median"), F.min("fidelity").alias("worst"),
        F.max("fidelity").alias("most"),
    )
    verdict = F.when(F.col("median") < floor, "below").when(F.col("median") > ceiling, "above").otherwise("within")
    return agg.withColumn("verdict", verdict)


def fidelity_outside_band(fidelity: DataFrame, floor: float = 0.80, ceiling: float = 1.20) -> DataFrame:
    return fidelity.filter(F.col("fidelity").isNotNull() & ~F.col("fidelity").between(floor, ceiling))


def interpolate(knots: DataFrame, queries: DataFrame, x: str, y: str, keys: list[str], keep: list[str]) -> DataFrame:
    """Linear interpolation of ``y`` over ``x`` at the query rows, clamped outside the knots.

    Knots and queries are merged and each query looks back and ahead to its
    neighbouring knots; there is no range join.
    """
    # Two running looks, one down and one up the order: linear in the rows of a key.
    w = Window.partitionBy(*keys).orderBy(x, "_kind", "_y").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*keys).orderBy(F.desc(x), F.desc("_kind"), F.desc("_y")).rowsBetween(Window.unboundedPreceding, 0)
    a = knots.select(*keys, x, F.col(y).alias("_y"), F.lit(0).alias("_kind"), *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in keep])
    b = queries.select(*keys, x, F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_kind"), *keep)
    knot = F.when(F.col("_kind") == 0, F.struct(F.col(x).alias("x"), F.col("_y").alias("y")))
    merged = a.unionByName(b).select(
        "*",
        F.last(knot, ignorenulls=True).over(w).alias("_a"),
        F.last(knot, ignorenulls=True).over(up).alias("_b"),
    )
    line = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * (F.col(x) - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))
    value = (
        F.when(F.col("_a").isNull(), F.col("_b.y"))
        .when(F.col("_b").isNull() | (F.col("_b.x") == F.col("_a.x")), F.col("_a.y"))
        .otherwise(line)
    )
    return merged.filter("_kind = 1").select(*keys, x, *keep, value.alias(y))


def cumulative_charge(curve: DataFrame) -> DataFrame:
    """Running trapezoidal integral of the absolute curve."""
    w = Window.partitionBy(*HALF).orderBy("voltage")
    slab = (F.col("voltage") - F.lag("voltage").over(w)) * 0.5 * (F.abs("dqdv") + F.abs(F.lag("dqdv").over(w)))
    slabs = curve.withColumn("_s", F.coalesce(slab, F.lit(0.0)))
    return slabs.withColumn("q", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def reconstruct_voltage(curve: DataFrame, records: DataFrame) -> DataFrame:
    """Integrate the curve back to a charge-voltage trace and compare it with the records.

    Returns the charge error in per cent and the voltage error (RMSE) over the
    charge range both cover.
    """
    q_curve = cumulative_charge(curve).select(*HALF, "voltage", "q")
    shape = q_curve.groupBy(*HALF).agg(
        F.count(F.lit(1)).alias("n_curve"), F.min("voltage").alias("c0"), F.max("voltage").alias("c1"), F.max("q").alias("q_total")
    ).filter("n_curve >= 3")
    rows = uncut(records.filter("voltage IS NOT NULL AND capacity IS NOT NULL").select(*HALF, "seq", "voltage", "capacity"))
    rows = attach(rows, shape.drop("n_curve", "q_total")).withColumn(
        "near", F.col("voltage").between(F.col("c0") - 1e-9, F.col("c1") + 1e-9)
    )
    order = F.struct("capacity", "seq")
    near = lambda c: F.when(F.col("near"), c)
    sizes = rows.groupBy(*HALF).agg(
        slices(), F.count(F.lit(1)).alias("n_all"), F.count(near(F.lit(1))).alias("n_near"),
        *[
            f(near(F.col("capacity")) if kept else F.col("capacity")).alias(f"{name}_{kept}")
            for kept in (0, 1)
            for name, f in (("lo", F.min), ("hi", F.max))
        ],
        *[
            f(F.col("voltage"), near(order) if kept else order).alias(f"{name}_{kept}")
            for kept in (0, 1)
            for name, f in (("first", F.min_by), ("last", F.max_by))
        ],
    ).filter("n_all >= 3")
    some = F.col("n_near") >= 3
    pick = lambda name: F.when(some, F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))
    span = pick("hi") - pick("lo")
    base = sizes.join(shape, HALF).select(
        *HALF, "n_slices", "q_total", some.alias("only_near"), pick("lo").alias("q_lo"), pick("hi").alias("q_hi"),
        span.alias("q_span"), (pick("last") < pick("first")).alias("flip"),
    )
    knots = attach(rows.drop("c0", "c1"), base.select(*HALF, "n_slices", "only_near", "q_lo", "q_hi", "flip")).filter("near OR NOT only_near")
    knots = knots.select(*HALF, "voltage", F.when(F.col("flip"), F.col("q_hi") - F.col("capacity")).otherwise(F.col("capacity") - F.col("q_lo")).alias("q"))
    wanted = q_curve.withColumnRenamed("voltage", "v_curve").join(base.select(*HALF, "q_total", "q_span"), HALF)
    wanted = wanted.filter(F.col("q") <= F.least("q_span", "q_total")).drop("q_total", "q_span")
    values = interpolate(knots, wanted, "q", "voltage", HALF, ["v_curve"])
    errors = values.groupBy(*HALF).agg(
        F.count(F.lit(1)).alias("n_compared"), F.sqrt(F.avg(F.pow(F.col("voltage") - F.col("v_curve"), 2))).alias("rmse")
    )
    return base.join(errors, HALF, "left").select(
        *HALF,
        F.when(F.col("q_span") > 0, F.abs(F.col("q_total") - F.col("q_span")) / F.col("q_span") * 100.0).alias("ape_pct"),
        F.when(F.col("n_compared") >= 3, F.col("rmse")).alias("rmse_v"),
        F.col("q_total").alias("q_reconstructed"),
        F.col("q_span").alias("q_measured"),
        F.when(F.col("n_compared") >= 3, F.col("n_compared")).otherwise(0).alias("n_compared"),
    )


def describe_reconstruction(checks: DataFrame, plan: DataFrame, window: DataFrame, empty: DataFrame) -> DataFrame:
    """Median errors, share of the window, bin widths, widened and empty share per cell."""
    agg = checks.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("ape_pct", 0.5).alias("ape_pct"), F.percentile("rmse_v", 0.5).alias("rmse_v")
    )
    widths = plan.groupBy(*CELL).agg(
        (F.percentile("width", 0.5) * 1000.0).alias("bin_median_mv"), (F.min("width") * 1000.0).alias("bin_min_mv"),
        (F.max("width") * 1000.0).alias("bin_max_mv"), F.count(F.when(F.col("widened"), 1)).alias("n_widened"),
    )
    share = F.col("rmse_v") / (F.col("window_high_v") - F.col("window_low_v"))
    verdict = F.when(F.col("ape_pct") > 5.0, "charge not accounted for").when(share > 0.05, "charge misplaced").otherwise("ok")
    return agg.join(widths, CELL, "left").join(window, CELL, "left").join(empty, CELL, "left").select(
        *CELL, "n", "ape_pct", "rmse_v", share.alias("window_share"), "bin_median_mv", "bin_min_mv", "bin_max_mv", "n_widened",
        "empty_fraction", verdict.alias("verdict"),
    )


def plateau_structure(records: DataFrame, points: int = 40) -> DataFrame:
    """Flattest and second flattest voltage on an even charge grid, and the number of flat spots.

    The grid has a fixed number of points per half-cycle, so only the
    interpolation touches the records.
    """
    rows = records.filter("voltage IS NOT NULL AND capacity IS NOT NULL").select(*HALF, "seq", "voltage", "capacity")
    w = Window.partitionBy(*HALF).orderBy("capacity", "seq")
    back = Window.partitionBy(*HALF).orderBy(F.desc("capacity"), F.desc("seq"))
    sixth = rows.select(*HALF, "capacity", F.row_number().over(w).alias("a"), F.row_number().over(back).alias("z"))
    ends = sixth.groupBy(*HALF).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("a") == 6, F.col("capacity"))).alias("g0"), F.max(F.when(F.col("z") == 5, F.col("capacity"))).alias("g1")
    ).filter("n >= 20")
    even = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("g0") + (F.col("g1") - F.col("g0")) * i / (points - 1))
    grid = ends.select(*HALF, F.posexplode(even).alias("i", "q"))
    line = interpolate(rows.select(*HALF, "voltage", F.col("capacity").alias("q")), grid, "q", "voltage", HALF, ["i"])
    g = Window.partitionBy(*HALF).orderBy("i")
    lag, lead = (lambda c: F.lag(c).over(g)), (lambda c: F.lead(c).over(g))
    slope = (
        F.when(F.col("i") == 0, (lead("voltage") - F.col("voltage")) / (lead("q") - F.col("q")))
        .when(F.col("i") == points - 1, (F.col("voltage") - lag("voltage")) / (F.col("q") - lag("q")))
        .otherwise((lead("voltage") - lag("voltage")) / (lead("q") - lag("q")))
    )
    a = line.withColumn("a", F.abs(slope))
    lower = [F.col("a") < F.lag("a", k).over(g) for k in (1, 2)] + [F.col("a") < F.lead("a", k).over(g) for k in (1, 2)]
    a = a.withColumn("is_min", F.coalesce(lower[0] & lower[1] & lower[2] & lower[3], F.lit(False)) & F.col("i").between(2, points - 3))
    inner = F.col("i").between(3, points - 4)
    best = a.groupBy(*HALF).agg(
        F.min_by(F.struct("voltage", "q"), F.when(inner, F.struct("a", "i"))).alias("f"), F.sum(F.col("is_min").cast("int")).alias("n_minima")
    )
    second = a.join(best, HALF).filter(inner & (F.abs(F.col("q") - F.col("f.q")) > 15)).groupBy(*HALF).agg(
        F.min_by("voltage", F.struct("a", "i")).alias("second_flattest_v")
    )
    return best.join(second, HALF, "left").select(
        *HALF, F.col("f.voltage").alias("flattest_v"), "second_flattest_v",
        (F.abs(F.col("second_flattest_v") - F.col("f.voltage")) * 1000.0).alias("separation_mv"), "n_minima",
    )


def quantisation_ripple(curve: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Local RMS of what binning equal charge parcels alone would add to a curve.

    Needs ``width``, ``dq_per_record`` and ``half_width`` per bin (see
    ``histogram_curves``).  Parcels are placed by the inverse of the running
    charge: the charge of bin edges by interpolation gives the number of
    parcels of each bin without listing them.
    """
    rows = cumulative_charge(curve.withColumn("dqdv", F.abs("dqdv")))
    whole = Window.partitionBy(*HALF)
    g = whole.orderBy("bin")
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(whole), "q_total": F.max("q").over(whole)})
    n_rec = F.bround(F.col("q_total") / F.col("dq_per_record"))
    # Charge at the upper edge of a bin: half-way to the next centre along the chord.
    upper = F.coalesce((F.col("q") + F.lead("q").over(g)) / 2, F.col("q"))
    lower = F.coalesce((F.col("q") + F.lag("q").over(g)) / 2, F.col("q"))
    below = lambda q: F.greatest(F.lit(0), F.least(n_rec, F.ceil(q / F.col("dq_per_record") - 0.5)))
    upto = lambda q: F.greatest(F.lit(0), F.least(n_rec, F.floor(q / F.col("dq_per_record") + 0.5)))
    last = F.lead("bin").over(g).isNull()
    first = F.lag("bin").over(g).isNull()
    count = F.when(last, upto(upper)).otherwise(below(upper)) - F.when(first, F.lit(0)).otherwise(below(lower))
    rows = rows.withColumn("raw", count * F.col("dq_per_record") / F.col("width")).withColumn("n_rec", n_rec)
    null = smooth_binomial(rows.select(*HALF, "bin", "voltage", "raw", "half_width", "n", "n_rec", F.col("dqdv").alias("y")))
    null = null.withColumnRenamed("dqdv", "null_y").withColumn("raw", F.col("y")).drop("y")
    both = smooth_binomial(null)
    residual = both.withColumn("sq", F.pow(F.col("null_y") - F.col("dqdv"), 2)).select(*HALF, "bin", "voltage", "n", "n_rec", "half_width", "sq")
    # Edge-padded mean square over the window of each half-cycle: weights repeat the end bins.
    prepare = {"_h": "greatest(4, _p[0].half_width)", "_n": "size(_p)", "_y": "transform(_p, x -> x.sq)"}
    padded = (
        "aggregate(sequence(greatest(0, i - _h), least(_n - 1, i + _h)), 0D, (s, j) -> s + _y[j])"
        " + greatest(0, _h - i) * _y[0] + greatest(0, i + _h - _n + 1) * _y[_n - 1]"
    )
    out = along_bins(residual, "mean_square", f"({padded}) / (2 * _h + 1)", prepare)
    enough = (F.col("n") >= 8) & (F.col("n_rec") >= 4)
    return out.select(*HALF, "bin", "voltage", F.when(enough, F.sqrt("mean_square")).otherwise(0.0).alias("ripple"))


def heat_map(curves: DataFrame, v_bins: int = 200) -> DataFrame:
    """Curves of one cell and step on common voltages; NULL outside a curve's own range."""
    bounds = curves.groupBy("cell_id", "step").agg(F.min("voltage").alias("g0"), F.max("voltage").alias("g1"))
    own = curves.groupBy(*HALF).agg(F.min("voltage").alias("c0"), F.max("voltage").alias("c1"))
    grid = own.join(bounds, ["cell_id", "step"]).select(
        *HALF, "c0", "c1", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(v_bins - 1)), lambda i: F.col("g0") + (F.col("g1") - F.col("g0")) * i / (v_bins - 1))).alias("column", "voltage"),
    )
    knots = curves.select(*HALF, "voltage", "dqdv")
    filled = interpolate(knots, grid, "voltage", "dqdv", HALF, ["column", "c0", "c1"])
    return filled.select(
        *HALF, "column", "voltage", F.when(F.col("voltage").between(F.col("c0"), F.col("c1")), F.col("dqdv")).alias("dqdv")
    )


def heat_limit(grid: DataFrame) -> DataFrame:
    """98th percentile of the absolute height, the colour limit of a map."""
    return grid.groupBy("cell_id", "step").agg(F.percentile(F.abs("dqdv"), 0.98).alias("limit"))


def waterfall(curves: DataFrame, every_n: int = 1, overlap: float = 0.5) -> DataFrame:
    """Every n-th cycle with a vertical offset: rank times the pitch."""
    tall = curves.groupBy(*HALF).agg((F.max("dqdv") - F.min("dqdv")).alias("amplitude"))
    side = Window.partitionBy("cell_id", "step")
    kept = (
        tall.withColumn("r", F.row_number().over(side.orderBy("cycle")) - 1)
        .filter(F.col("r") % every_n == 0)
        .withColumn("rank", (F.col("r") / every_n).cast("int"))
    )
    typical = kept.groupBy("cell_id", "step").agg(F.percentile("amplitude", 0.5).alias("typical"))
    pitch = F.greatest(F.col("typical") * (1.0 - overlap), F.col("typical") * 0.05)
    return kept.join(typical, ["cell_id", "step"]).select(*HALF, "rank", "amplitude", pitch.alias("pitch"), (F.col("rank") * pitch).alias("offset"))


def terminal_trim(curves: DataFrame, band_v: float = 0.020, factor: float = 1.4, max_fraction: float = 0.10) -> DataFrame:
    """Measured terminal trims: 20 mV bands from each end whose median stays above 1.4 times the interior."""
    w = Window.partitionBy(*HALF).orderBy("voltage")
    rows = curves.select(
        *HALF, "voltage", F.abs("dqdv").alias("y"), (F.row_number().over(w) - 1).alias("i"),
        F.count(F.lit(1)).over(Window.partitionBy(*HALF)).alias("n"),
        F.min("voltage").over(Window.partitionBy(*HALF)).alias("v0"), F.max("voltage").over(Window.partitionBy(*HALF)).alias("v1"),
    )
    interior = rows.groupBy(*HALF).agg(
        F.first("n").alias("n"), F.first(F.col("v1") - F.col("v0")).alias("span"),
        F.percentile(F.when((F.col("i") >= F.floor(0.2 * F.col("n"))) & (F.col("i") < F.floor(0.8 * F.col("n"))), F.col("y")), 0.5).alias("interior"),
    )
    usable = (F.col("n") >= 40) & (F.col("interior") > 0) & (F.col("span") > 0)
    bands = rows.select(
        *HALF, "y",
        F.inline(
            F.array(
                F.struct(F.lit("low").alias("side"), F.floor((F.col("voltage") - F.col("v0")) / band_v).cast("int").alias("band")),
                F.struct(F.lit("high").alias("side"), F.floor((F.col("v1") - F.col("voltage")) / band_v).cast("int").alias("band")),
            )
        ),
    ).groupBy(*HALF, "side", "band").agg(F.count(F.lit(1)).alias("k"), F.percentile("y", 0.5).alias("median"))
    # Bands that pass must be consecutive from the edge: passing count up to the first gap.
    passing = (
        bands.join(interior, HALF)
        .filter((F.col("k") >= 2) & (F.col("median") > factor * F.col("interior")) & ((F.col("band") + 1) * band_v <= max_fraction * F.col("span")))
        .withColumn("r", F.row_number().over(Window.partitionBy(*HALF, "side").orderBy("band")) - 1)
        .filter("r = band")
        .groupBy(*HALF)
        .agg(*[(F.count(F.when(F.col("side") == s, 1)) * band_v).alias(s) for s in ("low", "high")])
    )
    zero = lambda c: F.when(usable, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)
    return interior.join(passing, HALF, "left").select(*HALF, "n", zero("low").alias("trim_low_v"), zero("high").alias("trim_high_v"))


def step_trim(trims: DataFrame, min_points: int = 20) -> DataFrame:
    """Median measured trim per cell and step."""
    return trims.filter(F.col("n") > min_points).groupBy("cell_id", "step").agg(
        F.percentile("trim_low_v", 0.5).alias("trim_low_v"), F.percentile("trim_high_v", 0.5).alias("trim_high_v")
    )


def fixed_trim(curves: DataFrame, trim_mv: float = 75.0) -> DataFrame:
    """The same fixed span for every cell, on the end where the half-cycle terminates."""
    v = trim_mv / 1000.0
    return curves.select("cell_id", "step").distinct().select(
        "cell_id", "step",
        F.when(F.col("step") == "Discharge", v).otherwise(0.0).alias("trim_low_v"),
        F.when(F.col("step") == "Charge", v).otherwise(0.0).alias("trim_high_v"),
    )


def apply_trim(curves: DataFrame, trims: DataFrame) -> DataFrame:
    """Cut both ends, unless fewer than ten points would remain."""
    whole = Window.partitionBy(*HALF)
    rows = curves.join(trims, ["cell_id", "step"], "left").withColumns(
        {"_lo": F.min("voltage").over(whole), "_hi": F.max("voltage").over(whole)}
    )
    low, high = F.coalesce("trim_low_v", F.lit(0.0)), F.coalesce("trim_high_v", F.lit(0.0))
    rows = rows.withColumn("_keep", (F.col("voltage") >= F.col("_lo") + low) & (F.col("voltage") <= F.col("_hi") - high))
    rows = rows.withColumn("_left", F.sum(F.col("_keep").cast("int")).over(whole))
    return rows.filter(F.col("_keep") | (F.col("_left") < 10) | ((low <= 0) & (high <= 0))).select(*curves.columns)
