"""Peak detection on dQ/dV curves.

A curve has a few hundred bins whatever the record count, so it travels as
one row holding its sorted heights; peaks are found with higher-order
functions on that array and judged with ordinary column expressions.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cyclespark.functions.arrays import on_arrays
from cyclespark.functions.scalars import mv_to_samples
from cyclespark.schema import CELL, CYCLE, HALF

PROMINENCE_FRACTION = 0.05
MIN_DISTANCE_MV = 30.0
MIN_WIDTH_MV = {"sharp": 2.0, "moderate": 5.0, "broad": 5.0}
LOCAL_PROMINENCE_FRACTION = 0.25
MIN_HEIGHT_FRACTION = 0.02
TRUNCATION_VISIBLE = 0.6
EDGE_TOLERANCE_V = 0.002
NOISE_SNR = 12.0
NOISE_SHARE = 0.10
NOISE_BINS = 30
MAX_PEAKS = 12
EDGE_V = 0.050
SHOULDER_SEPARATION_MV = 20.0
SHOULDER_HEIGHT, SHOULDER_PROMINENCE, SHOULDER_PARENT_SHARE = 0.10, 0.08, 0.20
SHOULDER_WINDOW = (11, 21)
PHASES = (0.2, 0.4, 0.6, 0.8)
#: Volts between two peaks, one a shoulder, and between two primaries.
SEPARATIONS = (0.020, MIN_DISTANCE_MV / 1000)


def settle(df: DataFrame) -> DataFrame:
    """Compute every column once per row.

    Array lambdas re-evaluate what they refer to; passing the row through a
    generator keeps the optimiser from folding one step's columns into the
    lambdas of the next.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def curve_arrays(curves: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per curve: heights turned upright (``ys``), voltages (``vs``) and scale figures.

    ``curves`` has a row per bin, or is what ``curves.histogram_arrays`` makes; then a ``profile`` is kept.
    """
    along = []
    if isinstance(curves.schema["dqdv"].dataType, T.ArrayType):
        centres = F.expr("transform(dqdv, (y, i) -> lo + width * (i + 0.5D))")
        along = [c for c in ("profile",) if c in curves.columns]
        rows = curves.filter("size(dqdv) >= 10").select(*HALF, *keys, *along, centres.alias("vs"), F.col("dqdv").alias("d"), F.size("dqdv").alias("n"))
    else:
        point = F.struct("bin", "voltage", "dqdv")
        rows = curves.groupBy(*HALF, *keys).agg(F.array_sort(F.collect_list(point)).alias("p"))
        rows = rows.select(*HALF, *keys, F.col("p.voltage").alias("vs"), F.col("p.dqdv").alias("d"), F.size("p").alias("n")).filter("n >= 10")
    rows = rows.withColumn("_u", on_arrays(turned, "ys array<double>, up double")("vs", "d"))
    rows = rows.select(
        *HALF, *keys, *along, "vs", F.col("_u.ys").alias("ys"), "n", F.col("_u.up").alias("up"),
        F.array_max("_u.ys").alias("y_max"), (F.array_max("_u.ys") - F.array_min("_u.ys")).alias("y_range"),
        F.expr("(vs[n - 1] - vs[0]) / (n - 1)").alias("bin_v"),
    )
    return settle(rows)


def turned(voltages: pd.Series, heights: pd.Series) -> pd.DataFrame:
    """Curves turned so that their area is not negative, and the sign that does it."""
    out = []
    for v, d in zip(voltages, heights):
        up = -1.0 if np.cumsum((d[1:] + d[:-1]) * (v[1:] - v[:-1]) / 2)[-1] < 0 else 1.0
        out.append((d * up, up))
    return pd.DataFrame(out, columns=["ys", "up"])


def _samples(mv: Column) -> Column:
    return mv_to_samples(mv, F.col("bin_v"))


def local_maxima(arrays: DataFrame) -> DataFrame:
    """Add ``maxima``: indices of samples above both neighbours (middle of a flat top)."""
    return settle(arrays.withColumn("maxima", F.pandas_udf(maxima_of, "array<int>")("ys")))


def tops(y: np.ndarray) -> np.ndarray:
    """Places of a curve's samples above both neighbours; the middle of a flat top, the lower of two."""
    starts = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
    v = y[starts]
    inner = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    return ((starts[inner] + starts[inner + 1] - 1) // 2).astype(np.int32) if len(inner) else np.zeros(0, np.int32)


def maxima_of(heights: pd.Series) -> pd.Series:
    return pd.Series(all_tops(heights.tolist()) if len(heights) else [], dtype=object)


def spread_out(y: np.ndarray, at: np.ndarray, distance: int) -> np.ndarray:
    """Those of the sorted places that keep the distance, highest first (ties: later first)."""
    places, alive = at.tolist(), [True] * len(at)
    for k in np.lexsort((at, y[at]))[::-1].tolist():
        if not alive[k]:
            continue
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(places) and abs(places[j] - places[k]) < distance:
                alive[j] = False
                j += step
    return at[np.array(alive, bool)] if len(at) else at


def shape_of(y: np.ndarray, at: np.ndarray) -> tuple:
    """Height, prominence and the crossings at half prominence of a curve's samples.

    The nearest higher sample on either side bounds the search for the side minima; bases are the minima nearest to the peak, and
    crossings are not sought beyond them.
    """
    n, k = len(y), np.arange(len(y))
    out = np.zeros((4, len(at)))
    for x, i in enumerate(at.tolist()):
        h = y[i]
        above = k[y > h]
        cut = int(np.searchsorted(above, i))
        l = int(above[cut - 1]) + 1 if cut else 0
        r = int(above[cut]) - 1 if cut < len(above) else n - 1
        left, right = y[l : i + 1], y[i : r + 1]
        lb, rb = i - int(left[::-1].argmin()), i + int(right.argmin())
        prominence = h - max(y[lb], y[rb])
        half = h - prominence * 0.5
        low, high = y[lb:i] <= half, y[i + 1 : rb + 1] <= half
        a = i - 1 - int(low[::-1].argmax()) if low.any() else lb
        b = i + 1 + int(high.argmax()) if high.any() else rb
        left_ip = a + ((half - y[a]) / (y[a + 1] - y[a]) if y[a] < half else 0.0)
        right_ip = b - ((half - y[b]) / (y[b - 1] - y[b]) if y[b] < half else 0.0)
        out[:, x] = h, prominence, left_ip, right_ip
    return out


def noise_of(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Noise around samples: mean absolute second difference, scaled to a standard deviation."""
    off = np.abs(y[1:-1] - 0.5 * (y[:-2] + y[2:]))
    out = np.zeros(len(at))
    for x, i in enumerate(at.tolist()):
        near = off[max(0, i - NOISE_BINS) : min(len(y) - 2, i + NOISE_BINS - 1)]
        out[x] = np.cumsum(near)[-1] / len(near) * 1.2533141 / math.sqrt(1.5) if len(near) else np.nan
    return out


#: Curves that are worked out together, and values of them that stand beside all their maxima at most.
CURVES, BESIDE = 256, 1_000_000


def _pieces(flat: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(counts).tolist()
    return [flat[lo:hi] for lo, hi in zip([0, *ends], ends)]


def all_tops(ys: list[np.ndarray]) -> list[np.ndarray]:
    """``tops`` of every curve."""
    sizes = np.array([len(y) for y in ys])
    y, first = np.concatenate(ys), np.cumsum(sizes) - sizes
    new = np.ones(len(y), bool)
    new[1:] = y[1:] != y[:-1]
    new[first[sizes > 0]] = True
    starts = np.flatnonzero(new)
    of = np.repeat(np.arange(len(ys)), sizes)[starts]
    v, starts = y[starts], starts - first[of]
    inner = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]) & (of[1:-1] == of[:-2]) & (of[1:-1] == of[2:])) + 1
    return _pieces(((starts[inner] + starts[inner + 1] - 1) // 2).astype(np.int32) if len(inner) else np.zeros(0, np.int32), np.bincount(of[inner], minlength=len(ys)))


def shapes_together(ys: list[np.ndarray], ats: list[np.ndarray]) -> list[tuple]:
    """For every curve its samples ``at`` with ``shape_of`` and ``noise_of`` these: rows are maxima, columns the samples beside them."""
    sizes, counts = np.array([len(y) for y in ys]), np.array([len(at) for at in ats])
    most = max(int(sizes.max()), 3)
    table = np.zeros((len(ys), most))
    for row, y in zip(table, ys):
        row[: len(y)] = y
    off = np.abs(table[:, 1:-1] - 0.5 * (table[:, :-2] + table[:, 2:]))
    of, at = np.repeat(np.arange(len(ys)), counts), np.concatenate(ats).astype(np.int64)
    out, k = np.zeros((5, len(at))), np.arange(most)
    for lo in range(0, len(at), max(1, BESIDE // most)):
        some = slice(lo, lo + max(1, BESIDE // most))
        i, c = at[some], of[some]
        x, y, n = np.arange(len(i)), table[c], sizes[c]
        h, before, after = y[x, i], k < i[:, None], k > i[:, None]
        above = y > h[:, None]
        l = np.where(above & before, k, -1).max(1) + 1
        r = np.where(above & after & (k < n[:, None]), k, n[:, None]).min(1) - 1
        left, right = np.where((k >= l[:, None]) & ~after, y, np.inf), np.where((k <= r[:, None]) & ~before, y, np.inf)
        left_foot, right_foot = left.min(1), right.min(1)
        lb, rb = np.where(left == left_foot[:, None], k, -1).max(1), (right == right_foot[:, None]).argmax(1)
        prominence = h - np.maximum(left_foot, right_foot)
        half = h - prominence * 0.5
        low = y <= half[:, None]
        a, b = np.where(low & before & (k >= lb[:, None]), k, -1).max(1), np.where(low & after & (k <= rb[:, None]), k, most).min(1)
        a, b = np.where(a < 0, lb, a), np.where(b == most, rb, b)
        ya, yb = y[x, a], y[x, b]
        # Where a crossing lies between two samples, these differ.
        up, down = np.where(ya < half, y[x, np.minimum(a + 1, most - 1)] - ya, 1.0), np.where(yb < half, y[x, np.maximum(b - 1, 0)] - yb, 1.0)
        near = np.maximum(0, i - NOISE_BINS)
        count = np.minimum(n - 2, i + NOISE_BINS - 1) - near
        beside = near[:, None] + np.arange(2 * NOISE_BINS - 1)
        total = np.cumsum(np.where(beside < (near + count)[:, None], off[c[:, None], np.minimum(beside, most - 3)], 0.0), axis=1)[:, -1]
        noise = np.where(count > 0, total / np.maximum(count, 1) * 1.2533141 / math.sqrt(1.5), np.nan)
        out[:, some] = h, prominence, a + np.where(ya < half, (half - ya) / up, 0.0), b - np.where(yb < half, (half - yb) / down, 0.0), noise
    return list(zip(_pieces(at.astype(np.int32), counts), *[_pieces(v, counts) for v in out]))


def all_shapes(ys: list[np.ndarray], ats: list[np.ndarray]) -> list[tuple]:
    """``at``, ``shape_of`` and ``noise_of`` it for every curve. Curves with values that aren't finite go one by one."""
    out = []
    for lo in range(0, len(ys), CURVES):
        y, at = ys[lo : lo + CURVES], ats[lo : lo + CURVES]
        whole = np.isfinite(np.concatenate(y)).all()
        out += shapes_together(y, at) if whole else [(k, *shape_of(v, k), noise_of(v, k)) for v, k in zip(y, at)]
    return out


def shapes_of(heights: pd.Series, maxima: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(all_shapes(heights.tolist(), [np.asarray(at, np.int32) for at in maxima]), columns=SHAPE_COLUMNS)


def tops_of(heights: pd.Series, distances: pd.Series) -> pd.DataFrame:
    """Shapes of the maxima that keep a distance in samples."""
    ys = heights.tolist()
    apart = [at if len(at) < 2 or (at[1:] - at[:-1]).min() >= d else spread_out(y, at, int(d)) for y, at, d in zip(ys, all_tops(ys) if ys else [], distances)]
    return pd.DataFrame(all_shapes(ys, apart), columns=SHAPE_COLUMNS)


SHAPES = "i array<int>, h array<double>, prominence array<double>, left_ip array<double>, right_ip array<double>, noise array<double>"
SHAPE_COLUMNS = [c.split()[0] for c in SHAPES.split(", ")]


def _structs(shape: str) -> Column:
    """An array of structs, one per maximum, of the arrays that ``shape`` holds, with width_samples."""
    zipped = F.arrays_zip(*[F.col(f"{shape}.{c}") for c in SHAPE_COLUMNS])
    return F.transform(zipped, lambda p: p.withField("width_samples", p["right_ip"] - p["left_ip"]))


def with_shape(arrays: DataFrame) -> DataFrame:
    """One row per maximum with prominence, width at half prominence and noise around it."""
    rows = settle(arrays.withColumn("_s", on_arrays(shapes_of, SHAPES)("ys", "maxima")))
    return rows.select(*[c for c in arrays.columns if c != "maxima"], F.inline(_structs("_s")))


def with_min_width(arrays: DataFrame, profiles: DataFrame | None) -> DataFrame:
    """Add ``width_mv``: the least peak width of the cell's profile (5 mV without one); a profile on the row itself needs no join."""
    if profiles is None:
        return arrays.withColumn("width_mv", F.lit(5.0))
    width = F.lit(5.0)
    for name, mv in MIN_WIDTH_MV.items():
        width = F.when(F.col("profile") == name, mv).otherwise(width)
    if "profile" in arrays.columns:
        return arrays.withColumn("width_mv", width).drop("profile")
    return arrays.join(profiles.select(*CELL, width.alias("width_mv")), CELL, "left").na.fill(5.0, ["width_mv"])


def derivative_window(narrowest: Column) -> Column:
    """Samples of the second derivative's window: half the narrowest primary's width, odd, within its limits."""
    low, high = SHOULDER_WINDOW
    w = F.least(F.lit(high), F.greatest(F.lit(low), F.bround(narrowest * 0.5).cast("int")))
    return w + (w % 2 == 0).cast("int")


def curvature(heights: pd.Series, windows: pd.Series) -> pd.Series:
    """The bends of a batch of curves; None where the window doesn't fit."""
    return pd.Series(bends_of(heights.tolist(), [int(w) for w in windows]))


@lru_cache
def cubic_weights(m: int) -> tuple[list[float], list[float], float]:
    """Weights of the quadratic and the cubic term in a window of 2 m + 1 samples, and the sum of the latter's squares."""
    k = np.arange(-m, m + 1)
    cubic, cubes = (k * k * k - (3 * m * m + 3 * m - 1) / 5.0 * k).tolist(), 0.0
    for c in cubic:
        cubes += c * c
    return (3 * k * k - m * (m + 1)).astype(float).tolist(), cubic, cubes


def sign_changes(bend: np.ndarray, i: int) -> float | None:
    """Half the way between the curvature's sign changes on either side of a sample; None where one is missing."""
    left, right = np.flatnonzero(bend[: i + 1] <= 0), np.flatnonzero(bend[i:] <= 0)
    if not 0 < i < len(bend) - 1 or not len(left) or not len(right):
        return None
    half = (i + int(right[0]) - int(left[-1])) / 2.0
    return half if half > 0 else None


def bends_of(ys: list[np.ndarray], windows: list[int]) -> list[np.ndarray | None]:
    """The negative second derivative (per sample squared) of a cubic through each window of so many samples of a curve.

    The ends take theirs from the first and the last whole window; each sum runs over a window from its first sample on. None where
    the window doesn't fit. Curves of one window are worked out together.
    """
    out: list = [None] * len(ys)
    for w in set(windows):
        m = (w - 1) // 2
        which = [k for k, (y, own) in enumerate(zip(ys, windows)) if own == w and m >= 1 and len(y) >= 2 * m + 1]
        if not which:
            continue
        y, n = np.concatenate([ys[k] for k in which]), np.array([len(ys[k]) for k in which])
        start = np.cumsum(n) - n
        squares, cubic, cubes = cubic_weights(m)
        bent, first, last = np.zeros(len(y) - 2 * m), 0.0, 0.0
        for x in range(2 * m + 1):
            bent += squares[x] * y[x : x + len(bent)]
            first += cubic[x] * y[start + x]
            last += cubic[x] * y[start + n - 1 - 2 * m + x]
        bent *= 30.0 / (m * (m + 1) * (4 * m * m - 1) * (2 * m + 3))
        own, long = np.repeat(start, n), np.repeat(n, n)
        k = np.arange(len(y)) - own
        at = np.clip(k, m, long - 1 - m)
        slope = np.where(k < m, np.repeat(first * 6.0 / cubes, n), np.where(k >= long - m, np.repeat(last * 6.0 / cubes, n), 0.0))
        for k, bend in zip(which, _pieces(-(bent[own + at - m] + slope * (k - at)), n)):
            out[k] = bend
    return out


def shoulders_of(ys: list, vs: list, bends: list, primaries: list[list[int]], separations: list[int]) -> list[list[int]]:
    """Samples of every curve that are shoulders on the flanks of its primaries."""
    flanks, nears = [], []
    for c, (y, bend, peaks, sep) in enumerate(zip(ys, bends, primaries, separations)):
        if bend is None:
            continue
        n, span = len(y), y.max() - y.min()
        ends = [0, *[a + int(y[a : b + 1].argmin()) for a, b in zip(peaks, peaks[1:])], n - 1]
        for x, p in enumerate(peaks):
            for lo, hi in ((ends[x], p), (p, ends[x + 1])):
                if hi - lo < 2 * sep + 3:
                    continue
                base, near = min(y[lo], y[hi]), bend[lo : hi + 1]
                rise = y[p] - base
                if rise <= 0 or rise < SHOULDER_PARENT_SHARE * span or near.max() <= near.min():
                    continue
                flanks.append((c, p, (ends[x], ends[x + 1]), lo, hi, base, rise))
                nears.append(near)
    found: list[set] = [set() for _ in ys]
    # Few pass the plain tests; prominence is measured for those.
    fits = []
    for (c, p, ends, lo, hi, base, rise), near, tops_ in zip(flanks, nears, all_tops(nears) if nears else []):
        y, v, peaks, sep, fit = ys[c], vs[c], primaries[c], separations[c], []
        for i in ((tops_ if len(tops_) < 2 else spread_out(near, tops_, sep)) + lo).tolist():
            apart = abs(i - p) >= sep and min(abs(i - ends[0]), abs(i - ends[1])) >= sep and lo < i < hi and all(abs(k - i) >= sep for k in peaks)
            inside = v[0] + EDGE_V <= v[i] <= v[-1] - EDGE_V
            if apart and inside and y[i] - base >= SHOULDER_HEIGHT * rise and base <= y[i] <= y[p]:
                fit.append(i - lo)
        if fit:
            fits.append((c, lo, near, np.array(fit, np.int32)))
    for (c, lo, near, fit), shape in zip(fits, all_shapes([f[2] for f in fits], [f[3] for f in fits])):
        stands = shape[2] >= SHOULDER_PROMINENCE * (near.max() - near.min())
        found[c].update((fit[stands] + lo).tolist())
    return [sorted(f) for f in found]


def flank_tops(heights: pd.Series, voltages: pd.Series, windows: pd.Series, primaries: pd.Series, separations: pd.Series) -> pd.DataFrame:
    ys, out = heights.tolist(), []
    for lo in range(0, len(ys), CURVES):
        some = slice(lo, lo + CURVES)
        y, peaks = ys[some], [sorted(int(p) for p in own) for own in primaries[some]]
        # A window of 0 has no bend.
        bends = bends_of(y, [int(w) if own and len(x) >= 20 else 0 for x, own, w in zip(y, peaks, windows[some])])
        ats = shoulders_of(y, voltages[some].tolist(), bends, peaks, [int(x) for x in separations[some]])
        sigmas = [[sign_changes(bend, i) for i in at] for bend, at in zip(bends, ats)]
        out += [(*shape, own) for shape, own in zip(all_shapes(y, [np.array(at, np.int32) for at in ats]), sigmas)]
    return pd.DataFrame(out, columns=[*SHAPE_COLUMNS, "sigmas"])


def flank_shoulders(rows: DataFrame) -> DataFrame:
    """Add the shoulders on the flanks of the primaries ``peaks``: shapes ``low``, ``sigmas`` (NULL where not measured), window ``w``.

    A flank runs from a primary down to the trough before the next one, or to the curve's end. A maximum of the negative second
    derivative within it is a shoulder if it stands apart from both ends, rises enough above the flank's foot, and isn't higher than
    the primary. Flanks of primaries that are small against the curve have none.
    """
    usual = F.least(F.lit(SHOULDER_WINDOW[1]), F.greatest(F.lit(SHOULDER_WINDOW[0]), F.expr("n DIV 5").cast("int")))
    narrow = F.expr("array_min(filter(peaks.width_samples, x -> x > 0))")
    rows = settle(rows.withColumn("w", F.coalesce(derivative_window(narrow), usual + (usual % 2 == 0).cast("int"))))
    apart = F.greatest(F.lit(3), _samples(F.lit(SHOULDER_SEPARATION_MV)))
    found = on_arrays(flank_tops, SHAPES + ", sigmas array<double>")("ys", "vs", "w", F.col("peaks.i"), apart)
    rows = settle(rows.withColumn("_f", found))
    return settle(rows.withColumn("low", _structs("_f")).withColumn("sigmas", F.col("_f.sigmas")).drop("_f"))


def standing_out(curves: DataFrame, keys: tuple[str, ...] = (), distance_mv: float = MIN_DISTANCE_MV, profiles: DataFrame | None = None) -> DataFrame:
    """Curves as arrays, each with ``peaks``: its prominent or locally prominent maxima with their shape."""
    whole = with_min_width(curve_arrays(curves, keys).filter("y_range > 0"), profiles)
    rows = settle(whole.withColumn("_s", on_arrays(tops_of, SHAPES)("ys", _samples(F.lit(distance_mv)))))
    rows = settle(rows.withColumn("peaks", _structs("_s")).withColumn("_least", _samples(F.col("width_mv"))).drop("_s"))
    prominent = f"p.prominence >= {PROMINENCE_FRACTION}D * y_range"
    locally = f"p.prominence >= {LOCAL_PROMINENCE_FRACTION}D * p.h AND p.h >= {MIN_HEIGHT_FRACTION}D * y_max AND p.h > 0"
    return settle(rows.withColumn("peaks", F.expr(f"filter(peaks, p -> p.width_samples >= _least AND ({prominent} OR ({locally})))")).drop("_least"))


def _placed(rows: DataFrame, sigmas: bool) -> DataFrame:
    """Add ``_found``: the structs ``peaks`` or, with ``sigmas``, the shoulders ``low`` as peaks.

    A shoulder that is a low maximum has a width of its own; the others have that of the curvature.
    """
    at = lambda x: f"(vs[CAST(floor({x}) AS INT)] + ({x} - floor({x})) * bin_v)"
    own = "p.prominence > 0 AND p.width_samples > 0"
    left, right, rank = at("p.left_ip"), at("p.right_ip"), "p.prominence"
    if sigmas:
        sigma = "coalesce(sigmas[j] * bin_v, 0D)"
        left, right, rank = f"CASE WHEN {own} THEN {left} ELSE vs[p.i] - {sigma} END", f"CASE WHEN {own} THEN {right} ELSE vs[p.i] + {sigma} END", "p.h * 0.1D"
    sides = f"transform({'low' if sigmas else 'peaks'}, (p, j) -> struct(p.i AS i, p.h AS h, {rank} AS prominence, {left} AS l, {right} AS r, p.noise AS noise))"
    cut_off = f"q.r >= vs[n - 1] - {EDGE_TOLERANCE_V}D OR q.l <= vs[0] + {EDGE_TOLERANCE_V}D"
    peak = f"""struct(q.i AS peak_bin, vs[q.i] AS voltage, q.h AS height, q.prominence AS prominence, q.r - q.l AS width_v, q.l AS left_v, q.r AS right_v,
        {cut_off} AS is_truncated, {str(sigmas).lower()} AS is_shoulder, q.noise AS noise, y_max AS y_max)"""
    return settle(rows.withColumn("_q", F.expr(sides))).withColumn("_found", F.expr(f"transform(_q, q -> {peak})")).drop("_q")


def shoulders(curves: DataFrame, keys: tuple[str, ...] = (), distance_mv: float = MIN_DISTANCE_MV, profiles: DataFrame | None = None) -> DataFrame:
    """Shoulders of every curve as peaks, with a tenth of their height as prominence."""
    rows = _placed(flank_shoulders(standing_out(curves, keys, distance_mv, profiles)), True)
    return rows.select(*HALF, *keys, F.inline("_found"))


def primary_peaks(
    curves: DataFrame, keys: tuple[str, ...] = (), distance_mv: float = MIN_DISTANCE_MV, profiles: DataFrame | None = None
) -> DataFrame:
    """Prominent or locally prominent peaks of every curve and their shoulders, before the rules on spacing, noise and number.

    A peak that the window cuts is flagged, however little of it is inside.  The tallest interior
    sample is added where no peak is near it; its width is not measured. A curve's peaks are found where its row is: nothing is shuffled.
    """
    return _primaries(curves, keys, distance_mv, profiles).select(*HALF, *keys, F.inline("_all"))


def _primaries(curves: DataFrame, keys: tuple[str, ...], distance_mv: float, profiles: DataFrame | None) -> DataFrame:
    """``primary_peaks`` as an array ``_all`` on the row of each curve."""
    rows = _placed(flank_shoulders(standing_out(curves, keys, distance_mv, profiles)), True).withColumnRenamed("_found", "_low")
    rows = _placed(rows, False).withColumn("_found", F.concat("_found", "_low"))
    rows = settle(rows.withColumn("_i", F.expr("CAST(array_position(ys, y_max) - 1 AS INT)")).drop("_low", "low", "peaks", "sigmas"))
    side = "greatest(array_min(slice(ys, 1, _i + 1)), array_min(slice(ys, _i + 1, n - _i)))"
    rows = rows.withColumn("_prom", F.expr(f"CASE WHEN _i > 0 AND _i < n - 1 THEN y_max - {side} END"))
    rows = rows.withColumn("_noise", F.expr("CASE WHEN _prom > 0 THEN 1 END") * local_noise("_i"))
    # A shoulder beside the tallest sample was that: it takes its place and keeps its width.
    near = f"array_min(transform(filter(_found, p -> abs(vs[_i] - p.voltage) < {distance_mv / 1000.0}D), p -> struct(p.voltage AS voltage, p AS p))).p"
    rows = settle(rows.withColumn("_near", F.expr(f"CASE WHEN _prom > 0 THEN {near} END")))
    rows = rows.withColumn("_new", F.expr("coalesce(_prom > 0 AND (_near IS NULL OR _near.is_shoulder), false)"))
    top = """struct(_i AS peak_bin, vs[_i] AS voltage, y_max AS height, _prom AS prominence, _near.width_v AS width_v, _near.left_v AS left_v, _near.right_v AS right_v,
        false AS is_truncated, false AS is_shoulder, _noise AS noise, y_max AS y_max)"""
    whole = f"CASE WHEN _new THEN concat(filter(_found, p -> _near IS NULL OR p.peak_bin <> _near.peak_bin), array({top})) ELSE _found END"
    return settle(rows.withColumn("_all", F.expr(whole)).select(*HALF, *keys, "_all"))


def visible_fraction(centre: Column, left: Column, right: Column, low: Column, high: Column) -> Column:
    """Share of a peak inside the window, from its intact half-width (1 away from the ends).

    NULL for a peak clipped on both sides, which has no intact one.
    """
    near_high, near_low = right >= high - EDGE_TOLERANCE_V, left <= low + EDGE_TOLERANCE_V
    a, b = centre - left, right - centre
    return (
        F.when(near_high & ~near_low, F.when(a > 0, (a + b) / (2.0 * a)).otherwise(0.0))
        .when(near_low & ~near_high, F.when(b > 0, (a + b) / (2.0 * b)).otherwise(0.0))
        .when(~near_low & ~near_high, 1.0)
    )


def local_noise(i: str = "i") -> Column:
    """Noise around sample ``i``: mean absolute second difference, scaled to a standard deviation."""
    return F.expr(
        f"""aggregate(
              sequence(greatest(1, {i} - {NOISE_BINS} + 1), least(n - 2, {i} + {NOISE_BINS} - 1)), 0D,
              (s, k) -> s + abs(ys[k] - 0.5D * (ys[k - 1] + ys[k + 1])))
            / (least(n - 2, {i} + {NOISE_BINS} - 1) - greatest(1, {i} - {NOISE_BINS} + 1) + 1) * 1.2533141D / sqrt(1.5D)"""
    )


def noise_floor(peaks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Drop peaks that are both weak against the local noise and small; the tallest stays."""
    w = Window.partitionBy(*HALF, *keys)
    share = F.col("height") / F.max("height").over(w)
    weak = (F.col("noise") > 0) & (F.col("prominence") / F.col("noise") < NOISE_SNR)
    return peaks.withColumn("_share", share).filter(~(F.coalesce(weak, F.lit(False)) & (F.col("_share") < NOISE_SHARE))).drop("_share")


def strongest(peaks: DataFrame, keys: tuple[str, ...] = (), most: int = MAX_PEAKS) -> DataFrame:
    """Keep the most prominent peaks of a curve and number them by voltage."""
    side = Window.partitionBy(*HALF, *keys)
    ranked = peaks.withColumn("_r", F.row_number().over(side.orderBy(F.desc("prominence"), "voltage"))).withColumn(
        "peaks_capped", F.count(F.lit(1)).over(side) > most
    )
    return ranked.filter(F.col("_r") <= most).drop("_r").withColumn("peak_id", F.row_number().over(side.orderBy("voltage")))


def detect(curves: DataFrame, keys: tuple[str, ...] = (), profiles: DataFrame | None = None, most: int = MAX_PEAKS) -> DataFrame:
    """Peaks of every curve: primaries and the maximum, thinned by spacing, noise and number, in that order."""
    # What deduplicate, noise_floor and strongest do, on the row of the curve: nothing is shuffled.
    item = "struct(p.voltage AS voltage, p.prominence AS prominence, coalesce(p.is_shoulder, false) AS s, p.peak_bin AS id, p AS peak)"
    rows = _primaries(curves, keys, MIN_DISTANCE_MV, profiles).filter("size(_all) > 0")
    rows = settle(rows.select(*HALF, *keys, F.expr(f"array_sort(transform(_all, p -> {item}))").alias("p")))
    rows = _spaced(rows, *SEPARATIONS).withColumn("p", F.expr("transform(filter(p, (x, i) -> k[i]), x -> x.peak)"))
    rows = settle(rows.drop("k").withColumn("_top", F.expr("array_max(p.height)")))
    weak = f"coalesce(q.noise > 0 AND q.prominence / q.noise < {NOISE_SNR}D, false)"
    rows = settle(rows.withColumn("p", F.expr(f"filter(p, q -> NOT ({weak} AND q.height / _top < {NOISE_SHARE}D))")).drop("_top"))
    ranked = "array_sort(transform(p, (q, i) -> struct(-q.prominence AS r, q.voltage AS v, i AS i, q AS q)))"
    placed = f"array_sort(transform(slice({ranked}, 1, {most}), x -> struct(x.v AS v, x.i AS i, x.q AS q)))"
    rows = settle(rows.withColumn("peaks_capped", F.expr(f"size(p) > {most}")).withColumn("p", F.expr(placed)))
    rows = rows.select(*HALF, *keys, "peaks_capped", F.posexplode("p").alias("_i", "_x"))
    return rows.select(*HALF, *keys, "_x.q.*", "peaks_capped", (F.col("_i") + 1).alias("peak_id"))


def phase_stable(peaks: DataFrame, shifted: DataFrame, widths: DataFrame, testable: DataFrame, phases: int = len(PHASES)) -> DataFrame:
    """Keep peaks found again at every shift of the bin edges, renumbered; the tallest is exempt.

    ``shifted`` holds the peaks per ``phase``, ``widths`` the bin width of each half-cycle, ``testable`` the half-cycles whose
    shifted curves all have the ten bins that detection needs: where the test can't be made, nothing is dropped.
    """
    other = shifted.groupBy(*HALF, "phase").agg(F.collect_list("voltage").alias("found"))
    per_half = other.groupBy(*HALF).agg(F.collect_list("found").alias("found"))
    rows = peaks.join(widths, HALF).join(per_half, HALF, "left").join(testable.select(*HALF).withColumn("_can", F.lit(True)), HALF, "left")
    tolerance = F.greatest(F.lit(0.020), 3.0 * F.col("width"), 0.5 * F.col("width_v"))
    hits = F.size(F.filter("found", lambda f: F.exists(f, lambda v: F.abs(v - F.col("voltage")) <= F.col("_tol"))))
    side = Window.partitionBy(*HALF)
    rows = rows.withColumn("_tol", tolerance).withColumn("_hits", F.coalesce(F.greatest(hits, F.lit(0)), F.lit(0)))
    rows = rows.withColumn("_top", F.row_number().over(side.orderBy(F.desc(F.abs("height")), "voltage")) == 1)
    kept = rows.filter((F.col("_hits") >= phases) | F.col("_top") | F.col("_can").isNull()).drop("_tol", "_hits", "_top", "_can", "found", "width", "peak_id")
    return kept.withColumn("peak_id", F.row_number().over(side.orderBy("voltage")))


def peak_counts(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("cell_id", "step", "cycle").agg(F.count(F.lit(1)).alias("n_peaks"))


def middle_of(ordered: np.ndarray) -> float:
    """The median of sorted values, NaN of none."""
    half = len(ordered) // 2
    return float(ordered[half] if len(ordered) % 2 else (ordered[half - 1] + ordered[half]) / 2) if len(ordered) else math.nan


def settled_modes(voltages, cycles, shares, n_halves: int, tolerance: float, occupancy: float, share: float) -> list[tuple]:
    """Modes (voltage, share, cycles, occupancy) of sorted maxima; numpy arrays of one cell and step.

    From each maximum that no mode has claimed yet, upwards, the middle of a window settles on the median in three steps; the mode
    claims what lies within the tolerance. Of modes closer than that the one with the highest occupancy stays.
    """
    claimed, modes = np.zeros(len(voltages), bool), []
    window = lambda c: slice(np.searchsorted(voltages, c - tolerance), np.searchsorted(voltages, c + tolerance, "right"))
    for i in range(len(voltages)):
        if claimed[i]:
            continue
        c = float(voltages[i])
        for _ in range(3):
            c = middle_of(voltages[window(c)])
        own = window(c)
        claimed[own] = True
        n = len(np.unique(cycles[own]))
        middle = float(np.median(shares[own])) if own.stop > own.start else 0.0
        if n / n_halves >= occupancy and middle >= share:
            modes.append((c, middle, n, n / n_halves))
    kept: list[tuple] = []
    for mode in sorted(modes, key=lambda m: -m[3]):
        if all(abs(mode[0] - k[0]) > tolerance for k in kept):
            kept.append(mode)
    return sorted(kept)


def recurrent_maxima(curves: DataFrame, tolerance_v: float = 0.015, occupancy: float = 0.5, share: float = 0.25, density: float = 30.0) -> DataFrame:
    """Voltages where maxima recur across the cycles of a cell and step, from the curves of 20 points and more.

    Maxima within 50 mV of a curve's ends don't count. A cell and step with more maxima per curve than ``density`` has none: these
    are noise. So the maxima that one group brings together are bounded by its number of cycles.
    """
    side = Window.partitionBy("cell_id", "step")
    inside = f"filter(maxima, i -> y_max > 0 AND vs[i] BETWEEN vs[0] + {EDGE_V}D AND vs[n - 1] - {EDGE_V}D)"
    rows = local_maxima(curve_arrays(curves).filter("n >= 20"))
    rows = rows.select(*HALF, F.expr(f"transform({inside}, i -> struct(vs[i] AS voltage, ys[i] / y_max AS share))").alias("_p"))
    # Few bytes and much work: as many tasks as a shuffle may have.
    rows = rows.repartition(int(curves.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell_id", "step")
    rows = rows.withColumn("n_halves", F.count(F.lit(1)).over(side)).withColumn("_n", F.sum(F.size("_p")).over(side))
    rows = rows.filter(F.col("_n") <= density * F.col("n_halves")).select(*HALF, "n_halves", F.inline("_p"))

    def settle_group(group: pa.Table) -> pa.Table:
        voltages, cycles, shares = (group.column(c).to_numpy() for c in ("voltage", "cycle", "share"))
        by = np.lexsort((cycles, voltages))
        found = settled_modes(voltages[by], cycles[by], shares[by], group.column("n_halves")[0].as_py(), tolerance_v, occupancy, share)
        columns = {c: pa.array([group.column(c)[0].as_py()] * len(found), group.schema.field(c).type) for c in ("cell_id", "step")}
        columns["feature"] = pa.array(range(1, len(found) + 1), pa.int32())
        kinds = (pa.float64(), pa.float64(), pa.int64(), pa.float64())
        return pa.table(columns | {c: pa.array([f[k] for f in found], t) for k, (c, t) in enumerate(zip(("voltage", "share", "n_found", "occupancy"), kinds))})

    kind = curves.schema["cell_id"].dataType.simpleString()
    return rows.groupBy("cell_id", "step").applyInArrow(settle_group, f"cell_id {kind}, step string, feature int, voltage double, share double, n_found long, occupancy double")


def recurrent_seeds(peaks: DataFrame, curves: DataFrame, features: DataFrame, tolerance_v: float = 0.015, separation_v: float = MIN_DISTANCE_MV / 1000, share: float = 0.5, most: int = MAX_PEAKS) -> DataFrame:
    """Seeds for features that a half-cycle with peaks has a maximum for but didn't detect: peak_bin, voltage, height, prominence.

    Features are taken up by rising voltage; each meets the peaks and the seeds placed before it. The seed stands at the half-cycle's own
    maximum nearest to the feature (of ties, the lower), which must have at least half the feature's share of the curve.
    """
    side = ["cell_id", "step"]
    known = features.groupBy(*side).agg(F.array_sort(F.collect_list(F.struct("voltage", "share"))).alias("fs"))
    held = peaks.groupBy(*HALF).agg(F.collect_list("voltage").alias("pv"))
    rows = settle(local_maxima(curve_arrays(curves).filter("n >= 20 AND y_max > 0")).filter("size(maxima) > 0").join(held, HALF).join(known, side))
    near = "array_min(transform(maxima, k -> struct(abs(vs[k] - f.voltage) AS far, k AS i)))"
    rows = settle(rows.withColumn("fs", F.expr(f"transform(fs, f -> struct(f.voltage AS v, f.share AS share, {near} AS near))")))
    placed = F.expr(
        f"""aggregate(fs, struct(pv AS seen, CAST(array() AS ARRAY<INT>) AS bins), (a, f) ->
              CASE WHEN exists(a.seen, v -> abs(v - f.v) <= {separation_v}D) OR size(a.seen) >= {most} OR f.near.far > {tolerance_v}D
                     OR ys[f.near.i] / y_max < {share}D * f.share THEN a
                   ELSE struct(concat(a.seen, array(vs[f.near.i])) AS seen, concat(a.bins, array(f.near.i)) AS bins) END).bins"""
    )
    rows = settle(rows.withColumn("maxima", placed).drop("fs", "pv")).filter("size(maxima) > 0")
    return with_shape(rows).select(*HALF, F.col("i").alias("peak_bin"), F.expr("vs[i]").alias("voltage"), F.col("h").alias("height"), "prominence")


def with_seeds(peaks: DataFrame, seeds: DataFrame, flag: str) -> DataFrame:
    """Peaks and seeds, the seeds with ``flag`` set, false flags elsewhere, renumbered by voltage."""
    known = [c for c in ("is_truncated", "is_shoulder", "is_recurrent", "is_inferred") if c in peaks.columns or c in seeds.columns or c == flag]
    both = peaks.drop("peak_id").unionByName(seeds.withColumn(flag, F.lit(True)), allowMissingColumns=True)
    both = both.withColumns({c: F.coalesce(c, F.lit(False)) if c in both.columns else F.lit(False) for c in known})
    return both.withColumn("peak_id", F.row_number().over(Window.partitionBy(*HALF).orderBy("voltage", flag)))


def infer_missing_seeds(peaks: DataFrame, reference: DataFrame, halves: DataFrame, tolerance_v: float = 0.080) -> DataFrame:
    """Seeds for reference peaks a cycle lacks, from the nearest cycle that found them (of ties, the earlier).

    ``reference`` holds (cell_id, step, ref_id, ref_v, is_shoulder, is_truncated): at most a dozen per
    cell and step, so matching a peak to them is a small equi-join.  A cycle has found a reference peak if its nearest peak is within
    the tolerance and nearer to no other reference peak.  Only half-cycles with peaks are seeded, inside the voltages of their own
    curve (``halves``: points of the curves); seeds have the flags of the reference peak.
    """
    side = ["cell_id", "step"]
    pairs = peaks.join(reference.select(*side, "ref_id", "ref_v"), side).withColumn("far", F.abs(F.col("voltage") - F.col("ref_v")))
    pairs = pairs.withColumn("_own", F.min("far").over(Window.partitionBy(*HALF, "peak_id")))
    nearest = pairs.groupBy(*HALF, "ref_id").agg(F.min(F.struct("far", "voltage", "_own")).alias("m"))
    found = nearest.filter((F.col("m.far") <= tolerance_v) & (F.col("m._own") >= F.col("m.far") - 1e-12)).select(*HALF, "ref_id", F.col("m.voltage").alias("voltage"))
    ranges = halves.groupBy(*HALF).agg(F.min("voltage").alias("_lo"), F.max("voltage").alias("_hi")).join(peaks.select(*HALF).distinct(), HALF, "left_semi")
    flags = [c for c in ("is_shoulder", "is_truncated") if c in reference.columns]
    grid = ranges.join(reference.select(*side, "ref_id", *flags), side).join(found, [*HALF, "ref_id"], "left")
    order = Window.partitionBy(*side, "ref_id").orderBy("cycle").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*side, "ref_id").orderBy(F.desc("cycle")).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("voltage").isNotNull(), F.struct("cycle", "voltage"))
    filled = grid.select(
        "*",
        F.last(known, ignorenulls=True).over(order).alias("before"),
        F.last(known, ignorenulls=True).over(back).alias("after"),
    ).filter("voltage IS NULL")
    use_before = F.col("after").isNull() | (F.col("cycle") - F.col("before.cycle") <= F.col("after.cycle") - F.col("cycle"))
    seed = F.when(F.col("before").isNotNull() & use_before, F.col("before")).otherwise(F.col("after"))
    rows = filled.withColumn("_seed", seed).filter("_seed.voltage BETWEEN _lo AND _hi")
    return rows.select(*HALF, "ref_id", F.col("_seed.voltage").alias("seed_v"), F.col("_seed.cycle").alias("inferred_from_cycle"), *flags)


def append_seeds(peaks: DataFrame, seeds: DataFrame) -> DataFrame:
    """Peaks with inferred seeds added, flags filled and renumbered by voltage."""
    return with_seeds(peaks, seeds.drop("ref_id").withColumnRenamed("seed_v", "voltage"), "is_inferred")


def reference_peaks(peaks: DataFrame, reference: DataFrame) -> DataFrame:
    """Peaks of each cell's reference cycle, numbered per step."""
    hits = peaks.join(reference.select("cell_id", F.col("reference_cycle").alias("cycle")), CYCLE)
    w = Window.partitionBy("cell_id", "step").orderBy("voltage")
    flags = [c for c in ("is_shoulder", "is_truncated") if c in peaks.columns]
    return hits.select("cell_id", "step", F.row_number().over(w).alias("ref_id"), F.col("voltage").alias("ref_v"), "height", "prominence", "width_v", *flags)


def deduplicate(peaks: DataFrame, separation_v: float = SEPARATIONS[0], primary_separation_v: float = SEPARATIONS[1], keys: tuple[str, ...] = ()) -> DataFrame:
    """Of two peaks that are too close keep the more prominent, sweeping upwards in voltage.

    Each peak still kept meets all later ones that are: it drops those not more
    prominent, up to the first that is, which drops it.  The narrow separation
    holds for pairs with a shoulder, the other for two primaries.
    """
    shoulder = F.coalesce("is_shoulder", F.lit(False)) if "is_shoulder" in peaks.columns else F.lit(False)
    item = F.struct("voltage", "prominence", shoulder.alias("s"), F.col("peak_bin").alias("id"))
    rows = settle(peaks.groupBy(*HALF, *keys).agg(F.array_sort(F.collect_list(item)).alias("p")))
    rows = _spaced(rows, separation_v, primary_separation_v)
    kept = rows.select(*HALF, *keys, F.explode(F.expr("filter(p, (x, i) -> k[i])")).alias("q")).select(*HALF, *keys, F.col("q.id").alias("peak_bin"))
    return peaks.join(kept, [*HALF, *keys, "peak_bin"], "left_semi").select(*peaks.columns)


def _spaced(rows: DataFrame, separation_v: float, primary_separation_v: float) -> DataFrame:
    """Add ``k``: which of the sorted structs ``p`` (voltage, prominence, s) of a curve keep their distance."""
    close = lambda i, x: f"(p[{x}].voltage - p[{i}].voltage < if(p[{i}].s OR p[{x}].s, {separation_v + 1e-9}D, {primary_separation_v + 1e-9}D))"
    beaten_by = f"array_min(filter(sequence(i, size(p) - 1), x -> x > i AND k[x] AND {close('i', 'x')} AND p[x].prominence > p[i].prominence))"
    stays = (
        f"CASE WHEN NOT k[i] THEN y WHEN x = i THEN s.beaten IS NULL"
        f" WHEN x > i AND y AND {close('i', 'x')} AND p[x].prominence <= p[i].prominence AND (s.beaten IS NULL OR x < s.beaten) THEN false ELSE y END"
    )
    sweep = F.expr(
        f"""aggregate(sequence(0, size(p) - 1), transform(p, x -> true),
              (k, i) -> transform(array(struct({beaten_by} AS beaten)), s -> transform(k, (y, x) -> {stays}))[0])"""
    )
    return settle(rows.withColumn("k", sweep))


def peak_marks(peaks: DataFrame, cells: DataFrame) -> DataFrame:
    """Marks for a cell's key cycles with the kind of each peak."""
    keys = cells.select(*CELL, F.explode("key_cycles").alias("cycle")).distinct()
    kind = F.when(F.coalesce("is_truncated", F.lit(False)), "truncated").when(F.coalesce("is_shoulder", F.lit(False)), "shoulder").otherwise("primary")
    return peaks.join(keys, CYCLE, "left_semi").select(*HALF, "peak_id", "voltage", "height", kind.alias("kind"))
