"""Queries over dQ/dV curves: binning, smoothing, checks and trims."""

from pyspark.sql import functions as F

from cyclespark.functions import scalars as S
from cyclespark.operators import clean as B
from cyclespark.operators import curves as V
from cyclespark.operators import cycles as C
from cyclespark.operators import sequences as E
from cyclespark.operators.ordered import longest, parts, sliced
from cyclespark.plans.catalog.record_tables import HOLD, PROFILE, REVERSALS, WINDOW
from cyclespark.plans.fixture import cells, records, shared
from cyclespark.operators.lineage import cut
from cyclespark.plans.registry import query
from cyclespark.schema import HALF

K = "cell_id, cycle, step"


def on(a, b):
    return f"{b}.cell_id = {a}.cell_id AND {b}.cycle = {a}.cycle AND {b}.step = {a}.step"


SETTINGS = """
sett AS (SELECT p.cell_id, p.profile, CASE profile WHEN 'sharp' THEN 1e0 WHEN 'moderate' THEN 2e0 ELSE 5e0 END AS bin_mv,
  CASE profile WHEN 'sharp' THEN 1 WHEN 'moderate' THEN 3 ELSE 16 END AS smooth_bins, window_low_v, window_high_v FROM prof p JOIN win w ON w.cell_id = p.cell_id)
"""
STEPS = f"""{HOLD}, {PROFILE}, {WINDOW}, {SETTINGS},
st AS (SELECT * FROM (SELECT {K}, lag(voltage) OVER w AS v0, voltage AS v1, abs(capacity - lag(capacity) OVER w) AS dq, (voltage + lag(voltage) OVER w) * 5e-1 AS v_mid
  FROM stripped WINDOW w AS (PARTITION BY {K} ORDER BY seq)) WHERE v0 IS NOT NULL),
hl AS (SELECT {K}, sum(dq) AS charge_total FROM st GROUP BY ALL HAVING count(*) >= 4 AND max(dq) > 0),
sp AS (SELECT {K}, median(gap) AS spacing FROM (SELECT {K}, v_mid - lag(v_mid) OVER (PARTITION BY {K} ORDER BY v_mid) AS gap FROM st) GROUP BY ALL),
ins AS (SELECT st.* FROM st JOIN hl ON {on('st', 'hl')} JOIN sett s ON s.cell_id = st.cell_id WHERE v_mid >= window_low_v AND v_mid <= window_high_v),
seen AS (SELECT {K}, count(*) AS n_inside, sum(dq) AS charge_in_window, min(least(v0, v1)) AS a, max(greatest(v0, v1)) AS b, median(dq) FILTER (dq > 0) AS dq_per_record FROM ins GROUP BY ALL),
pl0 AS (SELECT e.*, charge_total, spacing, bin_mv / 1e3 AS stated, smooth_bins,
  CASE WHEN least(window_high_v, b) > greatest(window_low_v, a) THEN greatest(window_low_v, a) ELSE window_low_v END AS lo,
  CASE WHEN least(window_high_v, b) > greatest(window_low_v, a) THEN least(window_high_v, b) ELSE window_high_v END AS hi
  FROM seen e JOIN hl ON {on('e', 'hl')} LEFT JOIN sp ON {on('e', 'sp')} JOIN sett s ON s.cell_id = e.cell_id),
pl1 AS (SELECT *, greatest(stated, coalesce(spacing, 0), (hi - lo) / n_inside) AS width FROM pl0),
plan AS (SELECT *, width > stated AS widened, CAST(greatest(4, ceil((hi - lo) / width)) AS INT) AS n_bins FROM pl1),
put AS (SELECT ins.*, lo, width, least(v0, v1) AS x0, greatest(v0, v1) AS x1, n_bins,
  greatest(0, least(n_bins - 1, CAST(floor((least(v0, v1) - lo) / width) AS INT))) AS k0, greatest(0, least(n_bins - 1, CAST(floor((greatest(v0, v1) - lo) / width) AS INT))) AS k1,
  greatest(0, least(n_bins - 1, CAST(floor((v_mid - lo) / width) AS INT))) AS home FROM ins JOIN plan p ON {on('ins', 'p')}),
spread AS (SELECT *, unnest(generate_series(k0, k1)) AS bin FROM put),
got AS (SELECT {K}, bin, sum(CASE WHEN x1 > x0 THEN dq * greatest(0e0, least(x1, lo + width * bin + width) - greatest(x0, lo + width * bin)) / (x1 - x0) ELSE dq END) AS charge,
  count(*) FILTER (bin = home) AS occupancy FROM spread GROUP BY {K}, bin),
spine AS (SELECT *, unnest(generate_series(0, n_bins - 1)) AS bin FROM plan),
bins AS (SELECT s.cell_id, s.cycle, s.step, CAST(s.bin AS INT) AS bin, lo + width * (s.bin + 5e-1) AS voltage, width, coalesce(charge, 0e0) AS charge, coalesce(occupancy, 0) AS occupancy,
  n_bins, least(smooth_bins, CAST(floor((n_bins - 1) / 2e0) AS INT)) AS h, dq_per_record FROM spine s LEFT JOIN got g ON {on('s', 'g')} AND g.bin = s.bin)
"""
CURVES = f"""{STEPS},
curve AS (SELECT a.cell_id, a.cycle, a.step, a.bin, any_value(a.voltage) AS voltage, any_value(a.width) AS width, any_value(a.charge) AS charge, any_value(a.h) AS h,
  any_value(a.dq_per_record) AS dq_per_record, any_value(a.occupancy) AS occupancy,
  (CASE WHEN lower(a.step) LIKE 'charge%' THEN 1 ELSE -1 END) * sum(b.charge / b.width * CAST(factorial(2 * a.h) / (factorial(a.h + b.bin - a.bin) * factorial(a.h - b.bin + a.bin)) AS DOUBLE) / pow(4e0, a.h)) AS dqdv
  FROM bins a JOIN bins b ON {on('a', 'b')} AND b.bin BETWEEN a.bin - a.h AND a.bin + a.h WHERE a.n_bins >= 5 GROUP BY a.cell_id, a.cycle, a.step, a.bin)
"""

#: Each curve and a third of it 45 mV further up, as a second phase would add it: such curves have shoulders.
BLENDS = CURVES.replace("\ncurve AS (", "\ncurve0 AS (").rstrip() + f""",
curve AS (SELECT a.cell_id, a.cycle, a.step, a.bin, a.voltage, a.width, a.dqdv + 35e-2 * coalesce(b.dqdv, 0e0) AS dqdv
  FROM curve0 a LEFT JOIN curve0 b ON {on('a', 'b')} AND b.bin = a.bin - CAST(floor(45e-3 / a.width + 5e-1) AS INT))
"""


@shared
def settings(spark, sf):
    """Settings per cell, kept: one row per cell."""
    r = records(spark, sf)
    ranges = cut(B.cycle_ranges(r))
    return cut(V.with_profile_settings(E.classify_profile(r, ranges)).join(B.window_of(ranges), "cell_id"))


def _spread_records(spark, sf):
    """Records with half-cycles dealt to as many tasks as a shuffle may have: the windows' own shuffle makes them one more than cores."""
    rows = sliced(records(spark, sf))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *parts(rows))


def _increments(spark, sf):
    return V.increments(B.strip_hold(_spread_records(spark, sf)))


@shared
def layouts(spark, sf):
    """Bin layouts with the charge increments they are for, one row per half-cycle, kept; None where a half-cycle is too long for that."""
    if longest(records(spark, sf)) > V.ROW_RECORDS:
        return None
    return cut(V.laid_out(_increments(spark, sf), settings(spark, sf)))


@shared
def steps(spark, sf):
    """Charge increments of the half-cycles that have a layout, one row each."""
    kept = layouts(spark, sf)
    return _increments(spark, sf) if kept is None else V.increment_rows(kept)


@shared
def plan(spark, sf):
    """Bin layouts, one row per half-cycle, kept because several branches read them."""
    kept = layouts(spark, sf)
    return cut(V.bin_plan(steps(spark, sf), settings(spark, sf))) if kept is None else kept.drop(*V.INCREMENT)


def histograms(spark, sf, change=lambda plan: plan, keys=()):
    """Curves as arrays, of the layouts or of a change of them."""
    kept = layouts(spark, sf)
    if kept is None:
        return V.histogram_arrays(steps(spark, sf), change(plan(spark, sf)), keys)
    return V.histogram_arrays(None, change(kept), keys)


@shared
def curve_arrays(spark, sf):
    """Curves, kept as arrays: one row per half-cycle, read by several branches."""
    return cut(histograms(spark, sf))


@shared
def curves(spark, sf):
    return V.curve_rows(curve_arrays(spark, sf))


@shared
def blend_arrays(spark, sf):
    moved = "get(dqdv, i - CAST(floor(0.045D / width + 0.5D) AS INT))"
    return cut(curve_arrays(spark, sf).withColumn("dqdv", F.expr(f"transform(dqdv, (y, i) -> y + 0.35D * coalesce({moved}, 0D))")))


@shared
def blends(spark, sf):
    return V.curve_rows(blend_arrays(spark, sf)).select(*HALF, "bin", "voltage", "width", "dqdv")


@query("f1_charge_in_bins", f"WITH {STEPS} SELECT {K}, bin, voltage, width, charge, occupancy FROM bins", "voltage width charge")
def _(spark, sf):
    return V.charge_in_bins(steps(spark, sf), plan(spark, sf))


@query("f2_bin_plan", f"""WITH {STEPS} SELECT {K}, charge_total, n_inside, charge_in_window, dq_per_record, spacing, lo, hi, width, widened, n_bins FROM plan""",
       "charge_total charge_in_window dq_per_record spacing lo hi width")
def _(spark, sf):
    return plan(spark, sf).select(
        *HALF, "charge_total", "n_inside", "charge_in_window", "dq_per_record", "spacing", "lo", "hi", "width", "widened", "n_bins")


@query("f2_histogram_curves", f"WITH {CURVES} SELECT {K}, bin, voltage, dqdv, occupancy FROM curve", "voltage dqdv")
def _(spark, sf):
    return curves(spark, sf).select(*HALF, "bin", "voltage", "dqdv", "occupancy")


@query("f3_binomial_smoothing", f"""WITH {STEPS} SELECT a.cell_id, a.cycle, a.step, a.bin, sum(b.charge * CAST(factorial(6) / (factorial(3 + b.bin - a.bin) * factorial(3 - b.bin + a.bin)) AS DOUBLE) / 64) AS smoothed
FROM bins a JOIN bins b ON {on('a', 'b')} AND b.bin BETWEEN a.bin - 3 AND a.bin + 3 GROUP BY a.cell_id, a.cycle, a.step, a.bin""", "smoothed")
def _(spark, sf):
    bins = V.charge_in_bins(steps(spark, sf), plan(spark, sf)).withColumn("h", F.lit(3))
    return V.smooth_binomial(bins, "h", "charge").select(*HALF, "bin", F.col("dqdv").alias("smoothed"))


@query("f4_counted_charge", f"""WITH {STEPS} SELECT ins.cell_id, ins.cycle, ins.step, least(n_bins - 1, CAST(floor((v_mid - lo) / width) AS INT)) AS bin, sum(dq) AS charge, count(*) AS occupancy
FROM ins JOIN plan p ON {on('ins', 'p')} WHERE v_mid >= lo AND v_mid <= lo + width * n_bins GROUP BY ALL""", "charge")
def _(spark, sf):
    kept = layouts(spark, sf)
    return V.counted_charge(None, kept) if kept is not None else V.counted_charge(steps(spark, sf), plan(spark, sf))


SPAN = f"""
sv AS (SELECT *, lag(voltage) OVER w AS a, lead(voltage) OVER w AS b, min(voltage) OVER (PARTITION BY {K}) AS vmin, max(voltage) OVER (PARTITION BY {K}) AS vmax
  FROM records WINDOW w AS (PARTITION BY {K} ORDER BY voltage, seq)),
sw AS (SELECT *, abs(CASE WHEN a IS NULL THEN b - voltage WHEN b IS NULL THEN voltage - a ELSE (b - a) / 2 END) AS span FROM sv)
"""


@query("c15_record_span", f"WITH {SPAN} SELECT {K}, seq, span FROM sw", "span")
def _(spark, sf):
    from pyspark.sql.window import Window

    rows = records(spark, sf).select(*HALF, "seq", "voltage")
    return V.with_span(rows, Window.partitionBy(*HALF).orderBy("voltage", "seq")).select(*HALF, "seq", "span")


def rebin_sql(width, source="sw"):
    return f"""
rb0 AS (SELECT *, {width} AS wmv FROM {source}),
rb1 AS (SELECT *, least(CAST(floor((voltage - vmin) / (wmv / 1e3)) AS INT), greatest(0, CAST(ceil((vmax - vmin) / (wmv / 1e3)) AS INT) - 1)) AS bin FROM rb0),
rbn AS (SELECT {K}, wmv, bin, any_value(vmin + wmv / 1e3 * (bin + 5e-1)) AS voltage, CASE WHEN sum(span) > 0 THEN sum(dqdv * span) / sum(span) ELSE avg(dqdv) END AS dqdv
  FROM rb1 GROUP BY {K}, wmv, bin)
"""


@query("f5_rebin", f"WITH {SPAN}, {rebin_sql('5e0')} SELECT {K}, bin, voltage, dqdv FROM rbn", "voltage dqdv")
def _(spark, sf):
    return V.rebin(records(spark, sf), 5.0)


@query("f6_rebin_sensitivity", f"""WITH {SPAN}, {rebin_sql('unnest([1e0, 2e0, 4e0])')},
t AS (SELECT *, (abs(dqdv) + abs(lag(dqdv) OVER w)) / 2 * (voltage - lag(voltage) OVER w) AS slab FROM rbn WINDOW w AS (PARTITION BY {K}, wmv ORDER BY voltage)),
p AS (SELECT {K}, wmv, arg_max(voltage, {{'h': abs(dqdv), 'v': -voltage}}) AS apex, sum(slab) AS area FROM t GROUP BY {K}, wmv HAVING count(*) >= 3),
g AS (SELECT {K}, (max(apex) - min(apex)) * 1000 AS apex_spread_mv, CASE WHEN median(area) <> 0 THEN (max(area) - min(area)) / median(area) END AS area_spread FROM p GROUP BY ALL)
SELECT *, apex_spread_mv <= 10 AS apex_stable, coalesce(area_spread <= 1e-1, false) AS area_stable FROM g""", "apex_spread_mv area_spread")
def _(spark, sf):
    return V.rebin_sensitivity(records(spark, sf))


@query("f7_quantisation_ripple", f"""WITH {CURVES},
c0 AS (SELECT *, abs(dqdv) AS y, sum(s) OVER (PARTITION BY {K} ORDER BY bin) AS q, count(*) OVER (PARTITION BY {K}) AS n FROM (SELECT *, coalesce((voltage - lag(voltage) OVER w) * 5e-1 * (abs(dqdv) + abs(lag(dqdv) OVER w)), 0) AS s
  FROM curve WINDOW w AS (PARTITION BY {K} ORDER BY bin))),
c1 AS (SELECT *, max(q) OVER (PARTITION BY {K}) AS qt, lead(q) OVER w AS qn, lead(voltage) OVER w AS vn FROM c0 WINDOW w AS (PARTITION BY {K} ORDER BY bin)),
par AS (SELECT {K}, any_value(dq_per_record) AS d, any_value(qt) AS qt, CAST(round_even(any_value(qt) / any_value(dq_per_record), 0) AS BIGINT) AS nrec FROM c1 GROUP BY ALL),
pq AS (SELECT {K}, d, nrec, (unnest(generate_series(1, nrec)) - 5e-1) * d AS qr, qt FROM par),
pv AS (SELECT p.cell_id, p.cycle, p.step, d, c.voltage + (c.vn - c.voltage) * (qr - c.q) / (c.qn - c.q) AS v FROM pq p JOIN c1 c ON {on('p', 'c')} AND qr >= c.q AND qr < c.qn WHERE qr <= p.qt),
cnt AS (SELECT c.cell_id, c.cycle, c.step, c.bin, count(v) * any_value(c.dq_per_record) / any_value(c.width) AS yn FROM c1 c LEFT JOIN pv ON {on('c', 'pv')} AND v >= c.voltage - c.width / 2 AND v < c.voltage + c.width / 2 GROUP BY c.cell_id, c.cycle, c.step, c.bin),
b2 AS (SELECT c.*, yn FROM c1 c JOIN cnt ON {on('c', 'cnt')} AND cnt.bin = c.bin),
sm AS (SELECT a.cell_id, a.cycle, a.step, a.bin, any_value(a.voltage) AS voltage, any_value(a.n) AS n, any_value(a.h) AS h,
  pow(sum((b.yn - b.y) * CAST(factorial(2 * a.h) / (factorial(a.h + b.bin - a.bin) * factorial(a.h - b.bin + a.bin)) AS DOUBLE) / pow(4e0, a.h)), 2) AS sq
  FROM b2 a JOIN b2 b ON {on('a', 'b')} AND b.bin BETWEEN a.bin - a.h AND a.bin + a.h GROUP BY a.cell_id, a.cycle, a.step, a.bin),
pad AS (SELECT {K}, bin, voltage, n, h, unnest(generate_series(bin - greatest(4, h), bin + greatest(4, h))) AS at FROM sm),
r AS (SELECT p.cell_id, p.cycle, p.step, p.bin, any_value(p.voltage) AS voltage, any_value(p.n) AS n, sqrt(avg(s.sq)) AS ripple FROM pad p
  JOIN sm s ON {on('p', 's')} AND s.bin = greatest(0, least(p.n - 1, p.at)) GROUP BY p.cell_id, p.cycle, p.step, p.bin)
SELECT r.cell_id, r.cycle, r.step, bin, voltage, CASE WHEN n >= 8 AND nrec >= 4 THEN ripple ELSE 0 END AS ripple FROM r JOIN par ON {on('r', 'par')}""", "voltage ripple")
def _(spark, sf):
    return V.quantisation_ripple(curves(spark, sf))


@query("f8_plateau_structure", f"""WITH o AS (SELECT {K}, seq, voltage AS v, capacity AS q, row_number() OVER (PARTITION BY {K} ORDER BY capacity, seq) AS r, count(*) OVER (PARTITION BY {K}) AS n FROM records),
e AS (SELECT {K}, max(q) FILTER (r = 6) AS g0, max(q) FILTER (r = n - 4) AS g1 FROM o GROUP BY ALL HAVING count(*) >= 20),
g AS (SELECT {K}, i, g0 + (g1 - g0) * i / 39 AS q FROM e, range(0, 40) t(i)),
kn AS (SELECT *, lead(q) OVER w AS qn, lead(v) OVER w AS vn FROM o WINDOW w AS (PARTITION BY {K} ORDER BY q, seq)),
l AS (SELECT g.cell_id, g.cycle, g.step, i, g.q, k.v + coalesce((k.vn - k.v) * (g.q - k.q) / (k.qn - k.q), 0) AS v FROM g ASOF JOIN kn k ON {on('g', 'k')} AND g.q >= k.q),
s AS (SELECT *, abs(CASE WHEN i = 0 THEN (lead(v) OVER w - v) / (lead(q) OVER w - q) WHEN i = 39 THEN (v - lag(v) OVER w) / (q - lag(q) OVER w) ELSE (lead(v) OVER w - lag(v) OVER w) / (lead(q) OVER w - lag(q) OVER w) END) AS a
  FROM l WINDOW w AS (PARTITION BY {K} ORDER BY i)),
m AS (SELECT *, i BETWEEN 2 AND 37 AND coalesce(a < lag(a) OVER w AND a < lead(a) OVER w AND a < lag(a, 2) OVER w AND a < lead(a, 2) OVER w, false) AS is_min FROM s WINDOW w AS (PARTITION BY {K} ORDER BY i)),
f AS (SELECT {K}, arg_min(v, {{'a': a, 'i': i}}) FILTER (i BETWEEN 3 AND 36) AS fv, arg_min(q, {{'a': a, 'i': i}}) FILTER (i BETWEEN 3 AND 36) AS fq, count(*) FILTER (is_min) AS n_minima FROM m GROUP BY ALL),
s2 AS (SELECT m.cell_id, m.cycle, m.step, arg_min(v, {{'a': a, 'i': i}}) AS sv FROM m JOIN f ON {on('m', 'f')} WHERE i BETWEEN 3 AND 36 AND abs(q - fq) > 15 GROUP BY m.cell_id, m.cycle, m.step)
SELECT f.cell_id, f.cycle, f.step, fv AS flattest_v, sv AS second_flattest_v, abs(sv - fv) * 1000 AS separation_mv, n_minima FROM f LEFT JOIN s2 ON {on('f', 's2')}""",
       "flattest_v second_flattest_v separation_mv")
def _(spark, sf):
    return V.plateau_structure(records(spark, sf))


def savgol_sql(n, source, value, order):
    rows = "[" + ", ".join("[" + ", ".join(f"{c!r}" if "e" in repr(c) else f"{c!r}e0" for c in r) + "]" for r in V.savgol_rows(n, 3)) + "]"
    return f"""
sg0 AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {K}) AS n FROM {source} WINDOW w AS (PARTITION BY {K} ORDER BY {order})),
sg1 AS (SELECT *, CAST(greatest(0, least(i - {n // 2}, n - {n})) AS BIGINT) AS a FROM sg0),
kern AS (SELECT {rows} AS m),
sg2 AS (SELECT x.cell_id, x.cycle, x.step, x.i, sum(y.{value} * m[x.i - x.a + 1][y.i - x.a + 1]) AS smooth FROM sg1 x JOIN sg1 y ON {on('x', 'y')} AND y.i BETWEEN x.a AND x.a + {n - 1}, kern GROUP BY x.cell_id, x.cycle, x.step, x.i),
sgv AS (SELECT x.*, CASE WHEN n > {n} THEN smooth ELSE {value} END AS smoothed FROM sg1 x LEFT JOIN sg2 ON {on('x', 'sg2')} AND sg2.i = x.i)
"""


@query("e17_remove_spikes", f"""WITH {SPAN}, {rebin_sql('5e0')},
a AS (SELECT *, median(dqdv) OVER w AS m, max(abs(dqdv)) OVER (PARTITION BY {K}) AS top FROM rbn WINDOW w AS (PARTITION BY {K} ORDER BY voltage ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b AS (SELECT *, abs(dqdv - m) AS off FROM a),
c AS (SELECT *, greatest(median(off) OVER w * 14826e-4, top * 1e-6) AS mad FROM b WINDOW w AS (PARTITION BY {K} ORDER BY voltage ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT {K}, bin, off > 3 * mad AS is_spike, CASE WHEN off > 3 * mad THEN m ELSE dqdv END AS dqdv FROM c""", "dqdv")
def _(spark, sf):
    return V.remove_spikes(V.rebin(records(spark, sf), 5.0)).select(*HALF, "bin", "is_spike", "dqdv")


@query("e18_savitzky_golay", f"WITH {SPAN}, {rebin_sql('5e0')}, {savgol_sql(9, 'rbn', 'dqdv', 'voltage')} SELECT {K}, bin, smoothed AS dqdv FROM sgv", "dqdv")
def _(spark, sf):
    return V.savgol(V.rebin(records(spark, sf), 5.0), (9,)).select(*HALF, "bin", "dqdv")


@query("f9_derivative_curves")
def _(spark, sf):
    return V.derivative_curves(records(spark, sf), settings(spark, sf))


@query("f10_half_cycle_report", f"""WITH {CURVES}, {REVERSALS},
rt AS (SELECT {K}, count(*) AS n_reversals, coalesce(sum(charge) FILTER (at_full_current), 0) AS reversed_charge_at_current, max(span_mv) AS widest_reversal_mv FROM rev GROUP BY ALL),
ct AS (SELECT {K}, count(*) AS n_bins, count(*) FILTER (charge = 0) AS n_empty_bins, any_value(width) * 1000 AS bin_width_mv FROM curve GROUP BY ALL),
nh AS (SELECT {K}, count(*) AS n_records, count(*) FILTER (in_tail AND run >= 3 AND n >= 6) AS n_hold, CASE WHEN count(capacity) >= 2 THEN max(capacity) - min(capacity) END AS capacity_mAh_g FROM run GROUP BY ALL)
SELECT nh.*, direction, coalesce(n_reversals, 0) AS n_reversals, coalesce(reversed_charge_at_current, 0) AS reversed_charge_at_current, coalesce(widest_reversal_mv, 0) AS widest_reversal_mv,
  coalesce(n_bins, 0) AS n_bins, n_empty_bins, bin_width_mv, p_out AS charge_outside_window
FROM nh JOIN dir ON {on('nh', 'dir')} LEFT JOIN rt ON {on('nh', 'rt')} LEFT JOIN ct ON {on('nh', 'ct')}
LEFT JOIN (SELECT {K}, charge_total - charge_in_window AS p_out FROM plan) p ON {on('nh', 'p')}""",
       "capacity_mAh_g reversed_charge_at_current widest_reversal_mv bin_width_mv charge_outside_window")
def _(spark, sf):
    return half_report(spark, sf)


@shared
def half_report(spark, sf):
    """One row per half-cycle: records, hold, capacity, direction, reversals, bins."""
    r = records(spark, sf)
    base = B.hold_table(r).select(*HALF, "n_records", "n_hold").join(C.half_capacity(r), HALF).join(B.step_direction(r), HALF)
    bins = curves(spark, sf).groupBy(*HALF).agg(
        F.count(F.lit(1)).alias("n_bins"), F.count(F.when(F.col("charge") == 0, 1)).alias("n_empty_bins"),
        (F.first("width") * 1000.0).alias("bin_width_mv"),
    )
    outside = plan(spark, sf).select(*HALF, (F.col("charge_total") - F.col("charge_in_window")).alias("charge_outside_window"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        base.join(E.reversal_totals(E.reversals(r)), HALF, "left").join(bins, HALF, "left").join(outside, HALF, "left")
        .select(*HALF, "n_records", "n_hold", "capacity_mAh_g", "direction", zero("n_reversals"), zero("reversed_charge_at_current"),
                zero("widest_reversal_mv"), zero("n_bins"), "n_empty_bins", "bin_width_mv", "charge_outside_window")
    )


FIDELITY = f"""
ar AS (SELECT {K}, sum((abs(dqdv) + abs(p)) / 2 * (voltage - pv)) AS area FROM (SELECT *, lag(dqdv) OVER w AS p, lag(voltage) OVER w AS pv FROM curve WINDOW w AS (PARTITION BY {K} ORDER BY voltage)) GROUP BY ALL),
cap AS (SELECT {K}, CASE WHEN count(capacity) >= 2 THEN max(capacity) - min(capacity) END AS c FROM records GROUP BY ALL),
fid AS (SELECT ar.cell_id, ar.cycle, ar.step, CASE WHEN c > 0 THEN area / c END AS fidelity FROM ar LEFT JOIN cap ON {on('ar', 'cap')})
"""


@shared
def fidelity(spark, sf):
    return V.integral_fidelity(curves(spark, sf), C.half_capacity(records(spark, sf)))


@query("d25_integral_fidelity", f"WITH {CURVES}, {FIDELITY} SELECT * FROM fid", "fidelity")
def _(spark, sf):
    return fidelity(spark, sf)


@query("d26_describe_fidelity", f"""WITH {CURVES}, {FIDELITY} SELECT cell_id, step, count(*) AS n, median(fidelity) AS median, min(fidelity) AS worst, max(fidelity) AS most,
CASE WHEN median(fidelity) < 8e-1 THEN 'below' WHEN median(fidelity) > 12e-1 THEN 'above' ELSE 'within' END AS verdict FROM fid WHERE fidelity IS NOT NULL GROUP BY cell_id, step""",
       "median worst most")
def _(spark, sf):
    return V.describe_fidelity(fidelity(spark, sf))


@query("b26_fidelity_outside_band", f"WITH {CURVES}, {FIDELITY} SELECT * FROM fid WHERE fidelity NOT BETWEEN 8e-1 AND 12e-1", "fidelity")
def _(spark, sf):
    return V.fidelity_outside_band(fidelity(spark, sf))


RECONSTRUCTION = f"""
qc AS (SELECT {K}, voltage AS vc, sum(s) OVER (PARTITION BY {K} ORDER BY voltage) AS q FROM (SELECT *, coalesce((voltage - lag(voltage) OVER w) * 5e-1 * (abs(dqdv) + abs(lag(dqdv) OVER w)), 0) AS s
  FROM curve WINDOW w AS (PARTITION BY {K} ORDER BY voltage))),
shape AS (SELECT {K}, min(vc) AS c0, max(vc) AS c1, max(q) AS qt FROM qc GROUP BY ALL HAVING count(*) >= 3),
mr AS (SELECT r.cell_id, r.cycle, r.step, seq, voltage AS v, capacity AS c, voltage BETWEEN c0 - 1e-9 AND c1 + 1e-9 AS near, qt FROM records r JOIN shape s ON {on('r', 's')}),
mk AS (SELECT * FROM (SELECT *, count(*) FILTER (near) OVER (PARTITION BY {K}) AS nn FROM mr) WHERE near OR nn < 3),
mb AS (SELECT {K}, any_value(qt) AS qt, min(c) AS lo, max(c) AS hi, arg_max(v, {{'c': c, 's': seq}}) < arg_min(v, {{'c': c, 's': seq}}) AS flip FROM mk GROUP BY ALL HAVING count(*) >= 3),
kn AS (SELECT mk.cell_id, mk.cycle, mk.step, v, CASE WHEN flip THEN hi - c ELSE c - lo END AS q FROM mk JOIN mb ON {on('mk', 'mb')}),
kn2 AS (SELECT *, lead(q) OVER w AS qn, lead(v) OVER w AS vn FROM kn WINDOW w AS (PARTITION BY {K} ORDER BY q, v)),
want AS (SELECT qc.* FROM qc JOIN mb ON {on('qc', 'mb')} WHERE q <= least(hi - lo, qt)),
res AS (SELECT w.cell_id, w.cycle, w.step, sqrt(avg(pow(k.v + coalesce((k.vn - k.v) * (w.q - k.q) / (k.qn - k.q), 0) - vc, 2))) AS rmse, count(*) AS n FROM want w ASOF JOIN kn2 k ON {on('w', 'k')} AND w.q >= k.q GROUP BY w.cell_id, w.cycle, w.step),
rec AS (SELECT mb.cell_id, mb.cycle, mb.step, CASE WHEN hi > lo THEN abs(qt - (hi - lo)) / (hi - lo) * 100 END AS ape_pct, CASE WHEN n >= 3 THEN rmse END AS rmse_v, qt AS q_reconstructed, hi - lo AS q_measured,
  CASE WHEN n >= 3 THEN n ELSE 0 END AS n_compared FROM mb LEFT JOIN res ON {on('mb', 'res')})
"""


@shared
def reconstruction(spark, sf):
    return cut(V.reconstruct_voltage(curves(spark, sf), records(spark, sf)))


@query("f11_voltage_reconstruction", f"WITH {CURVES}, {RECONSTRUCTION} SELECT * FROM rec", "ape_pct rmse_v q_reconstructed q_measured")
def _(spark, sf):
    return reconstruction(spark, sf)


@query("d27_describe_reconstruction", f"""WITH {CURVES}, {RECONSTRUCTION},
a AS (SELECT cell_id, count(*) AS n, median(ape_pct) AS ape_pct, median(rmse_v) AS rmse_v FROM rec GROUP BY 1),
b AS (SELECT cell_id, median(width) * 1000 AS bin_median_mv, min(width) * 1000 AS bin_min_mv, max(width) * 1000 AS bin_max_mv, count(*) FILTER (widened) AS n_widened FROM plan GROUP BY 1),
c AS (SELECT cell_id, avg(CASE WHEN charge = 0 THEN 1 ELSE 0 END) AS empty_fraction FROM curve GROUP BY 1)
SELECT a.cell_id, n, ape_pct, rmse_v, rmse_v / (window_high_v - window_low_v) AS window_share, bin_median_mv, bin_min_mv, bin_max_mv, n_widened, empty_fraction,
  CASE WHEN ape_pct > 5 THEN 'charge not accounted for' WHEN rmse_v / (window_high_v - window_low_v) > 5e-2 THEN 'charge misplaced' ELSE 'ok' END AS verdict
FROM a JOIN b ON b.cell_id = a.cell_id JOIN c ON c.cell_id = a.cell_id JOIN win w ON w.cell_id = a.cell_id""",
       "ape_pct rmse_v window_share bin_median_mv bin_min_mv bin_max_mv empty_fraction")
def _(spark, sf):
    empty = curves(spark, sf).groupBy("cell_id").agg(F.avg((F.col("charge") == 0).cast("int")).alias("empty_fraction"))
    return V.describe_reconstruction(reconstruction(spark, sf), plan(spark, sf), B.voltage_window(records(spark, sf)), empty)


@query("f12_heat_map", f"""WITH {CURVES}, g AS (SELECT cell_id, step, min(voltage) AS g0, max(voltage) AS g1 FROM curve GROUP BY ALL),
o AS (SELECT {K}, min(voltage) AS c0, max(voltage) AS c1 FROM curve GROUP BY ALL),
x AS (SELECT o.*, CAST(i AS INT) AS "column", g0 + (g1 - g0) * i / 199 AS voltage FROM o JOIN g ON g.cell_id = o.cell_id AND g.step = o.step, range(0, 200) t(i)),
k AS (SELECT *, lead(voltage) OVER w AS vn, lead(dqdv) OVER w AS yn FROM curve WINDOW w AS (PARTITION BY {K} ORDER BY voltage))
SELECT x.cell_id, x.cycle, x.step, "column", x.voltage, CASE WHEN x.voltage BETWEEN c0 AND c1 THEN k.dqdv + coalesce((k.yn - k.dqdv) * (x.voltage - k.voltage) / (k.vn - k.voltage), 0) END AS dqdv
FROM x ASOF LEFT JOIN k ON {on('x', 'k')} AND x.voltage >= k.voltage""", "voltage dqdv")
def _(spark, sf):
    return V.heat_map(curves(spark, sf))


@query("f12_heat_limit", f"WITH {CURVES} SELECT cell_id, step, quantile_cont(abs(dqdv), 98e-2) AS \"limit\" FROM curve GROUP BY cell_id, step", '"limit"')
def _(spark, sf):
    return V.heat_limit(curves(spark, sf))


@query("f13_processed_key_cycles", f"""WITH {CURVES}, s AS (SELECT {K}, max(voltage) - min(voltage) AS span FROM records GROUP BY ALL),
ok AS (SELECT * FROM (SELECT *, median(span) OVER (PARTITION BY cell_id, step) AS m FROM s) WHERE NOT span < 8e-1 * m)
SELECT c.cell_id, c.cycle, c.step, bin, voltage, charge / width AS raw, dqdv FROM curve c JOIN ok ON {on('c', 'ok')} WHERE c.cycle IN (1, 5, 10, 20)""", "voltage raw dqdv")
def _(spark, sf):
    keys = cells(spark, sf).select("cell_id", F.explode("key_cycles").alias("cycle"))
    full = B.short_half_cycles(records(spark, sf)).filter("NOT is_short").select(*HALF)
    return curves(spark, sf).join(keys, ["cell_id", "cycle"], "left_semi").join(full, HALF, "left_semi").select(
        *HALF, "bin", "voltage", (F.col("charge") / F.col("width")).alias("raw"), "dqdv")


@query("f14_waterfall", f"""WITH {CURVES}, t AS (SELECT {K}, max(dqdv) - min(dqdv) AS amplitude FROM curve GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cell_id, step ORDER BY cycle) - 1 AS r FROM t),
k AS (SELECT *, CAST(r / 2 AS INT) AS rank FROM r WHERE r % 2 = 0), m AS (SELECT cell_id, step, median(amplitude) AS m FROM k GROUP BY ALL)
SELECT k.cell_id, k.cycle, k.step, rank, amplitude, greatest(m * 5e-1, m * 5e-2) AS pitch, rank * greatest(m * 5e-1, m * 5e-2) AS "offset" FROM k JOIN m ON m.cell_id = k.cell_id AND m.step = k.step""",
       'amplitude pitch "offset"')
def _(spark, sf):
    return V.waterfall(curves(spark, sf), every_n=2)


TRIM = f"""
ti AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY voltage) - 1 AS i, count(*) OVER (PARTITION BY {K}) AS n, min(voltage) OVER (PARTITION BY {K}) AS v0, max(voltage) OVER (PARTITION BY {K}) AS v1 FROM curve),
tn AS (SELECT {K}, any_value(n) AS n, any_value(v1 - v0) AS span, median(abs(dqdv)) FILTER (i >= floor(2e-1 * n) AND i < floor(8e-1 * n)) AS interior FROM ti GROUP BY ALL),
tb AS (SELECT {K}, 'low' AS side, CAST(floor((voltage - v0) / 2e-2) AS INT) AS band, abs(dqdv) AS y FROM ti UNION ALL SELECT {K}, 'high', CAST(floor((v1 - voltage) / 2e-2) AS INT), abs(dqdv) FROM ti),
tm AS (SELECT {K}, side, band, count(*) AS k, median(y) AS m FROM tb GROUP BY ALL),
tp AS (SELECT tm.*, row_number() OVER (PARTITION BY tm.cell_id, tm.cycle, tm.step, side ORDER BY band) - 1 AS r FROM tm JOIN tn ON {on('tm', 'tn')} WHERE k >= 2 AND m > 14e-1 * interior AND (band + 1) * 2e-2 <= 1e-1 * span),
tt AS (SELECT {K}, count(*) FILTER (side = 'low') * 2e-2 AS low, count(*) FILTER (side = 'high') * 2e-2 AS high FROM tp WHERE r = band GROUP BY ALL),
trim_k AS (SELECT tn.cell_id, tn.cycle, tn.step, n, CASE WHEN n >= 40 AND interior > 0 AND span > 0 THEN coalesce(low, 0) ELSE 0 END AS trim_low_v, CASE WHEN n >= 40 AND interior > 0 AND span > 0 THEN coalesce(high, 0) ELSE 0 END AS trim_high_v
  FROM tn LEFT JOIN tt ON {on('tn', 'tt')})
"""


@query("b12_terminal_trim", f"WITH {CURVES}, {TRIM} SELECT * FROM trim_k", "trim_low_v trim_high_v")
def _(spark, sf):
    return V.terminal_trim(curves(spark, sf))


@query("b13_step_trim", f"WITH {CURVES}, {TRIM} SELECT cell_id, step, median(trim_low_v) AS trim_low_v, median(trim_high_v) AS trim_high_v FROM trim_k WHERE n > 20 GROUP BY cell_id, step", "trim_low_v trim_high_v")
def _(spark, sf):
    return V.step_trim(V.terminal_trim(curves(spark, sf)))


@query("b14_apply_trim", f"""WITH {CURVES}, m AS (SELECT *, min(voltage) OVER (PARTITION BY {K}) + CASE WHEN step = 'Discharge' THEN 75e-3 ELSE 0 END AS a,
  max(voltage) OVER (PARTITION BY {K}) - CASE WHEN step = 'Charge' THEN 75e-3 ELSE 0 END AS b FROM curve),
k AS (SELECT *, count(*) FILTER (voltage >= a AND voltage <= b) OVER (PARTITION BY {K}) AS kept FROM m)
SELECT {K}, bin, voltage, dqdv FROM k WHERE (voltage >= a AND voltage <= b) OR kept < 10""", "voltage dqdv")
def _(spark, sf):
    c = curves(spark, sf).select(*HALF, "bin", "voltage", "dqdv")
    return V.apply_trim(c, V.fixed_trim(c))


EVENTS = f"""
grid AS (SELECT {K}, min(voltage) AS c0, max(voltage) AS c1, max(bin) AS lb, max(abs(dqdv)) AS tallest FROM curve GROUP BY ALL HAVING max(abs(dqdv)) > 0),
ev0 AS (SELECT r.*, (v_start + v_end) * 5e-1 AS voltage, (c1 - c0) / lb AS sv, c0, lb, tallest, window_low_v, window_high_v FROM rev r JOIN grid g ON {on('r', 'g')} JOIN win w ON w.cell_id = r.cell_id),
ev1 AS (SELECT e.*, CASE WHEN abs(c.voltage - e.voltage) <= 5 * sv THEN abs(c.dqdv) / tallest END AS dqdv_share FROM ev0 e
  LEFT JOIN curve c ON {on('e', 'c')} AND c.bin = greatest(0, least(lb, CAST(ceil((e.voltage - c0) / sv - 5e-1) AS INT)))),
ev AS (SELECT {K}, anchor_seq, n_records, charge, v_start, v_end, span_mv, seconds, at_full_current, voltage, dqdv_share,
  CASE WHEN voltage >= window_high_v - 5e-2 OR voltage <= window_low_v + 5e-2 THEN 'cv_hold' WHEN NOT at_full_current THEN 'current_taper' WHEN dqdv_share >= 5e-2 THEN 'plateau'
    WHEN dqdv_share IS NULL THEN 'outside_window' ELSE 'parasitic' END AS mechanism FROM ev1)
"""


@shared
def events(spark, sf):
    return cut(E.classify_reversals(E.reversals(_spread_records(spark, sf)), curve_arrays(spark, sf)))


@query("e3_reversal_mechanisms", f"WITH {CURVES}, {REVERSALS}, {EVENTS} SELECT * FROM ev", "charge v_start v_end span_mv seconds voltage dqdv_share")
def _(spark, sf):
    return events(spark, sf)


INTEGRITY = f"""
nc AS (SELECT {K}, count(*) AS n_records, CASE WHEN count(capacity) >= 2 THEN max(capacity) - min(capacity) END AS capacity FROM records GROUP BY ALL),
ch AS (SELECT {K}, count(*) AS n_reversals, coalesce(sum(charge) FILTER (mechanism = 'plateau'), 0) AS plateau_charge, coalesce(sum(charge) FILTER (mechanism IN ('cv_hold', 'current_taper')), 0) AS cv_charge,
  coalesce(sum(charge) FILTER (mechanism = 'parasitic'), 0) AS parasitic_charge, count(*) FILTER (charge IS NULL) AS n_unknown FROM ev GROUP BY ALL),
in0 AS (SELECT nc.*, n_records < 20 OR g.cell_id IS NULL AS few, CASE WHEN theoretical_mAh_g > 0 AND NOT (n_records < 20 OR g.cell_id IS NULL) THEN theoretical_mAh_g END AS theoretical_mAh_g,
  CASE WHEN n_records < 20 OR g.cell_id IS NULL THEN 0 ELSE coalesce(n_reversals, 0) END AS n_reversals, coalesce(n_unknown, 0) AS n_unknown,
  CASE WHEN n_records < 20 OR g.cell_id IS NULL THEN 0e0 ELSE coalesce(plateau_charge, 0) END AS plateau_charge, CASE WHEN n_records < 20 OR g.cell_id IS NULL THEN 0e0 ELSE coalesce(cv_charge, 0) END AS cv_charge,
  CASE WHEN n_records < 20 OR g.cell_id IS NULL THEN 0e0 ELSE coalesce(parasitic_charge, 0) END AS parasitic_charge
  FROM nc LEFT JOIN (SELECT DISTINCT {K} FROM curve) g ON {on('nc', 'g')} LEFT JOIN ch ON {on('nc', 'ch')} LEFT JOIN cells c ON c.cell_id = nc.cell_id),
in1 AS (SELECT *, capacity / theoretical_mAh_g AS capacity_ratio, coalesce(capacity / theoretical_mAh_g > 12e-1, false) AS over_theoretical, CASE WHEN capacity > 0 THEN parasitic_charge / capacity END AS parasitic_fraction FROM in0),
integ AS (SELECT {K}, capacity, theoretical_mAh_g, capacity_ratio, over_theoretical, n_records, n_reversals, plateau_charge, cv_charge, parasitic_charge, parasitic_fraction,
  CASE WHEN few THEN 'too few records' WHEN over_theoretical THEN 'ANOMALOUS' WHEN n_unknown > 0 OR parasitic_fraction IS NULL THEN 'unknown' WHEN parasitic_charge <= 0 AND capacity_ratio > 1 THEN 'suspect'
    WHEN parasitic_charge <= 0 THEN 'clean' WHEN parasitic_fraction >= 2e-2 THEN 'ANOMALOUS' ELSE 'suspect' END AS band FROM in1)
"""
INTEGRITY_COLUMNS = "capacity theoretical_mAh_g capacity_ratio plateau_charge cv_charge parasitic_charge parasitic_fraction"


@shared
def integrity(spark, sf):
    """Integrity table, one row per half-cycle, kept for the verdicts that read it."""
    r = records(spark, sf)
    # One row a half-cycle each, the first two from one pass over the records.
    n = r.groupBy(*HALF).agg(F.count(F.lit(1)).alias("n_records"), C.used_capacity().alias("capacity_mAh_g"))
    shaped = curve_arrays(spark, sf).select(*HALF).withColumn("has_curve", F.lit(True))
    halves = n.join(shaped, HALF, "left").withColumn("has_curve", F.coalesce("has_curve", F.lit(False)))
    return cut(E.integrity(halves, events(spark, sf), cells(spark, sf)))


ALL = f"{CURVES}, {REVERSALS}, {EVENTS}, {INTEGRITY}"


@query("e4_integrity", f"WITH {ALL} SELECT * FROM integ", INTEGRITY_COLUMNS, "records, cells")
def _(spark, sf):
    return integrity(spark, sf).drop("reason")


@query("e5_integrity_verdict", f"""WITH {ALL}, fl AS (SELECT *, band = 'ANOMALOUS' OR coalesce(capacity_ratio > 1, false) AS flagged FROM integ),
t AS (SELECT cell_id, count(*) AS n_total, max(cycle) AS n_cycles, count(*) FILTER (flagged) AS n_flagged, max(capacity_ratio) FILTER (flagged) AS worst_ratio,
  arg_min(cycle, {{'r': -capacity_ratio, 'c': cycle}}) FILTER (flagged AND capacity_ratio IS NOT NULL) AS worst_cycle, count(*) FILTER (capacity_ratio > 1) AS n_over_theoretical, count(*) FILTER (capacity_ratio > 12e-1) AS n_escalated FROM fl GROUP BY 1),
c AS (SELECT cell_id, cycle, cycle - lag(cycle) OVER (PARTITION BY cell_id ORDER BY cycle) AS gap FROM (SELECT DISTINCT cell_id, cycle FROM fl WHERE flagged)),
p AS (SELECT cell_id, count(*) AS nf, min(cycle) AS first_flagged, max(cycle) AS last_flagged, CAST(floor(median(gap)) AS BIGINT) AS typical_gap, count(*) FILTER (cycle > 5) AS n_late FROM c GROUP BY 1)
SELECT t.cell_id, CASE WHEN n_flagged = 0 THEN 'sound' WHEN n_late = 0 THEN 'formation' WHEN nf >= 3 AND last_flagged - first_flagged >= 5e-1 * n_cycles THEN 'recurring' WHEN nf >= 3 THEN 'clustered' ELSE 'isolated' END AS verdict,
  n_flagged, n_total, first_flagged, last_flagged, coalesce(last_flagged - first_flagged, 0) AS span, typical_gap, worst_ratio, worst_cycle, n_over_theoretical, n_escalated FROM t LEFT JOIN p ON p.cell_id = t.cell_id""",
       "worst_ratio", "records, cells")
def _(spark, sf):
    return E.integrity_verdict(integrity(spark, sf))


@query("d29_integrity_rollup", f"""WITH {ALL} SELECT cell_id, count(*) AS n_half_cycles, count(*) FILTER (band = 'clean') AS n_clean, count(*) FILTER (band = 'suspect') AS n_suspect, count(*) FILTER (band = 'ANOMALOUS') AS n_anomalous,
count(*) FILTER (band = 'too few records') AS n_too_few, coalesce(sum(parasitic_charge) FILTER (band = 'ANOMALOUS'), 0) AS parasitic_total, count(*) FILTER (over_theoretical) AS n_over_theoretical,
max(capacity_ratio) FILTER (over_theoretical) AS worst_ratio, median(plateau_charge) FILTER (NOT over_theoretical AND plateau_charge > 0) AS plateau_median, median(cv_charge) FILTER (cv_charge > 1e-2) AS cv_median FROM integ GROUP BY 1""",
       "parasitic_total worst_ratio plateau_median cv_median", "records, cells")
def _(spark, sf):
    return E.integrity_rollup(integrity(spark, sf))


@query("j5_worst_half_cycles", f"""WITH {ALL} SELECT * FROM (SELECT {K}, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY parasitic_fraction DESC NULLS LAST, cycle, step) AS INT) AS rank, capacity, parasitic_charge, parasitic_fraction
FROM integ WHERE band = 'ANOMALOUS') WHERE rank <= 5""", "capacity parasitic_charge parasitic_fraction", "records, cells")
def _(spark, sf):
    return E.worst_half_cycles(integrity(spark, sf))


@query("c22_profile_settings", f"WITH {PROFILE}, {WINDOW}, {SETTINGS} SELECT cell_id, profile, bin_mv, CAST(smooth_bins AS INT) AS smooth_bins FROM sett", "bin_mv")
def _(spark, sf):
    return settings(spark, sf).select("cell_id", "profile", "bin_mv", "smooth_bins")


@query("c23_preprocess_overrides", f"""WITH {PROFILE} SELECT p.cell_id, profile, coalesce(max_cycle, CASE profile WHEN 'sharp' THEN 5 WHEN 'moderate' THEN 9 ELSE 15 END) AS smoothing_window, profile <> 'sharp' AS spike_removal
FROM prof p LEFT JOIN cells c ON c.cell_id = p.cell_id""", "", "records, cells")
def _(spark, sf):
    stated = cells(spark, sf).select("cell_id", F.col("max_cycle").alias("smoothing_window"))
    out = V.with_profile_settings(E.classify_profile(records(spark, sf)), stated)
    return out.select("cell_id", "profile", "smoothing_window", "spike_removal")


@query("c24_mv_to_samples", f"""WITH {CURVES} SELECT {K}, CAST(greatest(1, round_even(30 / 1e3 / ((max(voltage) - min(voltage)) / (count(*) - 1)), 0)) AS INT) AS samples FROM curve GROUP BY {K}""")
def _(spark, sf):
    step = (F.max("voltage") - F.min("voltage")) / (F.count(F.lit(1)) - 1)
    return curves(spark, sf).groupBy(*HALF).agg(S.mv_to_samples(F.lit(30.0), step).alias("samples"))


@query("j4_sorted_records", f"SELECT {K}, seq, voltage, CAST(row_number() OVER (PARTITION BY {K} ORDER BY voltage, seq) AS INT) AS place FROM records", "voltage")
def _(spark, sf):
    from pyspark.sql.window import Window

    r = records(spark, sf)
    # Place in a half-cycle = place among its equal voltages plus the records at lower voltages.
    counts = r.groupBy(*HALF, "voltage").agg(F.count(F.lit(1)).alias("k"))
    before = counts.select(
        *HALF, "voltage",
        F.coalesce(F.sum("k").over(Window.partitionBy(*HALF).orderBy("voltage").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"),
    )
    same = F.row_number().over(Window.partitionBy(*HALF, "voltage").orderBy("seq"))
    return r.select(*HALF, "seq", "voltage", same.alias("r")).join(before, [*HALF, "voltage"]).select(
        *HALF, "seq", "voltage", (F.col("below") + F.col("r")).cast("int").alias("place"))
