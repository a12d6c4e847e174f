"""Queries over records: scans, tidying, conventions, holds, reversals, termination."""

from pyspark.sql import functions as F

from cyclespark.operators import clean as B
from cyclespark.operators import sequences as E
from cyclespark.plans.catalog.cycle_tables import TABLE, in_progress, table  # noqa: F401
from cyclespark.plans.fixture import cells, raw_records, records
from cyclespark.plans.registry import query
from cyclespark.sources.records import scan_records


def export_text(spark, sf):
    """The log in export form: source column names, everything text."""
    raw = raw_records(spark, sf)
    text = lambda c: F.col(c).cast("string")
    return raw.select(
        "cell_id", text("seq").alias("DataPoint"), text("cycle").alias("Cycle Index"), F.col("step_type").alias("Step Type"),
        text("current_a").alias("Current(A)"), text("voltage").alias("Voltage(V)"),
        F.coalesce(text("charge_capacity"), F.lit("--")).alias("Chg. Spec. Cap.(mAh/g)"),
        F.coalesce(text("discharge_capacity"), F.lit("NaN")).alias("DChg. Spec. Cap.(mAh/g)"),
        text("dqdv").alias("dQm/dV(mAh/V.g)"),
    )


@query("a1_record_scan", """SELECT cell_id, cycle, step, seq, voltage, current_a, charge_capacity, discharge_capacity, dqdv FROM records""",
       "voltage current_a charge_capacity discharge_capacity dqdv")
def _(spark, sf):
    return scan_records(export_text(spark, sf)).select(
        "cell_id", "cycle", "step", "seq", "voltage", "current_a", "charge_capacity", "discharge_capacity", "dqdv"
    )


@query("b1_tidy_steps", """SELECT cell_id, CASE WHEN trim(step_type) = 'CC DChg' THEN 'Discharge' WHEN trim(step_type) IN ('CC Chg', 'CCCV Chg') THEN 'Charge' ELSE trim(step_type) END AS step,
 count(*) AS n_records FROM raw WHERE lower(step_type) NOT LIKE '%rest%' GROUP BY ALL""", "", "raw")
def _(spark, sf):
    tidy = B.tidy_steps(raw_records(spark, sf), "step_type").withColumnRenamed("step_type", "step")
    return tidy.groupBy("cell_id", "step").agg(F.count(F.lit(1)).alias("n_records"))


CONVENTION = """
conv AS (SELECT r.cell_id, r.cycle, seq, lower(electrode_type) = 'negative' AS labels_swapped,
  CASE WHEN lower(electrode_type) <> 'negative' THEN step WHEN step = 'Charge' THEN 'Discharge' ELSE 'Charge' END AS step,
  CASE WHEN lower(electrode_type) = 'negative' THEN discharge_capacity ELSE charge_capacity END AS charge_capacity,
  CASE WHEN lower(electrode_type) = 'negative' THEN charge_capacity ELSE discharge_capacity END AS discharge_capacity,
  CASE WHEN lower(electrode_type) = 'negative' THEN -dqdv ELSE dqdv END AS dqdv
  FROM records r JOIN cells c ON c.cell_id = r.cell_id)
"""
CONVENTION_COLUMNS = ["cell_id", "cycle", "seq", "labels_swapped", "step", "charge_capacity", "discharge_capacity", "dqdv"]


@query("b2_electrode_convention", f"WITH {CONVENTION} SELECT * FROM conv", "charge_capacity discharge_capacity dqdv", "records, cells")
def _(spark, sf):
    joined = records(spark, sf).join(cells(spark, sf).select("cell_id", "electrode_type"), "cell_id")
    return B.electrode_convention(joined).select(*CONVENTION_COLUMNS)


@query("b3_convention_is_idempotent", f"WITH {CONVENTION} SELECT * FROM conv", "charge_capacity discharge_capacity dqdv", "records, cells")
def _(spark, sf):
    joined = records(spark, sf).join(cells(spark, sf).select("cell_id", "electrode_type"), "cell_id")
    once = B.electrode_convention(joined)
    return B.electrode_convention(once, swapped="labels_swapped").select(*CONVENTION_COLUMNS)


@query("b4_truncate_cycles", """SELECT r.cell_id, r.cycle, count(*) AS n FROM records r JOIN cells c ON c.cell_id = r.cell_id
WHERE max_cycle IS NULL OR max_cycle = 0 OR cycle <= max_cycle GROUP BY ALL""", "", "records, cells")
def _(spark, sf):
    joined = records(spark, sf).join(cells(spark, sf).select("cell_id", "max_cycle"), "cell_id")
    return B.truncate_cycles(joined).groupBy("cell_id", "cycle").agg(F.count(F.lit(1)).alias("n"))


@query("b5_drop_missing", """SELECT cell_id, cycle, step, count(*) AS n FROM records
WHERE voltage IS NOT NULL AND discharge_capacity IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return B.drop_missing(records(spark, sf), ("voltage", "discharge_capacity")).groupBy("cell_id", "cycle", "step").agg(
        F.count(F.lit(1)).alias("n"))


@query("b6_half_cycles", """SELECT cell_id, cycle, step, count(*) AS n_records, min(seq) AS first_seq, max(seq) AS last_seq FROM records GROUP BY ALL""")
def _(spark, sf):
    return B.half_cycles(records(spark, sf))


@query("b7_half_cycle_keys", "SELECT DISTINCT cell_id, cycle, step FROM records")
def _(spark, sf):
    return B.half_cycle_keys(records(spark, sf))


@query("b8_one_half_cycle", "SELECT cell_id, seq, voltage, capacity FROM records WHERE cycle = 3 AND step = 'Charge'", "voltage capacity")
def _(spark, sf):
    return B.half_cycle(records(spark, sf), 3, "Charge").select("cell_id", "seq", "voltage", "capacity")


WINDOW = """
win AS (SELECT cell_id, lo + t AS window_low_v, hi - t AS window_high_v FROM (
  SELECT cell_id, min(voltage) AS lo, max(voltage) AS hi, CASE WHEN min(voltage) + 5e-2 >= max(voltage) - 5e-2 THEN 1e-2 ELSE 5e-2 END AS t
  FROM records WHERE voltage IS NOT NULL AND dqdv IS NOT NULL GROUP BY 1))
"""


@query("b9_voltage_window", f"WITH {WINDOW} SELECT * FROM win", "window_low_v window_high_v")
def _(spark, sf):
    return B.voltage_window(records(spark, sf))


HOLD = """
med AS (SELECT cell_id, cycle, step, median(abs(current_a)) AS mi, count(*) AS n FROM records GROUP BY ALL),
low AS (SELECT r.*, n, coalesce(abs(current_a) < mi * 99e-2, false) AS low FROM records r
  JOIN med m ON m.cell_id = r.cell_id AND m.cycle = r.cycle AND m.step = r.step),
tail AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY cell_id, cycle, step ORDER BY seq DESC) = 0 AS in_tail FROM low),
run AS (SELECT *, sum(CASE WHEN in_tail THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id, cycle, step) AS run FROM tail),
stripped AS (SELECT * FROM run WHERE NOT (in_tail AND run >= 3 AND n >= 6))
"""


@query("b10_strip_hold", f"""WITH {HOLD} SELECT cell_id, cycle, step, count(*) AS n_records, CAST(sum(CASE WHEN in_tail AND run >= 3 AND n >= 6 THEN 1 ELSE 0 END) AS BIGINT) AS n_hold,
max(seq) FILTER (NOT (in_tail AND run >= 3 AND n >= 6)) AS last_kept FROM run GROUP BY ALL""")
def _(spark, sf):
    r = records(spark, sf)
    return B.mark_hold(r).groupBy("cell_id", "cycle", "step").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(F.col("in_hold").cast("int")).alias("n_hold"),
        F.max(F.when(~F.col("in_hold"), F.col("seq"))).alias("last_kept"),
    )


@query("b10_strip_hold_by_voltage", """WITH d AS (SELECT *, abs(voltage - lag(voltage) OVER (PARTITION BY cell_id, cycle, step ORDER BY seq)) AS dv,
  count(*) OVER (PARTITION BY cell_id, cycle, step) AS n FROM records),
m AS (SELECT cell_id, cycle, step, median(dv) FILTER (dv > 0) AS t FROM d GROUP BY ALL),
l AS (SELECT d.*, coalesce(dv < t * 1e-1, false) AS low FROM d JOIN m ON m.cell_id = d.cell_id AND m.cycle = d.cycle AND m.step = d.step),
tl AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY cell_id, cycle, step ORDER BY seq DESC) = 0 AS in_tail FROM l)
SELECT cell_id, cycle, step, CASE WHEN count(*) FILTER (in_tail) >= 3 AND any_value(n) >= 6 THEN count(*) FILTER (in_tail) ELSE 0 END AS n_hold FROM tl GROUP BY ALL""")
def _(spark, sf):
    blind = records(spark, sf).withColumn("current_a", F.lit(None).cast("double"))
    return B.hold_table(blind).select("cell_id", "cycle", "step", "n_hold")


DIRECTION = """
dir AS (SELECT cell_id, cycle, step, CASE WHEN count(*) >= 2 AND abs(arg_max(voltage, seq) - arg_min(voltage, seq)) > 1e-4
  THEN CAST(sign(arg_max(voltage, seq) - arg_min(voltage, seq)) AS INT) WHEN lower(step) LIKE 'c%' THEN 1 ELSE -1 END AS direction
  FROM records WHERE voltage IS NOT NULL GROUP BY cell_id, cycle, step)
"""


@query("b11_orient_dqdv", f"""WITH {DIRECTION},
d AS (SELECT r.*, direction, coalesce(sign(voltage - lag(voltage) OVER w), 0) = direction AS fwd, capacity - lag(capacity) OVER w AS dq,
  median(current_a) OVER (PARTITION BY r.cell_id, r.cycle, r.step) AS mi, count(*) OVER (PARTITION BY r.cell_id, r.cycle, r.step) AS n
  FROM records r JOIN dir ON dir.cell_id = r.cell_id AND dir.cycle = r.cycle AND dir.step = r.step
  WINDOW w AS (PARTITION BY r.cell_id, r.cycle, r.step ORDER BY seq)),
t AS (SELECT cell_id, cycle, step, sign(CASE WHEN count(*) FILTER (fwd) >= 3 THEN median(dqdv) FILTER (fwd) ELSE sum(dqdv) END) AS target FROM d GROUP BY ALL),
o AS (SELECT d.*, target, n >= 3 AND target <> 0 AND NOT fwd AND sign(dqdv) <> target AND (mi = 0 OR sign(current_a) = sign(mi)) AND NOT coalesce(dq < 0, false) AS oriented
  FROM d JOIN t ON t.cell_id = d.cell_id AND t.cycle = d.cycle AND t.step = d.step)
SELECT cell_id, cycle, step, seq, oriented, CASE WHEN oriented THEN abs(dqdv) * target ELSE dqdv END AS dqdv FROM o""", "dqdv")
def _(spark, sf):
    return B.orient_dqdv(records(spark, sf)).select("cell_id", "cycle", "step", "seq", "oriented", "dqdv")


@query("b15_short_half_cycles", """WITH s AS (SELECT cell_id, cycle, step, max(voltage) - min(voltage) AS span_v FROM records GROUP BY ALL)
SELECT *, median(span_v) OVER (PARTITION BY cell_id, step) AS median_span_v, span_v < 8e-1 * median(span_v) OVER (PARTITION BY cell_id, step) AS is_short FROM s""",
       "span_v median_span_v")
def _(spark, sf):
    return B.short_half_cycles(records(spark, sf))


@query("b16_sample_half_cycles", """WITH k AS (SELECT DISTINCT cell_id, cycle, step FROM records),
r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle, step) - 1 AS r, count(*) OVER (PARTITION BY cell_id) AS c FROM k)
SELECT cell_id, cycle, step FROM r WHERE c <= 8 OR r IN (SELECT CAST(round_even(i * (c - 1) / 7e0, 0) AS BIGINT) FROM range(0, 8) t(i))""")
def _(spark, sf):
    return B.sample_half_cycles(B.half_cycle_keys(records(spark, sf)), 8)


@query("b17_label_cycles", """WITH k AS (SELECT DISTINCT cell_id, cycle FROM records),
r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) - 1 AS r, count(*) OVER (PARTITION BY cell_id) AS c FROM k)
SELECT cell_id, cycle FROM r WHERE r % CAST(greatest(1, ceil(c / 6e0)) AS BIGINT) = 0 OR r = c - 1""")
def _(spark, sf):
    return B.label_cycles(records(spark, sf).select("cell_id", "cycle").distinct(), 6)


@query("b21_caption_window", """WITH m AS (SELECT cell_id, min(voltage) AS a, max(voltage) AS b FROM records GROUP BY 1)
SELECT m.cell_id, CASE WHEN coalesce(voltage_upper_v > voltage_lower_v, false) THEN voltage_lower_v ELSE a END AS low_v,
CASE WHEN coalesce(voltage_upper_v > voltage_lower_v, false) THEN voltage_upper_v ELSE b END AS high_v,
CASE WHEN coalesce(voltage_upper_v > voltage_lower_v, false) THEN 'stated' ELSE 'measured' END AS source FROM m LEFT JOIN cells c ON c.cell_id = m.cell_id""",
       "low_v high_v", "records, cells")
def _(spark, sf):
    return B.caption_window(records(spark, sf), cells(spark, sf))


@query("b22_column_alias", "SELECT cell_id, max(discharge_capacity) AS capacity FROM records GROUP BY 1", "capacity")
def _(spark, sf):
    r = records(spark, sf).withColumnRenamed("discharge_capacity", "cell_x_Discharge_Capacity")
    found = B.first_present(r, ("Discharge_mAh_g", "Discharge_Capacity"))
    return r.groupBy("cell_id").agg(F.max(found).alias("capacity"))


@query("b23_explicit_overrides", """SELECT cell_id, 'max_cycle' AS setting, CAST(max_cycle AS VARCHAR) AS value FROM cells WHERE max_cycle <> 0
UNION ALL SELECT cell_id, 'electrode_type', electrode_type FROM cells WHERE electrode_type <> 'positive'""", "", "cells")
def _(spark, sf):
    return B.explicit_overrides(cells(spark, sf), {"max_cycle": 0, "electrode_type": "positive"})


@query("b24_rule_violations", """SELECT cell_id, 'theoretical capacity is positive' AS rule FROM cells WHERE NOT coalesce(theoretical_mAh_g > 0, false)
UNION ALL SELECT cell_id, 'voltage window is ordered' FROM cells WHERE NOT coalesce(voltage_upper_v > voltage_lower_v, false)
UNION ALL SELECT cell_id, 'max cycle is positive' FROM cells WHERE max_cycle <= 0
UNION ALL SELECT cell_id, 'mass is positive' FROM cells WHERE NOT coalesce(active_mass_mg > 0, false)
UNION ALL SELECT cell_id, 'composition is given' FROM cells WHERE NOT coalesce(length(trim(composition)) > 0, false)
UNION ALL SELECT cell_id, 'electrode type is positive or negative' FROM cells WHERE NOT coalesce(lower(electrode_type) IN ('positive', 'negative'), false)""", "", "cells")
def _(spark, sf):
    return B.rule_violations(cells(spark, sf), B.cell_rules())


@query("d5_record_spacing", """WITH d AS (SELECT cell_id, abs(voltage - lag(voltage) OVER w) * 1000 AS mv, count(*) OVER (PARTITION BY cell_id, cycle, step) AS n
  FROM records WHERE voltage IS NOT NULL WINDOW w AS (PARTITION BY cell_id, cycle, step ORDER BY seq))
SELECT cell_id, median(mv) FILTER (mv > 0) AS median_mv, min(mv) FILTER (mv > 0) AS min_mv, avg(CASE WHEN mv = 0 THEN 1 ELSE 0 END) AS duplicate_fraction
FROM d WHERE n >= 50 AND mv IS NOT NULL GROUP BY 1""", "median_mv min_mv duplicate_fraction")
def _(spark, sf):
    return E.record_spacing(records(spark, sf))


@query("d6_half_cycle_seconds", "SELECT cell_id, cycle, step, CASE WHEN count(time_s) >= 2 THEN greatest(max(time_s), max(time_s) - min(time_s)) END AS duration_s FROM records GROUP BY ALL", "duration_s")
def _(spark, sf):
    return E.half_cycle_seconds(records(spark, sf))


PROFILE = """
cyc AS (SELECT cell_id, cycle, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS r FROM (SELECT DISTINCT cell_id, cycle FROM records WHERE cycle >= 2)),
hq AS (SELECT r.cell_id, r.cycle, r.step, count(*) AS n, max(voltage) - min(voltage) AS rng, quantile_cont(voltage, 25e-2) AS q1, median(voltage) AS q2, quantile_cont(voltage, 75e-2) AS q3
  FROM records r JOIN cyc ON cyc.cell_id = r.cell_id AND cyc.cycle = r.cycle AND cyc.r <= 4 GROUP BY ALL HAVING count(*) >= 20 AND max(voltage) - min(voltage) >= 1e-2),
hp AS (SELECT h.cell_id, h.cycle, h.step, any_value((q3 - q1) / rng) AS iqr, count(*) FILTER (voltage >= q2 - 2e-2 AND voltage <= q2 + 2e-2) / count(*) AS plat
  FROM hq h JOIN records r ON r.cell_id = h.cell_id AND r.cycle = h.cycle AND r.step = h.step GROUP BY ALL),
prof AS (SELECT cell_id, avg(iqr) AS iqr_fraction, avg(plat) AS plateau_fraction,
  CASE WHEN avg(iqr) < 8e-2 OR avg(plat) > 6e-1 THEN 'sharp' WHEN avg(iqr) < 2e-1 OR avg(plat) > 35e-2 THEN 'moderate' ELSE 'broad' END AS profile FROM hp GROUP BY 1)
"""


@query("d7_classify_profile", f"WITH {PROFILE} SELECT * FROM prof", "iqr_fraction plateau_fraction")
def _(spark, sf):
    return E.classify_profile(records(spark, sf))


@query("c25_step_end_reason", """WITH l AS (SELECT cell_id, cycle, step, trim(arg_max(end_reason, seq) FILTER (end_reason IS NOT NULL)) AS r FROM records GROUP BY ALL)
SELECT cell_id, cycle, step, CASE WHEN lower(r) IN ('', 'nan', 'none', '-') THEN NULL ELSE r END AS end_reason FROM l""")
def _(spark, sf):
    return E.step_end_reason(records(spark, sf))


@query("e1_step_direction", f"WITH {DIRECTION} SELECT * FROM dir")
def _(spark, sf):
    return B.step_direction(records(spark, sf))


REVERSALS = DIRECTION + """,
rd AS (SELECT r.*, direction, lag(voltage) OVER w AS v0, lag(capacity) OVER w AS q0 FROM records r
  JOIN dir ON dir.cell_id = r.cell_id AND dir.cycle = r.cycle AND dir.step = r.step WINDOW w AS (PARTITION BY r.cell_id, r.cycle, r.step ORDER BY seq)),
ri AS (SELECT *, coalesce((voltage - v0) * direction < 0, false) AS back,
  count(*) FILTER (NOT coalesce((voltage - v0) * direction < 0, false)) OVER (PARTITION BY cell_id, cycle, step ORDER BY seq) AS island FROM rd),
rmi AS (SELECT cell_id, cycle, step, median(abs(current_a)) AS mi FROM records GROUP BY ALL),
rev AS (SELECT i.cell_id, i.cycle, i.step, min(seq) AS anchor_seq, count(*) FILTER (back) AS n_records, sum(abs(capacity - q0)) FILTER (back) AS charge,
  arg_min(voltage, seq) AS v_start, arg_max(voltage, seq) AS v_end, abs(arg_max(voltage, seq) - arg_min(voltage, seq)) * 1000 AS span_mv,
  arg_max(time_s, seq) - arg_min(time_s, seq) AS seconds, median(abs(current_a)) > 99e-2 * any_value(mi) AS at_full_current
  FROM ri i JOIN rmi ON rmi.cell_id = i.cell_id AND rmi.cycle = i.cycle AND rmi.step = i.step GROUP BY i.cell_id, i.cycle, i.step, island HAVING count(*) FILTER (back) >= 1)
"""
REVERSAL_COLUMNS = "charge v_start v_end span_mv seconds"


@query("e2_reversals", f"WITH {REVERSALS} SELECT * FROM rev", REVERSAL_COLUMNS)
def _(spark, sf):
    return E.reversals(records(spark, sf))


TERMINATION = DIRECTION + """,
te AS (SELECT r.cell_id, r.cycle, r.step, any_value(direction) AS direction, arg_max(voltage, seq) AS v_end,
  CASE WHEN count(time_s) >= 2 THEN greatest(max(time_s), max(time_s) - min(time_s)) END AS duration_s,
  trim(arg_max(end_reason, seq) FILTER (end_reason IS NOT NULL)) AS er, max(seq) AS last_seq
  FROM records r JOIN dir ON dir.cell_id = r.cell_id AND dir.cycle = r.cycle AND dir.step = r.step GROUP BY ALL),
tp AS (SELECT * EXCLUDE (er, last_seq), nullif(er, '') AS end_reason, last_seq = max(last_seq) OVER (PARTITION BY cell_id) AS is_last,
  row_number() OVER (PARTITION BY cell_id ORDER BY cycle, step) AS place FROM te),
pairs AS (SELECT a.cell_id, a.cycle, a.step, b.v_end, b.duration_s, row_number() OVER (PARTITION BY a.cell_id, a.place ORDER BY abs(b.place - a.place), b.place) AS k
  FROM tp a JOIN tp b ON b.cell_id = a.cell_id AND b.direction = a.direction AND b.place <> a.place),
lim AS (SELECT cell_id, cycle, step, count(*) AS n, median(v_end) AS v_limit,
  CASE WHEN count(*) >= 4 THEN quantile_cont(v_end, 75e-2) - quantile_cont(v_end, 25e-2) ELSE max(v_end) - min(v_end) END AS spread,
  CASE WHEN count(duration_s) >= 2 THEN median(duration_s) END AS typical FROM pairs WHERE k <= 10 GROUP BY ALL HAVING count(*) >= 2),
tj AS (SELECT tp.* EXCLUDE (place), v_limit, tp.direction * (v_limit - v_end) * 1000 AS short_mv,
  CASE WHEN typical > 0 THEN duration_s / typical END AS duration_frac,
  coalesce(tp.direction * (v_limit - v_end) * 1000 <= greatest(20, 5 * spread * 1000), true) AS reached
  FROM tp LEFT JOIN lim ON lim.cell_id = tp.cell_id AND lim.cycle = tp.cycle AND lim.step = tp.step),
term AS (SELECT *, CASE WHEN reached THEN 'reached the cut-off' WHEN end_reason IS NOT NULL THEN 'ended on: ' || end_reason
  WHEN is_last AND (duration_frac IS NULL OR duration_frac < 9e-1) THEN 'still running when exported' ELSE 'terminated early, not on voltage' END AS termination_class FROM tj)
"""


@query("e7_termination_check", f"WITH {TERMINATION} SELECT * FROM term", "v_end duration_s v_limit short_mv duration_frac")
def _(spark, sf):
    return E.termination_check(records(spark, sf))


@query("e8_in_progress", f"WITH {TERMINATION} SELECT cell_id, cycle, step FROM term WHERE is_last AND NOT reached AND termination_class LIKE 'still running%'")
def _(spark, sf):
    return E.in_progress(E.termination_check(records(spark, sf)))


@query("e9_early_terminations", f"""WITH {TERMINATION} SELECT cell_id, cycle, step, v_end, v_limit, short_mv, duration_frac, termination_class, is_last
FROM term WHERE NOT reached AND termination_class NOT LIKE 'still running%'""", "v_end v_limit short_mv duration_frac")
def _(spark, sf):
    return E.early_terminations(E.termination_check(records(spark, sf)))


@query("e6_last_useful_cycle", f"""WITH {TABLE},
ref AS (SELECT cell_id, count(*) AS n, quantile_cont(discharge_mAh_g, 9e-1) AS q FROM tbl WHERE discharge_mAh_g IS NOT NULL GROUP BY 1),
dd AS (SELECT t.cell_id, cycle, discharge_mAh_g < 2e-2 * q AS dead, row_number() OVER w AS r, lag(cycle) OVER w AS before,
  row_number() OVER w - row_number() OVER (PARTITION BY t.cell_id, discharge_mAh_g < 2e-2 * q ORDER BY cycle) AS g
  FROM tbl t JOIN ref ON ref.cell_id = t.cell_id WHERE discharge_mAh_g IS NOT NULL WINDOW w AS (PARTITION BY t.cell_id ORDER BY cycle)),
isl AS (SELECT cell_id, g, min(cycle) AS first_dead, arg_min(coalesce(before, cycle), cycle) AS useful FROM dd WHERE dead GROUP BY ALL HAVING count(*) >= 3),
f AS (SELECT cell_id, arg_min(useful, first_dead) AS useful FROM isl GROUP BY 1)
SELECT ref.cell_id, CASE WHEN n >= 4 AND q > 0 THEN useful END AS last_useful_cycle, CASE WHEN n < 4 THEN 'too few cycles to judge' WHEN NOT q > 0 THEN 'no usable reference capacity'
 WHEN useful IS NOT NULL THEN 'dead' ELSE 'alive' END AS state, q * 2e-2 AS floor_mAh_g FROM ref LEFT JOIN f ON f.cell_id = ref.cell_id""", "floor_mAh_g")
def _(spark, sf):
    return E.last_useful_cycle(table(spark, sf))


FORMATION = """
ce AS (SELECT cell_id, cycle, ce_pct, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS i, count(*) OVER (PARTITION BY cell_id) AS n FROM tbl WHERE ce_pct IS NOT NULL),
later AS (SELECT a.cell_id, a.cycle, a.i, a.n, count(*) AS nl, median(b.ce_pct) AS m FROM ce a JOIN ce b ON b.cell_id = a.cell_id AND b.i > a.i GROUP BY ALL),
held AS (SELECT l.cell_id, l.cycle FROM later l JOIN ce x ON x.cell_id = l.cell_id AND x.i BETWEEN l.i AND l.i + 2
  WHERE l.n >= 4 AND l.i <= l.n - 2 AND nl >= 5 AND l.cycle <= 15 AND m <= 105 GROUP BY ALL HAVING max(abs(x.ce_pct - m)) <= {tol}),
form AS (SELECT c.cell_id, greatest(min(h.cycle), 2) AS formation_end FROM (SELECT DISTINCT cell_id FROM tbl) c LEFT JOIN held h ON h.cell_id = c.cell_id GROUP BY 1)
"""


@query("e10_formation_end", f"WITH {TABLE}, {FORMATION.format(tol='1e-1')} SELECT cell_id, CASE WHEN cell_id IN (SELECT cell_id FROM held) THEN formation_end END AS formation_end FROM form")
def _(spark, sf):
    return E.formation_end(table(spark, sf))


LOOSE = "WITH " + TABLE + ", " + FORMATION.format(tol="5e0") + ", fe AS (SELECT cell_id, CASE WHEN cell_id IN (SELECT cell_id FROM held) THEN formation_end END AS formation_end FROM form)"


@query("e10_formation_end_wide_band", f"{LOOSE} SELECT * FROM fe")
def _(spark, sf):
    return E.formation_end(table(spark, sf), tolerance_pp=5.0)


@query("d40_stable_efficiency", f"""{LOOSE},
s AS (SELECT t.*, coalesce(formation_end, 2) AS start_cycle FROM tbl t JOIN fe ON fe.cell_id = t.cell_id WHERE NOT (incomplete OR partial_final) AND cycle >= coalesce(formation_end, 2)),
a AS (SELECT cell_id, start_cycle, max(cycle) AS last_cycle, avg(ce_pct) AS mean_ce_pct, stddev_samp(ce_pct) AS sd_ce_pct, count(discharge_mAh_g) AS n,
  regr_slope(discharge_mAh_g, cycle) AS slope, arg_min(discharge_mAh_g, cycle) FILTER (discharge_mAh_g IS NOT NULL) AS base FROM s GROUP BY ALL)
SELECT cell_id, start_cycle, last_cycle, mean_ce_pct, sd_ce_pct, CASE WHEN n >= 3 THEN slope END AS fade_mAh_g_per_cycle,
  CASE WHEN n >= 3 AND base > 0 THEN slope / base * 100 END AS fade_pct_per_cycle FROM a""", "mean_ce_pct sd_ce_pct fade_mAh_g_per_cycle fade_pct_per_cycle")
def _(spark, sf):
    from cyclespark.operators.cycles import stable_efficiency

    t = table(spark, sf)
    return stable_efficiency(t, E.formation_end(t, tolerance_pp=5.0))


@query("e21_trailing_partial", f"""WITH {TABLE}, p AS (SELECT cell_id, max(cycle) AS partial_cycle, arg_max(discharge_mAh_g, cycle) AS partial_mAh_g FROM tbl WHERE partial_final GROUP BY 1),
b AS (SELECT t.cell_id, max(cycle) AS last_full_cycle, arg_max(discharge_mAh_g, cycle) AS last_full_mAh_g FROM tbl t JOIN p ON p.cell_id = t.cell_id
  WHERE cycle < partial_cycle AND discharge_mAh_g IS NOT NULL GROUP BY 1)
SELECT p.*, last_full_cycle, last_full_mAh_g FROM p LEFT JOIN b ON b.cell_id = p.cell_id""", "partial_mAh_g last_full_mAh_g")
def _(spark, sf):
    return E.trailing_partial(table(spark, sf))


@query("e24_voltage_envelope", """WITH e AS (SELECT cell_id, cycle, step, max(voltage) AS a, min(voltage) AS b FROM records GROUP BY ALL)
SELECT cell_id, step, (max(a) - min(a)) * 1000 AS top_range_mv, (max(b) - min(b)) * 1000 AS bottom_range_mv, (arg_max(a, cycle) - arg_min(a, cycle)) * 1000 AS top_shift_mv,
 (arg_max(b, cycle) - arg_min(b, cycle)) * 1000 AS bottom_shift_mv, greatest(max(a) - min(a), max(b) - min(b)) * 1000 >= 300 AS is_severe FROM e GROUP BY ALL""",
       "top_range_mv bottom_range_mv top_shift_mv bottom_shift_mv")
def _(spark, sf):
    return E.envelope_movement(E.voltage_envelope(records(spark, sf)))
