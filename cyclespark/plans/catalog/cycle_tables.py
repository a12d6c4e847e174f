"""Queries over cycle tables: capacity, efficiency, energy, power, fade, rates."""

from pyspark.sql import functions as F

from cyclespark.operators import cycles as C
from cyclespark.operators import rates as R
from cyclespark.plans.fixture import cells, records, shared
from cyclespark.operators.lineage import cut
from cyclespark.plans.registry import query

DELIVERED = """
delivered AS (
  SELECT cell_id, cycle,
    max(charge_capacity) FILTER (step = 'Charge') - min(charge_capacity) FILTER (step = 'Charge') AS charge_mAh_g,
    max(discharge_capacity) FILTER (step = 'Discharge') - min(discharge_capacity) FILTER (step = 'Discharge') AS discharge_mAh_g
  FROM records WHERE charge_capacity IS NOT NULL OR discharge_capacity IS NOT NULL GROUP BY 1, 2)
"""
TABLE = DELIVERED + """,
flagged AS (
  SELECT *, CASE WHEN charge_mAh_g > 0 AND discharge_mAh_g > 0 THEN discharge_mAh_g / charge_mAh_g * 100 END AS ce_pct,
    coalesce(discharge_mAh_g <= 0, true) AS incomplete,
    cell_no_of(cell_id) % 4 = 1 AND cycle = 20 AS partial_final FROM delivered),
refcap AS (
  SELECT cell_id, coalesce(max(discharge_mAh_g) FILTER (cycle = 2 AND NOT incomplete),
    arg_min(discharge_mAh_g, cycle) FILTER (NOT incomplete)) AS ref FROM flagged GROUP BY 1),
tbl AS (
  SELECT f.cell_id, f.cycle, charge_mAh_g, discharge_mAh_g, ce_pct, incomplete, partial_final,
    CASE WHEN ref > 0 THEN discharge_mAh_g / ref * 100 END AS retention_pct,
    charge_mAh_g - discharge_mAh_g AS charge_excess_mAh_g
  FROM flagged f LEFT JOIN refcap r ON r.cell_id = f.cell_id)
""".replace("cell_no_of(cell_id)", "CAST(substr(cell_id, 6) AS BIGINT)")
USABLE = "NOT (incomplete OR partial_final)"


@shared
def in_progress(spark, sf):
    """Half-cycles known to have been running at export."""
    return (
        records(spark, sf)
        .filter("step = 'Discharge' AND cycle = 20 AND cell_no % 4 = 1")
        .select("cell_id", "cycle", "step")
        .distinct()
    )


@shared
def table(spark, sf):
    """The cycle table: one row per cycle, read several times by most queries, hence kept."""
    return cut(C.cycling_summary(records(spark, sf), in_progress(spark, sf)))


@shared
def current(spark, sf):
    return cut(R.discharge_current(records(spark, sf)))


@shared
def grouped(spark, sf):
    return R.group_by_rate(current(spark, sf))


@shared
def groups(spark, sf):
    return R.rate_groups(grouped(spark, sf), cells_with_theory(spark, sf))


def cells_with_theory(spark, sf):
    """Cells with the theoretical capacity stated or a common fallback."""
    return cells(spark, sf).withColumn("theoretical_mAh_g", F.coalesce("theoretical_mAh_g", F.lit(125.0)))


@shared
def labels(spark, sf):
    return R.rate_block_labels(table(spark, sf), groups(spark, sf))


@query("d1_half_capacity", """
SELECT cell_id, cycle, step, CASE WHEN count(capacity) >= 2 THEN max(capacity) - min(capacity) END AS capacity_mAh_g
FROM records GROUP BY ALL""", "capacity_mAh_g")
def _(spark, sf):
    return C.half_capacity(records(spark, sf))


@query("d2_delivered_capacity", f"WITH {DELIVERED} SELECT * FROM delivered", "charge_mAh_g discharge_mAh_g")
def _(spark, sf):
    return C.delivered_capacity(records(spark, sf))


@query("d3_coulombic_efficiency", f"WITH {TABLE} SELECT cell_id, cycle, ce_pct FROM tbl", "ce_pct")
def _(spark, sf):
    return C.delivered_capacity(records(spark, sf)).select(
        "cell_id", "cycle", C.coulombic_efficiency().alias("ce_pct")
    )


ENERGY = """
pairs AS (
  SELECT cell_id, cycle, step, capacity AS q, voltage AS v,
    lag(capacity) OVER w AS q0, lag(voltage) OVER w AS v0
  FROM records WHERE voltage IS NOT NULL AND capacity IS NOT NULL
  WINDOW w AS (PARTITION BY cell_id, cycle, step ORDER BY capacity, seq)),
halves AS (
  SELECT cell_id, cycle, step, count(*) AS n, sum((v + v0) / 2 * (q - q0)) AS energy, max(q) - min(q) AS span
  FROM pairs GROUP BY ALL)
"""


@query("d4_mean_discharge_voltage", f"""WITH {ENERGY}
SELECT cell_id, cycle, energy / span AS avg_discharge_voltage_v FROM halves
WHERE step = 'Discharge' AND n >= 3 AND span > 0""", "avg_discharge_voltage_v")
def _(spark, sf):
    return C.mean_discharge_voltage(records(spark, sf))


@query("d8_energy_efficiency", f"""WITH {DELIVERED}, {ENERGY},
e AS (SELECT cell_id, cycle, max(abs(energy)) FILTER (step = 'Discharge' AND n >= 3) AS discharge_energy,
  max(abs(energy)) FILTER (step = 'Charge' AND n >= 3) AS charge_energy FROM halves GROUP BY ALL),
j AS (SELECT e.*, charge_mAh_g, discharge_mAh_g,
  CASE WHEN charge_energy > 0 THEN discharge_energy / charge_energy * 100 END AS energy_efficiency_pct,
  CASE WHEN charge_mAh_g > 0 AND discharge_mAh_g > 0 THEN discharge_mAh_g / charge_mAh_g * 100 END AS ce_pct,
  CASE WHEN charge_mAh_g > 0 THEN charge_energy / charge_mAh_g END AS avg_charge_voltage_v,
  CASE WHEN discharge_mAh_g > 0 THEN discharge_energy / discharge_mAh_g END AS avg_discharge_voltage_v
  FROM e LEFT JOIN delivered d ON d.cell_id = e.cell_id AND d.cycle = e.cycle)
SELECT *, CASE WHEN avg_charge_voltage_v > 0 THEN avg_discharge_voltage_v / avg_charge_voltage_v * 100 END AS voltage_efficiency_pct,
  ce_pct - energy_efficiency_pct AS ce_ee_gap_pct FROM j""",
    "discharge_energy charge_energy charge_mAh_g discharge_mAh_g energy_efficiency_pct ce_pct avg_charge_voltage_v "
    "avg_discharge_voltage_v voltage_efficiency_pct ce_ee_gap_pct")
def _(spark, sf):
    return C.energy_efficiency(records(spark, sf))


@query("d9_discharge_voltage_drift", f"""WITH {TABLE}, {ENERGY},
b AS (SELECT h.cell_id, h.cycle, energy / span AS v, span FROM halves h
  WHERE step = 'Discharge' AND n >= 3 AND span > 0
  AND NOT EXISTS (SELECT 1 FROM tbl t WHERE t.cell_id = h.cell_id AND t.cycle = h.cycle AND NOT ({USABLE}))),
r AS (SELECT cell_id, max(v) AS v_ref FROM b WHERE cycle = 2 GROUP BY 1)
SELECT b.cell_id, b.cycle, v AS avg_discharge_voltage_v, span AS discharge_mAh_g, (v - v_ref) * 1000 AS drift_mv,
  CASE WHEN v_ref IS NOT NULL THEN CASE WHEN b.cycle > 2 THEN (v - v_ref) * 1000 / (b.cycle - 2) ELSE 0e0 END END AS drift_mv_per_cycle
FROM b LEFT JOIN r ON r.cell_id = b.cell_id""", "avg_discharge_voltage_v discharge_mAh_g drift_mv drift_mv_per_cycle")
def _(spark, sf):
    return C.discharge_voltage_drift(records(spark, sf), table(spark, sf))


DIMS = """
dims AS (
  SELECT cell_id, active_mass_mg / 1000 AS mass_g, key_cycles,
    CASE WHEN blend IS NULL THEN 8e-1 WHEN blend = '80/10/10' THEN 80e0 / 100 ELSE 90e0 / 100 END AS fraction,
    3.141592653589793e0 * (coalesce(electrode_diameter_mm, 12e0) / 2 / 10) * (coalesce(electrode_diameter_mm, 12e0) / 2 / 10) AS area
  FROM cells)
"""
POWER = f"""{DIMS},
peak AS (
  SELECT cell_id, cycle, max(abs(discharge_energy)) AS e, max(abs(power_w)) AS p FROM records
  WHERE step = 'Discharge' AND discharge_energy IS NOT NULL AND power_w IS NOT NULL GROUP BY ALL),
pe AS (
  SELECT peak.cell_id, cycle, e AS energy_wh_kg_active, e * fraction AS energy_wh_kg_electrode, e * mass_g / area AS energy_mwh_cm2,
    p AS power_w, p / mass_g * 1000 AS power_mw_g_active, p / (mass_g / fraction) * 1000 AS power_mw_g_electrode,
    p / area * 1000 AS power_mw_cm2, key_cycles
  FROM peak LEFT JOIN dims ON dims.cell_id = peak.cell_id)
"""
POWER_COLUMNS = (
    "energy_wh_kg_active energy_wh_kg_electrode energy_mwh_cm2 power_w power_mw_g_active power_mw_g_electrode power_mw_cm2"
)


@query("d10_power_and_energy", f"WITH {POWER} SELECT * EXCLUDE (key_cycles) FROM pe", POWER_COLUMNS, "records, cells")
def _(spark, sf):
    return C.power_and_energy(records(spark, sf), cells(spark, sf))


@query("d11_area_and_active_fraction", f"WITH {DIMS} SELECT cell_id, fraction AS active_fraction, area AS area_cm2 FROM dims",
       "active_fraction area_cm2", "cells")
def _(spark, sf):
    return cells(spark, sf).select(
        "cell_id", C.active_fraction().alias("active_fraction"), C.electrode_area_cm2().alias("area_cm2")
    )


@query("d12_discharge_current", """
SELECT cell_id, cycle, avg(abs(current_a)) * 1000 AS avg_current_a FROM records
WHERE step = 'Discharge' AND current_a IS NOT NULL GROUP BY ALL""", "avg_current_a")
def _(spark, sf):
    return R.discharge_current(records(spark, sf), scale=1000.0)


TABLE_COLUMNS = "charge_mAh_g discharge_mAh_g ce_pct retention_pct charge_excess_mAh_g"


@query("d13_cycling_summary", f"WITH {TABLE} SELECT * FROM tbl", TABLE_COLUMNS)
def _(spark, sf):
    return table(spark, sf)


@query("d14_cell_health_flags", f"""WITH {TABLE},
good AS (SELECT * FROM tbl WHERE {USABLE} AND cycle >= 4),
ce AS (SELECT cell_id, cycle, ce_pct, lag(ce_pct) OVER (PARTITION BY cell_id ORDER BY cycle) AS before,
  row_number() OVER (PARTITION BY cell_id ORDER BY cycle DESC) AS from_end FROM good WHERE ce_pct IS NOT NULL),
trend AS (SELECT cell_id, count(*) AS n, regr_slope(ce_pct, cycle) AS s,
  sum(CASE WHEN from_end <= 4 AND ce_pct < before THEN 1 ELSE 0 END) AS falls FROM ce GROUP BY 1),
ex AS (SELECT cell_id, count(*) AS n_good, count(charge_excess_mAh_g) AS n, regr_slope(charge_excess_mAh_g, cycle) AS s FROM good GROUP BY 1),
lastrow AS (SELECT * FROM tbl t WHERE cycle = (SELECT max(cycle) FROM tbl u WHERE u.cell_id = t.cell_id)),
ends AS (SELECT cell_id, cycle, step, count(*) AS n, arg_min(voltage, seq) AS v_first, arg_max(voltage, seq) AS v_last FROM records GROUP BY ALL)
SELECT t.cell_id, CASE WHEN t.s < -5e-1 AND falls >= least(5, t.n) - 1 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  'ce_trend' AS flag, t.s AS value FROM trend t JOIN ex ON ex.cell_id = t.cell_id
  WHERE n_good >= 4 AND t.n >= 4 AND t.s < -3e-1
UNION ALL SELECT cell_id, CASE WHEN s > 3e-1 THEN 'CRITICAL' ELSE 'WARNING' END, 'charge_excess_trend', s FROM ex
  WHERE n_good >= 4 AND n >= 4 AND s > 1e-1
UNION ALL SELECT l.cell_id, 'FAILURE', 'open_circuit', d.v_first FROM lastrow l
  JOIN ends d ON d.cell_id = l.cell_id AND d.cycle = l.cycle AND d.step = 'Discharge' AND d.n <= 3
  JOIN ends c ON c.cell_id = l.cell_id AND c.cycle = l.cycle AND c.step = 'Charge'
  WHERE {USABLE} AND d.v_first > c.v_last + 1e-1
UNION ALL SELECT cell_id, 'FAILURE', 'died_on_discharge', charge_mAh_g FROM lastrow
  WHERE {USABLE} AND charge_mAh_g > 0 AND (discharge_mAh_g IS NULL OR discharge_mAh_g < 1)""", "value")
def _(spark, sf):
    return C.cell_health_flags(table(spark, sf), records(spark, sf))


@query("d15_headline_metrics", f"""WITH {TABLE},
a AS (SELECT cell_id, max(charge_mAh_g) FILTER (cycle = 1 AND NOT incomplete) AS q1,
  max(discharge_mAh_g) FILTER (cycle = 1 AND NOT incomplete) AS d1,
  max(discharge_mAh_g) FILTER (cycle = 1 AND {USABLE}) AS r1, max(discharge_mAh_g) FILTER (cycle = 2 AND {USABLE}) AS r2,
  max(cycle) FILTER ({USABLE}) AS last_cycle, arg_max(discharge_mAh_g, cycle) FILTER ({USABLE}) AS last_mAh_g FROM tbl GROUP BY 1)
SELECT cell_id, CASE WHEN q1 > 0 THEN q1 - d1 END AS first_cycle_loss_mAh_g, CASE WHEN q1 > 0 THEN (q1 - d1) / q1 * 100 END AS first_cycle_loss_pct,
  CASE WHEN q1 > 0 THEN d1 / q1 * 100 END AS first_cycle_ce_pct, last_cycle, last_mAh_g,
  CASE WHEN r1 <> 0 THEN 100 * last_mAh_g / r1 END AS retention_vs_1_pct, CASE WHEN r2 <> 0 THEN 100 * last_mAh_g / r2 END AS retention_vs_2_pct FROM a""",
    "first_cycle_loss_mAh_g first_cycle_loss_pct first_cycle_ce_pct last_mAh_g retention_vs_1_pct retention_vs_2_pct")
def _(spark, sf):
    return C.headline_metrics(table(spark, sf))


@query("d16_capacity_retention_pct", f"""WITH {TABLE},
g AS (SELECT cell_id, discharge_mAh_g AS d, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS a,
  row_number() OVER (PARTITION BY cell_id ORDER BY cycle DESC) AS b FROM tbl WHERE NOT incomplete AND discharge_mAh_g > 0),
m AS (SELECT cell_id, count(*) AS n, median(d) FILTER (a <= 3) AS a, median(d) FILTER (b <= 3) AS b FROM g GROUP BY 1)
SELECT cell_id, CASE WHEN n >= 2 AND a > 0 THEN b / a * 100 END AS retention_pct FROM m""", "retention_pct")
def _(spark, sf):
    return C.capacity_retention_pct(table(spark, sf))


@query("d17_cycle_life", f"WITH {TABLE} SELECT cell_id, cycle, charge_mAh_g, discharge_mAh_g, ce_pct FROM tbl WHERE {USABLE}",
       "charge_mAh_g discharge_mAh_g ce_pct")
def _(spark, sf):
    return C.cycle_life(table(spark, sf))


@query("b18_unusable_cycles", f"WITH {TABLE} SELECT cell_id, cycle, incomplete, partial_final FROM tbl WHERE incomplete OR partial_final")
def _(spark, sf):
    return table(spark, sf).filter(C.unusable()).select("cell_id", "cycle", "incomplete", "partial_final")


# Rate grouping and the running-median outlier rule are sequential, hence recursive SQL.
RATE = """
cur AS (SELECT cell_id, cycle, avg(abs(current_a)) AS i, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS k
  FROM records WHERE step = 'Discharge' AND current_a IS NOT NULL GROUP BY cell_id, cycle),
fold AS (
  SELECT cell_id, cycle, i, k, i AS s, 1 AS n, 0 AS block FROM cur WHERE k = 1
  UNION ALL
  SELECT c.cell_id, c.cycle, c.i, c.k,
    CASE WHEN abs(c.i - f.s / f.n) / (f.s / f.n) <= 5e-2 THEN f.s + c.i ELSE c.i END,
    CASE WHEN abs(c.i - f.s / f.n) / (f.s / f.n) <= 5e-2 THEN f.n + 1 ELSE 1 END,
    CASE WHEN abs(c.i - f.s / f.n) / (f.s / f.n) <= 5e-2 THEN f.block ELSE f.block + 1 END
  FROM fold f JOIN cur c ON c.cell_id = f.cell_id AND c.k = f.k + 1)
"""
THEORY = "theory AS (SELECT cell_id, active_mass_mg AS mass, coalesce(theoretical_mAh_g, 125e0) AS th, charge_rate_c FROM cells)"
RATE_LIST = "[1e0/100, 1e0/50, 1e0/20, 1e0/10, 1e0/5, 1e0/4, 1e0/3, 1e0/2, 1e0, 2e0, 3e0, 5e0, 10e0, 20e0]"


def format_rate_sql(c):
    """SQL text formatting a C-rate expression, snapped to a conventional rate."""
    near = f"list_sort(list_transform({RATE_LIST}, lambda r: {{'d': abs(ln(r / ({c}))), 'r': r}}))[1]"
    snapped = f"(CASE WHEN {near}.d <= ln(1.1e0) THEN {near}.r ELSE ({c}) END)"
    return (
        f"(CASE WHEN ({c}) > 0 THEN CASE WHEN {snapped} < 1 THEN "
        f"CASE WHEN abs(1 / {snapped} - round_even(1 / {snapped}, 0)) < 5e-2 THEN 'C/' || CAST(CAST(round_even(1 / {snapped}, 0) AS INT) AS VARCHAR) "
        f"ELSE printf('%.2f', {snapped}) || 'C' END ELSE "
        f"CASE WHEN abs({snapped} - round_even({snapped}, 0)) < 5e-2 THEN CAST(CAST(round_even({snapped}, 0) AS INT) AS VARCHAR) || 'C' "
        f"ELSE printf('%.2f', {snapped}) || 'C' END END ELSE '?C' END)"
    )


GROUPS = f"""{RATE}, {THEORY},
grp AS (SELECT f.cell_id, block, min(cycle) AS first_cycle, max(cycle) AS last_cycle, count(*) AS n_cycles, avg(i) AS mean_current_a,
  avg(i) / ((any_value(mass) / 1000) * any_value(th) / 1000) AS c_rate FROM fold f LEFT JOIN theory t ON t.cell_id = f.cell_id GROUP BY ALL),
proto AS (SELECT cell_id, count(*) FILTER (n_cycles >= 2) AS n_blocks, coalesce(sum(n_cycles) FILTER (n_cycles < 2), 0) AS n_transition_cycles,
  min(c_rate) FILTER (n_cycles >= 2) AS low, max(c_rate) FILTER (n_cycles >= 2) AS high,
  arg_min(c_rate, block) FILTER (n_cycles >= 2) AS first_rate, arg_max(c_rate, block) FILTER (n_cycles >= 2) AS last_rate FROM grp GROUP BY 1),
lab AS (SELECT t.cell_id, t.cycle, g.block FROM tbl t JOIN proto p ON p.cell_id = t.cell_id AND p.n_blocks > 1
  LEFT JOIN grp g ON g.cell_id = t.cell_id AND g.n_cycles >= 2 AND t.cycle BETWEEN g.first_cycle AND g.last_cycle)
"""





@query("e12_rate_groups", f"WITH {RATE} SELECT cell_id, cycle, i * 1000 AS avg_current_ma, block FROM fold", "avg_current_ma")
def _(spark, sf):
    return grouped(spark, sf).select("cell_id", "cycle", (F.col("avg_current_a") * 1000).alias("avg_current_ma"), "block")


PROTO_LABEL = (
    f"CASE WHEN n_blocks > 1 AND low IS NOT NULL THEN {format_rate_sql('low')} || ' to ' || {format_rate_sql('high')} "
    f"WHEN n_blocks > 0 THEN {format_rate_sql('first_rate')} END"
)


@query("e13_rate_protocol", f"""WITH {TABLE}, {GROUPS}
SELECT cell_id, n_blocks, CAST(n_transition_cycles AS BIGINT) AS n_transition_cycles, n_blocks > 1 AS is_variable, {PROTO_LABEL} AS label,
  coalesce(first_rate > 0 AND abs(last_rate - first_rate) / first_rate <= 1e-1, false) AS returns_to_start FROM proto""", base="records, cells")
def _(spark, sf):
    return R.rate_protocol(groups(spark, sf))


@query("e13_rate_blocks", f"""WITH {TABLE}, {GROUPS}
SELECT cell_id, block, first_cycle, last_cycle, n_cycles, mean_current_a * 1000 AS mean_current_ma, c_rate, {format_rate_sql('c_rate')} AS label
FROM grp WHERE n_cycles >= 2""", "mean_current_ma c_rate", "records, cells")
def _(spark, sf):
    return R.rate_blocks(groups(spark, sf)).select(
        "*", (F.col("mean_current_a") * 1000).alias("mean_current_ma")
    ).drop("mean_current_a")


@query("e14_rate_block_labels", f"WITH {TABLE}, {GROUPS} SELECT * FROM lab", base="records, cells")
def _(spark, sf):
    return labels(spark, sf)


@query("c11_c_rate", f"""WITH {TABLE}, {GROUPS} SELECT f.cell_id, f.cycle, f.i / ((mass / 1000) * th / 1000) AS c_rate
FROM fold f JOIN theory t ON t.cell_id = f.cell_id""", "c_rate", "records, cells")
def _(spark, sf):
    from cyclespark.functions.scalars import c_rate

    return R.discharge_current(records(spark, sf)).join(cells_with_theory(spark, sf), "cell_id").select(
        "cell_id", "cycle",
        c_rate(F.col("avg_current_a"), F.col("active_mass_mg"), F.col("theoretical_mAh_g")).alias("c_rate"),
    )


@query("c12_snap_c_rate", f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, (l_extendedprice - 2e4) / 1e4 AS c FROM lineitem),
n AS (SELECT *, CASE WHEN c > 0 THEN list_sort(list_transform({RATE_LIST}, lambda r: {{'d': abs(ln(r / c)), 'r': r}}))[1] END AS near FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN c > 0 AND near.d <= ln(1.1e0) THEN near.r ELSE c END AS snapped FROM n""",
       "snapped", "")
def _(spark, sf):
    from cyclespark.functions.scalars import snap_c_rate
    from cyclespark.plans.fixture import table as raw_table

    return raw_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        snap_c_rate((F.col("l_extendedprice") - 2e4) / 1e4).alias("snapped"),
    )


@query("c13_format_c_rate", f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, (l_extendedprice - 2e4) / 1e4 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, {format_rate_sql('c')} AS label FROM b""", "", "")
def _(spark, sf):
    from cyclespark.functions.scalars import format_c_rate
    from cyclespark.plans.fixture import table as raw_table

    return raw_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        format_c_rate((F.col("l_extendedprice") - 2e4) / 1e4).alias("label"),
    )


@query("c14_describe_rate", f"""WITH {TABLE}, {GROUPS}, p AS (SELECT *, {PROTO_LABEL} AS label FROM proto)
SELECT t.cell_id, coalesce(CASE WHEN n_blocks > 1 THEN 'rates from ' || label ELSE label END, CAST(charge_rate_c AS VARCHAR) || ' C', 'an unstated rate') AS rate_phrase,
  coalesce(CASE WHEN n_blocks > 1 THEN label || ' (' || CAST(n_blocks AS VARCHAR) || ' rate blocks)' ELSE label END, CAST(charge_rate_c AS VARCHAR) || ' C') AS rate_description
FROM theory t LEFT JOIN p ON p.cell_id = t.cell_id""", base="records, cells")
def _(spark, sf):
    return R.describe_rate(R.rate_protocol(groups(spark, sf)), cells(spark, sf))


PREFIX = """
ok AS (SELECT cell_id, cycle, discharge_mAh_g AS d, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS k FROM {source}),
pre AS (
  SELECT cell_id, cycle, d, k, d IS NULL AS is_outlier, CASE WHEN d IS NULL THEN CAST([] AS DOUBLE[]) ELSE [d] END AS kept FROM ok WHERE k = 1
  UNION ALL
  SELECT o.cell_id, o.cycle, o.d, o.k,
    o.d IS NULL OR (len(p.kept) >= 3 AND o.d < 3e-1 * list_median(p.kept)),
    CASE WHEN o.d IS NULL OR (len(p.kept) >= 3 AND o.d < 3e-1 * list_median(p.kept)) THEN p.kept ELSE list_append(p.kept, o.d) END
  FROM pre p JOIN ok o ON o.cell_id = p.cell_id AND o.k = p.k + 1)
"""


@query("b19_prefix_outliers", "WITH " + TABLE + ", " + PREFIX.format(source="tbl") +
       " SELECT cell_id, cycle, d AS discharge_mAh_g, is_outlier FROM pre", "discharge_mAh_g")
def _(spark, sf):
    return C.flag_prefix_outliers(table(spark, sf))


BLOCK = """
bl AS (SELECT t.cell_id, t.cycle, t.discharge_mAh_g AS d, l.block FROM {source} t JOIN lab l ON l.cell_id = t.cell_id AND l.cycle = t.cycle),
loo AS (SELECT a.cell_id, a.cycle, median(b.d) AS m, count(b.d) AS n FROM bl a JOIN bl b
  ON b.cell_id = a.cell_id AND b.block = a.block AND b.cycle <> a.cycle GROUP BY ALL),
blk AS (SELECT bl.cell_id, bl.cycle, d, d IS NULL OR coalesce(n >= 3 AND d < 3e-1 * m, false) AS is_outlier
  FROM bl LEFT JOIN loo ON loo.cell_id = bl.cell_id AND loo.cycle = bl.cycle)
"""


@query("b20_block_outliers", f"WITH {TABLE}, {GROUPS}, " + BLOCK.format(source="tbl") +
       " SELECT cell_id, cycle, d AS discharge_mAh_g, is_outlier FROM blk", "discharge_mAh_g", "records, cells")
def _(spark, sf):
    return C.flag_block_outliers(table(spark, sf), labels(spark, sf))


PLOTTED = (
    TABLE + f", usable AS (SELECT * FROM tbl WHERE {USABLE} AND discharge_mAh_g IS NOT NULL), " + GROUPS + ", "
    + PREFIX.format(source="(SELECT * FROM usable u WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE l.cell_id = u.cell_id))")
    + ", " + BLOCK.format(source="usable")
    + """, plotted AS (SELECT cell_id, cycle, d FROM pre WHERE NOT is_outlier UNION ALL SELECT cell_id, cycle, d FROM blk WHERE NOT is_outlier),
pref AS (SELECT cell_id, coalesce(max(d) FILTER (cycle = 2), arg_min(d, cycle)) AS ref FROM plotted GROUP BY 1)
"""
)


@query("d18_comparative_capacity", f"""WITH {PLOTTED} SELECT p.cell_id, cycle, d AS discharge_mAh_g, composition
FROM plotted p LEFT JOIN cells c ON c.cell_id = p.cell_id""", "discharge_mAh_g", "records, cells")
def _(spark, sf):
    return C.comparative_capacity(table(spark, sf), labels(spark, sf), cells(spark, sf))


@query("d19_capacity_retention", f"""WITH {PLOTTED} SELECT p.cell_id, cycle, d AS discharge_mAh_g, d / ref * 100 AS retention_pct
FROM plotted p JOIN pref r ON r.cell_id = p.cell_id WHERE ref > 0""", "discharge_mAh_g retention_pct", "records, cells")
def _(spark, sf):
    return C.capacity_retention(table(spark, sf), labels(spark, sf))


@query("e16_fade_table", f"""WITH {PLOTTED}, x AS (SELECT p.cell_id, cycle, d, ref, (ref - d) / ref * 100 AS loss FROM plotted p JOIN pref r ON r.cell_id = p.cell_id WHERE ref > 0)
SELECT cell_id, cycle, d AS discharge_mAh_g, loss AS capacity_loss_pct, (d - lag(d) OVER w) / ref * 100 AS per_cycle_change_pct,
  loss - lag(loss, 9) OVER w AS per_window_loss_pct FROM x WINDOW w AS (PARTITION BY cell_id ORDER BY cycle)""",
    "discharge_mAh_g capacity_loss_pct per_cycle_change_pct per_window_loss_pct", "records, cells")
def _(spark, sf):
    # The test tables hold 20 cycles per cell, so the window is 10 here; the default is 100.
    return C.fade_table(table(spark, sf), labels(spark, sf), window=10)


@query("d20_voltage_profiles", """SELECT cell_id, cycle, step, seq, capacity, voltage FROM records
WHERE voltage IS NOT NULL AND capacity IS NOT NULL""", "capacity voltage")
def _(spark, sf):
    return C.voltage_profile_points(records(spark, sf))


@query("d20_key_cycle_profiles", """SELECT cell_id, cycle, step, seq, capacity, voltage FROM records
WHERE voltage IS NOT NULL AND capacity IS NOT NULL AND cycle IN (1, 5, 10, 20)""", "capacity voltage")
def _(spark, sf):
    return C.voltage_profile_points(records(spark, sf), cells(spark, sf))


@query("d20_end_points", """SELECT cell_id, cycle, step, max(capacity) AS capacity, arg_max(voltage, {'q': capacity, 's': -seq}) AS voltage
FROM records WHERE voltage IS NOT NULL AND capacity IS NOT NULL AND cycle IN (1, 5, 10, 20) GROUP BY ALL""", "capacity voltage")
def _(spark, sf):
    return C.profile_end_points(records(spark, sf), cells(spark, sf))


CAPABILITY = f"""{TABLE}, {GROUPS},
per AS (SELECT t.cell_id, f.block, avg(discharge_mAh_g) AS mean_capacity, stddev_samp(discharge_mAh_g) AS sd_capacity, count(*) AS n_cycles,
  min(t.cycle) AS first_cycle, max(t.cycle) AS last_cycle FROM tbl t JOIN fold f ON f.cell_id = t.cell_id AND f.cycle = t.cycle
  WHERE {USABLE} AND discharge_mAh_g IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
seen AS (
  SELECT cell_id, block, [mean_current_a] AS rates FROM grp WHERE block = 0
  UNION ALL
  SELECT g.cell_id, g.block, CASE WHEN len(list_filter(s.rates, lambda r: abs(g.mean_current_a - r) / greatest(r, 1e-9) <= 5e-2)) > 0 THEN s.rates
    ELSE list_append(s.rates, g.mean_current_a) END FROM seen s JOIN grp g ON g.cell_id = s.cell_id AND g.block = s.block + 1),
nd AS (SELECT cell_id, CAST(max(len(rates)) AS INT) AS n_distinct FROM seen GROUP BY 1)
"""


@query("d22_distinct_rates", f"WITH {CAPABILITY} SELECT * FROM nd", base="records, cells")
def _(spark, sf):
    return R.distinct_rates(groups(spark, sf))


@query("d21_rate_capability", f"""WITH {CAPABILITY},
k AS (SELECT p.*, g.mean_current_a * 1000 AS mean_current_ma, g.c_rate, count(*) OVER (PARTITION BY p.cell_id) AS nk,
  first_value(mean_capacity) OVER w AS ref, first_value(g.c_rate) OVER w AS r0, lead(p.block) OVER w IS NULL AS is_last
  FROM per p JOIN nd ON nd.cell_id = p.cell_id AND n_distinct >= 2 JOIN grp g ON g.cell_id = p.cell_id AND g.block = p.block
  WINDOW w AS (PARTITION BY p.cell_id ORDER BY p.block))
SELECT cell_id, block, mean_current_ma, c_rate, mean_capacity, sd_capacity, n_cycles, first_cycle, last_cycle, mean_capacity / ref * 100 AS rate_capability_pct,
  CASE WHEN is_last AND abs(c_rate - r0) / greatest(r0, 1e-9) <= 1e-1 THEN mean_capacity / ref * 100 END AS recovery_pct FROM k WHERE nk >= 2""",
    "mean_current_ma c_rate mean_capacity sd_capacity rate_capability_pct recovery_pct", "records, cells")
def _(spark, sf):
    return R.rate_capability(table(spark, sf), grouped(spark, sf), cells_with_theory(spark, sf)).select(
        "*", (F.col("mean_current_a") * 1000).alias("mean_current_ma")
    ).drop("mean_current_a")


@query("e15_rate_recovery", f"""WITH {TABLE}, {GROUPS},
pr AS (SELECT cell_id FROM proto WHERE n_blocks >= 3 AND first_rate > 0 AND abs(last_rate - first_rate) / first_rate <= 1e-1),
bb AS (SELECT g.*, {format_rate_sql('c_rate')} AS label, row_number() OVER (PARTITION BY cell_id ORDER BY block) AS a,
  row_number() OVER (PARTITION BY cell_id ORDER BY block DESC) AS z FROM grp g WHERE n_cycles >= 2 AND cell_id IN (SELECT cell_id FROM pr)),
pt AS (SELECT t.cell_id, t.cycle, discharge_mAh_g AS d, label, last_cycle, CASE WHEN a = 1 THEN 'pre' WHEN z = 1 THEN 'post' ELSE 'ramp' END AS role
  FROM tbl t JOIN fold f ON f.cell_id = t.cell_id AND f.cycle = t.cycle JOIN bb ON bb.cell_id = f.cell_id AND bb.block = f.block WHERE discharge_mAh_g > 0),
fend AS (SELECT cell_id, max(last_cycle) FILTER (role = 'pre') AS f_end FROM pt GROUP BY 1),
fit AS (SELECT p.cell_id, label, cycle - avg(cycle) OVER w AS x, ln(d) - avg(ln(d)) OVER w AS y FROM pt p JOIN fend e ON e.cell_id = p.cell_id
  WHERE role = 'ramp' AND cycle > f_end WINDOW w AS (PARTITION BY p.cell_id, label)),
sums AS (SELECT cell_id, count(*) AS n_fit, count(DISTINCT label) AS nl, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(y*y) AS syy, sum(x*y)/sum(x*x) AS b FROM fit GROUP BY 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS r, row_number() OVER (PARTITION BY cell_id ORDER BY cycle DESC) AS re,
  count(*) OVER (PARTITION BY cell_id) AS np FROM pt WHERE role = 'pre'),
pre0 AS (SELECT cell_id, any_value(np) AS n_pre, avg(d) AS pm, avg(cycle) FILTER (np = 1 OR r > 1) AS bc, avg(d) FILTER (np = 1 OR r > 1) AS bd,
  max(cycle) FILTER (re = 2) AS c2, max(d) FILTER (re = 2) AS d2, max(cycle) FILTER (re = 1) AS c1, max(d) FILTER (re = 1) AS d1 FROM rk GROUP BY 1),
po AS (SELECT cell_id, count(*) AS n_post, avg(d) AS observed, avg(cycle) AS observed_cycle FROM pt WHERE role = 'post' GROUP BY 1)
SELECT s.cell_id, (exp(b) - 1) * 100 AS fade_pct_per_cycle,
  sqrt(greatest(syy - sxy * b, 0e0) / greatest(n_fit - nl - 1, 1)) / sqrt(sxx) * 100 AS fade_se_pct,
  sqrt(greatest(syy - sxy * b, 0e0) / greatest(n_fit - nl - 1, 1)) * 100 AS residual_sd_pct, n_fit, 100 * observed / pm AS q_recovery_pct, observed, observed_cycle,
  least(100 * observed / (bd * exp(b * (observed_cycle - bc))), 100 * observed / (d2 * exp(b * (observed_cycle - c2))), 100 * observed / (d1 * exp(b * (observed_cycle - c1)))) AS bound_low_pct,
  greatest(100 * observed / (bd * exp(b * (observed_cycle - bc))), 100 * observed / (d2 * exp(b * (observed_cycle - c2))), 100 * observed / (d1 * exp(b * (observed_cycle - c1)))) AS bound_high_pct,
  true AS anchor_in_formation
FROM sums s JOIN pre0 ON pre0.cell_id = s.cell_id JOIN po ON po.cell_id = s.cell_id WHERE nl >= 2 AND n_fit >= nl + 3 AND n_pre >= 2 AND n_post >= 2""",
    "fade_pct_per_cycle fade_se_pct residual_sd_pct q_recovery_pct observed observed_cycle bound_low_pct bound_high_pct", "records, cells")
def _(spark, sf):
    return R.rate_recovery(table(spark, sf), grouped(spark, sf), cells_with_theory(spark, sf))


@query("d41_areal_capacity", f"""WITH {TABLE}, {DIMS} SELECT t.cell_id, cycle, discharge_mAh_g * mass_g / area AS areal_mAh_cm2 FROM tbl t
JOIN dims d ON d.cell_id = t.cell_id WHERE {USABLE} AND discharge_mAh_g IS NOT NULL""", "areal_mAh_cm2", "records, cells")
def _(spark, sf):
    return C.areal_capacity(table(spark, sf), cells(spark, sf))


@query("d42_ragone_points", f"""WITH {POWER} SELECT cell_id, cycle, energy_wh_kg_electrode AS energy, power_mw_g_electrode AS power,
coalesce(list_contains(key_cycles, cycle), false) AS is_key_cycle FROM pe WHERE energy_wh_kg_electrode IS NOT NULL AND power_mw_g_electrode IS NOT NULL""",
       "energy power", "records, cells")
def _(spark, sf):
    return C.ragone_points(C.power_and_energy(records(spark, sf), cells(spark, sf)), cells(spark, sf), "electrode")


@query("i10_capacity_with_current", f"""WITH {TABLE}, {RATE} SELECT t.cell_id, t.cycle, discharge_mAh_g, i * 1000 AS avg_current_ma FROM tbl t
JOIN fold f ON f.cell_id = t.cell_id AND f.cycle = t.cycle WHERE {USABLE} AND discharge_mAh_g IS NOT NULL""", "discharge_mAh_g avg_current_ma")
def _(spark, sf):
    return R.capacity_with_current(table(spark, sf), R.discharge_current(records(spark, sf), 1000.0)).withColumnRenamed(
        "avg_current_a", "avg_current_ma")


@query("i11_energy_with_capacity", f"""WITH {DELIVERED}, {ENERGY} SELECT h.cell_id, h.cycle, energy AS discharge_energy, charge_mAh_g, discharge_mAh_g
FROM halves h LEFT JOIN delivered d ON d.cell_id = h.cell_id AND d.cycle = h.cycle WHERE step = 'Discharge'""",
       "discharge_energy charge_mAh_g discharge_mAh_g")
def _(spark, sf):
    r = records(spark, sf)
    energy = C.energy_by_half(r.filter("step = 'Discharge'")).select("cell_id", "cycle", F.col("energy").alias("discharge_energy"))
    return energy.join(C.delivered_capacity(r), ["cell_id", "cycle"], "left")


@query("j1_combined_cycle_table", """SELECT cycle, cell_id, charge_mAh_g, discharge_mAh_g FROM (
  WITH """ + DELIVERED.strip() + """ SELECT * FROM delivered)""", "charge_mAh_g discharge_mAh_g")
def _(spark, sf):
    # Long form; the wide form (one column group per cell) is C.wide_cycle_table.
    return C.delivered_capacity(records(spark, sf)).select("cycle", "cell_id", "charge_mAh_g", "discharge_mAh_g")


@query("j3_excluded_cycles", f"""WITH {TABLE}, {GROUPS}
SELECT t.cell_id, t.cycle, discharge_mAh_g FROM tbl t WHERE {USABLE} AND NOT EXISTS (SELECT 1 FROM fold f JOIN grp g ON g.cell_id = f.cell_id AND g.block = f.block
  WHERE f.cell_id = t.cell_id AND f.cycle = t.cycle AND g.n_cycles < 2)""", "discharge_mAh_g", "records, cells")
def _(spark, sf):
    single = groups(spark, sf).filter(~F.col("is_block")).select("cell_id", F.col("first_cycle").alias("cycle"))
    return (
        table(spark, sf).filter(~C.unusable()).join(single, ["cell_id", "cycle"], "left_anti")
        .select("cell_id", "cycle", "discharge_mAh_g")
    )


@query("d33_key_cycle_capacities", f"""WITH {TABLE}, k AS (SELECT cell_id, cycle, discharge_mAh_g, first_value(discharge_mAh_g) OVER (PARTITION BY cell_id ORDER BY cycle) AS f
  FROM tbl WHERE cycle IN (1, 5, 10, 20) AND discharge_mAh_g IS NOT NULL)
SELECT cell_id, cycle, discharge_mAh_g, CASE WHEN f > 0 THEN discharge_mAh_g / f * 100 END AS pct_of_first FROM k""", "discharge_mAh_g pct_of_first")
def _(spark, sf):
    return C.key_cycle_capacities(table(spark, sf), cells(spark, sf))
