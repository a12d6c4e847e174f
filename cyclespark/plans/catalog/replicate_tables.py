"""Queries over replicate cells, names and residuals."""

from pyspark.sql import functions as F

from cyclespark.operators import replicates as R
from cyclespark.plans.catalog.curve_tables import CURVES, K, curves
from cyclespark.plans.catalog.cycle_tables import TABLE, table
from cyclespark.plans.fixture import cells, shared
from cyclespark.plans.registry import query

KIND = "CAST(substr(cell_id, 6) AS BIGINT) % 4"


def by_kind(spark, sf):
    """The cycle table with the kind of cell: cells of a kind count as replicates of each other."""
    return table(spark, sf).withColumn("kind", F.expr("CAST(substr(cell_id, 6) AS BIGINT) % 4"))


@query("d23_replicate_mean", f"WITH {TABLE} SELECT {KIND} AS kind, cycle, avg(discharge_mAh_g) AS mean, stddev_samp(discharge_mAh_g) AS sd, count(discharge_mAh_g) AS n FROM tbl GROUP BY ALL", "mean sd")
def _(spark, sf):
    return R.mean_and_spread(by_kind(spark, sf), ["kind", "cycle"], "discharge_mAh_g")


@query("d24_relative_spread", f"""WITH {TABLE} SELECT {KIND} AS kind, cycle, count(ce_pct) AS n,
  CASE WHEN count(ce_pct) >= 2 AND median(ce_pct) <> 0 THEN (max(ce_pct) - min(ce_pct)) / abs(median(ce_pct)) END AS spread FROM tbl GROUP BY ALL""", "spread")
def _(spark, sf):
    return R.relative_spread(by_kind(spark, sf), ["kind", "cycle"], "ce_pct")


@query("d31_unusable_cells", f"""WITH {TABLE}, f AS (SELECT cell_id, count(*) FILTER (NOT incomplete AND cycle <= 1 + 3 * ({KIND})) AS n, median(ce_pct - 48 * (({KIND}) // 2)) AS ce FROM tbl GROUP BY ALL)
SELECT cell_id, coalesce(n <= 2, false) AS few_cycles, coalesce(ce < 50, false) AS low_efficiency, coalesce(n <= 2, false) OR coalesce(ce < 50, false) AS unusable FROM f""")
def _(spark, sf):
    rows = by_kind(spark, sf)
    facts = rows.groupBy("cell_id").agg(
        F.count(F.when(~F.col("incomplete") & (F.col("cycle") <= 1 + 3 * F.col("kind")), 1)).alias("n_cycles"),
        F.percentile(F.col("ce_pct") - 48 * F.floor(F.col("kind") / 2), 0.5).alias("median_ce"),
    )
    return R.unusable_cells(facts)


@query("d32_death_cycle", f"""WITH {TABLE}, fl AS (SELECT cell_id, quantile_cont(discharge_mAh_g, 9e-1) FILTER (NOT incomplete AND NOT partial_final) * 2e-2 AS fl FROM tbl GROUP BY ALL),
la AS (SELECT t.cell_id, any_value(fl) AS fl, max(cycle) FILTER (NOT incomplete AND NOT partial_final AND discharge_mAh_g > fl) AS last_live FROM tbl t JOIN fl ON fl.cell_id = t.cell_id GROUP BY ALL),
de AS (SELECT l.cell_id, last_live, count(*) FILTER (t.cycle > last_live AND (discharge_mAh_g IS NULL OR discharge_mAh_g <= fl)) AS n_dead FROM la l JOIN tbl t ON t.cell_id = l.cell_id GROUP BY ALL)
SELECT *, CASE WHEN n_dead >= 3 THEN last_live END AS death_cycle FROM de""")
def _(spark, sf):
    return R.death_cycles(table(spark, sf))


POINTS = """pt AS (SELECT CAST(substr(cell_id, 6) AS BIGINT) % 3 AS kind, cell_id, 3e0 + cycle * (CAST(substr(cell_id, 6) AS BIGINT) % 5 + 1) * 1e-2 AS voltage, ce_pct - 95 AS drift FROM tbl WHERE ce_pct IS NOT NULL)"""


@query("e22_feature_groups", f"""WITH {TABLE}, {POINTS}, st AS (SELECT *, CASE WHEN coalesce((voltage - lag(voltage) OVER w) * 1e3 > 8e1, true) THEN 1 ELSE 0 END AS nw FROM pt WINDOW w AS (PARTITION BY kind ORDER BY voltage)),
fe AS (SELECT *, sum(nw) OVER (PARTITION BY kind ORDER BY voltage) AS feature FROM st),
pc AS (SELECT kind, feature, cell_id, median(drift) AS d, sum(voltage) AS v, count(*) AS k FROM fe GROUP BY ALL)
SELECT kind, CAST(feature AS BIGINT) AS feature, sum(v) / sum(k) AS voltage, avg(d) AS mean, stddev_samp(d) AS sd, count(d) AS n, CAST(sum(k) AS BIGINT) AS n_peaks FROM pc GROUP BY ALL""", "voltage mean sd")
def _(spark, sf):
    number = "CAST(substr(cell_id, 6) AS BIGINT)"
    points = table(spark, sf).filter("ce_pct IS NOT NULL").selectExpr(
        f"{number} % 3 AS kind", "cell_id", f"3D + cycle * ({number} % 5 + 1) * 0.01D AS voltage", "ce_pct - 95 AS drift")
    return R.feature_groups(points, ["kind"])


@query("e19_net_change", f"""WITH {TABLE}, s AS (SELECT cell_id, CAST(cycle AS DOUBLE) AS cycle, discharge_mAh_g AS v FROM tbl WHERE discharge_mAh_g IS NOT NULL AND NOT (cycle BETWEEN 12 AND 11 + CAST(substr(cell_id, 6) AS BIGINT) % 5) AND cycle > CAST(substr(cell_id, 6) AS BIGINT) % 9),
g AS (SELECT *, sum(gap) OVER (PARTITION BY cell_id ORDER BY cycle) AS gaps FROM (SELECT *, CASE WHEN cycle - lag(cycle) OVER (PARTITION BY cell_id ORDER BY cycle) - 1 >= 3 THEN 1 ELSE 0 END AS gap FROM s)),
r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS k, count(*) OVER (PARTITION BY cell_id) AS n FROM g WHERE gaps = 0),
a AS (SELECT cell_id, max(n) AS n_used, median(v) FILTER (k <= greatest(1, least(3, n // 2))) AS v0, median(v) FILTER (k > n - greatest(1, least(3, n // 2))) AS v1, min(cycle) AS c_start, max(cycle) AS c_end FROM r GROUP BY ALL)
SELECT cell_id, CASE WHEN n_used >= 5 THEN v1 - v0 END AS net_change, CASE WHEN n_used >= 5 THEN v0 END AS v_start, CASE WHEN n_used >= 5 THEN v1 END AS v_end, c_start, c_end, n_used FROM a""", "net_change v_start v_end c_start c_end")
def _(spark, sf):
    number = "CAST(substr(cell_id, 6) AS BIGINT)"
    series = table(spark, sf).filter(f"NOT (cycle BETWEEN 12 AND 11 + {number} % 5) AND cycle > {number} % 9").selectExpr("cell_id", "cycle", "discharge_mAh_g AS value")
    return R.coherent_net_change(series, ["cell_id"])


@query("j2_common_cycles", f"WITH {TABLE} SELECT cell_id, cycle FROM tbl WHERE charge_mAh_g > 0 AND discharge_mAh_g > 0 AND cycle % 7 <> 0 AND cycle >= 2 GROUP BY ALL")
def _(spark, sf):
    t = table(spark, sf)
    return R.common_cycles(t.filter("charge_mAh_g > 0 AND cycle % 7 <> 0"), t.filter("discharge_mAh_g > 0"), ["cell_id"])


# A stand-in fit of each curve: a flat baseline and a total that is a little short.
FIT = f"""ft AS (SELECT {K}, bin, voltage, dqdv, (CASE WHEN bin % 7 < 4 THEN 95e-2 ELSE 103e-2 END) * dqdv AS total, 1e0 AS baseline FROM curve)"""
RUNS = f"""sg AS (SELECT {K}, voltage, sign(dqdv - total) AS s FROM ft WHERE sign(dqdv - total) <> 0),
tu AS (SELECT *, CASE WHEN s <> lag(s) OVER (PARTITION BY {K} ORDER BY voltage) THEN 1 ELSE 0 END AS t FROM sg),
ru AS (SELECT {K}, CAST(count(*) FILTER (s > 0) AS DOUBLE) AS a, CAST(count(*) FILTER (s < 0) AS DOUBLE) AS b, 1 + sum(t) AS runs FROM tu GROUP BY ALL),
rz AS (SELECT {K}, CASE WHEN a + b >= 10 AND a > 0 AND b > 0 AND 2 * a * b > a + b THEN (runs - (2 * a * b / (a + b) + 1)) / sqrt(2 * a * b * (2 * a * b - a - b) / ((a + b) * (a + b) * (a + b - 1))) END AS residual_runs_z FROM ru)"""


@shared
def fits(spark, sf):
    total = F.when(F.col("bin") % 7 < 4, 0.95).otherwise(1.03) * F.col("dqdv")
    return curves(spark, sf).select("cell_id", "cycle", "step", "bin", "voltage", "dqdv", total.alias("total"), F.lit(1.0).alias("baseline"))


@query("d37_runs_test", f"WITH {CURVES}, {FIT}, {RUNS} SELECT {K}, residual_runs_z FROM rz", "residual_runs_z")
def _(spark, sf):
    return R.runs_test(fits(spark, sf).withColumn("off", F.col("dqdv") - F.col("total")), ["cell_id", "cycle", "step"], ["voltage"], "off")


@query("d38_fit_quality", f"""WITH {CURVES}, {FIT}, {RUNS}, ag AS (SELECT {K}, count(*) AS n, max(dqdv) - min(dqdv) AS amp, max(abs(total - baseline)) AS f, max(abs(dqdv - baseline)) AS h,
  greatest(max(total) - max(dqdv), min(dqdv) - min(total), 0e0) AS o, max(abs(dqdv - total)) AS r FROM ft GROUP BY ALL)
SELECT a.cell_id, a.cycle, a.step, CASE WHEN n >= 3 AND h > 0 THEN f / h END AS height_ratio, CASE WHEN n >= 3 AND amp > 0 THEN o / amp END AS overshoot, CASE WHEN n >= 3 AND amp > 0 THEN r / amp END AS max_residual_frac,
  CASE WHEN n >= 3 THEN residual_runs_z END AS residual_runs_z FROM ag a LEFT JOIN rz ON rz.cell_id = a.cell_id AND rz.cycle = a.cycle AND rz.step = a.step""", "height_ratio overshoot max_residual_frac residual_runs_z")
def _(spark, sf):
    return R.fit_quality(fits(spark, sf), ["cell_id", "cycle", "step"])


# File names in runs of three cells: letters, a stated cell, numbers, and nothing to tell them apart.
NAMES = """CASE CAST(floor(cell_no / 3e0) AS BIGINT) % 4
  WHEN 0 THEN 'JQ_NNM_C-rate_2-4.2V_' || chr(CAST(65 + cell_no % 3 AS INT)) || '_29042026'
  WHEN 1 THEN 'Nik_LTO-DD2_Cell' || chr(CAST(97 + cell_no % 3 AS INT))
  WHEN 2 THEN 'Sample_2_' || CAST(cell_no AS VARCHAR(20)) || '_rerun7' ELSE 'plain run ' || chr(CAST(65 + cell_no % 3 AS INT)) END"""


@shared
def names(spark, sf):
    return cells(spark, sf).selectExpr("CAST(floor(cell_no / 3e0) AS BIGINT) AS run", f"{NAMES} AS name", "CAST('NMC' AS STRING) AS composition",
                                       "CASE WHEN cell_no % 11 = 4 THEN ' Q ' END AS stated_id")


NM = f"nm AS (SELECT CAST(floor(cell_no / 3e0) AS BIGINT) AS run, {NAMES} AS name, 'NMC' AS composition, CASE WHEN cell_no % 11 = 4 THEN ' Q ' END AS stated_id, cell_no FROM cells)"


@query("c9_cell_guess", f"""WITH {NM}, k AS (SELECT run, count(*) AS k FROM nm GROUP BY ALL)
SELECT nm.run, name, CASE run % 4 WHEN 0 THEN chr(CAST(65 + cell_no % 3 AS INT)) WHEN 1 THEN chr(CAST(65 + cell_no % 3 AS INT)) WHEN 2 THEN CASE WHEN k > 1 THEN CAST(cell_no AS VARCHAR) ELSE '' END ELSE '' END AS cell_guess
FROM nm JOIN k USING (run)""".replace("run % 4", "nm.run % 4").replace("nm.nm.", "nm."), "", "cells")
def _(spark, sf):
    return R.suggest_cell_ids(names(spark, sf).select("run", "name"), ["run"])


@query("c17_display_names", f"""WITH {NM}, k AS (SELECT *, count(*) OVER (PARTITION BY run) AS k, row_number() OVER (PARTITION BY run ORDER BY name) AS i FROM nm)
SELECT run, name, CASE WHEN k = 1 THEN 'NMC' ELSE 'NMC (Cell ' || CASE WHEN stated_id IS NOT NULL THEN 'Q' WHEN run % 4 = 0 THEN chr(CAST(65 + cell_no % 3 AS INT)) WHEN run % 4 = 1 THEN '2' WHEN run % 4 = 2 THEN CAST(cell_no AS VARCHAR) ELSE CAST(i AS VARCHAR) END || ')' END AS display_name FROM k""", "", "cells")
def _(spark, sf):
    return R.display_names(names(spark, sf), ["run"])
