"""Replicate, name and residual rules on literal rows."""

import pytest
from pyspark.sql import functions as F

from cyclespark.functions.scalars import erf
from cyclespark.operators import peaks as P
from cyclespark.operators import replicates as R

KEYS = "cell_id string, cycle int, step string, "


def test_cell_guess_and_display_name(spark):
    names = ["JQ_NNM_C-rate_2-4.2V_A_29042026", "Nik_LTO-DD2_CellB", "Sample_2_1", "Sample_2_2"]
    df = spark.createDataFrame([(0 if "Sample" not in n else 1, n) for n in names], "run int, name string")
    got = {r["name"]: r["cell_guess"] for r in R.suggest_cell_ids(df, ["run"]).collect()}
    assert got == dict(zip(names, ["A", "B", "1", "2"]))
    shown = R.display_names(df.selectExpr("run", "name", "'X' AS composition", "CAST(NULL AS STRING) AS stated_id"), ["run"])
    assert {r["display_name"] for r in shown.filter("run = 1").collect()} == {"X (Cell 1)", "X (Cell 2)"}


def test_runs_and_fit_quality(spark):
    rows = [("a", i, float(i), 1.0 if i < 10 else -1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "cell_id string, i int, voltage double, off double")
    z = R.runs_test(df, ["cell_id"], ["voltage"], "off").first()["residual_runs_z"]
    assert z == pytest.approx((2 - 11) / (2 * 100 * (200 - 20) / (400 * 19)) ** 0.5)
    few = R.runs_test(df.filter("i > 11"), ["cell_id"], ["voltage"], "off").first()
    assert few["residual_runs_z"] is None


def test_net_change_stops_at_a_gap(spark):
    cycles = [1, 2, 3, 4, 5, 6, 10, 11]
    df = spark.createDataFrame([("a", c, float(c)) for c in cycles], "cell_id string, cycle int, value double")
    r = R.coherent_net_change(df, ["cell_id"]).first()
    assert (r["net_change"], r["n_used"], r["c_end"]) == (3.0, 6, 6.0)


def test_features_count_cells_once(spark):
    points = [("k", "a", 3.00, 1.0), ("k", "a", 3.05, 3.0), ("k", "b", 3.07, 4.0), ("k", "b", 3.30, 9.0)]
    df = spark.createDataFrame(points, "k string, cell_id string, voltage double, drift double")
    got = [(r["mean"], r["n"], r["n_peaks"]) for r in R.feature_groups(df, ["k"]).orderBy("feature").collect()]
    assert got == [(3.0, 2, 3), (9.0, 1, 1)]


def test_spacing_sweep_keeps_what_the_nested_loops_keep(spark):
    rows = [("a", 1, "Charge", 1, 3.000, 10.0, False), ("a", 1, "Charge", 2, 3.025, 1.0, True), ("a", 1, "Charge", 3, 3.028, 2.0, False)]
    df = spark.createDataFrame(rows, KEYS + "peak_bin int, voltage double, prominence double, is_shoulder boolean")
    assert [r["peak_bin"] for r in P.deduplicate(df).orderBy("peak_bin").collect()] == [1, 2]


def test_peak_clipped_on_both_sides_is_kept_and_flagged(spark):
    ys = [8.0, 9.0, 10.0, 11.0, 12.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.5]
    rows = [("a", 1, "Charge", i, 3.0 + i * 0.01, y) for i, y in enumerate(ys)]
    found = P.primary_peaks(spark.createDataFrame(rows, KEYS + "bin int, voltage double, dqdv double")).collect()
    assert [r["peak_bin"] for r in found] == [5]


def test_error_function(spark):
    import math

    xs = [-7.0, -3.0, -0.5, 0.0, 0.1, 1.0, 2.5, 5.9, 8.0]
    got = [r["y"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(erf(F.col("x")).alias("y")).collect()]
    assert got == pytest.approx([math.erf(x) for x in xs], abs=1e-12)
