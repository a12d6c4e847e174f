"""Curve operators against plain Python, with overrides and a half-cycle of many records."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclespark.functions.scalars import mv_to_samples
from cyclespark.operators.curves import interpolate, plateau_structure, reconstruct_voltage, savgol, smooth_binomial, smoothing_windows
from cyclespark.operators.sequences import reversals

HALF = ["cell_id", "cycle", "step"]
KEYS = "cell_id string, cycle int, step string, "


def curve(spark, values, half_width):
    rows = [("a", 1, "Charge", i, 3.0 + i / 100, float(v), half_width) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, KEYS + "bin int, voltage double, raw double, half_width int")


@pytest.mark.parametrize("h", [0, 1, 3, 20, 24])
def test_binomial_smoothing_of_any_width(spark, h):
    rng = random.Random(h)
    ys = [rng.random() for _ in range(70)]
    weights = [math.comb(2 * h, k) / 4**h for k in range(2 * h + 1)]
    want = [sum(ys[j] * weights[j - i + h] for j in range(max(0, i - h), min(70, i + h + 1))) for i in range(70)]
    got = [r["dqdv"] for r in smooth_binomial(curve(spark, ys, h)).orderBy("bin").collect()]
    assert got == pytest.approx(want)


def savgol_by_fit(ys, window):
    out, n, half = [], len(ys), window // 2
    for i in range(n):
        start = max(0, min(i - half, n - window))
        x = np.arange(window)
        out.append(float(np.polyval(np.polyfit(x, ys[start : start + window], 3), i - start)))
    return out


@pytest.mark.parametrize(("stated", "used"), [(7, 7), (6, 7), (5, 5), (1, None), (0, None)])
def test_savgol_of_stated_windows(spark, stated, used):
    rng = random.Random(3)
    ys = [rng.random() for _ in range(30)]
    rows = [("a", 1, "Charge", 3.0 + i / 100, y, stated) for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, KEYS + "voltage double, dqdv double, w int")
    windows = smoothing_windows(spark.createDataFrame([("a", stated)], "cell_id string, smoothing_window int"), "smoothing_window", (5, 9))
    got = [r["dqdv"] for r in savgol(df, windows, F.col("w")).orderBy("voltage").collect()]
    assert got == pytest.approx(savgol_by_fit(ys, used) if used else ys)


def test_unlisted_window_is_an_error(spark):
    df = spark.createDataFrame([("a", 1, "Charge", 3.0 + i / 100, 1.0, 7) for i in range(20)], KEYS + "voltage double, dqdv double, w int")
    with pytest.raises(Exception, match="not listed"):
        savgol(df, (5, 9), F.col("w")).collect()


def test_interpolation_is_linear_in_the_records(spark):
    n = 400_000
    knots = spark.range(n).select(F.lit("a").alias("cell_id"), F.lit(1).alias("cycle"), F.lit("Charge").alias("step"), F.col("id").cast("double").alias("q"), (F.col("id") * 2.0).alias("voltage"))
    wanted = spark.createDataFrame([("a", 1, "Charge", -5.0, 0), ("a", 1, "Charge", 1000.25, 1), ("a", 1, "Charge", 7.0, 2), ("a", 1, "Charge", 1e9, 3)], KEYS + "q double, i int")
    began = time.time()
    got = {r["i"]: r["voltage"] for r in interpolate(knots, wanted, "q", "voltage", HALF, ["i"]).collect()}
    assert got == {0: 0.0, 1: 2000.5, 2: 14.0, 3: (n - 1) * 2.0} and time.time() - began < 30


def test_plateau_and_reconstruction_with_gaps_and_ties(spark):
    volts = [3.0 + i * 0.01 for i in range(10)] + [3.4] * 30 + [3.8 + i * 0.01 for i in range(10)]
    records = spark.createDataFrame([("a", 1, "Charge", i, v, i * 2.0) for i, v in enumerate(volts)], KEYS + "seq long, voltage double, capacity double")
    assert plateau_structure(records).first()["flattest_v"] == pytest.approx(3.4)
    flat = spark.createDataFrame([("a", 1, "Charge", 3.0 + i * 0.05, 90 / 0.85) for i in range(18)], KEYS + "voltage double, dqdv double")
    check = reconstruct_voltage(flat, records).first()
    assert check["ape_pct"] == pytest.approx(0, abs=1e-6) and check["n_compared"] >= 17


def test_reversals_keep_runs_and_their_anchor(spark):
    volts = [3.0, 3.1, 3.05, 3.0, 3.2, 3.3, 3.25, 3.4]
    rows = [("a", 1, "Charge", i, v, float(i), 1.0) for i, v in enumerate(volts)]
    df = spark.createDataFrame(rows, KEYS + "seq long, voltage double, capacity double, current_a double")
    got = [(r["anchor_seq"], r["n_records"], r["charge"], r["v_start"], r["v_end"]) for r in reversals(df).orderBy("anchor_seq").collect()]
    assert got == [(1, 2, 2.0, 3.1, 3.0), (5, 1, 1.0, 3.3, 3.25)]


def test_samples_round_half_to_even(spark):
    got = spark.createDataFrame([(30.0, 0.012), (25.0, 0.010), (35.0, 0.010), (1.0, 0.1)], "mv double, v double").select(mv_to_samples(F.col("mv"), F.col("v")).alias("n"))
    assert [r["n"] for r in got.collect()] == [2, 2, 4, 1]
