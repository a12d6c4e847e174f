"""Curves carried as arrays: the same as rows, and no shuffle of bins."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cyclespark.operators import curves as V
from cyclespark.operators import peaks as P
from cyclespark.schema import HALF


def _steps(spark, n=400):
    rng = np.random.default_rng(5)
    v = np.linspace(3.0, 4.0, n) + rng.normal(0, 2e-3, n)
    rows = [("c", cycle, "Discharge", 1, float(v[i - 1]), float(v[i]), float(0.1 + 0.05 * np.sin(i / 20 + cycle)), float((v[i] + v[i - 1]) / 2)) for cycle in (1, 2) for i in range(1, n)]
    return spark.createDataFrame(rows, "cell_id string, cycle int, step string, n_slices int, v0 double, v1 double, dq double, v_mid double")


def _plan(spark, steps):
    settings = spark.createDataFrame([("c", 2.9, 4.1, 5.0, 3)], "cell_id string, window_low_v double, window_high_v double, bin_mv double, smooth_bins int")
    return V.bin_plan(steps, settings)


def test_arrays_hold_the_same_curves(spark):
    steps = _steps(spark)
    plan = _plan(spark, steps)
    arrays = V.histogram_arrays(steps, plan)
    assert arrays.count() == 2
    bins = V.charge_in_bins(steps, plan).withColumn("h", F.lit(3)).withColumn("raw", F.col("charge") / F.col("width"))
    want = V.smooth_binomial(bins, "h", "raw").toPandas().sort_values(["cycle", "bin"])
    got = V.curve_rows(arrays).toPandas().sort_values(["cycle", "bin"])
    assert np.allclose(got.dqdv, -want.dqdv, rtol=1e-12) and np.allclose(got.charge, want.charge, rtol=1e-12)
    assert (got.occupancy.to_numpy() == want.occupancy.to_numpy()).all() and (got.voltage.to_numpy() == want.voltage.to_numpy()).all()
    by_row = P.curve_arrays(V.curve_rows(arrays)).toPandas().sort_values("cycle")
    by_array = P.curve_arrays(arrays).toPandas().sort_values("cycle")
    for column in ("ys", "vs"):
        assert all(np.array_equal(a, b) for a, b in zip(by_row[column], by_array[column]))


def test_bins_pass_no_shuffle(spark):
    steps = _steps(spark).repartition(4, *HALF).localCheckpoint()
    plan = _plan(spark, steps).localCheckpoint()
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    # At most one of either side of the join of increments and plan.
    assert shuffles(V.histogram_curves(steps, plan)) <= 2


def test_curvature_of_a_parabola():
    x = np.arange(40.0)
    bend = P.curvature(pd.Series([3 - 0.5 * x * x, x[:5]]), pd.Series([11, 11]))
    assert np.allclose(bend[0], 1.0) and bend[1] is None
