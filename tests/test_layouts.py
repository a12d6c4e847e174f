"""Layouts that hold their increments: the same plans and curves as from rows, without a shuffle of increments."""

import numpy as np
from pyspark.sql import functions as F

from cyclespark.operators import curves as V
from cyclespark.operators import ordered as O
from cyclespark.schema import HALF


def _steps(spark):
    rng = np.random.default_rng(11)
    rows = []
    for cycle in (1, 2, 3):
        v = np.round(np.linspace(3.0, 4.0, 300) + rng.normal(0, 4e-3, 300), 4)
        v[50:60] = v[50]  # increments without span
        rows += [("c", cycle, "Discharge", 1, float(v[i - 1]), float(v[i]), float(0.1 * (i % 7)), float((v[i] + v[i - 1]) * 0.5)) for i in range(1, 300)]
    rows += [("few", 1, "Charge", 1, 3.1, 3.2, 0.1, 3.15)] * 3 + [("far", 1, "Charge", 1, 1.1, 1.2, 0.1, 1.15)] * 9 + [("idle", 1, "Charge", 1, 3.1, 3.2, 0.0, 3.15)] * 9
    return spark.createDataFrame(rows, "cell_id string, cycle int, step string, n_slices int, v0 double, v1 double, dq double, v_mid double").repartition(4, *HALF).localCheckpoint()


def _settings(spark):
    rows = [(c, 2.9, 3.9, 5.0, 3) for c in ("c", "few", "far", "idle")]
    return spark.createDataFrame(rows, "cell_id string, window_low_v double, window_high_v double, bin_mv double, smooth_bins int")


def test_layouts_are_the_bin_plan(spark):
    steps, settings = _steps(spark), _settings(spark)
    want, got = (x.toPandas().sort_values("cycle").reset_index() for x in (V.bin_plan(steps, settings), V.laid_out(steps, settings)))
    assert len(want) == len(got) == 3
    for column in [c for c in want.columns if c not in ("index", *V.INCREMENT)]:
        assert want[column].tolist() == got[column].tolist() or np.allclose(want[column], got[column], rtol=1e-12), column


def test_curves_of_layouts(spark):
    steps = _steps(spark)
    layouts = V.laid_out(steps, _settings(spark)).localCheckpoint()
    for phase in (0.0, 0.4):
        plan = V.shift_plan(layouts, phase)
        rows, arrays = V.histogram_arrays(steps, plan.drop(*V.INCREMENT)), V.histogram_arrays(None, plan)
        want, got = (x.toPandas().sort_values("cycle") for x in (rows, arrays))
        assert len(want) == 3
        for column in ("charge", "occupancy", "dqdv"):
            assert all(np.allclose(a, b, rtol=1e-12, atol=1e-13) for a, b in zip(want[column], got[column]))
        assert all(np.array_equal(np.array(a) == 0, np.array(b) == 0) for a, b in zip(want.charge, got.charge))
    assert "Exchange" not in arrays._jdf.queryExecution().executedPlan().toString()
    back = V.increment_rows(layouts).select(steps.columns)
    kept = steps.filter("cell_id = 'c'")
    assert back.count() == kept.count() and back.exceptAll(kept).isEmpty()


def test_longest_half_cycle(spark):
    records = spark.range(30).select(F.lit("c").alias("cell_id"), (F.col("id") % 3).cast("int").alias("cycle"), F.lit("Charge").alias("step"), F.col("id").alias("seq"))
    records = records.filter("cycle < 2 OR seq < 9")
    assert O.longest(records) == 10
    assert O.longest(records.filter("seq < 0")) == 0
