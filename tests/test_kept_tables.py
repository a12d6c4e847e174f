"""Kept tables leave no shuffle files, and peaks are found without shuffles."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from cyclespark.functions.scalars import erf
from cyclespark.operators import curves as V
from cyclespark.operators import peaks as P
from cyclespark.operators.lineage import cut
from cyclespark.operators.sequences import classify_reversals
from cyclespark.operators.track import assign_components
from cyclespark.schema import HALF

LAYOUT = "cell_id string, cycle int, step string, lo double, width double, profile string, window_low_v double, window_high_v double, dqdv array<double>"


def _shuffle_bytes(spark) -> int:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in folders for f in Path(d.getPath()).rglob("shuffle_*.data"))


def _curves(spark):
    hill = lambda k: [float(4 + (x * 7 % 5) * 0.02 + 9 * max(0, 12 - abs(x - 20 - k)) + 5 * max(0, 9 - abs(x - 70 + k)) + (0.5 if x == 45 else 0)) for x in range(100)]
    rows = [(f"c{k}", 1, "Charge", 3.0, 0.005, ("sharp", "broad", None)[k % 3], 3.05, 3.45, hill(k)) for k in range(6)]
    return spark.createDataFrame(rows, LAYOUT)


def test_a_kept_table_leaves_no_shuffle_files(spark):
    spark.range(1000).repartition(2, "id").collect()
    before = _shuffle_bytes(spark)
    assert before > 0
    kept = cut(spark.range(300_000).repartition(4, "id").groupBy((F.col("id") % 100_000).alias("k")).count())
    assert kept.count() == 100_000
    deadline = time.time() + 20
    while _shuffle_bytes(spark) > before + 100_000 and time.time() < deadline:
        time.sleep(0.2)
    assert _shuffle_bytes(spark) <= before + 100_000  # the count itself shuffles a little
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_peaks_on_the_row_are_those_of_the_steps_and_need_no_shuffle(spark):
    curves = _curves(spark)
    profiles = curves.select("cell_id", "profile")
    whole = P.detect(curves, profiles=profiles, most=2)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    primary = cut(P.primary_peaks(curves.drop("profile"), profiles=profiles))
    steps = P.strongest(P.noise_floor(P.deduplicate(primary)), most=2)
    assert whole.columns == steps.columns
    a, b = ([r.asDict() for r in d.orderBy(*HALF, "peak_id").collect()] for d in (whole, steps))
    assert a == b and len(a) > 6


def test_a_moved_curve_is_computed_once(spark):
    layout = spark.createDataFrame([], "cell_id string, cycle int, step string, n_slices int, v0 array<double>, v1 array<double>, dq array<double>, lo double, width double, "
                                   "window_low_v double, window_high_v double, n_bins int, smooth_bins int, dq_per_record double")
    plan = P.curve_arrays(V.histogram_arrays(None, layout))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [spread_curves(") == 1


def test_reversals_meet_arrays_as_they_meet_bins(spark):
    curves = _curves(spark)
    runs = spark.createDataFrame(
        [(f"c{k}", 1, "Charge", j, 1, 0.1, 3.0 + 0.06 * j, 3.01 + 0.06 * j, 10.0, 1.0, j % 2 == 0) for k in range(6) for j in range(10)],
        "cell_id string, cycle int, step string, anchor_seq long, n_records long, charge double, v_start double, v_end double, span_mv double, seconds double, at_full_current boolean")
    rows = curves.select(*HALF, "lo", "width", F.posexplode("dqdv").alias("bin", "dqdv"))
    rows = rows.select(*HALF, "bin", (F.col("lo") + F.col("width") * (F.col("bin") + 0.5)).alias("voltage"), "dqdv")
    window = curves.select("cell_id", "window_low_v", "window_high_v")
    a, b = (sorted(map(str, d.collect())) for d in (classify_reversals(runs, curves), classify_reversals(runs, rows, window)))
    assert a == b and len(a) == 60


def test_tracks_are_dealt_to_many_tasks(spark):
    own = spark.createDataFrame([(f"c{k}", y, "Charge", 1, 3.5) for k in range(40) for y in (1, 2)], "cell_id string, cycle int, step string, component int, centre double")
    refs = spark.createDataFrame([(f"c{k}", "Charge", 1, 3.5, False) for k in range(40)], "cell_id string, step string, ref_id int, ref_v double, is_shoulder boolean")
    cycles = spark.createDataFrame([(f"c{k}", 1) for k in range(40)], "cell_id string, reference_cycle int")
    found = assign_components(own, refs, cycles)
    assert found.count() == 80
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() == 4  # spark.sql.shuffle.partitions of the tests


def test_the_error_function_computes_its_argument_once(spark):
    # Once for the sign and once for the series, whose terms refer to a variable.
    assert spark.range(1).select(erf(F.atan(F.col("id")))).columns[0].lower().count("atan(") == 2


def test_counting_on_the_row_is_that_of_the_increments(spark):
    row = ("c", 1, "Charge", 1, [3.0, 3.01, 3.05, 3.2, 3.19, 2.0], [3.01, 3.05, 3.2, 3.19, 3.3, 2.1], [0.5, 1.0, 2.0, 0.25, 4.0, 9.0], 3.0, 3.3, 3.0, 3.3, 0.1, 3)
    plan = spark.createDataFrame([row], "cell_id string, cycle int, step string, n_slices int, v0 array<double>, v1 array<double>, dq array<double>, "
                                        "window_low_v double, window_high_v double, lo double, hi double, width double, n_bins int")
    whole = V.counted_charge(None, plan)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    parts = V.counted_charge(V.increment_rows(plan), plan.drop(*V.INCREMENT))
    assert whole.columns == parts.columns and whole.schema["bin"].dataType == parts.schema["bin"].dataType
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
