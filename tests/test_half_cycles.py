import pytest

from cyclespark.operators.clean import mark_hold, step_direction
from cyclespark.operators.cycles import half_capacity
from cyclespark.operators.ordered import with_previous, with_running, with_slices

SCHEMA = "cell_id string, cycle int, step string, seq long, voltage double, capacity double, current_a double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    ("volts", "step", "swapped", "expected"),
    [((3.0, 3.2), "Charge", False, 1), ((3.2, 3.0), "Charge", False, -1), ((3.0, 3.0), "Charge", False, 1),
     ((3.0, 3.0), "Charge", True, -1), ((3.0, 3.0), "Discharge", False, -1)],
)
def test_direction(spark, volts, step, swapped, expected):
    df = frame(spark, [("a", 1, step, i, v, 0.0, 1.0) for i, v in enumerate(volts)])
    assert step_direction(df, swapped).first()["direction"] == expected


def test_capacity(spark):
    df = frame(spark, [("a", 1, "Charge", 0, 3.0, 0.2, 1.0), ("a", 1, "Charge", 1, 3.1, 1.7, 1.0)])
    assert half_capacity(df).first()["capacity_mAh_g"] == pytest.approx(1.5)


def test_cut_half_cycle_gives_the_same_answers(spark):
    df = frame(spark, [("a", 1, "Charge", i, 3.0 + (i * 7 % 11) / 100, float(i), 1.0 if i < 90 else 0.5) for i in range(100)])

    def run(rows):
        out = with_running(with_previous(rows, {"voltage": "v0"}), "max", "voltage", "top")
        return sorted((r.seq, r.v0, r.top) for r in out.collect())

    cut = with_slices(df, limit=16)
    assert "slice" in cut.columns
    assert run(with_slices(df)) == run(cut)
    holds = lambda rows: sorted(r.seq for r in mark_hold(rows).filter("in_hold").collect())
    assert holds(with_slices(df)) == holds(cut) == list(range(90, 100))
