"""Peaks found on curves as arrays: no shuffle of curves, and the rules against plain Python."""

import numpy as np
import pandas as pd
import pytest

from cyclespark.operators import curves as V
from cyclespark.operators import peaks as P

CURVES = "cell_id string, cycle int, step string, lo double, width double, dqdv array<double>"


def test_peaks_are_found_where_the_curve_is(spark):
    x = np.arange(120.0)
    y = 50 * np.exp(-(((x - 40) / 8) ** 2)) + 20 * np.exp(-(((x - 75) / 5) ** 2))
    curves = spark.createDataFrame([("a", c, "Charge", 3.0, 0.005, (y * c).tolist()) for c in (1, 2)], CURVES)
    found = P.primary_peaks(curves)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["cycle"], r["peak_bin"]) for r in found.collect()) == [(1, 40), (1, 75), (2, 40), (2, 75)]


def test_tops_and_their_distance():
    y = np.array([0, 2, 2, 2, 1, 3, 0, 3, 3, 5.0, 4, 4])
    assert P.tops(y).tolist() == [2, 5, 9]
    assert P.spread_out(y, P.tops(y), 4).tolist() == [5, 9]
    assert P.spread_out(np.array([0, 1, 0, 1, 0.0]), np.array([1, 3]), 3).tolist() == [3]


def test_curves_are_worked_out_together(monkeypatch):
    """Rough curves, flat tops and ties among them: the shapes of all, in pieces too, are those of each, and no curve is visited alone."""
    rng = np.random.default_rng(4)
    ys = [np.round(rng.normal(size=rng.integers(10, 90)), int(rng.integers(0, 3))) for _ in range(700)]
    ats = [P.spread_out(y, P.tops(y), 4) for y in ys]
    expected = [(at, *P.shape_of(y, at), P.noise_of(y, at)) for y, at in zip(ys, ats)]
    odd = [*ys[:3], np.array([0.0, 1.0, np.nan, 3.0, 1.0, 2.0, 0.0])]
    assert [[x.tolist() for x in s[:2]] for s in P.all_shapes(odd, [P.tops(y) for y in odd])][3] == [[5], [2.0]]
    for name in ("tops", "shape_of", "noise_of"):
        monkeypatch.setattr(P, name, lambda *_: pytest.fail("one curve alone"))
    for beside in (P.BESIDE, 200):
        monkeypatch.setattr(P, "BESIDE", beside)
        got = P.tops_of(pd.Series(ys), pd.Series([4] * len(ys)))
        for row, want in zip(got.itertuples(index=False), expected):
            assert all(np.array_equal(x, y, equal_nan=True) for x, y in zip(row, want))


def test_charge_is_spread_together(monkeypatch):
    """Curves of several kernels, one without increments inside: as each alone, also where they cover too many bins for one pass."""
    rng, rows = np.random.default_rng(5), []
    for k in range(300):
        v = np.cumsum(rng.random(int(rng.integers(2, 40))) - 0.2) / 10 + 3
        n = int(rng.integers(5, 60))
        inside = (0.0, 9.0) if k else (8.0, 9.0)
        rows.append((v[:-1], v[1:], rng.random(len(v) - 1), *inside, v.min(), n, (np.ptp(v) + 1e-3) / n, [0, 1, 3, (n - 1) // 2][k % 4], 1 - 2 * (k % 2)))
    calls, plain = [], V._spread_together
    monkeypatch.setattr(V, "_spread_together", lambda *c: (calls.append(len(c[0])), plain(*c))[1])
    columns = lambda some: [pd.Series(list(c)) for c in zip(*some)]
    whole = V.spread_curves(*columns(rows))
    assert calls == [256, 44]
    monkeypatch.setattr(V, "COVERED", 300)
    for got in (V.spread_curves(*columns(rows)), pd.concat([V.spread_curves(*columns([r])) for r in rows])):
        for c in ("charge", "occupancy", "dqdv"):
            assert all(np.allclose(x, y, rtol=0, atol=1e-12) for x, y in zip(whole[c], got[c])), c
    for (*_, n, width, half, sign), charge, dqdv in zip(rows, whole.charge, whole.dqdv):
        assert np.array_equal(dqdv, V.smoothed(charge, width, half, sign)) and len(charge) == n


def test_recurrent_modes(spark):
    """A maximum that recurs near 3.2 V, one in few cycles, and a cell of none; groups pass as Arrow tables."""
    x = np.arange(120.0)
    bump = lambda at, high: high * np.exp(-(((x - at) / 5) ** 2))
    rows = [("a", c, "Charge", 3.0, 0.005, (bump(40 + c % 2, 5.0) + (bump(80, 3.0) if c < 3 else 0 * x)).tolist()) for c in range(1, 9)]
    curves = spark.createDataFrame(rows + [("b", 1, "Charge", 3.0, 0.005, x.tolist())], CURVES)
    found = P.recurrent_maxima(curves)
    assert "InArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["cell_id"], r["feature"], round(r["voltage"], 4), r["n_found"], r["occupancy"]) for r in found.collect()] == [("a", 1, 3.205, 8, 1.0)]
    values = np.sort(np.random.default_rng(2).random(9))
    assert all(P.middle_of(values[:k]) == np.median(values[:k]) for k in range(1, 10)) and np.isnan(P.middle_of(values[:0]))
