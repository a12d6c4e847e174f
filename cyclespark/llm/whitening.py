"""Embedding whitening: principal components by contour integration (FEAST), fitted on all vectors.

Vectors become whole numbers (floor(64 c) + 1,000,000), so sums are exact and don't depend on how rows are split. Two passes over
the vectors gather their sums and, centred by the rounded means, their products; both are summed by Spark. The matrix of
products has one row per dimension, whatever the number of vectors, and is all that comes to the driver.

Components: a search by inertia finds intervals of eigenvalues that hold a few of the wanted ones each. For every interval a
quadrature over a circle around it sums solves of shifted systems, (z - V) X = Y with complex z, which projects Y onto the
eigenvectors inside; Rayleigh-Ritz takes them from the projection. The solves of all intervals and points are rows of one Spark
job per round. The inertias at the ends of an interval tell how many components it holds; the round ends when all are found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
_POINTS, _ROUNDS = 8, 40
_FINEST = 1e-12  # of the largest eigenvalue: what lies below counts as zero


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of the vectors without null or non-finite entries, and which rows those are; all are of one length."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    flat = pc.list_flatten(column)
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero((sizes == width) & (sizes > 0))
    full = values.reshape(len(rows), width) if len(rows) else np.zeros((0, width))
    return np.floor(full * SCALE).astype(np.int64) + SHIFT, rows


def _usable(vector: str) -> F.Column:
    """Not null, and without null, infinite or undefined entries or such beyond 2^40."""
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < 2.0**40))


def inertia(a: np.ndarray) -> int:
    """How many eigenvalues of the symmetric matrix are positive, by elimination with pivots of order one and two."""
    a, positive = a.copy(), 0
    while len(a):
        n = len(a)
        diagonal = np.abs(np.diagonal(a))
        k = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diagonal(a)))
        i, j = divmod(int(off.argmax()), n)
        if max(diagonal[k], off[i, j]) == 0:
            return positive
        at = [k] if diagonal[k] >= 0.6403882 * off[i, j] else [i, j]  # (1 + sqrt 17) / 8
        rest = np.setdiff1d(np.arange(n), at)
        pivot = a[np.ix_(at, at)]
        positive += int(pivot[0, 0] > 0) if len(at) == 1 else 1  # a pivot of order two has one of each sign
        side = a[np.ix_(rest, at)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(pivot, side.T)
        a = (a + a.T) / 2
    return positive


def _intervals(v: np.ndarray, wanted: int, room: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) that together hold the `wanted` largest positive eigenvalues, at most `room` each
    where eigenvalues can be told apart; from the top down."""
    n, top = len(v), float(np.abs(v).sum(axis=1).max())
    if top == 0:
        return []
    above = {}

    def count(x: float) -> int:
        if x not in above:
            above[x] = inertia(v - x * np.eye(n))
        return above[x]

    def cut(low: float, high: float, target: int) -> float:
        """A place below the `target` largest, with as few more above it as can be."""
        while high - low > 1e-9 * top and count(low) > target:
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= target else (low, middle)
        return widened(low, high)

    def widened(low: float, high: float) -> float:
        """The middle of the gap that `low` lies in: the wider the gap, the sharper the filter."""
        held, under, over = count(low), (-top, low), (low, high)
        for _ in range(40):
            if count(sum(under) / 2) > held:
                under = (sum(under) / 2, under[1])
            else:
                under = (under[0], sum(under) / 2)
            if count(sum(over) / 2) < held:
                over = (over[0], sum(over) / 2)
            else:
                over = (sum(over) / 2, over[1])
            if max(under[1] - under[0], over[1] - over[0]) < 0.1 * (over[0] - under[1]):
                break
        return (under[1] + over[0]) / 2

    zero = _FINEST * top
    wanted = min(wanted, count(zero))
    out, high, done = [], top * 1.001, 0
    while done < wanted:
        low = cut(zero, high, min(done + room, wanted))
        end = count(low)
        # A circle around far-off eigenvalues and a dense crowd would be too wide to tell the crowd from what lies below it.
        while end > done:
            middle = (low + high) / 2
            upper = count(middle) - done
            if 4 * upper >= end - done or high - low <= 1e-9 * top:
                out.append((low, high, end - done))
                done = end
            elif upper == 0:
                high = middle
            else:
                middle = widened(middle, high)
                out.append((middle, high, upper))
                high, done = middle, done + upper
        high = low
    return out


def _solves(spark, v: np.ndarray, spans: list[tuple[float, float, int]], blocks: list[np.ndarray]) -> list[np.ndarray]:
    """For each interval the quadrature of (z - V)^-1 Y over its circle; the solves are the rows of a Spark job."""
    n = len(v)
    rows, schema = [], "interval int, point int, low double, high double, y array<double>"
    for k, ((low, high, _), y) in enumerate(zip(spans, blocks)):
        rows += [(k, p, float(low), float(high), y.ravel().tolist()) for p in range(_POINTS)]
    matrix = v.tolist()

    def solve(inputs):
        a = np.array(matrix)
        nodes, weights = np.polynomial.legendre.leggauss(_POINTS)
        for batch in inputs:
            for r in batch.to_pylist():
                y = np.array(r["y"]).reshape(n, -1)
                angle = -np.pi / 2 * (nodes[r["point"]] - 1)
                radius, centre = (r["high"] - r["low"]) / 2, (r["high"] + r["low"]) / 2
                turn = np.exp(1j * angle)
                x = np.linalg.solve((centre + radius * turn) * np.eye(n) - a, y.astype(complex))
                q = weights[r["point"]] / 2 * np.real(radius * turn * x)
                yield pa.RecordBatch.from_arrays([pa.array([r["interval"]], pa.int32()), pa.array([r["point"]], pa.int32()), pa.array([q.ravel().tolist()])], names=["interval", "point", "q"])

    parts = spark.createDataFrame(rows, schema).repartition(min(len(rows), 64), "interval", "point").mapInArrow(solve, "interval int, point int, q array<double>")
    total = [np.zeros_like(y) for y in blocks]
    for r in sorted(parts.collect(), key=lambda r: (r["interval"], r["point"])):
        total[r["interval"]] += np.array(r["q"]).reshape(n, -1)
    return total


def components(spark, v: np.ndarray, wanted: int = COMPONENTS, room: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest positive eigenvalues of V, falling, and unit eigenvectors as columns. Raises if one is missed."""
    n = len(v)
    spans = _intervals(v, wanted, room)
    if not spans:
        return np.zeros(0), np.zeros((n, 0))
    scale = float(np.abs(v).max())
    rng = np.random.default_rng(17)
    blocks = [rng.standard_normal((n, min(n, 2 * m + 8))) for _, _, m in spans]
    found: dict[int, tuple] = {}
    for turn in range(_ROUNDS):
        open_ = [k for k in range(len(spans)) if k not in found]
        if not open_:
            break
        projected = _solves(spark, v, [spans[k] for k in open_], [blocks[k] for k in open_])
        for k, q in zip(open_, projected):
            low, high, m = spans[k]
            q, _ = np.linalg.qr(q)
            q, _ = np.linalg.qr(q)
            values, inner = np.linalg.eigh(q.T @ v @ q)
            vectors = q @ inner
            blocks[k] = vectors
            inside = np.flatnonzero((values > low) & (values <= high))
            worst = np.abs(v @ vectors[:, inside] - vectors[:, inside] * values[inside]).max(initial=0)
            if len(inside) == m and (worst <= 4e-14 * scale * np.sqrt(n) or turn == _ROUNDS - 1 and worst <= 1e-10 * scale):
                found[k] = values[inside], vectors[:, inside]
    if len(found) < len(spans):
        raise ArithmeticError("the contour integrals left out components that the inertia counts")
    values = np.concatenate([found[k][0][::-1] for k in range(len(spans))])
    vectors = np.concatenate([found[k][1][:, ::-1] for k in range(len(spans))], axis=1)
    vectors, _ = np.linalg.qr(vectors)  # eigenvectors of different intervals are orthogonal already, up to rounding
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    return values[:wanted], vectors[:, :wanted]


def fit_whitening(vectors: DataFrame, vector: str, wanted: int = COMPONENTS) -> dict:
    """n, sums S (exact), covariance and components of the usable vectors of the most frequent length (the longest of ties)."""
    spark = vectors.sparkSession
    good = vectors.filter(_usable(vector)).select(F.col(vector).alias("v"))

    def sums(inputs):
        got: dict[int, list] = {}
        for batch in inputs:
            column = batch.column("v")
            sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                x, rows = _matrix(column.filter(pa.array(sizes == size)))
                n, s = got.get(int(size), (0, np.zeros(int(size), np.int64)))
                got[int(size)] = n + int((sizes == size).sum()), s + x.sum(axis=0)
        for size, (n, s) in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.int64()))], names=["size", "n", "s"])

    parts = good.mapInArrow(sums, "size int, n long, s array<long>")
    best = parts.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not best or not best[0]["size"]:
        return {"n": 0}
    size, n = best[0]["size"], best[0]["n"]
    cells = parts.filter(F.col("size") == size).select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    s = [0] * size
    for r in cells.collect():
        s[r["i"]] = int(r["s"])
    middle = np.array([(2 * t + n) // (2 * n) for t in s], np.int64)  # rounded means
    rest = [t - n * int(m) for t, m in zip(s, middle)]
    good = good.filter(F.size("v") == size)

    def products(inputs):
        total = np.zeros((size, size))
        for batch in inputs:
            for lo in range(0, batch.num_rows, 4096):
                x, _ = _matrix(batch.column("v").slice(lo, 4096))
                d = (x - middle).astype(np.float64)
                total += d.T @ d
        for i in range(size):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i, i:].tolist()], pa.list_(pa.float64()))], names=["i", "p"])

    rows = good.mapInArrow(products, "i int, p array<double>").select("i", F.posexplode("p").alias("k", "p"))
    p = np.zeros((size, size))
    for r in rows.groupBy("i", "k").agg(F.sum("p").alias("p")).collect():
        p[r["i"], r["i"] + r["k"]] = p[r["i"] + r["k"], r["i"]] = r["p"]
    off = np.array([r / n for r in rest])
    covariance = p / n - np.outer(off, off)
    values, axes = components(spark, covariance, wanted)
    return {"n": n, "size": size, "sums": s, "middle": middle, "rest": rest, "covariance": covariance, "values": values, "axes": axes}


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """Per row and component: the columns of vectors but the vector, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or has null or non-finite entries are left out, as are entries beyond 2^40, which no whole number
    here could hold, and vectors of another length than the most frequent one. Each entry c becomes x = floor(64 c) + 1,000,000.
    whitened is x less its mean, projected on the component, over the root of its eigenvalue; deviation is the exact sum of
    (n x - S)^2 over dimensions (null where it exceeds a long); explained is the eigenvalue's share of the trace;
    identity_error the largest absolute entry of the whitened values' covariance less the identity, measured on all rows.

    Components are the eigenvectors of the `wanted` largest positive eigenvalues; a table whose vectors vary in fewer directions
    has fewer. Equal eigenvalues may have any basis. Repeated rows stay; null keys are kept. An empty table, or equal vectors
    only, gives no rows. Columns called like the new ones are replaced.
    """
    new = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    own = [c for c in vectors.columns if c != vector and c not in new]
    plain = vectors.select(F.struct(*own).alias("_own"), F.col(vector).alias("v"))
    fit = fit_whitening(vectors, vector, wanted)
    kinds = "component int, n long, deviation long, whitened double, explained double"
    if not fit["n"] or not len(fit["values"]):
        empty = plain.filter("false").select("_own.*", *[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in kinds.split(", ")])
        return empty.withColumn("identity_error", F.lit(None).cast("double"))
    n, size, middle, values, axes = fit["n"], fit["size"], fit["middle"], fit["values"], fit["axes"]
    rest, m = fit["rest"], len(fit["values"])
    turn = axes / np.sqrt(values)
    off = np.array([r / n for r in rest])
    rest_squares = sum(r * r for r in rest)
    share = values / np.trace(fit["covariance"])
    schema = T.StructType([plain.schema["_own"], *T._parse_datatype_string("deviation long, white array<double>").fields])

    def run(inputs):
        for whole in inputs:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                x, _ = _matrix(batch.column("v"))
                d = x - middle
                white = (d.astype(np.float64) - off) @ turn
                wide = d.astype(object) if len(d) and np.abs(d).max() >= 1 << 25 else d
                squares = (wide * wide).sum(axis=1)
                cross = (wide.astype(object) * np.array(rest, object)).sum(axis=1) if n >= 1 << 24 or wide.dtype == object else wide @ np.array(rest, np.int64)
                deviation = [n * n * int(a) - 2 * n * int(c) + rest_squares for a, c in zip(squares, cross)]
                deviation = [v if v < 1 << 63 else None for v in deviation]
                yield pa.RecordBatch.from_arrays([batch.column("_own"), pa.array(deviation, pa.int64()), pa.array(list(white), pa.list_(pa.float64()))], names=["_own", "deviation", "white"])

    good = plain.filter(_usable("v") & (F.size("v") == size))
    done = good.mapInArrow(run, schema)

    def second(inputs):
        total, sums, k = np.zeros((m, m)), np.zeros(m), 0
        for batch in inputs:
            y = pc.list_flatten(batch.column("white")).to_numpy().reshape(-1, m)
            total, sums, k = total + y.T @ y, sums + y.sum(axis=0), k + len(y)
        if k:
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.concatenate([sums, total.ravel()]).tolist()])], names=["k", "t"])

    # The whitened rows are written once: the error of the whole is a column of each.
    done = stored(done, "whitened")
    cells = done.select("white").mapInArrow(second, "k long, t array<double>").select("k", F.posexplode("t").alias("i", "t"))
    got = np.zeros(m + m * m)
    for r in cells.groupBy("i").agg(F.sum("t").alias("t")).collect():
        got[r["i"]] = r["t"]
    mean = got[:m] / n
    error = float(np.abs(got[m:].reshape(m, m) / n - np.outer(mean, mean) - np.eye(m)).max())
    explained = F.array(*[F.lit(float(s)) for s in share])
    long = done.select("_own.*", "deviation", F.posexplode("white").alias("_i", "whitened"))
    return long.select(*[F.col(c) for c in own], (F.col("_i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("_i") + 1).alias("explained"), F.lit(error).alias("identity_error"))
