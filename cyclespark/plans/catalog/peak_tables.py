"""Queries over peaks: detection, stability, recurrence, seeds and the reference cycle."""

from pyspark.sql import functions as F

from cyclespark.operators import curves as V
from cyclespark.operators import peaks as P
from cyclespark.operators import sequences as E
from cyclespark.operators.lineage import cut
from cyclespark.plans.catalog.curve_tables import ALL, BLENDS, CURVES, K, STEPS, blend_arrays, curve_arrays, curves, histograms, integrity, on, plan, settings
from cyclespark.plans.catalog.cycle_tables import TABLE, table
from cyclespark.plans.catalog.record_tables import FORMATION
from cyclespark.plans.fixture import cells, shared
from cyclespark.plans.registry import query
from cyclespark.schema import HALF

PEAKS = f"""
up AS (SELECT {K}, CASE WHEN sum((dqdv + p) * (voltage - pv) / 2) < 0 THEN -1 ELSE 1 END AS up, count(*) AS n FROM (SELECT *, lag(dqdv) OVER w AS p, lag(voltage) OVER w AS pv FROM curve WINDOW w AS (PARTITION BY {K} ORDER BY bin)) GROUP BY {K} HAVING count(*) >= 10),
cy AS (SELECT c.cell_id, c.cycle, c.step, bin AS i, voltage, dqdv * up AS y, n FROM curve c JOIN up ON {on('c', 'up')}),
sc AS (SELECT {K}, max(y) AS y_max, max(y) - min(y) AS y_range, (max(voltage) - min(voltage)) / (count(*) - 1) AS bin_v, min(voltage) AS v_lo, max(voltage) AS v_hi FROM cy GROUP BY {K} HAVING max(y) > min(y)),
ru AS (SELECT *, sum(chg) OVER (PARTITION BY {K} ORDER BY i) AS run FROM (SELECT *, CASE WHEN y IS DISTINCT FROM lag(y) OVER (PARTITION BY {K} ORDER BY i) THEN 1 ELSE 0 END AS chg FROM cy)),
rr AS (SELECT {K}, run, min(i) AS a, max(i) AS z, any_value(y) AS y FROM ru GROUP BY {K}, run),
mx AS (SELECT {K}, CAST((a + z) // 2 AS INT) AS i, y FROM (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS nx FROM rr WINDOW w AS (PARTITION BY {K} ORDER BY run)) WHERE p < y AND nx < y)
"""


def sweep(name, source, shoulder, narrow, wide):
    """CTEs that thin peaks by spacing: one recursion step for each peak, upwards in voltage."""
    near = f"l[x].v - l[i].v < CASE WHEN l[i].s OR l[x].s THEN {narrow} ELSE {wide} END"
    return f"""{name}_l AS (SELECT {K}, list({{'v': voltage, 'p': prominence, 's': {shoulder}, 'b': peak_bin}} ORDER BY voltage, prominence) AS l FROM {source} GROUP BY {K}),
{name}_k AS (
  SELECT {K}, l, list_transform(l, lambda x: true) AS k, 1 AS i FROM {name}_l
  UNION ALL
  SELECT {K}, l, CASE WHEN NOT k[i] THEN k ELSE list_transform(range(1, len(l) + 1), lambda x: CASE WHEN x = i THEN b IS NULL WHEN x > i AND k[x] AND {near} AND l[x].p <= l[i].p AND (b IS NULL OR x < b) THEN false ELSE k[x] END) END, i + 1
  FROM (SELECT *, list_min(list_filter(range(i + 1, len(l) + 1), lambda x: k[x] AND {near} AND l[x].p > l[i].p)) AS b FROM {name}_k WHERE i < len(l))),
{name}_e AS (SELECT {K}, unnest(list_filter(list_transform(range(1, len(l) + 1), lambda x: CASE WHEN k[x] THEN l[x].b END), lambda x: x IS NOT NULL)) AS peak_bin FROM (SELECT {K}, arg_max(l, i) AS l, arg_max(k, i) AS k FROM {name}_k GROUP BY {K})),
{name} AS (SELECT p.* FROM {source} p JOIN {name}_e e ON {on('p', 'e')} AND e.peak_bin = p.peak_bin)"""


def spaced(name, source, keys, height):
    """CTEs that keep maxima ``dist`` samples apart, highest first (ties: later first): one recursion step for each."""
    same = lambda x, y: " AND ".join(f"{y}.{k} = {x}.{k}" for k in keys.split(", "))
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {height} DESC, i DESC) AS k FROM {source}),
{name}_d AS (
  SELECT {keys}, k, [i] AS kept FROM {name}_o WHERE k = 1
  UNION ALL
  SELECT {", ".join(f"m.{k}" for k in keys.split(", "))}, m.k, CASE WHEN len(list_filter(d.kept, lambda x: abs(x - m.i) < m.dist)) > 0 THEN d.kept ELSE list_append(d.kept, m.i) END FROM {name}_d d JOIN {name}_o m ON {same('d', 'm')} AND m.k = d.k + 1),
{name} AS (SELECT {keys}, unnest(arg_max(kept, k)) AS i FROM {name}_d GROUP BY {keys})"""


def prominence(name, source, curve, keys, value, n):
    """CTEs with prominence and the sides' foot of samples (i, h) of a curve; n is its last sample's number, or a column of the source."""
    same = lambda x, y: " AND ".join(f"{y}.{k} = {x}.{k}" for k in keys.split(", "))
    x = ", ".join(f"x.{k}" for k in keys.split(", "))
    return f"""{name}_l AS (SELECT {x}, x.i, any_value(h) AS h, coalesce(max(c.i) FILTER (c.i < x.i AND c.{value} > h) + 1, min(c.i)) AS l, coalesce(min(c.i) FILTER (c.i > x.i AND c.{value} > h) - 1, max(c.i)) AS r
  FROM {source} x JOIN {curve} c ON {same('x', 'c')} GROUP BY {x}, x.i),
{name}_b AS (SELECT {x}, x.i, any_value(h) AS h, any_value(l) AS l, any_value(r) AS r, min(c.{value}) FILTER (c.i BETWEEN l AND x.i) AS lm, min(c.{value}) FILTER (c.i BETWEEN x.i AND r) AS rm
  FROM {name}_l x JOIN {curve} c ON {same('x', 'c')} GROUP BY {x}, x.i),
{name} AS (SELECT *, h - greatest(lm, rm) AS prom FROM {name}_b)"""


def widths(name, source):
    """CTEs with the crossings at half prominence on the curve ``cy``, in samples."""
    return f"""{name}_3 AS (SELECT x.cell_id, x.cycle, x.step, x.i, any_value(h) AS h, any_value(prom) AS prom, any_value(h - prom * 5e-1) AS half,
  max(c.i) FILTER (c.i BETWEEN l AND x.i AND c.y = lm) AS lb, min(c.i) FILTER (c.i BETWEEN x.i AND r AND c.y = rm) AS rb FROM {source} x JOIN cy c ON {on('x', 'c')} GROUP BY x.cell_id, x.cycle, x.step, x.i),
{name}_c AS (SELECT x.cell_id, x.cycle, x.step, x.i, any_value(h) AS h, any_value(prom) AS prom, any_value(half) AS half, coalesce(max(c.i) FILTER (c.i >= lb AND c.i < x.i AND c.y <= half), any_value(lb)) AS a, coalesce(min(c.i) FILTER (c.i <= rb AND c.i > x.i AND c.y <= half), any_value(rb)) AS b
  FROM {name}_3 x JOIN cy c ON {on('x', 'c')} GROUP BY x.cell_id, x.cycle, x.step, x.i),
{name} AS (SELECT x.cell_id, x.cycle, x.step, x.i, h, prom, a + CASE WHEN ys[a + 1] < half THEN (half - ys[a + 1]) / (ys[a + 2] - ys[a + 1]) ELSE 0 END AS lip,
  b - CASE WHEN ys[b + 1] < half THEN (half - ys[b + 1]) / (ys[b] - ys[b + 1]) ELSE 0 END AS rip FROM {name}_c x JOIN yl ON {on('x', 'yl')})"""


def noises(name, source):
    return f"""{name} AS (SELECT w.cell_id, w.cycle, w.step, w.i, avg(abs(c.d2)) * 12533141e-7 / sqrt(15e-1) AS noise FROM {source} w JOIN (SELECT *, y - 5e-1 * (lag(y) OVER q + lead(y) OVER q) AS d2 FROM cy WINDOW q AS (PARTITION BY {K} ORDER BY i)) c
  ON {on('w', 'c')} AND c.i BETWEEN w.i - 29 AND w.i + 29 AND c.d2 IS NOT NULL GROUP BY w.cell_id, w.cycle, w.step, w.i)"""


CUT_OFF = "v_lo + rip * bin_v >= v_hi - 2e-3 OR v_lo + lip * bin_v <= v_lo + 2e-3"
KF = f"{K}, flank"
SHOULDERS = f"""
w0 AS (SELECT {K}, list(peak_bin ORDER BY peak_bin) AS pk, CAST(least(21, greatest(11, round_even(min(ws) FILTER (ws > 0) * 5e-1, 0))) AS INT) AS w FROM pr0 GROUP BY {K}),
w1 AS (SELECT a.cell_id, a.cycle, a.step, pk, n, y_range, bin_v, v_lo, v_hi, greatest(3, CAST(round_even(2e1 / 1e3 / bin_v, 0) AS INT)) AS sep, coalesce(w, least(21, greatest(11, n // 5))) // 2 AS m
  FROM w0 a JOIN (SELECT {K}, any_value(n) AS n FROM cy GROUP BY {K}) q ON {on('a', 'q')} JOIN sc ON {on('a', 'sc')}),
w2 AS (SELECT *, list_sum(list_transform(range(-m, m + 1), lambda k: pow(k * k * k - (3 * m * m + 3 * m - 1) / 5e0 * k, 2))) AS cubes FROM w1 WHERE n >= 20 AND n >= 2 * m + 1),
d2 AS (SELECT a.cell_id, a.cycle, a.step, a.i, sum((3 * (b.i - a.i) * (b.i - a.i) - m * (m + 1)) * b.y) * any_value(3e1 / (m * (m + 1) * (4 * m * m - 1) * (2 * m + 3))) AS c
  FROM w2 w JOIN cy a ON {on('w', 'a')} AND a.i BETWEEN m AND w.n - 1 - m JOIN cy b ON {on('w', 'b')} AND b.i BETWEEN a.i - m AND a.i + m GROUP BY a.cell_id, a.cycle, a.step, a.i),
d3 AS (SELECT a.cell_id, a.cycle, a.step, a.i, sum((pow(b.i - a.i, 3) - (3 * m * m + 3 * m - 1) / 5e0 * (b.i - a.i)) * b.y) * any_value(6e0 / cubes) AS t
  FROM w2 w JOIN cy a ON {on('w', 'a')} AND (a.i = m OR a.i = w.n - 1 - m) JOIN cy b ON {on('w', 'b')} AND b.i BETWEEN a.i - m AND a.i + m GROUP BY a.cell_id, a.cycle, a.step, a.i),
bj AS (SELECT c.cell_id, c.cycle, c.step, c.i, greatest(m, least(w.n - 1 - m, c.i)) AS j FROM cy c JOIN w2 w ON {on('w', 'c')}),
be AS (SELECT b.cell_id, b.cycle, b.step, b.i, -(d2.c + coalesce(d3.t, 0e0) * (b.i - b.j)) AS y FROM bj b JOIN d2 ON {on('b', 'd2')} AND d2.i = b.j LEFT JOIN d3 ON {on('b', 'd3')} AND d3.i = b.j AND b.i <> b.j),
tr AS (SELECT w.cell_id, w.cycle, w.step, x, arg_min(c.i, {{'y': c.y, 'i': c.i}}) AS t FROM (SELECT *, unnest(range(1, len(pk))) AS x FROM w2) w JOIN cy c ON {on('w', 'c')} AND c.i BETWEEN pk[x] AND pk[x + 1] GROUP BY ALL),
ed AS (SELECT w.*, list_concat([0], coalesce(ts, []), [n - 1]) AS e FROM w2 w LEFT JOIN (SELECT {K}, list(t ORDER BY x) AS ts FROM tr GROUP BY {K}) q ON {on('w', 'q')}),
fx AS (SELECT *, unnest(range(1, len(pk) + 1)) AS x FROM ed),
f0 AS (SELECT *, 2 * x - 2 AS flank, pk[x] AS p, e[x] AS lo, pk[x] AS hi FROM fx UNION ALL SELECT *, 2 * x - 1, pk[x], pk[x], e[x + 1] FROM fx),
f1 AS (SELECT f.*, ys, least(ys[lo + 1], ys[hi + 1]) AS base, ys[p + 1] - least(ys[lo + 1], ys[hi + 1]) AS rise FROM f0 f JOIN yl ON {on('f', 'yl')} WHERE hi - lo >= 2 * sep + 3),
f2 AS (SELECT * FROM f1 WHERE rise > 0 AND rise >= 2e-1 * y_range),
sg0 AS (SELECT b.cell_id, b.cycle, b.step, flank, CAST(b.i - lo AS INT) AS i, b.y, sep AS dist FROM f2 f JOIN be b ON {on('f', 'b')} AND b.i BETWEEN lo AND hi),
sg AS (SELECT * FROM (SELECT *, max(y) OVER (PARTITION BY {KF}) - min(y) OVER (PARTITION BY {KF}) AS span FROM sg0) WHERE span > 0),
sr AS (SELECT {KF}, run, min(i) AS a, max(i) AS z, any_value(y) AS y, any_value(dist) AS dist, any_value(span) AS span FROM (SELECT *, sum(chg) OVER (PARTITION BY {KF} ORDER BY i) AS run FROM (SELECT *, CASE WHEN y IS DISTINCT FROM lag(y) OVER (PARTITION BY {KF} ORDER BY i) THEN 1 ELSE 0 END AS chg FROM sg)) GROUP BY {KF}, run),
sm AS (SELECT {KF}, CAST((a + z) // 2 AS INT) AS i, y AS h, dist, span FROM (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS nx FROM sr WINDOW w AS (PARTITION BY {KF} ORDER BY run)) WHERE p < y AND nx < y),
{spaced('sk', 'sm', KF, 'h')},
sp0 AS (SELECT m.* FROM sm m JOIN sk ON {on('m', 'sk')} AND sk.flank = m.flank AND sk.i = m.i),
{prominence('sq', 'sp0', 'sg', KF, 'y', '')},
sc0 AS (SELECT f.*, lo + q.i AS i FROM f2 f JOIN sq q ON {on('f', 'q')} AND q.flank = f.flank JOIN sp0 z ON {on('q', 'z')} AND z.flank = q.flank AND z.i = q.i WHERE q.prom >= 8e-2 * z.span),
sh0 AS (SELECT DISTINCT {K}, i, y_range, bin_v, v_lo, v_hi, ys[i + 1] AS h FROM sc0 WHERE abs(i - p) >= sep AND least(abs(i - e[x]), abs(i - e[x + 1])) >= sep AND i > lo AND i < hi AND len(list_filter(pk, lambda k: abs(k - i) < sep)) = 0
  AND v_lo + i * bin_v >= v_lo + 5e-2 AND v_lo + i * bin_v <= v_hi - 5e-2 AND ys[i + 1] - base >= 1e-1 * rise AND ys[i + 1] >= base AND ys[i + 1] <= ys[p + 1]),
ss AS (SELECT s.cell_id, s.cycle, s.step, s.i, (min(b.i) FILTER (b.i >= s.i AND b.y <= 0) - max(b.i) FILTER (b.i <= s.i AND b.y <= 0)) / 2e0 AS half FROM sh0 s JOIN be b ON {on('s', 'b')} GROUP BY s.cell_id, s.cycle, s.step, s.i),
{prominence('sx', 'sh0', 'cy', K, 'y', '')},
{widths('sw', 'sx')},
{noises('sn', 'sh0')},
sh1 AS (SELECT s.cell_id, s.cycle, s.step, s.i, s.h, bin_v, v_lo, v_hi, noise, coalesce(CASE WHEN ss.half > 0 THEN ss.half END * bin_v, 0e0) AS sigma, w.prom > 0 AND rip > lip AS own, lip, rip
  FROM sh0 s JOIN ss ON {on('s', 'ss')} AND ss.i = s.i JOIN sw w ON {on('s', 'w')} AND w.i = s.i JOIN sn ON {on('s', 'sn')} AND sn.i = s.i),
sh2 AS (SELECT s.*, c.voltage, CASE WHEN own THEN v_lo + lip * bin_v ELSE c.voltage - sigma END AS left_v, CASE WHEN own THEN v_lo + rip * bin_v ELSE c.voltage + sigma END AS right_v FROM sh1 s JOIN cy c ON {on('s', 'c')} AND c.i = s.i)
"""
KEEP = PEAKS + f""",
mo AS (SELECT m.*, greatest(1, CAST(round_even(3e1 / 1e3 / bin_v, 0) AS INT)) AS dist FROM mx m JOIN sc ON {on('m', 'sc')}),
{spaced('kk', 'mo', K, 'y')},
pk AS (SELECT kk.cell_id, kk.cycle, kk.step, kk.i, c.y AS h, c.voltage, c.n FROM kk JOIN cy c ON {on('kk', 'c')} AND c.i = kk.i),
yl AS (SELECT {K}, list(y ORDER BY i) AS ys FROM cy GROUP BY {K}),
{prominence('bs', 'pk', 'cy', K, 'y', '')},
{widths('wd', 'bs')},
{noises('nz', 'wd')},
pr0 AS (SELECT w.cell_id, w.cycle, w.step, w.i AS peak_bin, c.voltage, h AS height, prom AS prominence, (rip - lip) * bin_v AS width_v, v_lo + lip * bin_v AS left_v, v_lo + rip * bin_v AS right_v,
  {CUT_OFF} AS is_truncated, noise, y_max, rip - lip AS ws FROM wd w JOIN sc ON {on('w', 'sc')} JOIN nz ON {on('w', 'nz')} AND nz.i = w.i JOIN cy c ON {on('w', 'c')} AND c.i = w.i JOIN sett s ON s.cell_id = w.cell_id
  WHERE rip - lip >= greatest(1, round_even(CASE profile WHEN 'sharp' THEN 2 ELSE 5 END / 1e3 / bin_v, 0)) AND (prom >= 5e-2 * y_range OR (h > 0 AND prom >= 25e-2 * h AND h >= 2e-2 * y_max))),
{SHOULDERS},
pr1 AS (SELECT {K}, peak_bin, voltage, height, prominence, width_v, left_v, right_v, is_truncated, false AS is_shoulder, noise, y_max FROM pr0 UNION ALL
  SELECT s.cell_id, s.cycle, s.step, s.i, voltage, h, h * 1e-1, right_v - left_v, left_v, right_v, right_v >= s.v_hi - 2e-3 OR left_v <= s.v_lo + 2e-3, true, noise, y_max FROM sh2 s JOIN sc ON {on('s', 'sc')}),
t0 AS (SELECT {K}, arg_max(i, {{'y': y, 'i': -i}}) AS i, max(y) AS y, any_value(n) AS n FROM cy GROUP BY {K}),
t1 AS (SELECT t.cell_id, t.cycle, t.step, t.i, any_value(t.y) - greatest(min(c.y) FILTER (c.i <= t.i), min(c.y) FILTER (c.i >= t.i)) AS prom FROM t0 t JOIN cy c ON {on('t', 'c')} WHERE t.i > 0 AND t.i < t.n - 1 GROUP BY ALL),
t2 AS (SELECT t.*, c.voltage, y_max FROM t1 t JOIN sc ON {on('t', 'sc')} JOIN cy c ON {on('t', 'c')} AND c.i = t.i WHERE prom > 0),
{noises('tn', 't2')},
tb AS (SELECT t.cell_id, t.cycle, t.step, arg_min({{'b': p.peak_bin, 's': p.is_shoulder, 'w': p.width_v, 'l': p.left_v, 'r': p.right_v}}, p.voltage) AS near FROM t2 t JOIN pr1 p ON {on('t', 'p')} AND abs(p.voltage - t.voltage) < 3e-2 GROUP BY ALL),
t3 AS (SELECT t.*, noise, near FROM t2 t JOIN tn ON {on('t', 'tn')} LEFT JOIN tb ON {on('t', 'tb')} WHERE near IS NULL OR near.s),
prim AS (SELECT p.* FROM pr1 p LEFT JOIN t3 t ON {on('p', 't')} AND t.near.b = p.peak_bin WHERE t.cell_id IS NULL UNION ALL SELECT {K}, i, voltage, y_max, prom, near.w, near.l, near.r, false, false, noise, y_max FROM t3),
{sweep('dd', 'prim', 'is_shoulder', '20000001e-9', '30000001e-9')},
nf AS (SELECT * FROM (SELECT *, height / max(height) OVER (PARTITION BY {K}) AS share FROM dd) WHERE NOT (coalesce(noise > 0 AND prominence / noise < 12, false) AND share < 1e-1)),
pks AS (SELECT * EXCLUDE (r, share), CAST(row_number() OVER (PARTITION BY {K} ORDER BY voltage) AS INT) AS peak_id FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY prominence DESC, voltage) AS r, count(*) OVER (PARTITION BY {K}) > 12 AS peaks_capped FROM nf) WHERE r <= 12)
"""
PEAK_DOUBLES = "voltage height prominence width_v left_v right_v noise"


@shared
def primary(spark, sf):
    return cut(P.primary_peaks(curve_arrays(spark, sf), profiles=settings(spark, sf)))


@shared
def peaks(spark, sf):
    return cut(P.detect(curve_arrays(spark, sf), profiles=settings(spark, sf)))


@shared
def blend_peaks(spark, sf):
    """Peaks of the blended curves, shoulders among them."""
    return cut(P.detect(blend_arrays(spark, sf), profiles=settings(spark, sf)))


@query("g1_local_maxima", f"WITH {CURVES}, {PEAKS} SELECT {K}, i AS peak_bin FROM mx")
def _(spark, sf):
    return P.local_maxima(P.curve_arrays(curve_arrays(spark, sf))).select(*HALF, F.explode("maxima").alias("peak_bin"))


@query("g1_primary_peaks", f"WITH {CURVES}, {KEEP} SELECT * EXCLUDE (y_max) FROM prim", PEAK_DOUBLES)
def _(spark, sf):
    return primary(spark, sf).drop("y_max")


@query("g4_truncation", f"""WITH {CURVES}, {KEEP}, f AS (SELECT p.*, CASE WHEN right_v >= v_hi - 2e-3 AND NOT left_v <= v_lo + 2e-3 THEN CASE WHEN voltage - left_v > 0 THEN (right_v - left_v) / (2 * (voltage - left_v)) ELSE 0 END
  WHEN left_v <= v_lo + 2e-3 AND NOT right_v >= v_hi - 2e-3 THEN CASE WHEN right_v - voltage > 0 THEN (right_v - left_v) / (2 * (right_v - voltage)) ELSE 0 END
  WHEN NOT left_v <= v_lo + 2e-3 AND NOT right_v >= v_hi - 2e-3 THEN 1 END AS visible FROM prim p JOIN sc ON {on('p', 'sc')})
SELECT {K}, peak_bin, visible, coalesce(visible >= 6e-1, true) AS usable FROM f WHERE left_v IS NOT NULL""", "visible")
def _(spark, sf):
    edges = curves(spark, sf).groupBy(*HALF).agg(F.min("voltage").alias("lo"), F.max("voltage").alias("hi"))
    seen = P.visible_fraction(F.col("voltage"), F.col("left_v"), F.col("right_v"), F.col("lo"), F.col("hi"))
    return primary(spark, sf).filter("left_v IS NOT NULL").join(edges, HALF).select(
        *HALF, "peak_bin", seen.alias("visible"), F.coalesce(seen >= P.TRUNCATION_VISIBLE, F.lit(True)).alias("usable"))


@query("g5_local_noise", f"WITH {CURVES}, {KEEP} SELECT {K}, peak_bin, noise FROM prim", "noise")
def _(spark, sf):
    return primary(spark, sf).select(*HALF, "peak_bin", "noise")


@query("g6_noise_floor", f"WITH {CURVES}, {KEEP} SELECT {K}, peak_bin, prominence FROM nf", "prominence")
def _(spark, sf):
    return P.noise_floor(P.deduplicate(primary(spark, sf))).select(*HALF, "peak_bin", "prominence")


@query("g7_strongest_peaks", f"WITH {CURVES}, {KEEP} SELECT * EXCLUDE (y_max) FROM pks", PEAK_DOUBLES)
def _(spark, sf):
    return peaks(spark, sf).drop("y_max")


@query("g2_curve_maximum", f"""WITH {CURVES}, {KEEP}, t AS (SELECT {K}, arg_max(i, {{'y': y, 'i': -i}}) AS top_bin, max(y) AS height, any_value(n) AS n FROM cy GROUP BY {K})
SELECT t.cell_id, t.cycle, t.step, top_bin, t.height, p.cell_id IS NOT NULL AS is_peak FROM t LEFT JOIN pks p ON {on('t', 'p')} AND p.peak_bin = top_bin""", "height")
def _(spark, sf):
    rows = P.curve_arrays(curve_arrays(spark, sf))
    top = rows.select(*HALF, F.expr("CAST(array_position(ys, y_max) - 1 AS INT)").alias("top_bin"), F.col("y_max").alias("height"))
    found = peaks(spark, sf).select(*HALF, F.col("peak_bin").alias("top_bin"), F.lit(True).alias("is_peak"))
    return top.join(found, [*HALF, "top_bin"], "left").withColumn("is_peak", F.coalesce("is_peak", F.lit(False)))


@query("g3_deduplicate", f"WITH {BLENDS}, {KEEP} SELECT {K}, peak_bin, voltage, prominence, is_shoulder FROM dd", "voltage prominence")
def _(spark, sf):
    return P.deduplicate(cut(P.primary_peaks(blend_arrays(spark, sf), profiles=settings(spark, sf)))).select(*HALF, "peak_bin", "voltage", "prominence", "is_shoulder")


@query("g8_flank_shoulders", f"WITH {BLENDS}, {KEEP} SELECT {K}, peak_bin, voltage, height, width_v, left_v, right_v, is_truncated FROM pr1 WHERE is_shoulder", "voltage height width_v left_v right_v")
def _(spark, sf):
    # Before the tallest sample takes the place of one.
    return P.shoulders(blend_arrays(spark, sf), profiles=settings(spark, sf)).select(*HALF, "peak_bin", "voltage", "height", "width_v", "left_v", "right_v", "is_truncated")


@query("g9_shoulder_sigma", f"WITH {BLENDS}, {KEEP} SELECT {K}, i AS peak_bin, 2 * m + 1 AS window_samples, CASE WHEN half > 0 THEN half END AS sigma_samples FROM ss JOIN w2 USING ({K})", "sigma_samples")
def _(spark, sf):
    rows = P.flank_shoulders(P.standing_out(blend_arrays(spark, sf), profiles=settings(spark, sf)))
    found = F.zip_with("low", "sigmas", lambda p, sigma: F.struct(p["i"].alias("peak_bin"), sigma.alias("sigma_samples")))
    return rows.select(*HALF, F.col("w").alias("window_samples"), F.inline(found)).select(*HALF, "peak_bin", "window_samples", "sigma_samples")


#: The peaks of curves whose bin edges are moved; a phase is part of the step's name meanwhile.
MOVED = f"""plan_o AS (SELECT * FROM plan), ins_o AS (SELECT * FROM ins),
moved AS (WITH RECURSIVE ph(ph) AS (VALUES (2e-1), (4e-1), (6e-1), (8e-1)),
plan AS (SELECT * REPLACE (step || '@' || ph AS step, lo - ph * width AS lo, CAST(greatest(4, ceil((hi - (lo - ph * width)) / width)) AS INT) AS n_bins) FROM plan_o, ph),
ins AS (SELECT * REPLACE (step || '@' || ph AS step) FROM ins_o, ph),
{CURVES[CURVES.index("put AS ("):]}, {KEEP} SELECT cell_id, cycle, split_part(step, '@', 1) AS step, split_part(step, '@', 2) AS phase, voltage FROM pks)"""
STABLE = f"""{MOVED},
ht AS (SELECT p.cell_id, p.cycle, p.step, p.peak_bin, count(DISTINCT phase) AS hits FROM pks p JOIN plan l ON {on('p', 'l')} JOIN moved m ON {on('p', 'm')} AND abs(m.voltage - p.voltage) <= greatest(2e-2, 3 * width, 5e-1 * coalesce(width_v, 0)) GROUP BY ALL),
cb AS (SELECT {K}, min(greatest(4, ceil((hi - (lo - ph * width)) / width))) >= 10 AS can FROM plan, (VALUES (2e-1), (4e-1), (6e-1), (8e-1)) f(ph) GROUP BY {K}),
stab AS (SELECT * EXCLUDE (can, hits, top, peak_id), CAST(row_number() OVER (PARTITION BY {K} ORDER BY voltage) AS INT) AS peak_id FROM (
  SELECT p.*, can, coalesce(hits, 0) AS hits, row_number() OVER (PARTITION BY p.cell_id, p.cycle, p.step ORDER BY abs(height) DESC, p.voltage) = 1 AS top
  FROM pks p JOIN cb ON {on('p', 'cb')} LEFT JOIN ht ON {on("p", "ht")} AND ht.peak_bin = p.peak_bin) WHERE top OR hits = 4 OR NOT can)"""


@shared
def stable_peaks(spark, sf):
    p = plan(spark, sf)
    phases = F.explode(F.array(*[F.lit(x) for x in P.PHASES]))
    shifted = lambda rows: V.shift_plan(rows.withColumn("phase", phases), F.col("phase"))
    moved = P.detect(histograms(spark, sf, shifted, ("phase",)), ("phase",), settings(spark, sf))
    testable = shifted(p).groupBy(*HALF).agg(F.min("n_bins").alias("n")).filter("n >= 10")
    return cut(P.phase_stable(peaks(spark, sf), moved, p.select(*HALF, "width"), testable))


@query("g10_phase_stable_peaks", f"WITH {CURVES}, {KEEP}, {STABLE} SELECT * EXCLUDE (y_max) FROM stab", PEAK_DOUBLES)
def _(spark, sf):
    return stable_peaks(spark, sf).drop("y_max")


@query("d39_peak_counts", f"WITH {CURVES}, {KEEP}, {STABLE} SELECT cell_id, step, cycle, count(*) AS n_peaks FROM stab GROUP BY ALL")
def _(spark, sf):
    return P.peak_counts(stable_peaks(spark, sf))


RECUR = f"""
ra AS (SELECT c.*, y_max, v_lo, v_hi FROM cy c JOIN sc ON {on('c', 'sc')} WHERE n >= 20),
nh AS (SELECT cell_id, step, count(DISTINCT cycle) AS n_halves FROM ra GROUP BY ALL),
pt AS (SELECT a.cell_id, a.cycle, a.step, a.voltage, a.y / y_max AS share FROM mx m JOIN ra a ON {on('m', 'a')} AND a.i = m.i WHERE a.voltage BETWEEN v_lo + 5e-2 AND v_hi - 5e-2),
vl AS (SELECT p.cell_id, p.step, list(voltage ORDER BY voltage) AS vs FROM pt p JOIN nh ON nh.cell_id = p.cell_id AND nh.step = p.step GROUP BY p.cell_id, p.step HAVING count(*) <= 30 * any_value(n_halves)),
md AS (
  SELECT cell_id, step, vs, CAST([] AS DOUBLE[]) AS cs, 0 AS i FROM vl
  UNION ALL
  SELECT cell_id, step, vs, CASE WHEN held THEN cs ELSE list_append(cs, list_median(list_filter(vs, lambda x: x >= m2 - 15e-3 AND x <= m2 + 15e-3))) END, i + 1
  FROM (SELECT *, list_median(list_filter(vs, lambda x: x >= m1 - 15e-3 AND x <= m1 + 15e-3)) AS m2 FROM (
    SELECT *, list_median(list_filter(vs, lambda x: x >= vs[i + 1] - 15e-3 AND x <= vs[i + 1] + 15e-3)) AS m1, len(list_filter(cs, lambda c: vs[i + 1] >= c - 15e-3 AND vs[i + 1] <= c + 15e-3)) > 0 AS held FROM md WHERE i < len(vs)))),
mc AS (SELECT cell_id, step, unnest(cs) AS c, unnest(range(1, len(cs) + 1)) AS o FROM md WHERE i = len(vs)),
ms AS (SELECT m.cell_id, m.step, m.o, any_value(c) AS c, median(share) AS share, count(DISTINCT cycle) AS n_found, count(DISTINCT cycle) / any_value(n_halves) AS occupancy
  FROM mc m JOIN pt p ON p.cell_id = m.cell_id AND p.step = m.step AND p.voltage >= c - 15e-3 AND p.voltage <= c + 15e-3 JOIN nh ON nh.cell_id = m.cell_id AND nh.step = m.step GROUP BY m.cell_id, m.step, m.o),
mo1 AS (SELECT *, row_number() OVER (PARTITION BY cell_id, step ORDER BY occupancy DESC, o) AS k FROM ms WHERE occupancy >= 5e-1 AND share >= 25e-2),
mk AS (
  SELECT cell_id, step, k, [c] AS kept FROM mo1 WHERE k = 1
  UNION ALL
  SELECT m.cell_id, m.step, m.k, CASE WHEN len(list_filter(d.kept, lambda x: abs(x - m.c) <= 15e-3)) > 0 THEN d.kept ELSE list_append(d.kept, m.c) END FROM mk d JOIN mo1 m ON m.cell_id = d.cell_id AND m.step = d.step AND m.k = d.k + 1),
ft AS (SELECT m.cell_id, m.step, CAST(row_number() OVER (PARTITION BY m.cell_id, m.step ORDER BY m.c) AS INT) AS feature, m.c AS voltage, m.share, n_found, occupancy
  FROM mo1 m JOIN (SELECT cell_id, step, unnest(arg_max(kept, k)) AS c FROM mk GROUP BY cell_id, step) q ON q.cell_id = m.cell_id AND q.step = m.step AND q.c = m.c)"""


@shared
def features(spark, sf):
    return cut(P.recurrent_maxima(curve_arrays(spark, sf)))


@query("g11_recurrent_maxima", f"WITH {CURVES}, {PEAKS}, {RECUR} SELECT * FROM ft", "voltage share occupancy")
def _(spark, sf):
    return features(spark, sf)


SEEDED = f"""{RECUR},
fl0 AS (SELECT cell_id, step, list({{'v': voltage, 's': share}} ORDER BY voltage) AS fs FROM ft GROUP BY ALL),
ml AS (SELECT m.cell_id, m.cycle, m.step, list(m.i ORDER BY m.i) AS mi, list(a.voltage ORDER BY m.i) AS mv, list(a.y / a.y_max ORDER BY m.i) AS ms FROM mx m JOIN ra a ON {on('m', 'a')} AND a.i = m.i GROUP BY m.cell_id, m.cycle, m.step),
sd AS (
  SELECT p.cell_id, p.cycle, p.step, pv AS seen, CAST([] AS INT[]) AS bins, fs, mi, mv, ms, 1 AS i
  FROM (SELECT {K}, list(voltage) AS pv FROM stab GROUP BY {K}) p JOIN fl0 f ON f.cell_id = p.cell_id AND f.step = p.step JOIN ml m ON {on('p', 'm')}
  UNION ALL
  SELECT {K}, CASE WHEN ok THEN list_append(seen, mv[x]) ELSE seen END, CASE WHEN ok THEN list_append(bins, mi[x]) ELSE bins END, fs, mi, mv, ms, i + 1 FROM (
    SELECT *, len(list_filter(seen, lambda v: abs(v - fs[i].v) <= 3e-2)) = 0 AND len(seen) < 12 AND abs(mv[x] - fs[i].v) <= 15e-3 AND ms[x] >= 5e-1 * fs[i].s AS ok
    FROM (SELECT *, list_position(list_transform(mv, lambda v: abs(v - fs[i].v)), list_min(list_transform(mv, lambda v: abs(v - fs[i].v)))) AS x FROM sd WHERE i <= len(fs)))),
sb AS (SELECT cell_id, cycle, step, unnest(bins) AS i FROM sd WHERE i = len(fs) + 1),
sv AS (SELECT b.cell_id, b.cycle, b.step, b.i, c.y AS h, c.voltage FROM sb b JOIN cy c ON {on('b', 'c')} AND c.i = b.i),
{prominence('se', 'sv', 'cy', K, 'y', '')},
seed AS (SELECT s.cell_id, s.cycle, s.step, CAST(s.i AS INT) AS peak_bin, v.voltage, s.h AS height, s.prom AS prominence FROM se s JOIN sv v ON {on('s', 'v')} AND v.i = s.i),
det AS (SELECT *, CAST(row_number() OVER (PARTITION BY {K} ORDER BY voltage, is_recurrent) AS INT) AS peak_id FROM (
  SELECT * EXCLUDE (peak_id, y_max), false AS is_recurrent FROM stab
  UNION ALL BY NAME SELECT *, false AS is_truncated, false AS is_shoulder, true AS is_recurrent FROM seed))"""


@query("g12_recurrent_seeds", f"WITH {CURVES}, {KEEP}, {STABLE}, {SEEDED} SELECT * FROM seed", "voltage height prominence")
def _(spark, sf):
    return seeds(spark, sf)


@shared
def seeds(spark, sf):
    return cut(P.recurrent_seeds(stable_peaks(spark, sf), curve_arrays(spark, sf), features(spark, sf)))


@shared
def detected(spark, sf):
    """Stable peaks and recurrent seeds: what everything after detection reads."""
    return cut(P.with_seeds(stable_peaks(spark, sf).drop("y_max"), seeds(spark, sf), "is_recurrent"))


@query("g14_detected_peaks", f"WITH {CURVES}, {KEEP}, {STABLE}, {SEEDED} SELECT * FROM det", PEAK_DOUBLES)
def _(spark, sf):
    return detected(spark, sf)


REFERENCE = f"""
so AS (SELECT cell_id, cycle, bool_and(band IN ('clean', 'suspect')) AS sound FROM integ GROUP BY ALL),
rc0 AS (SELECT t.cell_id, t.cycle, coalesce(sound, false) AND p.cell_id IS NOT NULL AS ok, greatest(2, coalesce(CASE WHEN t.cell_id IN (SELECT cell_id FROM held) THEN formation_end END, 6)) AS start,
  CASE WHEN t.cell_id IN (SELECT cell_id FROM held) THEN formation_end END AS fe, row_number() OVER (PARTITION BY t.cell_id ORDER BY t.cycle) AS r
  FROM (SELECT DISTINCT cell_id, cycle FROM tbl) t LEFT JOIN so ON so.cell_id = t.cell_id AND so.cycle = t.cycle LEFT JOIN (SELECT DISTINCT cell_id, cycle FROM det) p ON p.cell_id = t.cell_id AND p.cycle = t.cycle JOIN form f ON f.cell_id = t.cell_id),
rc AS (SELECT cell_id, min(cycle) FILTER (ok AND cycle >= start) AS above, max(cycle) FILTER (ok AND cycle < start) AS below, max(cycle) FILTER (cycle = 2) AS stated, max(cycle) FILTER (r = 2) AS second, min(cycle) AS first, max(fe) AS fe, max(start) AS start FROM rc0 GROUP BY 1),
refc AS (SELECT cell_id, coalesce(above, below, stated, second, first) AS reference_cycle,
  CASE WHEN above IS NOT NULL AND fe IS NULL THEN 'formation not measured; first sound cycle from the fallback on' WHEN above = start AND start > 2 THEN 'formation ended here' WHEN above IS NOT NULL AND start > 2 THEN 'first sound cycle after formation'
    WHEN above = start THEN 'default, and it passes the integrity check' WHEN above IS NOT NULL THEN 'first sound cycle above the default' WHEN below IS NOT NULL THEN 'latest sound cycle below the start' ELSE 'no cycle passes the integrity check' END AS reason,
  CASE WHEN above IS NOT NULL AND fe IS NOT NULL THEN 'ok' WHEN coalesce(above, below) IS NOT NULL THEN 'warn' ELSE 'bad' END AS severity FROM rc)
"""
CHAIN = f"{ALL}, {KEEP}, {STABLE}, {SEEDED}, {TABLE}, {FORMATION.format(tol='5e0')}, {REFERENCE}"


@shared
def reference(spark, sf):
    t = table(spark, sf)
    return cut(E.choose_reference_cycle(t, integrity(spark, sf), detected(spark, sf), E.formation_end(t, tolerance_pp=5.0)))


@query("e11_reference_cycle", f"WITH {CHAIN} SELECT * FROM refc", "", "records, cells")
def _(spark, sf):
    return reference(spark, sf)


INFERRED = f"""
rp AS (SELECT p.cell_id, p.step, CAST(row_number() OVER (PARTITION BY p.cell_id, p.step ORDER BY voltage) AS INT) AS ref_id, voltage AS ref_v, height, prominence, width_v, is_shoulder, is_truncated
  FROM det p JOIN refc r ON r.cell_id = p.cell_id AND r.reference_cycle = p.cycle),
ne0 AS (SELECT p.cell_id, p.cycle, p.step, voltage, ref_id, abs(voltage - ref_v) AS far, min(abs(voltage - ref_v)) OVER (PARTITION BY p.cell_id, p.cycle, p.step, p.peak_id) AS own FROM det p JOIN rp ON rp.cell_id = p.cell_id AND rp.step = p.step),
ne AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {K}, ref_id ORDER BY far, voltage) AS k FROM ne0) WHERE k = 1),
fo AS (SELECT {K}, ref_id, voltage AS v FROM ne WHERE far <= 8e-2 AND own >= far - 1e-12),
gr AS (SELECT c.cell_id, c.cycle, c.step, ref_id, min(c.voltage) AS lo, max(c.voltage) AS hi FROM curve c JOIN rp ON rp.cell_id = c.cell_id AND rp.step = c.step WHERE EXISTS (SELECT 1 FROM det p WHERE {on('c', 'p')}) GROUP BY ALL),
mi AS (SELECT g.* FROM gr g LEFT JOIN fo f ON {on('g', 'f')} AND f.ref_id = g.ref_id WHERE f.v IS NULL),
cd AS (SELECT m.cell_id, m.cycle, m.step, m.ref_id, f.v, f.cycle AS near, lo, hi, row_number() OVER (PARTITION BY m.cell_id, m.cycle, m.step, m.ref_id ORDER BY abs(f.cycle - m.cycle), f.cycle) AS k FROM mi m JOIN fo f ON f.cell_id = m.cell_id AND f.step = m.step AND f.ref_id = m.ref_id),
inf AS (SELECT c.cell_id, c.cycle, c.step, c.ref_id, v AS seed_v, near AS inferred_from_cycle, is_shoulder, is_truncated FROM cd c JOIN rp ON rp.cell_id = c.cell_id AND rp.step = c.step AND rp.ref_id = c.ref_id WHERE k = 1 AND v BETWEEN lo AND hi)"""


@shared
def reference_peaks(spark, sf):
    return cut(P.reference_peaks(detected(spark, sf), reference(spark, sf)))


@shared
def inferred(spark, sf):
    return cut(P.infer_missing_seeds(detected(spark, sf), reference_peaks(spark, sf), curves(spark, sf)))


@shared
def final_peaks(spark, sf):
    """Detected peaks and inferred seeds: the starts of the decomposition."""
    return cut(P.append_seeds(detected(spark, sf), inferred(spark, sf)))


@query("g14_reference_peaks", f"WITH {CHAIN}, {INFERRED} SELECT * FROM rp", "ref_v height prominence width_v", "records, cells")
def _(spark, sf):
    return reference_peaks(spark, sf)


@query("g13_inferred_seeds", f"WITH {CHAIN}, {INFERRED} SELECT * FROM inf", "seed_v", "records, cells")
def _(spark, sf):
    return inferred(spark, sf)


ALL_PEAKS = f"""
fin AS (SELECT * EXCLUDE (old), CAST(row_number() OVER (PARTITION BY {K} ORDER BY voltage, is_inferred) AS INT) AS peak_id FROM (
  SELECT * RENAME (peak_id AS old), false AS is_inferred FROM det
  UNION ALL BY NAME SELECT {K}, seed_v AS voltage, is_shoulder, is_truncated, false AS is_recurrent, true AS is_inferred, inferred_from_cycle FROM inf))"""


@query("j6_append_seeds", f"WITH {CHAIN}, {INFERRED}, {ALL_PEAKS} SELECT * FROM fin", PEAK_DOUBLES, "records, cells")
def _(spark, sf):
    return final_peaks(spark, sf)


@query("g15_peak_marks", f"WITH {BLENDS}, {KEEP} SELECT {K}, peak_id, voltage, height, CASE WHEN is_truncated THEN 'truncated' WHEN is_shoulder THEN 'shoulder' ELSE 'primary' END AS kind FROM pks WHERE cycle IN (1, 5, 10, 20)", "voltage height")
def _(spark, sf):
    return P.peak_marks(blend_peaks(spark, sf), cells(spark, sf))
