"""Queries over cell metadata: parsed texts, chemistry, label/value grids, settings and input files."""

from pyspark.sql import functions as F

from cyclespark.functions import scalars as S
from cyclespark.plans.fixture import cells, shared, table
from cyclespark.plans.registry import query
from cyclespark.sources import grid as G
from cyclespark.sources import inventory as I

MASS = "CASE WHEN p_partkey % 5 = 0 THEN 'n/a' WHEN p_partkey % 5 = 1 THEN NULL ELSE ' ' || CAST(p_size AS VARCHAR(20)) || '.' || CAST(p_partkey % 10 AS VARCHAR(20)) || 'mg' END"


@query("c1_leading_number", "SELECT p_partkey, CASE WHEN p_partkey % 5 > 1 THEN p_size + (p_partkey % 10) / 1e1 END AS mass_mg FROM part", "mass_mg", "")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.leading_number(F.expr(MASS)).alias("mass_mg"))


CLOCK = """CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN CAST(o_orderkey % 50 AS VARCHAR(20)) WHEN 1 THEN CAST(o_orderkey % 59 AS VARCHAR(20)) || ':' || CAST(o_custkey % 60 AS VARCHAR(20))
  WHEN 2 THEN CAST(o_custkey % 30 AS VARCHAR(20)) || ':' || CAST(o_orderkey % 60 AS VARCHAR(20)) || ':07.5' WHEN 3 THEN CAST(o_custkey % 9 AS VARCHAR(20)) || '-1:' || CAST(o_orderkey % 60 AS VARCHAR(20)) || ':00' ELSE 'rest' END"""


@query("c2_duration_seconds", """SELECT o_orderkey, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN o_orderkey % 50 WHEN 1 THEN (o_orderkey % 59) * 60 + o_custkey % 60
  WHEN 2 THEN (o_custkey % 30) * 3600 + (o_orderkey % 60) * 60 + 75e-1 WHEN 3 THEN (o_custkey % 9) * 86400 + 3600 + (o_orderkey % 60) * 60 END AS seconds FROM orders""", "seconds", "")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.duration_seconds(F.expr(CLOCK)).alias("seconds"))


@query("c3_step_sign", "SELECT step, CASE WHEN step = 'Charge' THEN 1 ELSE -1 END AS sign, count(*) AS n FROM records GROUP BY ALL")
def _(spark, sf):
    from cyclespark.plans.fixture import records

    return records(spark, sf).groupBy("step", S.step_sign(F.col("step")).alias("sign")).agg(F.count(F.lit(1)).alias("n"))


@query("c4_composition_key", "SELECT cell_id, CASE cell_no % 4 WHEN 0 THEN 'nmc811' WHEN 1 THEN 'licoo2' WHEN 2 THEN 'lto' ELSE 'nnm' END AS key FROM cells", "", "cells")
def _(spark, sf):
    return cells(spark, sf).select("cell_id", S.composition_key(F.col("composition")).alias("key"))


# Charge per mole of electrons over 3.6, times electrons, over molar mass, to one decimal.
LIBRARY = """CASE cell_no % 4 WHEN 0 THEN 'LiNi0.8Mn0.1Co0.1O2' WHEN 1 THEN 'LiCoO2' WHEN 2 THEN 'Li4Ti5O12' ELSE 'Na0.67Ni0.33Mn0.67O2' END"""
LIBRARY_CAPACITY = """round(CASE cell_no % 4 WHEN 0 THEN 1e0 / 9728e-2 WHEN 1 THEN 1e0 / 97871e-3 WHEN 2 THEN 3e0 / 459083e-3 ELSE 67e-2 / 103578e-3 END * 9648533212e-5 / 36e-1, 1)"""


@query("c5_library_capacity", f"SELECT cell_id, {LIBRARY} AS formula, {LIBRARY_CAPACITY} AS library_mAh_g FROM cells", "library_mAh_g", "cells")
def _(spark, sf):
    return S.with_library_capacity(cells(spark, sf)).select("cell_id", "formula", "library_mAh_g")


@query("c6_chemistry", "SELECT cell_id, CASE cell_no % 4 WHEN 3 THEN 'Na-ion' WHEN 2 THEN 'Unknown' ELSE 'Li-ion' END AS chemistry FROM cells", "", "cells")
def _(spark, sf):
    return cells(spark, sf).select("cell_id", S.infer_chemistry(F.col("composition"), F.col("electrolyte")).alias("chemistry"))


def counter(spark, sf):
    known = S.with_library_capacity(cells(spark, sf))
    stated = F.expr("CASE WHEN cell_no % 7 = 5 THEN ' sodium' END")
    return known.withColumn("m", S.counter_metal(stated, S.infer_chemistry(F.col("composition"), F.col("electrolyte")), F.col("library_ion")))


@query("c7_counter_metal", """SELECT cell_id, CASE WHEN cell_no % 7 = 5 THEN 'So' WHEN cell_no % 4 = 3 THEN 'Na' ELSE 'Li' END AS metal,
  CASE WHEN cell_no % 7 = 5 THEN 'stated' WHEN cell_no % 4 = 2 THEN 'library' ELSE 'chemistry' END AS source FROM cells""", "", "cells")
def _(spark, sf):
    return counter(spark, sf).select("cell_id", "m.metal", "m.source")


@query("c8_counter_mass", """SELECT cell_id, pi() * pow(coalesce(electrode_diameter_mm, 16) / 2e1, 2) * 5e-2 * CASE WHEN cell_no % 7 <> 5 AND cell_no % 4 = 3 THEN 971e-3 ELSE 534e-3 END * 1e3 AS mass_mg FROM cells""", "mass_mg", "cells")
def _(spark, sf):
    return counter(spark, sf).select("cell_id", S.counter_mass_mg(F.col("m.metal"), F.col("electrode_diameter_mm")).alias("mass_mg"))


SHAPE = "3e0 + s_suppkey % 10 * 1e-1 AS centre, 2e-2 + s_suppkey % 7 * 1e-2 AS sigma, s_suppkey % 5 / 4e0 AS fraction"


@query("c19_pseudo_voigt", f"""WITH p AS (SELECT s_suppkey, s_acctbal, {SHAPE} FROM supplier)
SELECT s_suppkey, s_acctbal * ((1 - fraction) * sqrt(ln(2) / pi()) / sigma * exp(-ln(2) * pow((33e-1 - centre) / sigma, 2)) + fraction * sigma / (pi() * (pow(33e-1 - centre, 2) + pow(sigma, 2)))) AS value,
  s_acctbal * ((1 - fraction) * sqrt(ln(2) / pi()) / sigma + fraction / (pi() * sigma)) AS height FROM p""", "value height", "")
def _(spark, sf):
    p = table(spark, sf, "supplier").selectExpr("s_suppkey", "s_acctbal", *SHAPE.split(", "))
    area, c, s, f = F.col("s_acctbal"), F.col("centre"), F.col("sigma"), F.col("fraction")
    return p.select("s_suppkey", S.pseudo_voigt(F.lit(3.3), area, c, s, f).alias("value"), S.pseudo_voigt_height(area, s, f).alias("height"))


# The share outside by summing the density over 4,000 strips of the window.
@query("c21_mass_outside", f"""WITH p AS (SELECT s_suppkey, s_acctbal, {SHAPE} FROM supplier), g AS (SELECT *, sigma / sqrt(2 * ln(2)) AS g FROM p),
t AS (SELECT s_suppkey, sum(exp(-pow((32e-1 + (k + 5e-1) * 3e-1 / 4e3 - centre) / g, 2) / 2) / (g * sqrt(2 * pi()))) * 3e-1 / 4e3 AS inside FROM g, range(4000) r(k) GROUP BY 1)
SELECT s_suppkey, round(1 - inside, 5) AS outside FROM t""", "outside", "")
def _(spark, sf):
    p = table(spark, sf, "supplier").selectExpr("s_suppkey", *SHAPE.split(", "))
    return p.select("s_suppkey", F.round(S.gaussian_mass_outside(F.col("centre"), F.col("sigma"), F.lit(3.2), F.lit(3.5)), 5).alias("outside"))


@shared
def grids(spark, sf):
    """A label/value grid per supplier: labels in column 0, values one or two columns further, a step plan below."""
    n = "CAST(s_suppkey AS STRING)"
    entries = [
        (0, 0, "'Active material:'"), (0, 2, f"concat({n} % 9 + 1, '.25mg')"), (1, 0, "'Volt. upper'"), (1, 1, "'4.6'"), (2, 0, "'Volt. lower'"), (2, 2, "if(s_suppkey % 3 = 0, 'nan', '2.9')"),
        (3, 0, "'Cycle count'"), (3, 2, f"{n}"), (4, 0, "'Barcode'"), (4, 2, f"concat('BC-', {n})"), (5, 0, "'Start time'"), (5, 2, "' 2026-05-08 18:10:29 '"),
        (8, 0, "'Step Index'"), (8, 1, "'Step Name'"), (8, 2, "'C-rate(C)'"), (8, 3, "'Current(A)'"), (8, 4, "'Cut-off current'"),
        (9, 0, "'1'"), (9, 1, "'CCCV Chg'"), (9, 2, "'0.1'"), (9, 3, "concat('0.00', s_suppkey % 7)"), (9, 4, "'9'"),
        (10, 0, "'2'"), (10, 1, "'CC DChg'"), (10, 2, "'0.2'"), (10, 3, "if(s_suppkey % 4 = 0, NULL, '0.003')"),
    ]
    cells_of = ", ".join(f"struct({r} AS r, {c} AS c, CAST({v} AS STRING) AS value)" for r, c, v in entries)
    number = table(spark, sf, "supplier").selectExpr("s_suppkey", f"inline(array({cells_of.replace(f'{n} % 9 + 1', 's_suppkey % 9 + 1')}))")
    return number.selectExpr("concat('g', s_suppkey) AS cell_id", "r", "c", "value")


@query("a7_cell_metadata", """SELECT 'g' || s_suppkey AS cell_id, s_suppkey % 9 + 125e-2 AS active_mass_mg, 46e-1 AS voltage_upper_v, CASE WHEN s_suppkey % 3 <> 0 THEN 29e-1 END AS voltage_lower_v,
  CAST(s_suppkey AS INT) AS cycle_count, 'BC-' || s_suppkey AS barcode, '2026-05-08 18:10:29' AS test_start_date FROM supplier""", "active_mass_mg voltage_upper_v voltage_lower_v", "")
def _(spark, sf):
    return G.cell_metadata(grids(spark, sf))


@query("a8_step_plan", """SELECT 'g' || s_suppkey AS cell_id, 1e-1 AS c_rate, (s_suppkey % 7) / 1e3 AS charge_current_a, CASE WHEN s_suppkey % 4 <> 0 THEN 3e-3 END AS discharge_current_a FROM supplier""",
       "c_rate charge_current_a discharge_current_a", "")
def _(spark, sf):
    return G.step_plan(grids(spark, sf))


@query("a9_cell_value", """SELECT 'g' || s_suppkey AS cell_id, r, c, CASE WHEN r = 1 THEN '4.6' WHEN r = 2 AND s_suppkey % 3 <> 0 THEN '2.9' END AS value FROM supplier, (VALUES (1, 1), (2, 2), (99, 0)) w(r, c)""", "", "")
def _(spark, sf):
    asked = table(spark, sf, "supplier").selectExpr("concat('g', s_suppkey) AS cell_id", "inline(array(struct(1 AS r, 1 AS c), struct(2 AS r, 2 AS c), struct(99 AS r, 0 AS c)))")
    return G.cell_value(grids(spark, sf), asked)


@query("a6_config_drift", """SELECT s_name AS key, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS at_start,
  CASE WHEN s_suppkey % 11 <> 0 THEN CAST(s_nationkey + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS at_end FROM supplier
  WHERE (s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 11 = 0) AND NOT (s_suppkey % 7 = 0 AND s_suppkey % 11 = 0)""", "", "")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    start = s.filter("s_suppkey % 7 <> 0").selectExpr("s_name AS key", "CAST(s_nationkey AS STRING) AS value")
    end = s.filter("s_suppkey % 11 <> 0").selectExpr("s_name AS key", "CAST(s_nationkey + IF(s_suppkey % 5 = 0, 1, 0) AS STRING) AS value")
    return I.config_drift(start, end)


@query("a2_find_files")
def _(spark, sf):
    return I.find_files(spark, sf, "parquet").select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")


@query("a4_file_checksums")
def _(spark, sf):
    return I.file_inventory(spark, sf, "*.parquet").select("file_name", "bytes", "sha256", "empty")
