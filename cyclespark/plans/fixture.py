"""Cycler tables derived from the shared test tables.

``lineitem`` is read as a cycler log and ``supplier`` as the list of cells.
Every expression is plain arithmetic (no transcendental functions), so any SQL
engine produces the same bits.  All of it is a scan-time projection: no
shuffle is needed to obtain the records, and the number of cells and
half-cycles grows with the tables.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclespark.operators.clean import tidy_steps

# Ordered stages: each may use the columns of the stages before it.
_KEYS = {
    "cell_no": "CAST(floor(l_suppkey / 1e1) AS BIGINT)",
    "cycle": "CAST(1 + l_partkey % 20 AS INT)",
    "charging": "l_linestatus = 'O'",
    "position": "{day} * 10000000000000 + (l_orderkey % 1000000000) * 10000 + (l_partkey % 100) * 10 + l_linenumber",
}
_POSITION = {
    "seq": "(cycle * 2 + CASE WHEN charging THEN 0 ELSE 1 END) * 25000000000000000 + position",
    "x": "CAST(position AS DOUBLE) / 25e15",
    "rate": "CASE WHEN cell_no % 2 = 0 THEN 1e0 WHEN cycle <= 5 THEN 1e0 WHEN cycle <= 10 THEN 2e0 "
    "WHEN cycle <= 14 THEN 5e0 ELSE 1e0 END",
    "step_type": "CASE WHEN l_tax > 75e-3 THEN 'Rest' WHEN charging AND cell_no % 2 = 0 THEN 'CCCV Chg' "
    "WHEN charging THEN ' CC Chg' ELSE 'CC DChg ' END",
}
_SHAPE = {
    "u": "CASE WHEN charging THEN x ELSE 1e0 - x END",
    "health": "CASE WHEN cell_no % 7 = 3 AND cycle > 16 AND NOT charging THEN 1e-2 ELSE 1e0 END "
    "* (1e0 - cycle * (4e-3 + (cell_no % 4) * 1e-3)) / (9e-1 + rate * 1e-1) "
    "* (CASE WHEN charging THEN 1e0 WHEN cycle = 1 THEN 9e-1 WHEN cycle = 2 THEN 97e-2 WHEN cycle = 3 THEN 985e-3 "
    "ELSE 995e-3 - (cell_no % 3) * 1e-3 END)",
    "shift": "(CASE WHEN charging THEN 1e0 ELSE -1e0 END) * (5e-3 + cycle * 4e-4) + (cell_no % 5) * 1e-3",
}
_LOCAL = {
    "z": "CASE WHEN cell_no % 3 <> 0 THEN 2e0 * u - 1e0 WHEN u < 5e-1 THEN 4e0 * u - 1e0 ELSE 4e0 * u - 3e0 END",
}
_MEASURED = {
    "voltage": "floor(((CASE WHEN cell_no % 3 = 0 AND u < 5e-1 THEN 34e-1 + 2e-1 * (25e-2 * z + 75e-2 * z * z * z) "
    "WHEN cell_no % 3 = 0 THEN 38e-1 + 2e-1 * (25e-2 * z + 75e-2 * z * z * z) "
    "WHEN cell_no % 3 = 1 THEN 36e-1 + 4e-1 * (15e-2 * z + 85e-2 * z * z * z) "
    "ELSE 36e-1 + 4e-1 * (2e-2 * z + 98e-2 * z * z * z * z * z * z * z * z * z) END) "
    "+ shift + (l_discount - 5e-2) * 2e-2) * 1e4 + 5e-1) / 1e4",
    "slope": "CASE WHEN cell_no % 3 = 0 THEN 8e-1 * (25e-2 + 225e-2 * z * z) "
    "WHEN cell_no % 3 = 1 THEN 8e-1 * (15e-2 + 255e-2 * z * z) "
    "ELSE 8e-1 * (2e-2 + 882e-2 * z * z * z * z * z * z * z * z) END",
    "passed": "150e0 * health * x",
    "current_a": "(CASE WHEN charging THEN 1e-3 ELSE -1e-3 END) * rate * (CASE WHEN x > 95e-2 THEN 5e-1 ELSE 1e0 END)",
    "time_s": "floor(x * 36e3 / rate)",
}
_OUTPUT = {
    "dqdv": "(CASE WHEN charging THEN 1e0 ELSE -1e0 END) * (CASE WHEN l_returnflag = 'R' AND l_linenumber <= 2 "
    "THEN -1e0 ELSE 1e0 END) * 150e0 * health / slope",
    "charge_capacity": "CASE WHEN charging THEN passed END",
    "discharge_capacity": "CASE WHEN NOT charging THEN passed END",
    "charge_energy": "CASE WHEN charging THEN passed * 36e-1 END",
    "discharge_energy": "CASE WHEN NOT charging THEN passed * 36e-1 END",
    "power_w": "abs(current_a) * voltage",
    "end_reason": "CASE WHEN l_linenumber = 7 THEN '' WHEN x > 95e-2 THEN 'Time limit' ELSE NULL END",
}
_STAGES = (_KEYS, _POSITION, _SHAPE, _LOCAL, _MEASURED, _OUTPUT)

# Half-cycles cut short: one stopped early in mid-life, one still running at the end.
_CUT_SHORT = (
    "NOT (cell_no % 5 = 2 AND cycle = 9 AND charging AND x > 7e-1) "
    "AND NOT (cell_no % 4 = 1 AND cycle = 20 AND NOT charging AND x > 5e-1)"
)

RAW_COLUMNS = (
    "cell_id", "cell_no", "cycle", "step_type", "seq", "voltage", "current_a", "time_s", "rate",
    "dqdv", "charge_capacity", "discharge_capacity", "charge_energy", "discharge_energy",
    "power_w", "end_reason",
)
_DAY_SPARK = "datediff(l_shipdate, DATE '1995-01-01')"
_DAY_SQL = "date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))"


_SHARED: dict[tuple, DataFrame] = {}


def shared(build):
    """Build a table once per (application, input), so that branches reading it share one plan."""

    @wraps(build)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, build.__module__, build.__name__)
        if key not in _SHARED:
            _SHARED[key] = build(spark, sf_dir)
        return _SHARED[key]

    return get


def forget() -> None:
    """Drop the kept tables, so that the next query builds its own (timing, or new files under the same path)."""
    _SHARED.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycler log as exported: step types untidied, rest records present."""
    df = table(spark, sf_dir, "lineitem")
    for stage in _STAGES:
        columns = [F.expr(e.replace("{day}", _DAY_SPARK)).alias(n) for n, e in stage.items()]
        if stage is _MEASURED:
            # One generated row per record: the curve is evaluated once, and filters on the
            # voltage are not rewritten into copies of its expression.
            df = df.select("*", F.inline(F.array(F.struct(*columns))))
        else:
            df = df.select("*", *columns)
    return df.filter(_CUT_SHORT).select(
        F.concat(F.lit("cell_"), F.col("cell_no").cast("string")).alias("cell_id"), *RAW_COLUMNS[1:]
    )


@shared
def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidied records, ready for every record-level operator."""
    tidy = tidy_steps(raw_records(spark, sf_dir), "step_type").withColumnRenamed("step_type", "step")
    return tidy.withColumn("capacity", F.coalesce("charge_capacity", "discharge_capacity"))


def raw_sql() -> str:
    """CTEs ``raw`` (the export) for the SQL oracle."""
    inner = "lineitem"
    for stage in _STAGES:
        columns = ", ".join(f"{e.replace('{day}', _DAY_SQL)} AS {n}" for n, e in stage.items())
        inner = f"(SELECT *, {columns} FROM {inner})"
    rest = ", ".join(RAW_COLUMNS[1:])
    return f"raw AS (SELECT 'cell_' || CAST(cell_no AS VARCHAR) AS cell_id, {rest} FROM {inner} WHERE {_CUT_SHORT})"


def records_sql() -> str:
    return (
        raw_sql()
        + ", records AS (SELECT * EXCLUDE (step_type), CASE WHEN trim(step_type) LIKE '%DChg' THEN 'Discharge' "
        "ELSE 'Charge' END AS step, coalesce(charge_capacity, discharge_capacity) AS capacity "
        "FROM raw WHERE lower(step_type) NOT LIKE '%rest%')"
    )


# One cell per ten suppliers.
_CELLS = {
    "composition": "CASE CAST(cell_no % 4 AS INT) WHEN 0 THEN 'NMC-811' WHEN 1 THEN 'LiCoO2' WHEN 2 THEN 'LTO' ELSE 'NNM' END",
    "electrolyte": "CASE WHEN cell_no % 4 = 3 THEN '1M NaPF6 in EC' WHEN cell_no % 4 = 2 THEN NULL ELSE '1M LiPF6 in EC' END",
    "electrode_type": "CASE WHEN cell_no % 4 = 2 THEN 'Negative' ELSE 'positive' END",
    "active_mass_mg": "8e0 + n_sources / 1e1 + (cell_no % 5) * 5e-1",
    "blend": "CASE WHEN cell_no % 3 = 0 THEN '80/10/10' WHEN cell_no % 3 = 1 THEN '90/5/5' ELSE NULL END",
    "electrode_diameter_mm": "CASE WHEN cell_no % 5 = 4 THEN NULL ELSE 12e0 + cell_no % 3 END",
    "theoretical_mAh_g": "CASE WHEN cell_no % 3 = 0 THEN NULL WHEN cell_no % 3 = 1 THEN 118e0 ELSE 170e0 END",
    "charge_rate_c": "CASE WHEN cell_no % 6 = 1 THEN NULL ELSE 1e-1 END",
    "voltage_lower_v": "CASE WHEN cell_no % 5 = 3 THEN NULL ELSE 31e-1 END",
    "voltage_upper_v": "CASE WHEN cell_no % 5 = 3 THEN NULL ELSE 41e-1 END",
    "max_cycle": "CAST(CASE WHEN cell_no % 3 = 0 THEN 15 WHEN cell_no % 3 = 1 THEN 0 ELSE NULL END AS INT)",
}
_CELLS_BASE = (
    "SELECT CAST(floor(s_suppkey / 1e1) AS BIGINT) AS cell_no, count(*) AS n_sources, max(s_name) AS supplier_name "
    "FROM supplier GROUP BY 1"
)


@shared
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell dimension: one row per cell with its stated parameters."""
    base = (
        table(spark, sf_dir, "supplier")
        .groupBy(F.expr("CAST(floor(s_suppkey / 1e1) AS BIGINT)").alias("cell_no"))
        .agg(F.count(F.lit(1)).alias("n_sources"), F.max("s_name").alias("supplier_name"))
    )
    return base.select(
        F.concat(F.lit("cell_"), F.col("cell_no").cast("string")).alias("cell_id"),
        "*",
        *[F.expr(e).alias(n) for n, e in _CELLS.items()],
        F.array(*[F.lit(c) for c in (1, 5, 10, 20)]).alias("key_cycles"),
    )


def cells_sql() -> str:
    columns = ", ".join(f"{e} AS {n}" for n, e in _CELLS.items())
    return f"cells AS (SELECT 'cell_' || CAST(cell_no AS VARCHAR) AS cell_id, *, {columns}, [1,5,10,20] AS key_cycles FROM ({_CELLS_BASE}))"
