"""Keys and schemas shared by every operator.

A *half-cycle* is the set of records sharing (cell_id, cycle, step).  Record
order is carried explicitly by ``seq``; a very long half-cycle is cut into
``slice`` pieces (see ``operators.ordered``) so that no task ever has to hold
a whole one.
"""

from pyspark.sql import types as T

CELL = ["cell_id"]
CYCLE = ["cell_id", "cycle"]
HALF = ["cell_id", "cycle", "step"]
SLICED = ["cell_id", "cycle", "step", "slice"]

# Source columns of a cycler record export, in export order (fixed values).
EXPORT_SCHEMA = T.StructType(
    [
        T.StructField("DataPoint", T.StringType()),
        T.StructField("Cycle Index", T.StringType()),
        T.StructField("Step Index", T.StringType()),
        T.StructField("Step Type", T.StringType()),
        T.StructField("Time", T.StringType()),
        T.StructField("Cumulative Time", T.StringType()),
        T.StructField("Current(A)", T.StringType()),
        T.StructField("Voltage(V)", T.StringType()),
        T.StructField("Capacity(Ah)", T.StringType()),
        T.StructField("Spec. Cap.(mAh/g)", T.StringType()),
        T.StructField("Chg. Cap.(Ah)", T.StringType()),
        T.StructField("Chg. Spec. Cap.(mAh/g)", T.StringType()),
        T.StructField("DChg. Cap.(Ah)", T.StringType()),
        T.StructField("DChg. Spec. Cap.(mAh/g)", T.StringType()),
        T.StructField("Energy(Wh)", T.StringType()),
        T.StructField("Spec. Energy(mWh/g)", T.StringType()),
        T.StructField("Chg. Energy(Wh)", T.StringType()),
        T.StructField("Chg. Spec. Energy(mWh/g)", T.StringType()),
        T.StructField("DChg. Energy(Wh)", T.StringType()),
        T.StructField("DChg. Spec. Energy(mWh/g)", T.StringType()),
        T.StructField("Date", T.StringType()),
        T.StructField("Power(W)", T.StringType()),
        T.StructField("dQ/dV(mAh/V)", T.StringType()),
        T.StructField("dQm/dV(mAh/V.g)", T.StringType()),
        T.StructField("Contact resistance(mΩ)", T.StringType()),
        T.StructField("Module start-stop switch", T.StringType()),
    ]
)

# Canonical name and type of each export column.
CANONICAL = {
    "DataPoint": ("seq", "bigint"),
    "Cycle Index": ("cycle", "int"),
    "Step Index": ("step_index", "int"),
    "Step Type": ("step", "string"),
    "Time": ("time_txt", "string"),
    "Cumulative Time": ("total_time_txt", "string"),
    "Current(A)": ("current_a", "double"),
    "Voltage(V)": ("voltage", "double"),
    "Capacity(Ah)": ("capacity_ah", "double"),
    "Spec. Cap.(mAh/g)": ("spec_capacity", "double"),
    "Chg. Cap.(Ah)": ("charge_ah", "double"),
    "Chg. Spec. Cap.(mAh/g)": ("charge_capacity", "double"),
    "DChg. Cap.(Ah)": ("discharge_ah", "double"),
    "DChg. Spec. Cap.(mAh/g)": ("discharge_capacity", "double"),
    "Energy(Wh)": ("energy_wh", "double"),
    "Spec. Energy(mWh/g)": ("spec_energy", "double"),
    "Chg. Energy(Wh)": ("charge_wh", "double"),
    "Chg. Spec. Energy(mWh/g)": ("charge_energy", "double"),
    "DChg. Energy(Wh)": ("discharge_wh", "double"),
    "DChg. Spec. Energy(mWh/g)": ("discharge_energy", "double"),
    "Date": ("recorded_at", "timestamp"),
    "Power(W)": ("power_w", "double"),
    "dQ/dV(mAh/V)": ("dqdv_abs", "double"),
    "dQm/dV(mAh/V.g)": ("dqdv", "double"),
    "Contact resistance(mΩ)": ("contact_resistance", "double"),
    "Module start-stop switch": ("switch_state", "string"),
}

# Step names written by the cycler (fixed values).
STEP_NAMES = {
    "CCCV Chg": "Charge",
    "CCCV CHG": "Charge",
    "CC Chg": "Charge",
    "CC CHG": "Charge",
    "CC DChg": "Discharge",
    "CC DCHG": "Discharge",
    "CCCV DChg": "Discharge",
}
