"""Battery-cycling analytics as Spark DataFrame operators."""

from cyclespark.schema import CELL, HALF, SLICED

__all__ = ["CELL", "HALF", "SLICED"]
