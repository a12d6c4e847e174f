"""All registered queries, section by section."""

from cyclespark.plans.catalog import curve_tables, cycle_tables, fit_tables, metadata_tables, peak_tables, record_tables, replicate_tables  # noqa: F401
from cyclespark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
