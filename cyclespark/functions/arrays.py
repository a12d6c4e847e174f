"""Functions over batches of rows that hold arrays."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def on_arrays(function: Callable[..., pd.DataFrame], kind: str):
    """A column function from one of pandas columns to a frame with the columns that ``kind`` lists.

    Arrays pass as numpy arrays both ways. A pandas function's result would be made lists of single numbers first, which takes
    longer than the work on a curve itself.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(kind))

    def run(*columns: pa.Array) -> pa.Array:
        frame = function(*[c.to_pandas() for c in columns])
        return pa.StructArray.from_arrays([pa.array(frame[f.name].tolist() if pa.types.is_list(f.type) else frame[f.name], f.type) for f in schema], fields=list(schema))

    run.__name__ = function.__name__
    return F.arrow_udf(run, kind)
