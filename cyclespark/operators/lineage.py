"""Cut the lineage of derived tables that several branches read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

#: Deletes a job's shuffle files when it ends; else they stay until the driver collects its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder named by ``spark.checkpoint.dir``.

    Survives the loss of executors.  A temporary folder is used only where none
    is configured and all runs in one process; a cluster must name one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    # Nothing reads the shuffles of a kept table again. A plan takes the setting when it is made.
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        conf.set(CLEAN_UP, before)
