"""Small inputs in few files would keep most cores idle: their rows are dealt out first."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes a core may get before a file's own parts are enough to go by.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores, if it is small and in fewer files than there are cores; else as it
    is. Only for work that takes much longer than moving the rows, and cares for no order."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < cores * SMALL and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df
