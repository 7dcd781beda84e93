"""Stage hand-offs.

The source pipeline hands each stage to the next as a written table (feature
table -> prep -> targets). Here a hand-off is a parquet table in a folder of
its own below the shared folder the cluster names in `spark.checkpoint.dir`:
later plans read it with column pruning and filter pushdown, stay small, and a
lost executor reads the files again. `clear` removes the folders that a
session's hand-offs wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loanlens.session import checkpoint_dir

_WRITTEN: list[str] = []


def handoff(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write `df` as parquet (to `path`, else a new folder) and read it back."""
    if path is None:
        path = f"{checkpoint_dir(df.sparkSession)}/stages/{uuid.uuid4().hex}"
        _WRITTEN.append(path)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the folders written by `handoff` without a path; returns how many.
    Frames that read them must not be used afterwards."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    n = len(_WRITTEN)
    while _WRITTEN:
        path = hadoop(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
