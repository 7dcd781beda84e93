"""Session helpers.

Operators never create sessions; they take DataFrames. These helpers are for
scripts, tests and the bench. Every setting here is a runtime SQL conf or a
builder conf a Spark user would set.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime settings the library relies on or benefits from. None of them
# changes results; they only shape the physical plan.
RUNTIME_CONF = {
    # AQE: coalesce small shuffle partitions, split skewed join partitions,
    # and turn shuffle joins into broadcast joins when the runtime size of a
    # side is proven small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Static broadcast only below this estimated size; beyond it the planner
    # falls back to a shuffle join. Never -1 (unchecked) and never huge.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}

# Bytes of shuffled input of one task, and how many times the shuffle partitions
# are cut finer before AQE puts them together up to that size: a task of many
# joins and aggregates then holds as much on large inputs as on small ones.
TASK_BYTES = "16m"
FINER = 4

# Call-site capture for DataFrame error messages costs several JVM round
# trips per Column function call; with plans of a few thousand expressions
# that is seconds of driver time per query. Errors still carry the SQL
# context; only the Python call site is dropped.
DEBUG_CONF = "spark.python.sql.dataFrameDebugging.enabled"


def fast_planning(spark: SparkSession) -> None:
    """Turn off per-call Python call-site capture where Spark allows it.

    The conf is static: it takes effect when set at session build time (as
    `get_session` does). On a session built elsewhere it cannot change, and
    planning simply keeps capturing call sites (slower, same results).
    """
    if spark.conf.isModifiable(DEBUG_CONF) and spark.conf.get(DEBUG_CONF, "true").lower() != "false":
        spark.conf.set(DEBUG_CONF, "false")


def bounded_tasks(spark: SparkSession) -> None:
    """Bound what one task reads after a shuffle, where the session says nothing
    of its own about it (same results, more and smaller tasks)."""
    size, number = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(size, None) is None and spark.conf.get(number, None) is None:
        spark.conf.set(size, TASK_BYTES)
        spark.conf.set(number, str(FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))))


# Whether the class generated for a stage is named after the stage's number.
CLASS_CONF = "spark.sql.codegen.useIdInClassName"


@contextmanager
def shared_code(spark: SparkSession) -> Iterator[None]:
    """For what is run inside: stages of one query that do the same on different
    columns share one generated class (same results). Else each is compiled, and
    begins interpreted, anew."""
    old = spark.conf.get(CLASS_CONF, None)
    spark.conf.set(CLASS_CONF, "false")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(CLASS_CONF)
        else:
            spark.conf.set(CLASS_CONF, old)


def get_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "loanlens",
    extra_conf: dict | None = None,
) -> SparkSession:
    """Return a session for scripts/tests; the UI stays off."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LOANLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config(DEBUG_CONF, "false")
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    fast_planning(spark)
    bounded_tasks(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in `spark.checkpoint.dir` (or
    that was set on the context); it must be set."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")
