"""Readers and writers: CSV and parquet datasets, multi-format export,
date-suffixed table replacement.

Paths are any Hadoop-compatible URI (object store, HDFS, local); Spark's
file-system connectors do the transfer, in parallel, from the executors.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators.ordering import with_position
from loanlens.sources.csv_records import WRITE_OPTIONS, read_csv

FORMATS = ("csv", "parquet")


def _check_format(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"Invalid file format {fmt!r}. Please choose 'csv' or 'parquet'.")
    return fmt


def read_dataset(spark: SparkSession, path: str, fmt: str = "csv", schema=None, malformed: str | None = None) -> DataFrame:
    """Read a CSV (header, read by record, types inferred from all rows unless
    `schema`) or parquet dataset; any other format raises ValueError.
    `malformed` names a column for CSV records that do not fit the schema."""
    _check_format(fmt)
    if fmt == "csv":
        return read_csv(spark, path, schema, malformed)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_dataset(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write `df` as one CSV (with header, no index) or parquet dataset,
    replacing what is there; any other format raises ValueError. CSV keeps every
    text as it is: quotes, line breaks and blanks, and empty apart from null."""
    _check_format(fmt)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        if len(df.columns) == 1 and not df.where(F.col(f"`{df.columns[0]}`").isNull()).isEmpty():
            raise ValueError("a CSV of one column cannot hold nulls: their lines would be blank and are not written")
        writer = writer.options(**WRITE_OPTIONS)
    writer.save(path)
    return path


def write_multi(df: DataFrame, root: str | None, path: str, name: str,
                formats: tuple[str, ...] = FORMATS) -> dict[str, str]:
    """Write the same frame in several formats under `<root>/<path>/<name>.<fmt>`.

    Returns a `format -> location` manifest. A missing root raises; the
    leading '/' of `path` is dropped; a failing format is recorded under
    'error' and stops the remaining ones, keeping earlier entries.
    """
    if not root:
        raise ValueError("Please provide the root (bucket or base folder) to write to")
    for fmt in formats:
        _check_format(fmt)
    path = path.lstrip("/")
    base = f"{root.rstrip('/')}/{path}/{name}"
    results: dict[str, str] = {}
    source = df
    try:
        # parquet first: the other formats are written from it, not computed again
        for fmt in sorted(formats, key=lambda f: f != "parquet"):
            write_dataset(source, f"{base}.{fmt}", fmt)
            results[fmt] = f"{base}.{fmt}"
            if fmt == "parquet":
                source = df.sparkSession.read.schema(df.schema).parquet(results[fmt])
    except Exception as exc:  # noqa: BLE001 - reported in the manifest, as the source does
        results["error"] = str(exc)
    return results


def table_name(schema: str, base: str, run_date: _dt.date | str | None = None) -> str:
    """`<schema>.<base>_<yyyymmdd>` for the run date (today when omitted)."""
    if run_date is None:
        run_date = _dt.date.today()
    if isinstance(run_date, str):
        run_date = _dt.date.fromisoformat(run_date)
    return f"{schema}.{base}_{run_date.strftime('%Y%m%d')}"


def replace_table(df: DataFrame, schema: str, base: str, run_date=None, keep: int = 2) -> str:
    """Create or replace the date-suffixed table from `df`; returns its name.

    The rows are written as a new version, `<name>__v<number>_<id>`, which nobody
    reads yet (the id keeps it apart from what a failed write may have left); then the view `<name>` is pointed at it, one change of the catalog.
    So a write that fails leaves the old rows in place, readers never find the
    table absent or half written, and queries that began on an old version go on
    reading it. Of the versions, the newest `keep` stay.
    """
    if keep < 1:
        raise ValueError("at least the version just written must be kept")
    spark, name = df.sparkSession, table_name(schema, base, run_date)
    old = versions(spark, name)
    version = f"{name}__v{old[-1][0] + 1 if old else 1:06d}_{uuid.uuid4().hex[:8]}"
    try:
        df.write.saveAsTable(version)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {version}")
        raise
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        # written by an earlier release as a plain table: it becomes a version of its own, once
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}__v000000_plain")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    for _, gone in versions(spark, name)[:-keep]:
        spark.sql(f"DROP TABLE IF EXISTS {gone}")
    return name


def versions(spark: SparkSession, name: str) -> list[tuple[int, str]]:
    """(number, table) of the versions that are kept of a table, oldest first."""
    schema, _, base = name.rpartition(".")
    found = [r.tableName for r in spark.sql(f"SHOW TABLES IN {schema} LIKE '{base}__v*'").collect()]
    marked = [(t[len(base) + 3:].partition("_")[0], t) for t in found]
    return sorted((int(n), f"{schema}.{t}") for n, t in marked if n.isdigit())


def write_ordered(df: DataFrame, order: Sequence[Column | str], path: str, name: str = "position", parts: int | None = None) -> str:
    """Write `df` as parquet in the total order `order`, every row with its
    0-based place `name`; returns the path. The files are ranges of the order,
    sorted inside, and the place says it whatever reads them: a reader that needs
    rows n..m filters on it and skips the other files by their statistics."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = with_position(df, order, name, parts)
    placed.repartitionByRange(parts, name).sortWithinPartitions(name).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path
