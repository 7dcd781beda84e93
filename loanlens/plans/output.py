"""Output edge: decimals become doubles only when a table leaves the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def edge(df: DataFrame) -> DataFrame:
    """Cast decimal columns to double; other columns unchanged, order kept."""
    cols = [
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)
