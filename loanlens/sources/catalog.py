"""Source mapping: table name -> DataFrame.

Operators receive a `Sources` object and ask for the tables (and columns)
they need. Tables load lazily: nothing is read until an operator asks, and
Catalyst prunes the columns it does not use down to the parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType


class MissingColumns(ValueError):
    """Raised when a table lacks columns an operator needs."""


def require(df: DataFrame, columns: list[str] | tuple[str, ...], what: str = "input") -> DataFrame:
    """Fail early, with the missing names, if `df` lacks any of `columns`."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in columns if c.lower() not in have]
    if missing:
        raise MissingColumns(f"{what} is missing columns: {', '.join(missing)}")
    return df


def active(df: DataFrame, flag: str = "is_delete") -> DataFrame:
    """Rows that are not soft-deleted: `flag IS NULL` (is_delete / deleted_at)."""
    return df.where(F.col(flag).isNull())


# an instant as its UTC wall time, free of the session's time zone
UTC_WALL = "timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(unix_micros(`{0}`) as decimal(20, 0)) / 1000000)"


def utc_ntz(df: DataFrame) -> DataFrame:
    """Columns of type timestamp (an instant) as their UTC wall time without
    zone, whatever the session's zone is; other columns unchanged."""
    zoned = {f.name for f in df.schema.fields if isinstance(f.dataType, TimestampType)}
    if not zoned:
        return df
    return df.selectExpr(*[f"{UTC_WALL.format(c)} AS `{c}`" if c in zoned else f"`{c}`" for c in df.columns])


class Sources(Mapping):
    """Lazy mapping of source table names to DataFrames; timestamps are UTC wall
    times without zone, so no result depends on the session's time zone."""

    def __init__(
        self,
        frames: Mapping[str, DataFrame] | None = None,
        loader: Callable[[str], DataFrame] | None = None,
    ) -> None:
        self._frames: dict[str, DataFrame] = dict(frames or {})
        self._loader = loader
        self._utc: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if self._loader is None:
                raise KeyError(f"no source table named {name!r}")
            self._frames[name] = self._loader(name)
        if name not in self._utc:
            self._utc[name] = utc_ntz(self._frames[name])
        return self._utc[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)

    def table(self, name: str, *columns: str) -> DataFrame:
        """The table `name`, checked to have `columns` (all columns kept)."""
        return require(self[name], columns, what=f"source table {name!r}")

    def with_tables(self, **frames: DataFrame) -> "Sources":
        """A copy with some tables replaced (used by tests and plans)."""
        merged = dict(self._frames)
        merged.update(frames)
        return Sources(merged, self._loader)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> "Sources":
        """Tables of a catalog database, e.g. a warehouse schema."""
        return cls(loader=lambda name: _declared(spark.table(f"{database}.{name}"), name))

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "Sources":
        """One parquet dataset per table under `root/<name>`."""
        root = root.rstrip("/")
        return cls(loader=lambda name: _declared(spark.read.parquet(f"{root}/{name}"), name))


def _declared(df: DataFrame, name: str) -> DataFrame:
    """`df` with the declared types on the columns it shares with the declared
    schema of `name`; other columns and tables as they are."""
    from loanlens.sources.schemas import SCHEMAS

    df = utc_ntz(df)
    types = {c.lower(): t for c, t in SCHEMAS.get(name, [])}
    return df.select(*[F.col(f"`{c}`").cast(types[c.lower()]).alias(c) if c.lower() in types else F.col(f"`{c}`") for c in df.columns])


def lit_date(value) -> Column:
    """A DATE literal from a `datetime.date` or an ISO string."""
    return F.lit(str(value)).cast("date")
