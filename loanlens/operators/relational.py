"""Relational building blocks shared by the operators.

Top-1 per key is an aggregation (`max_by` of the other columns over the struct
of order keys), not a window: it combines map-side, so a key that holds a third
of all rows still reaches the shuffle as one row per map task, and no single
task ever holds a whole group. Callers select the columns they need first;
only those are carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampType

from loanlens.functions.exprs import as_ntz, parse_date
from loanlens.plans.stages import handoff
from loanlens.sources.catalog import UTC_WALL

ColumnOrName = Column | str


def _col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def latest_by(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[ColumnOrName],
    tiebreak: Sequence[ColumnOrName] = (),
    earliest: bool = False,
) -> DataFrame:
    """One row per `keys`: the row with the greatest (`order`, `tiebreak`).

    Equals `ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order DESC, tiebreak
    DESC) = 1` with nulls last, or with `earliest` the smallest row (ascending,
    nulls first). The tie-break makes the choice deterministic.
    """
    keys = list(keys)
    place = F.struct(*[_col(c).alias(f"o{i}") for i, c in enumerate([*order, *tiebreak])])
    payload = F.struct(*[c for c in df.columns if c not in keys])
    pick = F.min_by(payload, place) if earliest else F.max_by(payload, place)
    out = df.groupBy(*keys).agg(pick.alias("_row"))
    return out.select(*keys, "_row.*").select(*df.columns)


def typed_time(df: DataFrame, name: str) -> Column:
    """A date or timestamp column as UTC wall time; text is parsed as
    yyyy-MM-dd and raises if it is none."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, StringType):
        return as_ntz(parse_date(name, strict=True))
    if isinstance(dtype, TimestampType):
        return F.expr(UTC_WALL.format(name))
    return as_ntz(name)


def same_id(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> Column:
    """Equality of two ids; as text if their types differ."""
    a, b = left[left_key], right[right_key]
    if left.schema[left_key].dataType == right.schema[right_key].dataType:
        return a == b
    return a.cast("string") == b.cast("string")


def in_keys(df: DataFrame, keys_df: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows of `df` whose key appears in `keys_df` (semi join, no collect)."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(keys_df.select(*on).distinct(), on=on, how="left_semi")


def not_in_keys(df: DataFrame, keys_df: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows of `df` whose key does not appear in `keys_df` (anti join)."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(keys_df.select(*on).distinct(), on=on, how="left_anti")


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: ColumnOrName,
    right_time: ColumnOrName,
    tiebreak: Sequence[ColumnOrName] = (),
) -> DataFrame:
    """Per key, the right row with the latest `right_time <= left_time`.

    `left` must have one row per key (or rows that agree on `left_time`).
    """
    joined = right.join(left, on=key, how="inner").where(_col(right_time) <= _col(left_time))
    return latest_by(joined, [key], [right_time], tiebreak)


def unnest(df: DataFrame, array_col: str) -> DataFrame:
    """One row per element of an array of structs; null/empty arrays drop the row."""
    others = [c for c in df.columns if c != array_col]
    return df.select(*others, F.inline(F.col(array_col)))


def first_by(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[ColumnOrName],
    tiebreak: Sequence[ColumnOrName] = (),
) -> DataFrame:
    """One row per `keys`: the first row by ascending (`order`, `tiebreak`),
    nulls first (a sort-then-keep-first de-dup, made deterministic)."""
    return latest_by(df, keys, order, tiebreak, earliest=True)


def join_as_string(left: DataFrame, left_key: str, right: DataFrame, right_key: str,
                   how: str = "inner") -> DataFrame:
    """Equi-join where the left key is an integer id and the right key its text
    (the integer side is cast; never through double, so '123.0' cannot arise)."""
    return left.join(right, left[left_key].cast("string") == right[right_key], how)


def slice_window(df: DataFrame, windows: DataFrame, key: str, t: str, lo: str, hi: str) -> DataFrame:
    """Rows of `df` whose `t` lies in their key's [lo, hi] window (both ends
    included); `windows` has one row per key."""
    joined = df.join(windows, on=key, how="inner")
    return joined.where((F.col(t) >= F.col(lo)) & (F.col(t) <= F.col(hi)))


def asof_tagged(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    tiebreak: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Per row of `left`, the right row of its `key` with the latest
    `right_time <= left_time` (ties: the greatest `tiebreak`); rows without one
    are left out. `left` may have any number of rows per key.

    Both sides go into one run, sorted by (key, time) and range-partitioned, so a
    key with any share of the rows lies in many partitions and is never joined
    row by row. Inside a partition a window carries the last right row forward;
    across partition borders a table of one row per partition carries it, for the
    key that goes on there. Null keys and times match nothing.
    """
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = [F.col(c) for c in tiebreak]
    payload = F.struct(*[F.col(c) for c in right.columns if c != key])
    rows = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*ties, F.lit(0)).alias("_tie"),
                        payload.alias("_right"))
    asks = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"),
                       F.struct(*[c for c in left.columns if c != key]).alias("_left"))
    run = rows.unionByName(asks, allowMissingColumns=True).where(F.col("_k").isNotNull() & F.col("_t").isNotNull())
    order = ["_k", "_t", "_side", F.col("_tie").asc_nulls_last(), "_salt"]
    run = run.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))  # spreads rows that are equal in all this
    run = handoff(run.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn(
        "_part", F.shiftright("_at", 33))
    inside = Window.partitionBy("_part", "_k").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = run.withColumn("_near", F.last("_right", ignorenulls=True).over(inside))
    # the last right row of each partition, of the key it ends with, and what arrives at each border
    edge = run.groupBy("_part").agg(
        F.max_by("_k", "_at").alias("_end"),
        F.max_by(F.when(F.col("_side") == 0, F.struct("_k", "_right")), F.when(F.col("_side") == 0, F.col("_at"))).alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    border = edge.select("_part", F.last("_last", ignorenulls=True).over(before).alias("_arrives"))
    found = carried.where("_side = 1").join(F.broadcast(border), "_part")  # at most `parts` rows
    match = F.coalesce("_near", F.when(F.col("_arrives._k") == F.col("_k"), F.col("_arrives._right")))
    taken = [c for c in right.columns if c != key]
    out = found.withColumn("_hit", match).where(F.col("_hit").isNotNull()).select(F.col("_k").alias(key), "_left.*", *[
        F.col(f"_hit.`{c}`").alias(c) for c in taken])
    return out


def slice_buckets(df: DataFrame, windows: DataFrame, key: str, t: str, lo: str, hi: str, days: int = 31) -> DataFrame:
    """As `slice_window`, for keys with any share of the rows: windows are cut
    into time buckets of `days`, and rows meet them on (key, bucket), so a hot
    key's rows are dealt by their time; the exact bounds are checked after. A
    window reaches as many join rows as it has buckets."""
    def bucket(c: str) -> Column:
        return F.floor(F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")) / days)

    cut = windows.where(F.col(lo) <= F.col(hi)).withColumn("_bucket", F.explode(F.sequence(bucket(lo), bucket(hi))))
    joined = df.withColumn("_bucket", bucket(t)).join(cut, on=[key, "_bucket"], how="inner")
    return joined.where((F.col(t) >= F.col(lo)) & (F.col(t) <= F.col(hi))).drop("_bucket")


def heavy_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, heavy: int = 100_000, salts: int = 32) -> DataFrame:
    """Inner equi-join in which a key may hold any share of both sides.

    Keys are counted on both sides, combined map-side. Those with more than
    `heavy` matches (left count x right count) are joined apart: their left rows
    get a random salt, their right rows one copy per salt, so each key's matches
    are dealt over `salts` tasks; how many salts a key needs follows from its
    counts, up to all of them. The rest is one plain join on the key. Null keys
    match nothing.
    """
    a = left.groupBy(F.col(left_key).alias("_key")).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(F.col(right_key).alias("_key")).agg(F.count(F.lit(1)).alias("_b"))
    # one row per heavy key; written, so that both sides see the same keys
    keys = handoff(a.join(b, "_key").where(F.col("_a") * F.col("_b") > heavy).select(
        "_key", F.least(F.ceil(F.col("_a") * F.col("_b") / heavy), F.lit(salts)).cast("int").alias("_salts")))
    hot_left = left.join(keys, left[left_key] == keys["_key"]).drop("_key").withColumn(
        "_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_salts")).cast("int")).drop("_salts")
    hot_right = right.join(keys, right[right_key] == keys["_key"]).drop("_key").withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    apart = hot_left.join(hot_right, (hot_left[left_key] == hot_right[right_key]) & (hot_left["_salt"] == hot_right["_copy"])).drop("_salt", "_copy")
    light_left = left.join(keys, left[left_key] == keys["_key"], "left_anti")
    light_right = right.join(keys, right[right_key] == keys["_key"], "left_anti")
    return light_left.join(light_right, light_left[left_key] == light_right[right_key]).unionByName(apart)


def heavy_keys(df: DataFrame, key: str, least: int = 100_000) -> DataFrame:
    """The keys that more than about `least` rows of `df` hold, as a written table.

    They come from a sketch of frequent items that merges map-side, so no row is
    shuffled: it names every key of more than 0.035% of the rows and may name one
    too many. For choices of how rows are dealt, never of what results.
    """
    found = df.agg(F.expr(f"approx_top_k(`{key}`, 1000, 10000)").alias("_top")).select(F.explode("_top").alias("_x"))
    return handoff(found.where((F.col("_x.count") > least) & F.col("_x.item").isNotNull()).select(F.col("_x.item").alias(key)))


def light_and_heavy(df: DataFrame, heavy: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of `df` whose key is not among `heavy` (null keys among them), and
    the rest; `heavy` holds a thousand keys at most."""
    return df.join(F.broadcast(heavy), key, "left_anti"), df.join(F.broadcast(heavy), key, "left_semi")
