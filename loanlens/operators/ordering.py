"""Positions and ranks without a window over a whole group or table.

Rows are range-partitioned and sorted by the wanted order and written down with
their place inside their partition. One count per partition then gives every
partition's offset (a table of as many rows as there are partitions), so a row's
global position is an addition. A position inside a key is the global position
less that of the key's first row. However many rows one key has, they lie in
many partitions; rows equal in the whole order are spread by a salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.plans.stages import handoff

_INSIDE = (1 << 33) - 1  # low bits of monotonically_increasing_id: the row's number in its partition


def _ordered(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def with_position(df: DataFrame, order: Sequence[Column | str], name: str = "position", parts: int | None = None) -> DataFrame:
    """`df` with the 0-based place `name` of every row in the total order
    `order` (columns, or expressions with asc/desc and null placement).

    Rows equal in the whole order get neighbouring places in no stated order.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 15)).cast("short"))  # 2 bytes spread enough
    by = [*_ordered(order), F.col("_salt")]
    written = handoff(
        salted.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_salt").withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = written.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = written.join(F.broadcast(offsets), "_part")  # at most `parts` rows
    return placed.withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND(F.lit(_INSIDE))).select(*df.columns, name)


def position_in(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "position",
                parts: int | None = None) -> DataFrame:
    """`df` with the 0-based place `name` of every row among the rows of its
    `keys` (a null key is a key). The first place of each key comes from an
    aggregate that combines map-side and meets the rows in a join of two plain
    shuffles, which the planner can split where one key is hot."""
    placed = handoff(with_position(df, [*keys, *_ordered(order)], "_place", parts))
    first = placed.groupBy(*keys).agg(F.min("_place").alias("_first"))
    first = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    same = [placed[k].eqNullSafe(first[f"_k{i}"]) for i, k in enumerate(keys)]
    return placed.join(first, same).withColumn(name, F.col("_place") - F.col("_first")).select(*df.columns, name)


def ranked_in(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str | None = "rank", dense: str | None = "dense_rank",
              parts: int | None = None) -> DataFrame:
    """`df` with RANK and DENSE_RANK of its `keys`, ascending in `order`.

    Peers (rows equal in keys and order) are counted first, combined map-side,
    so a value repeated without bound is one row; the distinct values are placed
    by `position_in`, which is the dense rank. RANK adds the rows before: a
    running sum inside each (key, block of 4,096 distinct values) and one total
    per earlier block.
    """
    keys, order = list(keys), list(order)
    peers = df.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("_n"))
    placed = position_in(peers, keys, order, "_dense", parts)
    block = F.floor(F.col("_dense") / 4096)
    if rank:
        placed = handoff(placed.withColumn("_block", block))
        inside = Window.partitionBy(*keys, "_block").orderBy("_dense").rowsBetween(Window.unboundedPreceding, -1)
        earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = placed.groupBy(*keys, "_block").agg(F.sum("_n").alias("_sum")).select(
            *[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], F.col("_block").alias("_bb"),
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
        same = [placed[k].eqNullSafe(blocks[f"_b{i}"]) for i, k in enumerate(keys)] + [placed["_block"] == blocks["_bb"]]
        placed = placed.join(blocks, same).withColumn("_rank", F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + 1)
    names = [*keys, *order]
    found = placed.select(*[F.col(c).alias(f"_v{i}") for i, c in enumerate(names)],
                          *([F.col("_rank").alias(rank)] if rank else []), *([(F.col("_dense") + 1).alias(dense)] if dense else []))
    return df.join(found, [df[c].eqNullSafe(found[f"_v{i}"]) for i, c in enumerate(names)]).select(*df.columns, *[c for c in (rank, dense) if c])
