"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `replicas` points (virtual nodes) of a ring of 2^16 cells;
a document's ring position is the hash of its `doc_id`, and its first choice
is the shard of the next point clockwise. Loads are bounded by rows: shard s
takes floor(N / shards) rows, one more if s < N mod shards. What a full shard
can't take continues clockwise to the next point of a shard with room left.
All room together is N, so every row finds a place and the counts differ by
one at most (law `rows`). First choices are served before any overflow, so
only rows of overfull arcs move away from their own shard.

How it runs. One narrow pass writes (doc_id, size, crc, arc, part) to the
shared folder; `part` is the Spark partition that read the row. The walk
around the ring needs one count per arc (shards * replicas numbers, whatever
the input's size); it answers "ranks a..b of this arc go to shard s, slots
from c". A row's rank in its arc is the offset of (arc, part), from a running
sum over the counts per (arc, part), plus its row number within (arc, part).
So an arc that holds a third of all rows (one repeated doc_id) is ranked by
many tasks, and no window sees more rows than one input partition gave.
DataFrame functions only.

Defined results: a null doc_id has a ring position like any other value; a
null text has size 1 and crc 0; repeated rows are rows of their own and may
be split over shards; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.llm.common import staged

CELLS = 1 << 16


def ring_points(spark: SparkSession, shards: int, replicas: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, in ring order; of two nodes in one
    cell, the smaller shard is first."""
    nodes = spark.range(shards * replicas).select(
        F.pmod(F.xxhash64((F.col("id") % shards).cast("int"), F.floor(F.col("id") / shards)), F.lit(CELLS)).alias("cell"),
        (F.col("id") % shards).cast("int").alias("shard"),
    )
    return sorted((r.cell, r.shard) for r in nodes.collect())


def walk(points: list[tuple[int, int]], counts: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Bounded-load walk: (arc, first rank, end rank, shard, first slot).

    `counts[a]` rows fall in arc a, which ends at ring point a. In round r an
    arc with rows left offers them to the r-th distinct shard clockwise.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    ranked = [0] * len(counts)
    order = []
    for a in range(len(points)):
        clockwise = dict.fromkeys(s for _, s in points[a:] + points[:a])
        order.append(list(clockwise))
    out = []
    for r in range(shards):
        for a, n in enumerate(counts):
            s = order[a][r]
            take = min(n - ranked[a], room[s] - filled[s])
            if take > 0:
                out.append((a, ranked[a], ranked[a] + take, s, filled[s]))
                ranked[a] += take
                filled[s] += take
    return out


def shard_documents(docs: DataFrame, shards: int = 16, replicas: int = 32) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per document."""
    if shards < 1 or replicas < 1:
        raise ValueError("shards and replicas must be positive")
    spark = docs.sparkSession
    points = ring_points(spark, shards, replicas)
    # arc of a cell: the first point at or after it, wrapping to point 0
    cells = F.array(*[F.lit(c) for c, _ in points])
    arcs = spark.range(CELLS).select(
        F.col("id").cast("int").alias("cell"),
        F.pmod(F.size(F.filter(cells, lambda c: c < F.col("id"))), F.lit(len(points))).alias("arc"),
    )
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(CELLS)).cast("int").alias("cell"),
            F.spark_partition_id().alias("part"),
        ).join(F.broadcast(arcs), "cell").drop("cell")  # CELLS rows, whatever the input
    )
    sizes = rows.groupBy("arc", "part").agg(F.count("*").alias("n"))
    counts = [0] * len(points)
    for r in sizes.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # at most one row per ring point
        counts[r.arc] = r.n
    before = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("arc", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = Window.partitionBy("arc", "part").orderBy("doc_id", "size", "text_crc32")
    ranked = (
        rows.withColumn("at", F.row_number().over(local) - 1)
        .join(bases, ["arc", "part"])
        .withColumn("rank", F.col("base") + F.col("at"))
    )
    pieces = walk(points, counts, shards)
    places = spark.sql(
        "SELECT * FROM VALUES "
        + ", ".join(f"({a}, {lo}L, {hi}L, {s}, {slot}L)" for a, lo, hi, s, slot in pieces or [(-1, 0, 0, 0, 0)])
        + " AS places(arc, lo, hi, shard, first_slot)"
    )
    return ranked.join(F.broadcast(places), "arc").where("rank >= lo and rank < hi").select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("first_slot") + F.col("rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
