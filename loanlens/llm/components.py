"""Connected components of a link table, on Spark.

Alternates two steps until every node hangs on its component's smallest one:
each node hands its larger neighbours, then its smaller ones, to the smallest
node it knows (large-star, small-star). The number of links never grows, a
node with very many links is reduced by partial aggregation, and the links
stay distributed. Partitions follow the number of links, so a small graph on a
session with many shuffle partitions doesn't pay for empty tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import discard, in_parts, staged


def _star(links: DataFrame, larger: bool, rows: int) -> DataFrame:
    """links (a, b): each a's neighbours (larger or smaller ones) to a's least."""
    least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    linked = links.join(least, "a")
    moved = linked.where(F.col("b") > F.col("a") if larger else F.col("b") < F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not larger:
        moved = moved.unionByName(links.groupBy("a").agg(F.min("b").alias("b")))
    return in_parts(in_parts(moved.where("a <> b"), rows).distinct(), rows)


def components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every linked node but the
    roots. `links` has comparable, non-null columns a, b."""
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = staged(ordered.distinct())
    while True:
        rows = links.count()
        # done if every node has one parent and no parent has one
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = in_parts(ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")), rows)
        if ends.where("up + down > 1").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        before, links = links, staged(_star(_star(both, True, rows), False, rows))
        discard(before)
