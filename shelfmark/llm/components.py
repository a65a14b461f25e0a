"""Connected components of a graph whose edges no machine has to hold: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import checkpoint, written

#: Edges of one task. As many or fewer are a single partition, which no step of a round shuffles.
TASK_EDGES = 1 << 16


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _either(edges: DataFrame, one: Column, other: Column) -> DataFrame:
    """Two edges for each. Unlike a union this leaves a single partition one."""
    return edges.select(F.explode(F.array(one, other)).alias("e")).select("e.*")


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``label``, the smallest id that edges (a, b) lead to, for every id that is not that smallest one itself.

    Each round hangs a node's larger neighbours on its smallest one, then its smaller neighbours; the number of rounds
    grows with the logarithm of the longest path. A node with very many edges is one minimum, taken in each task first.
    Rounds are written to the shared folder; only a count and a checksum come to the driver. Tasks are as many as the edges
    of a round need (TASK_EDGES), however many the session deals out. The result is a written table, and the rounds are
    deleted.
    """
    return written(edges.sparkSession, lambda: _stars(edges))


def _stars(edges: DataFrame) -> DataFrame:
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    stamp = _stamp(now)
    while stamp[0]:
        now = now.coalesce(-(-stamp[0] // TASK_EDGES))
        both = _either(now, F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = _either(hung, F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v")
        after = checkpoint(small.distinct())
        before, stamp = stamp, _stamp(after)
        now = after
        if stamp == before:
            break
    return now.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "id")
