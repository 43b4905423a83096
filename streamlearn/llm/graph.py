"""Connected components of an edge table by alternating star contractions.

Each round is two grouped minima and two joins over edges, all hash-partitioned
by node; a hot node's edges are split by the skew join.  Every round is written
to the shared folder.  Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlearn.llm.common import stash


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).union(e.select("v", "u"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` for every node of ``edges(u, v)`` but the roots; the root is the least node.

    Self links, null ends and repeated links are ignored.  No edges, no rows.
    """
    e = (edges.filter("u is not null and v is not null and u <> v")
              .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e, seen = stash(e, "links"), None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return e.select("u", F.col("v").alias("root"))
        seen = mark
        e = stash(_small_star(_large_star(e)).distinct(), "links")
