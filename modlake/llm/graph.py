"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlake.llm.common import saved


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(links: DataFrame) -> DataFrame:
    """node, root: for each node of ``links`` (columns a, b, long) but the roots, the smallest node that it reaches.

    Each round is two aggregations and two equi-joins over the remaining links, written to the shared folder; rounds
    go with the logarithm of a component's size. The driver sees a count and a checksum. Loops, repeated links and
    either direction are fine; no links give no rows.
    """
    link = F.col("a") != F.col("b")
    now = saved(links.filter(link).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = saved(small.unionByName(low.select("a", F.col("m").alias("b"))).filter(link).distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
