"""Joins by shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlake.core import global_rank, saved


def lookup(df: DataFrame, dimension: DataFrame, on: str | list[str], how: str = "left", most: int = 100_000) -> DataFrame:
    """Join a dimension table: broadcast if it has at most ``most`` rows (counted), shuffled otherwise."""
    small = dimension.limit(most + 1).count() <= most
    return df.join(F.broadcast(dimension) if small else dimension, on, how)


def require(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Inner join where a row without a partner fails the job."""
    x = df.join(other.withColumn("_there", F.lit(True)), on, "left")
    ok = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit(f"no {on} "), F.coalesce(F.col(on).cast("string"), F.lit("null")))).cast("boolean")).otherwise(True)
    return x.filter(ok).drop("_there")


def containment(df: DataFrame, text: str, terms: list[str]) -> Column:
    """The terms that the text holds: an array literal, no join."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.filter(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t))


#: Labels up to which a set is a bitmap of 64-bit words, and the parts that one side of a label's pairs is dealt to.
BITMAP, DEAL = 1_024, 8


def label_similarity(df: DataFrame, row_id: str, labels: str, threshold: float, batch: str | None = None) -> DataFrame:
    """class representatives a < b with jaccard, of different label sets at or above the threshold.

    Equal sets are one class: see ``label_classes`` for the membership. A dictionary ranks the labels, rarest first. Of each set's n
    labels only the first n - ceil(threshold n) + 1 are looked up, which any similar pair shares one of; a pair is taken
    at the first label that both look up, so it comes once; sizes, and what is left of both sets after that label, must allow the
    similarity; what is left is counted on bitmaps of the ranks (on the ranks themselves, where there are over ``BITMAP`` labels).
    Empty sets have no partner, and a null label is none.
    """
    keys = ["_batch"] if batch else []
    sets = label_classes(df, row_id, labels, batch).select(*keys, "rep", "set").distinct()
    each = saved(sets.select(*keys, "rep", F.explode("set").alias("label")), "class-labels")
    ranked = global_rank(each.groupBy("label").agg(F.count("*").alias("often")), "often", "label")
    words = -(-ranked.count() // 64)
    order = lookup(each, ranked.select("label", (F.col("rank") - 1).cast("int").alias("rank")), "label").groupBy(*keys, "rep").agg(F.array_sort(F.collect_list("rank")).alias("r"))
    n = F.size("r")
    order = order.select(*keys, "rep", "r", n.alias("n"), F.slice("r", F.lit(1), (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int")).alias("p"))
    small = words * 64 <= BITMAP
    one = F.lit(1).cast("long")

    def bits(col: str, w: int) -> Column:
        own = F.filter(col, lambda x: F.floor(x / 64) == w)
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", one, F.pmod(x, F.lit(64)).cast("int"))))

    if small:
        order = order.select(*keys, "rep", "n", "p", *[bits(c, w).alias(f"{c}{w}") for c in "pr" for w in range(words)])
    kept = [c for c in order.columns if c not in keys and c not in (["p"] if small else [])]
    at = order.select(*keys, *kept, F.posexplode("p").alias("i", "rank"))
    left = at.withColumn("deal", F.pmod(F.xxhash64("rep"), F.lit(DEAL)).cast("int"))
    right = at.select(*keys, "rank", *[F.col(c).alias(f"{c}_") for c in (*kept, "i")], F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("deal"))
    both = left.join(right, [*keys, "rank", "deal"])
    if small:
        k, word = F.pmod("rank", F.lit(64)).cast("int"), F.floor(F.col("rank") / 64)
        below = F.when(k == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - k))
        shared = [F.col(f"p{w}").bitwiseAND(F.col(f"p{w}_")).bitwiseAND(F.when(word == w, below).when(word > w, F.lit(-1).cast("long")).otherwise(F.lit(0).cast("long"))) for w in range(words)]
        first = F.lit(True)
        for x in shared:
            first = first & (x == 0)
        same = F.lit(0)
        for w in range(words):
            same = same + F.bit_count(F.col(f"r{w}").bitwiseAND(F.col(f"r{w}_")))
    else:
        first = F.array_min(F.array_intersect("p", "p_")) == F.col("rank")
        same = F.size(F.array_intersect("r", "r_"))
    least = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n_")) - 1e-9
    could = (F.col("rep") < F.col("rep_")) & (F.least("n", "n_") >= F.lit(threshold) * F.greatest("n", "n_") - 1e-9) & (F.least(F.col("n") - F.col("i"), F.col("n_") - F.col("i_")) >= least)
    pairs = both.filter(could & first).select(*keys, F.col("rep").alias("a"), F.col("rep_").alias("b"), (same / (F.col("n") + F.col("n_") - same)).alias("jaccard"))
    return pairs.select("a", "b", "jaccard").filter(F.col("jaccard") >= threshold)


def label_classes(df: DataFrame, row_id: str, labels: str, batch: str | None = None) -> DataFrame:
    """row_id, rep, set (, _batch): the class of each row's label set, named by its smallest row."""
    keys = [F.col(batch).alias("_batch")] if batch else []
    x = df.select(row_id, *keys, F.array_sort(F.array_distinct(labels)).alias("set")).filter(F.size("set") > 0)
    on = ["set", *(["_batch"] if batch else [])]
    return x.join(x.groupBy(*on).agg(F.min(row_id).alias("rep")), on).select(row_id, "rep", "set", *(["_batch"] if batch else []))


def positional(a: DataFrame, b: DataFrame, key: str, a_items: str, b_items: str) -> DataFrame:
    """i-th item of a with i-th of b, by key."""
    x = a.select(key, F.posexplode(a_items).alias("i", "a_item"))
    y = b.select(key, F.posexplode(b_items).alias("i", "b_item"))
    return x.join(y, [key, "i"])


def shared_ids(df: DataFrame, key: str, split: str, one: str, two: str) -> DataFrame:
    """Keys that two splits share; must be empty."""
    return df.filter(F.col(split) == one).select(key).intersect(df.filter(F.col(split) == two).select(key))
