"""Mixing sources to target weights: capped water-filling and seeded repetitions.

*Targets.* Each source wants its weight's share of the budget. Sources whose share is above their cap (``max_epochs``
times their size) are clamped there, and what they leave goes to the others by weight, round by round, until none is
above. Rounds run as aggregates over the table of sources; the driver sees two sums a round.

*Repetitions.* A source at 1.4 epochs takes every document once, and a seeded 40 % of its words once more. Documents
above 1/256 of their source (fewer than 256) are gone through first, in the order of a seeded hash; the others, in that
order, fill up what is left. One last document gives the part of its words that is missing. Running sums go over hash buckets, and over single documents in one bucket of each
source only; a source of any size is spread over all tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modlake.llm.common import WORD, saved

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2.0
SEED = 20
#: Hash buckets of a source's documents.
BUCKETS = 4096
#: Documents above 1 / LARGE of their source's words are drawn before the others.
LARGE = 256


def water_fill(sources: DataFrame, budget: float) -> DataFrame:
    """``sources`` (with weight and cap, doubles) and target: shares of ``budget`` by weight, none above its cap.

    A budget above all caps gives the caps; sources of no weight get nothing.
    """
    clamped, free = sources.agg(F.lit(0.0), F.sum("weight")).first()
    level, seen = (budget / free if free else 0.0), None
    while free:
        full = (F.col("weight") > 0) & (F.col("cap") <= F.col("weight") * F.lit(level))
        n, clamped, free = sources.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == seen or not free:
            break
        level, seen = max(0.0, budget - clamped) / free, n
    share = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(F.col("weight") <= 0, 0.0).when(F.lit(not free), F.col("cap")).otherwise(F.least(F.col("cap"), share)))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, whole, taken for every row.

    size: words; whole: complete copies in the mix; taken: words of these and of a part of one more.
    Sources go by code point, null last, and get the weights in turn. Null texts have no words, and take none; sources
    without words have target 0. Equal rows share their fate but for the one where a source's target is met.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))
    docs = saved(slim, "sizes")
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))) - 1  # one row for each source
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    sources = saved(sources, "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    sources = water_fill(sources, budget * total)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = saved(sources.withColumn("every", F.floor(epochs + 1e-12)), "targets").select("source", "source_size", "target", "every")
    # more words than whole epochs give, still to be drawn
    sources = sources.withColumn("rest", F.round(F.col("target")).cast("long") - F.col("every") * F.col("source_size"))
    same = F.col("s.source").eqNullSafe(F.col("d.source"))
    laid = docs.alias("d").join(sources.alias("s"), same).select("d.*", "source_size", "target", "every", "rest")
    laid = laid.withColumn("large", F.col("size") * LARGE > F.col("source_size"))

    small = laid.filter("not large").withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sums = saved(small.groupBy("source", "rest", "bucket").agg(F.sum("size").alias("words")), "buckets")
    room = sums.groupBy("source").agg(F.sum("words").alias("room"))

    # of each source fewer than LARGE large documents: in the order of their hash, each that brings the sum nearer to its share
    big = laid.filter("large").groupBy("source", "source_size", "target", "every", "rest").agg(F.sort_array(F.collect_list(F.struct("h", "doc_id", "size"))).alias("docs"), F.sum("size").alias("words"))
    share = F.col("words") * F.col("rest") / F.col("source_size")
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.array().cast("array<boolean>").alias("drawn"))

    def draw(done, doc):
        take = done["upto"] + doc["size"] / 2 <= share
        return F.struct((done["upto"] + F.when(take, doc["size"]).otherwise(0)).alias("upto"), F.concat(done["drawn"], F.array(take)).alias("drawn"))

    big = big.withColumn("fold", F.aggregate("docs", start, draw)).alias("d").join(room.alias("s"), same, "left").select("d.*", F.coalesce("room", F.lit(0)).alias("room"))
    # what small documents can't make up, one large one does with a part of its words
    missing = F.col("rest") - F.col("fold.upto")
    big = big.withColumn("over", missing - F.greatest(F.lit(0), F.least(F.col("room"), missing)))
    each = F.arrays_zip("docs", F.col("fold.drawn").alias("drawn"))
    fits = F.transform(each, lambda x, i: F.when(F.when(F.col("over") > 0, ~x["drawn"] & (x["docs"]["size"] >= F.col("over"))).otherwise(x["drawn"] & (x["docs"]["size"] >= -F.col("over"))), i))
    at = F.when(F.col("over") > 0, F.array_min(fits)).when(F.col("over") < 0, F.array_max(fits))
    big = big.withColumn("at", at).select("source", "source_size", "target", "every", "over", "at", F.posexplode(each).alias("i", "one"))
    extra = F.when(F.col("one.drawn"), F.col("one.docs.size")).otherwise(0) + F.when(F.col("i") == F.col("at"), F.col("over")).otherwise(0)
    big = saved(big.select("one.docs.doc_id", "source", "one.docs.size", "source_size", "target", "every", extra.alias("extra")), "large")
    by_big = big.groupBy("source").agg(F.sum("extra").alias("got"))

    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.alias("d").join(by_big.alias("s"), same, "left").select("d.*", F.coalesce("got", F.lit(0)).alias("got"))
    edge = sums.withColumn("upto", F.sum("words").over(over)).withColumn("need", F.greatest(F.lit(0), F.col("rest") - F.col("got")))
    edge = edge.groupBy("source").agg(
        F.max("need").alias("need"), F.coalesce(F.min(F.when(F.col("upto") >= F.col("need"), F.col("bucket"))), F.lit(BUCKETS)).alias("edge"),
        F.coalesce(F.max(F.when(F.col("upto") < F.col("need"), F.col("upto"))), F.lit(0)).alias("below"))
    edge = saved(edge, "edges")
    small = small.alias("d").join(edge.alias("s"), same).select("d.*", "need", "edge", "below")
    w = Window.partitionBy("source").orderBy("h", "doc_id", "size")
    inside = small.filter("bucket = edge").withColumn("before", F.col("below") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - F.col("before")))
    rest = small.filter("bucket <> edge").withColumn("extra", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(0))
    keys = ["doc_id", "source", "size", "source_size", "target", "every"]
    out = rest.select(*keys, "extra").unionByName(inside.select(*keys, part.alias("extra"))).unionByName(big.select(*keys, "extra"))
    whole = F.col("every") + F.when((F.col("size") > 0) & (F.col("extra") * 2 >= F.col("size")), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", whole.cast("int").alias("whole"), (F.col("every") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``df`` in whole copies, as often as the mix takes them; the part of a document counts as a copy from a half on.

    Repeated rows of one id and text are taken as often as the mix takes one of them.
    """
    own = [f"{n}_{uuid.uuid4().hex}" for n in ("id", "source", "whole", "copy")]
    plan = mix(df, id_col, text_col, source_col, **how).groupBy("doc_id", "source").agg(F.max("whole").alias("whole")).filter("whole > 0").toDF(*own[:3])
    on = df[id_col].cast("long").eqNullSafe(F.col(own[0])) & df[source_col].cast("string").eqNullSafe(F.col(own[1]))
    return df.join(plan, on).withColumn(own[3], F.explode(F.sequence(F.lit(1), F.col(own[2])))).select(*[df[c] for c in df.columns])
