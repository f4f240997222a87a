"""Hard-negative mining: candidates, decisions, queue order, stop rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modlake.functions.labels import strings
from modlake.operators.joins import lookup
from modlake.operators.collections import check_promotions, promote_reviewed

ACTIONS = ("confirm_fp", "confirm_positive", "skip")


def score_candidates(pool: DataFrame, harm: list[str], pos: str, probs: str = "probs", fp: float = 0.6, uncertain: float = 0.4) -> DataFrame:
    """clip_id, pos, kind, predicted, prob, priority of all candidates of the pool.

    The first harm class of the highest score counts. From ``fp`` on it is a false positive with its score as priority,
    from ``uncertain`` on it is uncertain, with 1 - 2 |p - .5|. False positives come first, then by priority, then ``pos``.
    """
    top = F.array_max(F.transform(F.slice(probs, 1, len(harm)), lambda p, i: F.named_struct(F.lit("p"), p, F.lit("i"), -i)))
    x = pool.select("clip_id", pos, top.alias("t")).select("clip_id", pos, F.col("t.p").alias("prob"), F.get(strings(harm), -F.col("t.i")).alias("predicted"))
    kind = F.when(F.col("prob") >= fp, "false_positive").when(F.col("prob") >= uncertain, "uncertain")
    priority = F.when(F.col("prob") >= fp, F.col("prob")).otherwise(1 - 2 * F.abs(F.col("prob") - 0.5))
    return x.withColumn("kind", kind).filter("kind is not null").withColumn("priority", priority)


def select_candidates(pool: DataFrame, harm: list[str], k: int, pos: str, probs: str = "probs", fp: float = 0.6, uncertain: float = 0.4, pseudo: DataFrame | None = None) -> DataFrame:
    """rank, clip_id, kind, predicted, prob, priority (, pseudo_label): the k best candidates. A top-k, no full sort."""
    x = score_candidates(pool, harm, pos, probs, fp, uncertain)
    best = x.orderBy(F.when(F.col("kind") == "false_positive", 0).otherwise(1), F.col("priority").desc(), pos).limit(k)
    order = Window.orderBy(F.when(F.col("kind") == "false_positive", 0).otherwise(1), F.col("priority").desc(), pos)  # k rows
    best = best.withColumn("rank", F.row_number().over(order))
    cols = ["rank", "clip_id", "kind", "predicted", "prob", "priority"]
    if pseudo is not None:
        best = best.join(pseudo.select("clip_id", "pseudo_label"), "clip_id", "left")
        cols.append("pseudo_label")
    return best.select(*cols)


def fp_distribution(candidates: DataFrame) -> DataFrame:
    return candidates.filter(F.col("kind") == "false_positive").groupBy("predicted").agg(F.count("*").alias("n"))


def should_stop(history: DataFrame, most: int = 5, least_drop: float = 0.005) -> DataFrame:
    """stop: after ``most`` iterations (iteration, fpr), or when the last brought less than ``least_drop``."""
    w = Window.orderBy("iteration")  # a row for each iteration
    x = history.withColumn("drop", F.lag("fpr").over(w) - F.col("fpr"))
    return x.agg((F.coalesce(F.max("iteration") >= most, F.lit(False)) | F.coalesce(F.max_by("drop", "iteration") < least_drop, F.lit(False))).alias("stop"))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last action and label of each clip, by seq."""
    return decisions.groupBy("clip_id").agg(F.max_by(F.struct("action", "label"), "seq").alias("d")).select("clip_id", "d.action", "d.label")


def pending(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Undecided clips, then skipped ones, in the order of their rank."""
    return pending_rows(queue, decisions).orderBy("skipped", "rank").drop("skipped")


def pending_rows(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """The same rows in no order, with ``skipped``."""
    x = queue.join(latest_decisions(decisions), "clip_id", "left").filter("action is null or action = 'skip'")
    return x.withColumn("skipped", F.col("action").isNotNull()).drop("action", "label")


def progress(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    x = queue.join(latest_decisions(decisions), "clip_id", "left")
    return x.agg(F.count(F.when(F.coalesce(F.col("action"), F.lit("skip")) != "skip", 1)).alias("decided"), F.count("*").alias("total"))


def check_decisions(decisions: DataFrame, queue: DataFrame, classes: DataFrame) -> DataFrame:
    """clip_id, problem: unknown clips and actions, missing labels, labels of the wrong kind."""
    known = lookup(decisions.join(queue.select("clip_id", F.lit(True).alias("_q")), "clip_id", "left"), classes.select(F.col("class").alias("label"), "is_harm"), "label")
    act, label = F.col("action"), F.col("label")
    problem = (
        F.when(F.col("_q").isNull(), "unknown clip").when(~F.coalesce(act.isin(*ACTIONS), F.lit(False)), "unknown action").when((act != "skip") & label.isNull(), "label required")
        .when((act != "skip") & F.col("is_harm").isNull(), "unknown label").when((act == "confirm_fp") & F.col("is_harm"), "label of the wrong kind").when((act == "confirm_positive") & ~F.col("is_harm"), "label of the wrong kind")
    )
    return known.withColumn("problem", problem).filter("problem is not null").select("clip_id", "problem")


def export_reviewed(decisions: DataFrame, candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed decisions as verified train rows: false positives with confusable labels, positives with harm labels."""
    last = latest_decisions(decisions)
    return promote_reviewed(last.filter("action = 'confirm_fp'"), candidates, classes, False).unionByName(promote_reviewed(last.filter("action = 'confirm_positive'"), candidates, classes, True))


__all__ = ["score_candidates", "select_candidates", "fp_distribution", "should_stop", "latest_decisions", "pending", "pending_rows", "progress", "check_decisions", "export_reviewed", "check_promotions"]
