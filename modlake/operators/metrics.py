"""Ranking metrics, thresholds and reports over long-form scores: rows (id, class, y, score).

Undefined values are null; means over classes skip them. Ties: average precision takes rows one by one (by score, then
id), AUROC averages them, thresholds and recall at a false-positive rate move over whole groups of equal scores.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlake.core import global_rank, running_sums, saved
from modlake.functions.text import compose, normalize_text
from modlake.operators.joins import lookup

KEY = "class"


def average_precision(df: DataFrame, key: str = KEY, y: str = "y", score: str = "score", row_id: str = "id") -> DataFrame:
    """class, ap: sum over positives of precision at their rank, over the positives. Null without positives."""
    r = running_sums(df.select(key, y, score, row_id), key, F.col(score).desc(), row_id, rank=F.lit(1), tp=F.col(y))
    return r.groupBy(key).agg((F.sum(F.when(F.col(y) == 1, F.col("tp") / F.col("rank"))) / F.nullif(F.sum(y), F.lit(0))).alias("ap"))


def average_precision_one(df: DataFrame, y: str = "y", score: str = "score", row_id: str = "id") -> DataFrame:
    """ap of all rows as one class."""
    r = global_rank(df.select(y, score, row_id), F.col(score).desc(), F.col(row_id), sums={"tp": F.col(y)})
    return r.agg((F.sum(F.when(F.col(y) == 1, F.col("tp") / F.col("rank"))) / F.nullif(F.sum(y), F.lit(0))).alias("ap"))


def score_groups(df: DataFrame, key: str = KEY, y: str = "y", score: str = "score") -> DataFrame:
    """class, score, pos, neg: counts of each distinct score; what the tie-aware metrics shuffle."""
    return df.groupBy(key, score).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))


def auroc(df: DataFrame, key: str = KEY, y: str = "y", score: str = "score") -> DataFrame:
    """class, auroc: chance that a positive stands above a negative, ties count half. Null with one kind only."""
    g = running_sums(score_groups(df, key, y, score), key, score, upto=F.col("neg")).withColumn("below", F.col("upto") - F.col("neg"))
    u = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return g.groupBy(key).agg((u / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auroc"))


def _running(df: DataFrame, key: str, y: str, score: str) -> DataFrame:
    g = running_sums(score_groups(df, key, y, score), key, F.col(score).desc(), tp=F.col("pos"), fp=F.col("neg"))
    whole = df.groupBy(F.col(key).alias("_k")).agg(F.sum(y).alias("p"), F.sum(1 - F.col(y)).alias("n"))
    return g.join(whole, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def recall_at_fpr(df: DataFrame, fpr: float, key: str = KEY, y: str = "y", score: str = "score") -> DataFrame:
    """class, recall: the best with a false-positive rate of at most ``fpr``; 0 if no threshold does, null with one kind only."""
    ok = F.col("fp") <= F.lit(fpr) * F.col("n")
    best = F.coalesce(F.max(F.when(ok, F.col("tp") / F.nullif(F.col("p"), F.lit(0)))), F.lit(0.0))
    return _running(df, key, y, score).groupBy(key).agg(F.when((F.max("p") > 0) & (F.max("n") > 0), best).alias("recall"))


def recall_at_kth_negative(df: DataFrame, fpr: float, key: str = KEY, y: str = "y", score: str = "score") -> DataFrame:
    """class, threshold, recall: threshold is the k-th largest negative, k = max(0, floor(fpr n) - 1) from 0."""
    g = _running(df.filter(F.col(y) == 0), key, y, score)  # equal scores are one threshold: its group holds places fp - neg to fp - 1
    neg = g.withColumn("k", F.greatest(F.lit(0), F.floor(F.lit(fpr) * F.col("n")) - 1))
    at = neg.filter(F.col("k").between(F.col("fp") - F.col("neg"), F.col("fp") - 1)).select(key, F.col(score).alias("threshold"))
    return df.filter(F.col(y) == 1).join(at, key).groupBy(key).agg(F.first("threshold").alias("threshold"), F.avg((F.col(score) > F.col("threshold")).cast("double")).alias("recall"))


def macro(df: DataFrame, value: str) -> DataFrame:
    """Mean over the classes that have a value."""
    return df.agg(F.avg(value).alias(f"macro_{value}"), F.count(value).alias("defined"))


def prf_at_threshold(df: DataFrame, threshold: float | Column, key: str | list[str] = KEY, y: str = "y", score: str = "score") -> DataFrame:
    """precision, recall, f1 with score >= threshold; 0 on empty denominators."""
    hit = F.col(score) >= threshold
    tp, fp, fn = (F.count(F.when(c, 1)) for c in (hit & (F.col(y) == 1), hit & (F.col(y) == 0), ~hit & (F.col(y) == 1)))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion_at_threshold(df: DataFrame, threshold: float, key: str = KEY, y: str = "y", score: str = "score") -> DataFrame:
    hit, pos = (F.col(score) >= threshold).cast("double"), F.col(y) == 1
    return df.groupBy(key).agg(F.avg(F.when(pos, hit)).alias("recall"), F.avg(F.when(~pos, hit)).alias("fpr"), F.count(F.when(pos, 1)).alias("n_pos"), F.count(F.when(~pos, 1)).alias("n_neg"))


def group_recall(df: DataFrame, slices: list[str], threshold: float, y: str = "y", score: str = "score") -> DataFrame:
    hit, pos = (F.col(score) >= threshold).cast("double"), F.col(y) == 1
    return df.groupBy(*slices).agg(F.avg(F.when(pos, hit)).alias("recall"), F.avg(F.when(~pos, hit)).alias("fpr"), F.count("*").alias("n"))


def bin_of(score: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts a score reaches, by halving: a row's work goes with the logarithm of their number."""
    if not cuts:
        return F.lit(0)

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(score >= F.lit(cuts[mid]), among(mid + 1, high)).otherwise(among(low, mid))

    return among(0, len(cuts))


def threshold_sweep(df: DataFrame, thresholds: list[float], key: str = KEY, y: str = "y", score: str = "score", budget: float = 0.02) -> DataFrame:
    """One row for each class and threshold, with ``chosen``: the lowest within the false-positive budget, else the nearest to it.

    Each row falls into one bin between thresholds; a threshold's counts are those of its bin and all above. Repeated thresholds are one;
    rows without a score or label don't count, and a class of only such rows has null rates.
    """
    cuts = sorted(set(map(float, thresholds)))
    rows = df.select(F.col(key).alias("_key"), F.when(F.col(score).isNotNull(), bin_of(F.col(score), cuts)).alias("bin"), (F.col(y) == 1).alias("pos"))
    bins = rows.groupBy("_key", "bin").agg(F.count(F.when(F.col("pos"), 1)).alias("p"), F.count(F.when(~F.col("pos"), 1)).alias("n"))
    grid = bins.select("_key", F.posexplode(F.array(*map(F.lit, cuts))).alias("bin", "threshold")).distinct()
    every = grid.withColumn("bin", F.col("bin") + 1).unionByName(bins.filter("bin = 0").select("_key", "bin", F.lit(None).cast("double").alias("threshold")))
    table = every.join(bins.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k")) & (every["bin"] == bins["bin"]), "left").select("_key", every["bin"], "threshold", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("n", F.lit(0)).alias("n"))
    own = Window.partitionBy("_key")  # a row for each threshold
    up = own.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    table = table.select("_key", "threshold", F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"), F.sum("p").over(own).alias("P"), F.sum("n").over(own).alias("N"))
    rate = lambda x, of: F.col(x) / F.nullif(F.col(of), F.lit(0))
    table = table.filter("threshold is not null").select(F.col("_key").alias(key), "threshold", rate("tp", "P").alias("recall"), rate("fp", "N").alias("fpr"), "tp", "fp")
    within = F.coalesce(F.col("fpr"), F.lit(0.0)) <= budget
    order = Window.partitionBy(key).orderBy(F.when(within, 0).otherwise(1), F.when(within, F.col("threshold")).otherwise(F.abs(F.col("fpr") - budget)), "threshold")
    return table.withColumn("chosen", F.row_number().over(order) == 1)


def threshold_at_fpr(df: DataFrame, budget: float, key: str = KEY, y: str = "y", score: str = "score") -> DataFrame:
    """class, threshold: the smallest score such that the share of negatives at or above it is within the budget.

    Where even the highest score is over it, just above the maximum. Only negatives count; classes without any get .5.
    """
    g = _running(df, key, y, score)
    within = F.min(F.when(F.col("fp") <= F.lit(budget) * F.col("n"), F.col(score)))
    above = F.max(F.when(F.col("neg") > 0, F.col(score))) + F.lit(1e-9)
    return g.groupBy(key).agg(F.when(F.max("n") == 0, 0.5).otherwise(F.coalesce(within, above)).alias("threshold"))


def threshold_at_recall(df: DataFrame, target: float, key: str = KEY, y: str = "y", score: str = "score") -> DataFrame:
    """class, threshold: the highest score that keeps recall at the target or above; 0 without positives."""
    best = F.max(F.when((F.col("p") > 0) & (F.col("tp") >= F.lit(target) * F.col("p") - 1e-9), F.col(score)))
    return _running(df, key, y, score).groupBy(key).agg(F.coalesce(best, F.lit(0.0)).alias("threshold"))


def harm_report(df: DataFrame, classes: DataFrame, fpr: float = 0.01, targets: dict[str, float] | None = None) -> DataFrame:
    """scope, name, ap, auroc, recall: each class, each category (labels and scores pooled by max), macro over all and over harm.

    ``classes``: class, category, is_harm; small, and joined to every row. A target passes if at least one value of the
    macro over harm is defined and none of the defined is below it; flags are columns pass_<metric>.
    """
    df = saved(df.select("id", KEY, "y", "score"), "scored")
    rows = lookup(df, classes, KEY, "inner")

    def of(x: DataFrame) -> DataFrame:
        """All three from one ranking of the rows."""
        r = saved(running_sums(x.select(KEY, "y", "score", "id"), KEY, F.col("score").desc(), "id", rank=F.lit(1), tp=F.col("y")), "ranked")
        ap = r.groupBy(KEY).agg((F.sum(F.when(F.col("y") == 1, F.col("tp") / F.col("rank"))) / F.nullif(F.sum("y"), F.lit(0))).alias("ap"), F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
        g = lookup(r.groupBy(KEY, "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"), F.max("tp").alias("tp"), F.max("rank").alias("rank")), ap, KEY, "inner")
        fp = F.col("rank") - F.col("tp")
        u = F.sum(F.col("pos") * (F.col("n") - fp + F.col("neg") / 2)) / F.nullif(F.max("p") * F.max("n"), F.lit(0))
        best = F.coalesce(F.max(F.when(fp <= F.lit(fpr) * F.col("n"), F.col("tp") / F.nullif(F.col("p"), F.lit(0)))), F.lit(0.0))
        return g.groupBy(KEY).agg(F.first("ap").alias("ap"), u.alias("auroc"), F.when((F.max("p") > 0) & (F.max("n") > 0), best).alias("recall"))

    by_class = saved(lookup(of(df), classes, KEY, "inner"), "by-class")  # a row for each class, read by three parts of the report
    pooled = rows.groupBy("id", F.col("category").alias(KEY)).agg(F.max("y").alias("y"), F.max("score").alias("score"))
    one = by_class.select(F.lit("class").alias("scope"), F.col(KEY).alias("name"), "ap", "auroc", "recall")
    cat = of(pooled).select(F.lit("category").alias("scope"), F.col(KEY).alias("name"), "ap", "auroc", "recall")
    means = [F.avg(c).alias(c) for c in ("ap", "auroc", "recall")]
    out = one.unionByName(cat).unionByName(by_class.agg(*means).select(F.lit("macro").alias("scope"), F.lit("all").alias("name"), "ap", "auroc", "recall"))
    out = out.unionByName(by_class.filter("is_harm").agg(*means).select(F.lit("macro").alias("scope"), F.lit("harm").alias("name"), "ap", "auroc", "recall"))
    if targets:
        flags = by_class.filter("is_harm").agg(*[F.coalesce(F.min(k) >= v, F.lit(False)).alias(f"pass_{k}") for k, v in targets.items()])
        out = out.crossJoin(F.broadcast(flags))  # one row
    return out


def report_json(df: DataFrame, name: str = "report") -> DataFrame:
    """Each row as JSON; NaN and infinities become null."""
    clean = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias(name))


#: Counts up to which a Poisson weight is drawn from its exact distribution; replicates that a task draws at once.
EXACT, RUN = 30, 20


def poisson_cdf(n: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson number around n, as far as 52 bits of a uniform reach."""
    n = n.cast("double")
    first = F.exp(-n)
    steps = F.sequence(F.lit(1), F.ceil(n + 9 * F.sqrt(n) + 20).cast("int"))
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))
    grown = F.aggregate(steps, start, lambda s, k: F.struct((s["p"] * n / k).alias("p"), (s["c"] + s["p"] * n / k).alias("c"), F.concat(s["all"], F.array(s["c"] + s["p"] * n / k)).alias("all")))
    return grown["all"]


def poisson_weight(n: Column, cdf: Column, digest: Column) -> Column:
    """A Poisson number around n from an md5: the inverse of ``cdf`` (for n up to ``EXACT``), else a normal one with its skew.

    Two uniforms are the first 13 and the next 13 hex digits, so other engines can repeat it.
    """
    uniforms = F.struct(*[(F.conv(F.substring(digest, at, 13), 16, 10).cast("double") / F.lit(float(1 << 52))).alias(k) for k, at in (("u", 1), ("v", 14))])

    def drawn(x: Column) -> Column:
        z = F.sqrt(-2 * F.ln(1 - x["u"])) * F.cos(2 * F.pi() * x["v"])
        large = F.transform(F.array(z), lambda z: F.greatest(F.floor(n + F.sqrt(n) * z + (z * z - 1) / 6 + 0.5), F.lit(0)))[0]
        return F.when(n <= EXACT, F.size(F.filter(cdf, lambda c: c <= x["u"]))).otherwise(large).cast("long")

    return F.transform(F.array(uniforms), drawn)[0]  # bound once, not for each step of the distribution


def bootstrap_compare(df: DataFrame, replicates: int = 2000, bins: int = 100, seed: int = 0, y: str = "y", a: str = "score", b: str = "score_b") -> DataFrame:
    """auroc_a, auroc_b, delta, low, high, p_better, significant: paired Poisson bootstrap over rows.

    The three first are exact. For the resamples scores go into ``bins`` bins by the share of rows below them, so that range
    and skew don't matter; rows of one label and one pair of bins are a cell. The weights of a cell's rows sum up to a Poisson
    number around its count, drawn from an md5 of seed, replicate and cell: replicates draw from the at most 2 bins^2 cells and not
    from the rows (``drawn_areas``), and repeat anywhere. Replicates with one kind only are skipped. Rows with a null label or score
    are left out; nulls where a kind is missing.
    """
    rows = saved(df.select((F.col(y) == 1).cast("int").alias("y"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna(), "pairs")
    n = rows.count()
    cells = rows
    for c in "ab":
        each = global_rank(rows.groupBy(c).agg(F.count("*").alias("own")), c, name="_rank", sums={"upto": F.col("own")})
        cells = cells.join(each.select(c, F.floor(F.lit(bins) * (F.col("upto") - F.col("own")) / F.lit(n)).cast("int").alias(f"{c}_bin")), c)
    cells = saved(cells.groupBy("y", "a_bin", "b_bin").agg(F.count("*").alias("n")), "cells")
    drawn = drawn_areas(cells, replicates, seed).select((F.col("b") - F.col("a")).alias("d")).filter("d is not null")
    spread = drawn.agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.avg((F.col("d") > 0).cast("double")).alias("p_better"))
    both = rows.select(F.explode(F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"))).alias(KEY, "score"), "y")
    exact = auroc(both).agg(*[F.max(F.when(F.col(KEY) == k, F.col("auroc"))).alias(f"auroc_{k}") for k in "ab"])
    out = exact.crossJoin(spread)  # one row each
    return out.select("auroc_a", "auroc_b", (F.col("auroc_b") - F.col("auroc_a")).alias("delta"), "low", "high", "p_better", ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant"))


def _poisson_numbers(n: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``poisson_weight`` of counts in ascending order, by their uniforms; counts up to ``EXACT`` are looked up, one search a count."""
    z = np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * v)
    out = np.maximum(np.floor(n + np.sqrt(n) * z + (z * z - 1) / 6 + 0.5), 0)
    for k in np.unique(n[n <= EXACT]).tolist():
        p = c = math.exp(-k)
        cdf = [c]
        for i in range(1, math.ceil(k + 9 * math.sqrt(k) + 20) + 1):
            p = p * k / i
            cdf.append(c := c + p)
        at = slice(*np.searchsorted(n, [k, k + 1]))
        out[at] = np.searchsorted(cdf, u[at], "right")
    return out


def drawn_areas(cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """id, a, b: the areas of both sides in each replicate, null where a kind is missing. ``cells``: y, a_bin, b_bin, n.

    Replicates go to tasks in runs of ``RUN``, each with all cells, so that draws are summed up where they are made and a replicate is one row.
    """
    def area(y: np.ndarray, at: np.ndarray, w: np.ndarray) -> float | None:
        size = int(at.max()) + 1
        pos, neg = (np.bincount(at[y == k], w[y == k], size) for k in (1, 0))
        if not (both := pos.sum() * neg.sum()):
            return None
        return float((pos * (np.cumsum(neg) - neg / 2)).sum() / both)

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t["n"].to_numpy(), kind="stable")
        y, a, b, n = (t[c].to_numpy()[order] for c in ("y", "a_bin", "b_bin", "n"))
        tails = [f"|{i}|{j}|{k}".encode() for i, j, k in zip(y.tolist(), a.tolist(), b.tolist(), strict=True)]
        first, md5 = t["run"][0].as_py() * RUN, hashlib.md5
        ids, areas = range(first, min(first + RUN, replicates)), []
        for i in ids:
            head = f"{seed}|{i}".encode()
            high, low = np.frombuffer(b"".join([md5(head + x).digest() for x in tails]), ">u8").astype(np.uint64).reshape(-1, 2).T
            u, v = high >> np.uint64(12), (high & np.uint64(0xFFF)) << np.uint64(40) | low >> np.uint64(24)  # 13 hex digits each
            w = _poisson_numbers(n, u / 2.0**52, v / 2.0**52)
            areas.append((area(y, a, w), area(y, b, w)))
        return pa.table({"id": pa.array(ids, pa.int64()), "a": pa.array([x for x, _ in areas], pa.float64()), "b": pa.array([x for _, x in areas], pa.float64())})

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = cells.sparkSession.range(-(-replicates // RUN)).withColumnRenamed("id", "run")
    return cells.crossJoin(F.broadcast(runs)).repartition(parts, "run").groupBy("run").applyInArrow(run, "id long, a double, b double")


#: Newton steps at most, and the change of a coefficient that ends them.
STEPS, SETTLED = 25, 1e-10


def fit_risk(df: DataFrame, features: tuple[str, str] = ("weighted_max", "weighted_sum"), y: str = "y", steps: int = STEPS) -> dict:
    """Logistic regression of any-harm on the two risk features: a, b, c and the fit's AUROC.

    Each Newton step is one aggregate of nine sums over the rows, which Spark combines before anything is sent; the driver
    solves three equations. Rows with a null are left out. Where the labels can be told apart fully, coefficients have
    no finite best value and are those of the last step that the equations still allow. Empty input has nulls.
    """
    rows = saved(df.select(*[F.col(f).cast("double").alias(k) for f, k in zip(features, "uv", strict=True)], F.col(y).cast("double").alias("y")).dropna(), "features")
    w = np.zeros(3)
    one = [F.col("u"), F.col("v"), F.lit(1.0)]
    for _ in range(steps):
        z = sum((F.lit(float(k)) * x for k, x in zip(w, one, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))
        sums = [F.sum((F.col("y") - p) * x) for x in one] + [F.sum(p * (1 - p) * one[i] * one[j]) for i in range(3) for j in range(i, 3)]
        got = rows.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()
        if got[0] is None:
            return dict.fromkeys(("a", "b", "c", "auroc"))
        h = np.zeros((3, 3))
        h[np.triu_indices(3)] = got[3:]
        h = h + np.triu(h, 1).T
        if abs(np.linalg.det(h)) < 1e-12 * max(np.abs(h).max(), 1e-300) ** 3:
            break
        step = np.linalg.solve(h, np.array(got[:3], float))
        w = w + step
        if np.abs(step).max() < SETTLED:
            break
    scored = rows.select(F.lit(0).alias(KEY), F.col("y").cast("int").alias("y"), (F.lit(float(w[0])) * F.col("u") + F.lit(float(w[1])) * F.col("v") + F.lit(float(w[2]))).alias("score"))
    return {"a": float(w[0]), "b": float(w[1]), "c": float(w[2]), "auroc": auroc(scored).first()["auroc"]}


def _compared(df: DataFrame, reference: str, hypothesis: str, *keep: Column) -> DataFrame:
    """The kept columns with r and h: both texts as ``normalize_text`` leaves their composed forms."""
    x = compose(df.select(*keep, F.coalesce(F.col(reference), F.lit("")).alias("r"), F.coalesce(F.col(hypothesis), F.lit("")).alias("h")), "r", "h")
    return x.withColumns({"r": normalize_text(F.col("r")), "h": normalize_text(F.col("h"))})


def _edits(r: str, h: str) -> Column:
    """Edit distance; equal texts, the most frequent case, are not walked."""
    return F.when(F.col(r) == F.col(h), 0).otherwise(F.levenshtein(r, h))


def character_error_rate(df: DataFrame, reference: str, hypothesis: str, by: list[str] | None = None) -> DataFrame:
    """cer, n: edits over reference characters on normalised texts; empty references are left out. Null if none is left.

    Equal pairs of texts are compared once, with their number. Distinct pairs are dealt to a fixed number of tasks, since
    adaptive execution would join them by their few bytes, and a comparison takes the product of the lengths.
    """
    pairs = _compared(df, reference, hypothesis, *(by or [])).filter("r <> ''").groupBy(*(by or []), "r", "h").agg(F.count("*").alias("n"))
    pairs = pairs.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "r", "h")
    return pairs.groupBy(*(by or [])).agg((F.sum(_edits("r", "h") * F.col("n")) / F.nullif(F.sum(F.length("r") * F.col("n")), F.lit(0))).alias("cer"), F.sum("n").alias("n"))


def asr_report(df: DataFrame, reference: str = "text", hypothesis: str = "hypothesis", domain: str = "domain", terms: str = "harm_terms", silent: str = "no_speech") -> DataFrame:
    """domain, n, cer (null for the silent domain), empty_rate (of the others), false_transcript_rate (of the silent one), term_recall (over all rows, on each row)."""
    rows = _compared(df, reference, hypothesis, domain, terms)
    has = F.size(F.filter(terms, lambda t: F.contains(F.col("h"), normalize_text(t))))
    spoken = F.col(domain) != silent
    rows = rows.select(domain, "r", "h", has.alias("hit"), F.greatest(F.size(terms), F.lit(0)).alias("all"))
    out = rows.groupBy(domain).agg(
        F.count("*").alias("n"), (F.sum(F.when(spoken & (F.col("r") != ""), _edits("r", "h"))) / F.nullif(F.sum(F.when(spoken, F.length("r"))), F.lit(0))).alias("cer"),
        F.avg(F.when(spoken, (F.col("h") == "").cast("double"))).alias("empty_rate"), F.avg(F.when(~spoken, (F.col("h") != "").cast("double"))).alias("false_transcript_rate"),
        F.sum(F.when(F.col("all") > 0, F.col("hit"))).alias("_hit"), F.sum("all").alias("_all"))
    whole = Window.partitionBy()  # a row for each domain
    return out.withColumn("term_recall", F.sum("_hit").over(whole) / F.nullif(F.sum("_all").over(whole), F.lit(0))).drop("_hit", "_all")


def cascade_report(df: DataFrame, y: str, gate: str, trigger: str) -> DataFrame:
    """recall, fpr and share woken of the gate, the trigger and both (boolean columns)."""
    rows = df.select(F.col(y).alias("y"), F.explode(F.map_from_arrays(F.array(*map(F.lit, ("gate", "trigger", "both"))), F.array(F.col(gate), F.col(trigger), F.col(gate) & F.col(trigger)))).alias("stage", "hit"))
    h = F.col("hit").cast("double")
    return rows.groupBy("stage").agg(F.avg(F.when(F.col("y") == 1, h)).alias("recall"), F.avg(F.when(F.col("y") == 0, h)).alias("fpr"), F.avg(h).alias("woken"))


def accept_asr(base: DataFrame, new: DataFrame, domain: str = "domain", slack: float = 0.02) -> DataFrame:
    """accepted: general error not worse by ``slack``, movie and song better, term recall better, false transcripts not up."""
    b, n = (x.select(domain, F.col("cer").alias(f"{p}_cer"), F.col("term_recall").alias(f"{p}_recall"), F.col("false_transcript_rate").alias(f"{p}_false")) for x, p in ((base, "b"), (new, "n")))
    ok = F.when(F.col(domain) == "general", F.col("n_cer") <= F.col("b_cer") + slack).when(F.col(domain).isin("movie", "song"), F.col("n_cer") < F.col("b_cer")).when(F.col(domain) == "no_speech", F.col("n_false") <= F.col("b_false")).otherwise(True)
    return b.join(n, domain).agg((F.every(F.coalesce(ok, F.lit(False))) & F.every(F.coalesce(F.col("n_recall") > F.col("b_recall"), F.lit(False)))).alias("accepted"))


def segment_confidence(df: DataFrame, key: str) -> DataFrame:
    """Mean log-probability, worst no-speech probability and compression ratio of each transcript's segments."""
    return df.groupBy(key).agg(F.avg("avg_logprob").alias("confidence"), F.max("no_speech_prob").alias("no_speech"), F.max("compression_ratio").alias("compression"))


def real_time_factor(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg((F.sum("elapsed") / F.nullif(F.sum("audio_seconds"), F.lit(0.0))).alias("rtf"))
