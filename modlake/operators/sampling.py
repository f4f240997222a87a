"""Sampling, weights and augmentation. Randomness is a hash of seed, epoch and row: runs repeat, partitions don't matter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlake.core import global_rank, hashed_uniform


def seed_mix(*values: Column | int | str) -> Column:
    """A seeded order: md5 over the values joined by bars."""
    return F.md5(F.concat_ws("|", *[(v if isinstance(v, Column) else F.lit(v)).cast("string") for v in values]))


def balanced_batches(df: DataFrame, row_id: str, harm: str, batch_size: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """batch, slot, row_id, harm: batches of half harm rows and the rest others.

    As many batches as the larger pool's quotas fill, at least one. Each pass over a pool has an order of its own; a
    batch doesn't repeat a row unless the pool is smaller than its quota; the short tail of a pass is left out. With
    one pool empty, batches come from the other.
    """
    sizes = {bool(r[0]): r[1] for r in df.groupBy(harm).agg(F.count("*").alias("n")).collect()}
    n_harm = batch_size // 2
    quota = {True: n_harm, False: batch_size - n_harm}
    if not sizes.get(True) or not sizes.get(False):
        quota = dict.fromkeys(quota, batch_size)
    pools = {k: n for k, n in sizes.items() if n and quota[k]}
    batches = max([1, *(math.ceil(n / quota[k]) for k, n in pools.items())])
    out = None
    for kind, size in pools.items():
        q = quota[kind]
        pool = df.filter(F.col(harm) == kind).select(row_id, harm)
        per_pass = size // q
        passes = math.ceil(batches / per_pass) if per_pass else math.ceil(batches * q / size)
        each = pool.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
        ranked = global_rank(each, F.col("_pass"), seed_mix(seed, epoch, int(kind), F.col("_pass"), F.col(row_id)), F.col(row_id), name="_r")
        pos = F.col("_r") - 1 - F.col("_pass") * size
        if per_pass:
            rows = ranked.filter(pos < per_pass * q).select(row_id, harm, (F.col("_pass") * per_pass + F.floor(pos / q)).alias("batch"), F.pmod(pos, F.lit(q)).alias("slot"))
        else:
            i = F.col("_pass") * size + pos
            rows = ranked.select(row_id, harm, F.floor(i / q).alias("batch"), F.pmod(i, F.lit(q)).alias("slot"))
        rows = rows.filter(F.col("batch") < batches).withColumn("slot", F.col("slot") + (0 if kind or len(pools) < 2 else quota[True]))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return df.select(row_id, harm, F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot")).limit(0)
    return out.select(F.col("batch").cast("long"), F.col("slot").cast("long"), row_id, harm)


def domain_weights(df: DataFrame, ratios: dict[str, float], domain: str = "domain") -> DataFrame:
    """``df`` with weight = ratio / rows of its domain. Unknown domains, a zero sum and empty weighted domains are errors."""
    if sum(ratios.values()) <= 0:
        raise ValueError("ratios sum to zero")
    counts = {r[0]: r[1] for r in df.groupBy(domain).agg(F.count("*").alias("n")).collect()}
    if unknown := set(counts) - set(ratios):
        raise ValueError(f"unknown domains: {sorted(map(str, unknown))}")
    if empty := [d for d, r in ratios.items() if r > 0 and not counts.get(d)]:
        raise ValueError(f"no rows in {empty}")
    weights = F.create_map(*[x for d, n in counts.items() for x in (F.lit(d), F.lit(ratios[d] / n))])
    return df.withColumn("weight", weights[F.col(domain)])


#: Mean of a part of a row's draws: a heavier row is cut into equal parts, each drawn for itself; and parts that are dealt at once.
PART, BLOCK = 500, 4_096


def weighted_sample(df: DataFrame, n: int, row_id: str, weight: str = "weight", seed: int = 0, uniform: Column | None = None) -> DataFrame:
    """About n draws with replacement: each row by a Poisson number of mean n w / sum of weights, from its hash; ``draw`` tells a row's draws apart.

    The number is the inverse distribution at ``uniform`` (a hash, where unset). A row of a mean above ``PART`` is the sum of equal parts with
    hashes of their own, so no row is an array that grows with its weight. Null and zero weights are never drawn.
    """
    total = df.agg(F.sum(weight)).first()[0] or 0.0
    whole = F.lit(float(n)) * F.col(weight) / F.lit(float(total) or 1.0)
    parts = F.greatest(F.ceil(whole / PART), F.lit(1)).cast("long")
    x = df.withColumns({"_lam": whole, "_parts": parts}).filter("_lam > 0").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_parts") - 1) / BLOCK))))
    x = x.withColumn("_part", F.explode(F.sequence(F.col("_b") * BLOCK, F.least(F.col("_parts") - 1, F.col("_b") * BLOCK + BLOCK - 1))))
    u = F.when(F.col("_part") == 0, uniform if uniform is not None else hashed_uniform(seed, row_id)).otherwise(hashed_uniform(seed, row_id, F.col("_part")))
    x = x.withColumns({"_u": u, "_lam": F.col("_lam") / F.col("_parts")})
    lam = F.col("_lam")
    state = F.struct(F.exp(-lam).alias("p"), F.exp(-lam).alias("c"), F.lit(0).alias("k"))
    step = lambda s, i: F.when(F.col("_u") < s["c"], s).otherwise(F.struct((s["p"] * lam / i).alias("p"), (s["c"] + s["p"] * lam / i).alias("c"), (s["k"] + 1).alias("k")))
    most = F.ceil(lam + 10 * F.sqrt(lam) + 10).cast("int")
    times = F.aggregate(F.sequence(F.lit(1), most), state, step)["k"]
    far = 2 * PART + 100  # over the draws of any part
    drawn = x.withColumn("_k", times).filter("_k > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    return drawn.withColumn("draw", F.col("draw") + F.col("_part") * far).drop("_k", "_lam", "_parts", "_b", "_part", "_u")


def exact_weighted_sample(df: DataFrame, n: int, row_id: str, weight: str = "weight", seed: int = 0) -> DataFrame:
    """Exactly n draws with replacement: hashed points over the running sum of weights, met by an equi-join on buckets."""
    r = global_rank(df.select(row_id, weight), row_id, sums={"upto": F.col(weight)})
    total = r.agg(F.max("upto")).first()[0]
    width = total / max(n, 1)
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("x", hashed_uniform(seed, "draw") * total).withColumn("_b", F.floor(F.col("x") / width))
    spans = r.withColumn("low", F.col("upto") - F.col(weight)).withColumn("_b", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("upto") / width))))
    hit = draws.join(spans, "_b").filter("x >= low and x < upto").select("draw", row_id)
    return hit.join(df, row_id)


def class_alpha(df: DataFrame, classes: list[str], labels: str = "labels", lo: float = 0.25, hi: float = 0.75) -> DataFrame:
    """class, n, alpha: min-max of 1 / sqrt(n) into lo..hi; .5 without positives, or if fewer than two classes have any."""
    each = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    n = each.join(df.select(F.explode(labels).alias("class")).groupBy("class").agg(F.count("*").alias("n")), "class", "left").fillna(0, ["n"])
    w = Window.partitionBy()  # a row for each class
    inv = F.when(F.col("n") > 0, 1 / F.sqrt("n"))
    low, high, some = F.min(inv).over(w), F.max(inv).over(w), F.count(inv).over(w)
    span = F.when(high > low, (inv - low) / (high - low)).otherwise(0.5)
    return n.withColumn("alpha", F.when((F.col("n") == 0) | (some < 2), 0.5).otherwise(lo + (hi - lo) * span))


def class_weights(df: DataFrame, classes: list[str], label: str = "label") -> DataFrame:
    """class, n, weight = rows / (classes * max(n, 1))."""
    each = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    n = each.join(df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n")), "class", "left").fillna(0, ["n"])
    return n.withColumn("weight", F.sum("n").over(Window.partitionBy()) / (len(classes) * F.greatest("n", F.lit(1))))


def _draw(seed: int, epoch: int, row_id: str, op: str) -> Column:
    return hashed_uniform(seed, F.lit(epoch), F.col(row_id), F.lit(op))


def augment_gain(x: str, row_id: str, seed: int, epoch: int, low: float = -6.0, high: float = 6.0, p: float = 0.5, log_mel: bool = False) -> Column:
    """A gain drawn in dB, with probability p: added to log-mel bins x frames, or multiplied on samples."""
    db = low + (high - low) * _draw(seed, epoch, row_id, "gain")
    on = _draw(seed, epoch, row_id, "gain?") < p
    if log_mel:
        return F.when(on, F.transform(x, lambda f: F.transform(f, lambda v: (v + db * (math.log(10) / 10)).cast("float")))).otherwise(F.col(x))
    return F.when(on, F.transform(x, lambda v: (v * F.pow(F.lit(10.0), db / 20)).cast("float"))).otherwise(F.col(x))


def augment_shift(x: str, row_id: str, seed: int, epoch: int) -> Column:
    """A circular roll by a drawn number of places."""
    n = F.size(x)
    k = F.floor(_draw(seed, epoch, row_id, "shift") * n).cast("int")
    return F.when(n > 0, F.concat(F.slice(x, n - k + 1, k), F.slice(x, F.lit(1), n - k))).otherwise(F.col(x))


def augment_mask(x: str, row_id: str, seed: int, epoch: int, bins: int = 24, frames: int = 64) -> Column:
    """One band of bins and one stretch of frames of a bins x frames array set to 0."""
    u = lambda op: _draw(seed, epoch, row_id, op)
    nb, nf = F.size(x), F.size(F.get(x, F.lit(0)))
    wb, wf = F.floor(u("mask-b") * (F.least(F.lit(bins), nb) + 1)), F.floor(u("mask-f") * (F.least(F.lit(frames), nf) + 1))
    b0, f0 = F.floor(u("mask-b0") * (nb - wb + 1)), F.floor(u("mask-f0") * (nf - wf + 1))
    return F.transform(x, lambda f, i: F.transform(f, lambda v, j: F.when(((i >= b0) & (i < b0 + wb)) | ((j >= f0) & (j < f0 + wf)), F.lit(0.0)).otherwise(v).cast("float")))


def augment_noise(signal: Column, noise: Column, snr_db: Column) -> Column:
    """signal plus noise, tiled or cut to its length, at the given ratio of powers; silence on either side adds nothing."""
    power = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / F.greatest(F.size(x), F.lit(1))
    n = F.size(signal)
    tiled = F.slice(F.flatten(F.array_repeat(noise, F.ceil(n / F.greatest(F.size(noise), F.lit(1))).cast("int"))), F.lit(1), n)
    scale = F.sqrt(power(signal) / (power(tiled) * F.pow(F.lit(10.0), snr_db / 10)))
    ok = (F.size(noise) > 0) & (power(tiled) > 0) & (power(signal) > 0)
    return F.when(ok, F.zip_with(signal, tiled, lambda s, v: (s + v * scale).cast("float"))).otherwise(signal)


def random_crop(x: str, n: int, row_id: str, seed: int, epoch: int, training: bool = True) -> Column:
    """At most n samples: the first ones, or from a drawn start when training."""
    room = F.greatest(F.size(x) - n, F.lit(0))
    start = F.floor(_draw(seed, epoch, row_id, "crop") * (room + 1)).cast("int") if training else F.lit(0)
    return F.slice(x, start + 1, F.lit(n))


def mixup(df: DataFrame, row_id: str, x: str, y: str, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Each row mixed with the next one in a seeded order, by a weight from Beta(1/2, 1/2); labels are joined by max. Never with itself."""
    r = global_rank(df.select(row_id, x, y), seed_mix(seed, epoch, F.col(row_id)), F.col(row_id), name="_r")
    n = df.count()
    if n < 2:
        return df.select(row_id, x, y, F.lit(1.0).alias("lam"))
    other = r.select((F.pmod(F.col("_r") - 2, F.lit(n)) + 1).alias("_r"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    lam = F.pow(F.sin(F.lit(math.pi / 2) * _draw(seed, epoch, row_id, "mixup")), 2)
    both = r.join(other, "_r").withColumn("lam", lam)
    return both.select(row_id, F.zip_with(x, "_x", lambda a, b: (F.col("lam") * a + (1 - F.col("lam")) * b)).alias(x), F.zip_with(y, "_y", lambda a, b: F.greatest(a, b)).alias(y), "lam")


def per_epoch_variants(df: DataFrame, row_id: str, x: str, mean: Column, std: Column, seed: int, epochs: int, training: bool = True) -> DataFrame:
    """Rows for each epoch with their own augmentation: gain, normalise, shift of frames, mask. Evaluation rows are normalised only."""
    from modlake.functions.labels import apply_norm

    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if not training:
        return e.withColumn(x, apply_norm(x, mean, std))
    e = e.withColumn("_row", F.concat_ws("|", F.col("epoch"), F.col(row_id)))
    e = e.withColumn(x, augment_gain(x, "_row", seed, 0, log_mel=True)).withColumn(x, apply_norm(x, mean, std))
    k = hashed_uniform(seed, F.col("_row"), F.lit("roll"))
    rolled = F.transform(x, lambda f: F.concat(F.slice(f, F.size(f) - F.floor(k * F.size(f)).cast("int") + 1, F.floor(k * F.size(f)).cast("int")), F.slice(f, F.lit(1), F.size(f) - F.floor(k * F.size(f)).cast("int"))))
    return e.withColumn(x, rolled).withColumn(x, augment_mask(x, "_row", seed, 0)).drop("_row")
