"""Building collections: label maps, segments, caps, splits, dedupe, promotion, alignment, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlake.core import global_rank, hashed_uniform, running_sums, saved
from modlake.functions.labels import clip_key
from modlake.operators.joins import lookup


def invert_label_map(label_map: DataFrame) -> DataFrame:
    """mid, classes (sorted)."""
    return label_map.groupBy("mid").agg(F.sort_array(F.collect_set("class")).alias("classes"))


def describe_label_map(label_map: DataFrame, ontology: DataFrame) -> DataFrame:
    return label_map.join(ontology.select("mid", "name"), "mid", "left").select("class", "mid", F.coalesce("name", F.lit("<MISSING>")).alias("name"))


def map_segments(segments: DataFrame, label_map: DataFrame, key: str | list[str], mids: str = "mids") -> DataFrame:
    """Segments with labels: the sorted classes of their mids; those without any are left out.

    The map is a dimension table: it is counted, and joined by broadcast if it is small. Spark doesn't know the size of a made map, and
    would send around the segments instead, or sort all segments of a mid in one task.
    """
    keys = [key] if isinstance(key, str) else key
    each = lookup(segments.select(*keys, F.explode(F.array_distinct(mids)).alias("mid")), label_map.select("mid", "class"), "mid", "inner")
    return each.groupBy(*keys).agg(F.sort_array(F.collect_set("class")).alias("labels"))


def cap_per_class(df: DataFrame, cap: int, pos: str, labels: str = "labels") -> DataFrame:
    """Rows of which some class has fewer than ``cap`` earlier rows, in the order of ``pos`` (unique).

    Equal to going through the rows and keeping one while a class of it is below its cap.
    """
    w = Window.partitionBy("_c").orderBy(pos)
    each = df.select(pos, F.explode(F.array_distinct(labels)).alias("_c")).withColumn("_n", F.row_number().over(w))
    keep = each.filter(F.col("_n") <= cap).select(pos).distinct()
    return df.join(keep, pos, "left_semi")


def build_manifest(segments: DataFrame, label_map: DataFrame, source: str, split: str, confidence: str = "verified", cap: int | None = None) -> DataFrame:
    """Clip manifest rows from segments (ytid, start, end, mids, pos)."""
    rows = segments.select("ytid", "start", "end", "mids", "pos")
    mapped = rows.join(map_segments(rows, label_map, "pos"), "pos")
    if cap:
        mapped = cap_per_class(mapped, cap, "pos")
    return mapped.select(
        clip_key("ytid", "start").alias("clip_id"), F.lit(source).alias("source"), F.col("ytid").alias("source_id"), F.col("start").alias("start_sec"), F.round(F.col("end") - F.col("start"), 3).alias("duration"), "labels",
        F.lit(confidence).alias("label_confidence"), F.lit(split).alias("split"), F.lit(None).cast("string").alias("annotator"), F.lit(None).cast("double").alias("snr_est"), F.lit(False).alias("flagged"))


def source_group_counts(df: DataFrame, forced: list[str] = (), key: str = "source_id", source: str = "source") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.max(F.col(source).isin(*forced) if forced else F.lit(False)).alias("forced"))


def check_ratios(ratios: dict[str, float]) -> None:
    if len(ratios) != 3 or abs(sum(ratios.values()) - 1) > 1e-6:
        raise ValueError(f"ratios must be three shares that sum to 1, not {ratios}")


def greedy_runs(sizes: list[tuple[int, int]], ratios: list[float], total: int, fixed: int) -> list[tuple]:
    """(size, alone, paired, first, second, cycle) for each size and number of sources, largest first.

    What a split lacks goes down by the size with each source it gets: three descending sequences of one step, of which the highest
    value is next. So the split that lacks most is alone for ``alone`` sources, then takes turns with the second up to the
    ``paired``-th, and from there all three go round in one order. Lacks are whole millionths, so ties are exact.
    """
    lacks = [round(r * 1_000_000) * total for r in ratios]
    lacks[-1] -= 1_000_000 * fixed
    out = []
    for size, m in sorted(sizes, reverse=True):
        step = 1_000_000 * size
        before = lambda s, value, of: max(0, (lacks[s] - value) // step + 1 if s < of and (lacks[s] - value) % step == 0 else -((value - lacks[s]) // step))  # noqa: B023, E731
        one, two, three = sorted(range(3), key=lambda s: (-lacks[s], s))
        alone = before(one, lacks[two], two)
        n1, n2 = before(one, lacks[three], three), before(two, lacks[three], three)
        nxt = sorted((one, two), key=lambda s: (-(lacks[s] - (n1 if s == one else n2) * step), s))
        cycle = [three, *nxt]
        out.append((size, alone, n1 + n2, one, two, cycle))
        got = [0, 0, 0]
        got[one] += min(m, alone)
        turns = min(max(m - alone, 0), n1 + n2 - alone)
        got[two] += -(-turns // 2)
        got[one] += turns // 2
        left = max(m - n1 - n2, 0)
        for at, s in enumerate(cycle):
            got[s] += left // 3 + (at < left % 3)
        lacks = [x - g * step for x, g in zip(lacks, got, strict=True)]
    return out


def assign_splits_greedy(df: DataFrame, ratios: dict[str, float], seed: int = 0, forced: list[str] = (), key: str = "source_id") -> DataFrame:
    """key, split: sources by size (ties by a seeded md5), each to the split that lacks most of its share of the free rows;
    forced ones go to test and count there first. Three ratios that sum to 1, or ValueError; of equal lacks the first split counts.

    Sources of one size are placed by their rank among these (``greedy_runs``), so the driver sees a number for each size only, of which there are
    at most about the square root of twice the rows, and no task holds all sources.
    """
    check_ratios(ratios)
    groups = saved(source_group_counts(df, forced, key), "source-counts")
    names = list(ratios)
    if names[-1] != "test" and forced:
        raise ValueError("the last split is test, which takes the forced sources")
    free = groups.filter(~F.col("forced"))
    sizes = [tuple(r) for r in free.groupBy("n").count().collect()]
    fixed = groups.filter("forced").agg(F.sum("n")).first()[0] or 0
    runs = df.sparkSession.createDataFrame(greedy_runs(sizes, [ratios[s] for s in names], sum(n * m for n, m in sizes), fixed), "n long, alone long, paired long, one int, two int, cycle array<int>")
    ranked = running_sums(free.select(key, "n").withColumn("_h", hashed_uniform(seed, key)), "n", "_h", key, _j=F.lit(1))
    j = F.col("_j") - 1
    at = F.when(j < F.col("alone"), F.col("one")).when(j < F.col("paired"), F.when((j - F.col("alone")) % 2 == 0, F.col("two")).otherwise(F.col("one"))).otherwise(F.get("cycle", ((j - F.col("paired")) % 3).cast("int")))
    placed = lookup(ranked, runs, "n").select(key, F.get(F.array(*map(F.lit, names)), at).alias("split"))
    return placed.unionByName(groups.filter("forced").select(key, F.lit("test").alias("split")))


def assign_splits_hash(source_id: Column | str, ratios: dict[str, float], seed: int = 0) -> Column:
    """The split of a source by its hash alone: no shuffle, any number of sources."""
    check_ratios(ratios)
    at = F.floor(hashed_uniform(seed, source_id) * 1_000_000)
    out, upto = None, 0.0
    for name, share in ratios.items():
        upto += share
        hit = at < int(round(upto * 1_000_000))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(list(ratios)[-1])


def apply_split(df: DataFrame, assignment: DataFrame, key: str = "source_id") -> DataFrame:
    """``df`` with its source's split; a source without one fails the job."""
    a = assignment.select(key, F.col("split").alias("_split"))
    missing = F.raise_error(F.concat(F.lit("no split for source "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("string")
    return df.drop("split").join(a, key, "left").withColumn("split", F.when(F.col("_split").isNull(), missing).otherwise(F.col("_split"))).drop("_split")


def dedup_union_labels(df: DataFrame, pos: str, key: str = "clip_id", labels: str = "labels") -> DataFrame:
    """One row a clip: the first, with all labels in first-seen order."""
    rest = [c for c in df.columns if c not in (key, labels)]
    lists = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(labels).alias("l")))), lambda x: x["l"])
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), pos).alias("_r"), F.array_distinct(F.flatten(lists)).alias(labels)).select(key, "_r.*", labels)


def split_per_class(df: DataFrame, key: str = "source_id", labels: str = "labels", shares: tuple[float, float] = (0.7, 0.15), seed: int = 0, order: Column | None = None) -> DataFrame:
    """key, class, split: a video belongs to its smallest class; of each class the first share trains, the next validates, the rest tests."""
    own = df.groupBy(key).agg(F.min(F.array_min(labels)).alias("class")).filter("class is not null")
    own = own.withColumn("_order", order if order is not None else F.xxhash64(F.lit(seed), F.col(key)))
    ranked = lookup(running_sums(own, "class", "_order", key, _k=F.lit(1)), own.groupBy("class").agg(F.count("*").alias("_size")), "class")
    k, (train, val) = F.col("_k"), (F.greatest(F.lit(1), F.floor(s * F.col("_size"))) for s in shares)
    return ranked.select(key, "class", F.when(k <= train, "train").when(k <= train + val, "val").otherwise("test").alias("split"))


def split_union(parts: list[DataFrame], split: str | None = None) -> DataFrame:
    all_rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return all_rows.filter(F.col("split") == split) if split else all_rows


def check_promotions(decisions: DataFrame, candidates: DataFrame, classes: DataFrame, harm: bool) -> DataFrame:
    """clip_id, problem: unknown clips, unknown labels, labels of the wrong kind."""
    x = lookup(decisions.join(candidates.select("clip_id", F.lit(True).alias("_c")), "clip_id", "left"), classes.select(F.col("class").alias("label"), "is_harm"), "label")
    problem = F.when(F.col("_c").isNull(), "unknown clip").when(F.col("is_harm").isNull(), "unknown label").when(F.col("is_harm") != harm, "label of the wrong kind")
    return x.withColumn("problem", problem).filter("problem is not null").select("clip_id", "problem")


def promote_reviewed(decisions: DataFrame, candidates: DataFrame, classes: DataFrame, harm: bool) -> DataFrame:
    """Verified train rows of reviewed candidates: confusable labels of false positives (harm False), or harm labels of positives."""
    ok = lookup(decisions, classes.filter(F.col("is_harm") == harm).select(F.col("class").alias("label")), "label", "left_semi")
    return candidates.join(ok.select("clip_id", "label"), "clip_id").select("clip_id", "source", "source_id", "start_sec", "duration", F.array("label").alias("labels"), F.lit("verified").alias("label_confidence"), F.lit("train").alias("split"))


def teacher_targets(df: DataFrame, targets: DataFrame, key: str = "clip_id") -> DataFrame:
    return df.join(targets, key)


def fill_teacher_text(df: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Rows without text or teacher text take a teacher's label; silent rows get an empty text."""
    x = df.join(labels.select(key, F.col("text").alias("_label")), key, "left")
    need = F.col("text").isNull() & F.col("teacher_text").isNull()
    silent = F.col("domain") == "no_speech"
    return x.withColumn("text", F.when(need & silent, "").otherwise(F.col("text"))).withColumn("teacher_text", F.when(need & ~silent, F.col("_label")).otherwise(F.col("teacher_text"))).drop("_label")


def clear_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("labels", F.array().cast("array<string>"))


def first_per_group(df: DataFrame, groups: list[str], name: str, wanted: DataFrame | None = None) -> DataFrame:
    """Of each group the row with the smallest ``name``; a wanted group without rows fails the job."""
    rest = [c for c in df.columns if c not in groups]
    out = df.groupBy(*groups).agg(F.min_by(F.struct(*rest), name).alias("_r")).select(*groups, "_r.*")
    if wanted is not None and (gap := wanted.join(out, groups, "left_anti").limit(5).collect()):
        raise ValueError(f"groups without rows: {[tuple(r) for r in gap]}")
    return out


def sample_per_group(df: DataFrame, group: str, row_id: str, takes: dict[str, int], seed: int = 0, keep: Column | None = None, strict: bool = True, order: Column | None = None) -> DataFrame:
    """``df`` with domain: of each group, in a seeded order, the first n rows for one domain, the next for another."""
    rows = df.filter(keep) if keep is not None else df
    k = F.row_number().over(Window.partitionBy(group).orderBy(order if order is not None else F.xxhash64(F.lit(seed), F.col(row_id)), row_id))
    total = sum(takes.values())
    if strict and (short := rows.groupBy(group).count().filter(F.col("count") < total).limit(5).collect()):
        raise ValueError(f"groups with fewer than {total} rows: {[r[0] for r in short]}")
    out, upto = None, 0
    for name, n in takes.items():
        upto += n
        out = F.when(F.col("_k") <= upto, name) if out is None else out.when(F.col("_k") <= upto, name)
    return rows.withColumn("_k", k).filter(F.col("_k") <= total).withColumn("domain", out).drop("_k")


def align_lines_to_times(lines: DataFrame, times: DataFrame, key: str, duration: str, lead: float = 0.25) -> DataFrame:
    """key, line, start, end: the i-th Hangul syllable of the lines (key, line, text) belongs to the i-th timing row (key, i, start, end)."""
    per_line = lines.withColumn("_s", F.regexp_extract_all("text", F.lit("[가-힣]"), F.lit(0)))
    base = F.coalesce(F.sum(F.size("_s")).over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = per_line.withColumn("_b", base).select(key, "line", "_b", F.posexplode("_s").alias("_i", "syllable")).select(key, "line", (F.col("_b") + F.col("_i")).alias("i"))
    n = each.groupBy(key).agg(F.count("*").alias("a")).join(times.groupBy(key).agg(F.count("*").alias("b")), key, "full").filter("a is null or b is null or a <> b")
    if bad := n.limit(5).collect():
        raise ValueError(f"syllables and times differ in number: {[r[0] for r in bad]}")
    out = each.join(times, [key, "i"]).groupBy(key, "line").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(duration).alias("_d"))
    return out.select(key, "line", F.greatest(F.lit(0.0), F.col("start") - lead).alias("start"), F.least(F.col("_d"), F.col("end") + lead).alias("end"))


def mix_plan(foreground: DataFrame, background: DataFrame, fg_id: str, bg_id: str, snrs: tuple[float, ...] = (0.0, 5.0, 10.0)) -> DataFrame:
    """fg_id, bg_id, snr: foreground rows take the background in turn, and the levels in turn."""
    n = background.count()
    if not n:
        raise ValueError("no background")
    f = global_rank(foreground.select(fg_id), fg_id, name="_n").select(fg_id, (F.col("_n") - 1).alias("_k"))
    b = global_rank(background.select(bg_id), bg_id, name="_n").select(bg_id, (F.col("_n") - 1).alias("_j"))
    return f.withColumn("_j", F.pmod("_k", F.lit(n))).join(b, "_j").select(fg_id, bg_id, F.get(F.array(*map(F.lit, snrs)), F.pmod("_k", F.lit(len(snrs))).cast("int")).alias("snr"))


def count_matrix(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def status_report(df: DataFrame, row_id: str, status: str = "status", failed: str = "failed") -> tuple[DataFrame, DataFrame]:
    """Counts by status, and the failed ids."""
    return df.groupBy(status).agg(F.count("*").alias("n")), df.filter(F.col(status) == failed).select(row_id)


fetch_report = precompute_report = status_report


def seeded_order(seed: int, *cols: str) -> Column:
    return hashed_uniform(seed, *cols)
