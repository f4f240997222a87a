"""Quality rules: base statistics of whole texts, and a learned decision list over them. DataFrame functions only.

Rules are found by sequential covering over the labelled documents, whose statistics are kept as bins. Growing adds the
threshold with the highest information gain to a conjunction: each step counts the covered documents by statistic, bin
and label in Spark, so that the driver sees at most ``BINS`` counts for each statistic and label. Pruning takes conditions
off the end while the other fold says so; covered documents go and the next rule is sought. A list is emitted as one
conditional expression, first rule first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlake.functions.text import let
from modlake.llm.common import WORD, discard, saved, text_or_empty

WINDOW = 8
#: Statistics that rules may use, by name: ratios of the base counts.
STATISTICS = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "stutter_share": "n_stutter / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
}
#: Where thresholds may lie: quantiles of the labelled documents, by label.
QUANTILES = {0: (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98), 1: (0.002, 0.02, 0.98, 0.998)}
BINS = sum(map(len, QUANTILES.values())) + 1
MAX_RULES, MAX_CONDITIONS = 8, 3
#: Share of bad documents among those that a rule covers, on the pruning fold, and their least number.
PRECISION, LEAST = 0.9, 5


def _repeat_words(words: Column, n: Column) -> Column:
    """Words that stand in a window of WINDOW words found twice or more."""
    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.named_struct(F.lit("h"), x, F.lit("i"), i)))

        def places(s: Column) -> Column:
            again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(F.get(s, k)["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(F.get(s, k)["h"] == F.get(s, k + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(again, lambda k: F.get(s, k)["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - i)).alias("n"))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(F.aggregate(let(ranked, places), start, step)["n"])

    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(WINDOW))))
    return F.when(n <= WINDOW, 0).otherwise(let(windows, covered))


def _stutter(w: Column) -> Column:
    return F.when(F.size(w) < 2, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.get(w, i) == F.get(w, i - 1))))


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of every whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_distinct,
    n_stutter (words equal to the one before).

    Null texts have no words: every count is 0. Repeated rows give repeated rows; other columns are left out.
    """
    text = text_or_empty("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    found = F.struct(
        let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), _repeat_words(w, F.size(w)).cast("long").alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), _stutter(w).cast("long").alias("n_stutter"))).alias("words"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
    )
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.select("doc_id", found.alias("x")).select("doc_id", "x.words.*", "x.n_dup_lines", "x.word_chars", "x.n_symbols", "x.n_upper")


def learn(labelled: DataFrame) -> list[list[tuple[str, str, float]]]:
    """Rules from rows of statistics with label y (0: bad): each a list of (statistic, '<' or '>=', threshold)."""
    names = list(STATISTICS)
    rows = labelled.filter("y in (0, 1)").select("y", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold"), *[F.expr(e).cast("double").alias(n) for n, e in STATISTICS.items()])
    at = rows.groupBy("y").agg(*[F.percentile_approx(n, list(QUANTILES[y]), 10_000).alias(f"{n}_{y}") for n in names for y in QUANTILES]).collect()
    cuts = {n: sorted({x for r in at for x in r[f"{n}_{r.y}"] or []}) for n in names}
    bins = [sum((F.when(F.col(n) >= c, 1).otherwise(0) for c in cuts[n]), F.lit(0)).alias(n) for n in names]
    rows = saved(rows.select("y", "fold", *bins), "labelled-bins")
    grow, prune = rows.filter("fold <> 0"), rows.filter("fold = 0")
    rules = []
    while len(rules) < MAX_RULES:
        rule, good, bad = _pruned(_grown(grow, names), prune)
        if not rule or bad < LEAST or bad < PRECISION * (good + bad):
            break
        rules.append([(n, op, cuts[n][k - 1]) for n, op, k in rule])
        grow, prune = (part.filter(~_holds(rule)) for part in (grow, prune))
    discard(rows)
    return rules


def _holds(rule: list[tuple[str, str, int]]) -> Column:
    out = F.lit(True)
    for name, op, k in rule:
        out = out & (F.col(name) >= k if op == ">=" else F.col(name) < k)
    return out


def _grown(rows: DataFrame, names: list[str]) -> list[tuple[str, str, int]]:
    """The conjunction that grows by the best condition of each step; ties go to the first statistic and threshold."""
    rule: list[tuple[str, str, int]] = []
    while len(rule) < MAX_CONDITIONS:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(n).alias("bin")) for i, n in enumerate(names)])).alias("x")
        counts: dict = {}
        for r in rows.filter(_holds(rule)).select("y", each).groupBy("x.i", "x.bin", "y").count().collect():
            counts.setdefault(r["i"], {})[r["bin"], r["y"]] = r["count"]
        good, bad = (sum(c for (_, y), c in counts.get(0, {}).items() if y == label) for label in (1, 0))
        if not bad or not good:
            break
        gain, best = 0.0, None
        for i, n in enumerate(names):
            for k in range(1, max((b for b, _ in counts[i]), default=0) + 1):
                for op in ("<", ">="):
                    g, b = (sum(c for (at, y), c in counts[i].items() if y == label and (at >= k) == (op == ">=")) for label in (1, 0))
                    if b and (v := b * (math.log2(b / (g + b)) - math.log2(bad / (good + bad)))) > gain + 1e-9:
                        gain, best = v, (n, op, k)
        if best is None:
            break
        rule.append(best)
    return rule


def _pruned(rule: list, rows: DataFrame) -> tuple[list, int, int]:
    """The beginning of the rule that is worth most on the rows, the longest of equals, with what it covers: good, bad."""
    if not rule:
        return [], 0, 0
    counts = [F.count(F.when(_holds(rule[:k]) & (F.col("y") == label), 1)) for k in range(len(rule), 0, -1) for label in (1, 0)]
    got = list(rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first())
    worth = lambda g, b: (b - g) / (b + g) if b + g else -1.0
    at = max(range(len(rule)), key=lambda i: (worth(got[2 * i], got[2 * i + 1]), -i))
    return rule[: len(rule) - at], got[2 * at], got[2 * at + 1]


def verdict(rules: list) -> Column:
    """True unless a rule holds: an ordered conditional expression over the statistics' columns."""
    out = None
    for rule in rules:
        hit = F.lit(True)
        for name, op, value in rule:
            x = F.expr(STATISTICS[name])
            hit = hit & (x >= F.lit(value) if op == ">=" else x < F.lit(value))
        out = F.when(hit, False) if out is None else out.when(hit, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def apply_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The statistics of each row, base_failed, kept. Rules are learned from the labelled rows that the base keeps.

    Without labels, or where no rule is good enough, kept is the base's verdict. An id with several labels counts as often.
    """
    stats = saved(statistics(df, id_col, text_col).withColumn("base_failed", base_failed()), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    rules = learn(saved(stats.filter("not base_failed").join(known, "doc_id"), "labelled"))
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules))
