"""Text scoring expressions and operators. Lexicons, prototypes and term lists are tables or literals given by the caller."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlake.operators.joins import lookup

Lexicon = dict[str, tuple[float, dict[str, float]]]  # category -> (weight, term -> weight)


def lexicon_from_table(table: DataFrame) -> Lexicon:
    """category, term, w, cat_weight -> a lexicon; categories in the order of their name. A configuration table."""
    out: Lexicon = {}
    for r in table.orderBy("category", "term").collect():
        out.setdefault(r.category, (r.cat_weight, {}))[1][r.term.lower()] = r.w
    return out


def lexicon_score(text: Column | str, lexicon: Lexicon) -> Column:
    """struct(risk, top, by_category map, matched map): case-insensitive containment, a narrow expression.

    A category's risk is round(min(1, sum of weights) * its weight, 4); the text's is the largest, ties to the first.
    """
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))

    def category(name: str, weight: float, terms: dict[str, float]) -> Column:
        entries = F.array(*[F.named_struct(F.lit("t"), F.lit(t.lower()), F.lit("w"), F.lit(float(w))) for t, w in terms.items()])
        risk = lambda h: F.round(F.least(F.lit(1.0), F.aggregate(h, F.lit(0.0), lambda a, e: a + e["w"])) * F.lit(float(weight)), 4)
        return F.transform(F.array(F.filter(entries, lambda e: F.contains(low, e["t"]))), lambda h: F.named_struct(F.lit("c"), F.lit(name), F.lit("r"), risk(h), F.lit("m"), F.transform(h, lambda e: e["t"])))[0]

    cats = [category(name, weight, terms) for name, (weight, terms) in lexicon.items()]

    def summary(x: Column) -> Column:
        some = F.filter(x, lambda e: F.size(e["m"]) > 0)
        best = F.array_max(F.transform(x, lambda e, i: F.named_struct(F.lit("r"), e["r"], F.lit("i"), -i, F.lit("c"), e["c"])))
        return F.named_struct(
            F.lit("risk"), best["r"], F.lit("top"), F.when(best["r"] > 0, best["c"]), F.lit("by_category"), F.map_from_entries(F.transform(x, lambda e: F.struct(e["c"], e["r"]))),
            F.lit("matched"), F.map_from_entries(F.transform(some, lambda e: F.struct(e["c"], e["m"]))))

    return F.transform(F.array(F.array(*cats)), summary)[0]


def vocabulary_prompt(terms: Column, n: int, separator: str = ", ") -> Column:
    """At most n terms of a category: all, or the first n - n/3 and the last n/3; without repeats, joined."""
    tail = n // 3
    size = F.size(terms)
    cut = F.concat(F.slice(terms, 1, n - tail), F.slice(terms, F.greatest(size - tail + 1, F.lit(1)), F.lit(tail)))
    return F.array_join(F.array_distinct(F.when(size <= n, terms).otherwise(cut)), separator)


# Hangul syllables are laid out by code point as 19 initials x 21 vowels x 28 finals from U+AC00.
_FIRST, _VOWELS, _FINALS = 0xAC00, 21, 28


def _units(c: Column) -> Column:
    """The units of one character."""
    code = F.ascii(c) - _FIRST
    unit = lambda base, v: F.decode(F.unhex(F.lpad(F.hex(F.lit(base) + v), 4, "0")), "UTF-16BE")
    syllable = F.concat(unit(0xE000, F.floor(code / (_VOWELS * _FINALS)).cast("int")), unit(0xE100, F.pmod(F.floor(code / _FINALS).cast("int"), F.lit(_VOWELS))), unit(0xE200, F.pmod(code, F.lit(_FINALS))))
    return F.when((code >= 0) & (code < 11172), syllable).otherwise(c)


def jamo(text: Column) -> Column:
    """Each Hangul syllable as three units of one private-use character each (initial, vowel, final, where none has a unit too); others stay."""
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), _units), "")


def fuzzy_terms(text: Column, terms: list[str], most: int = 1) -> Column:
    """array of (term, distance, span): terms of 3 or more characters within ``most`` unit edits of a span of the text without spaces.

    Spans are one shorter to one longer than the term and begin with the same unit. A term that the text holds is left
    out. Of several spans the best distance counts, then the shorter, then the first.
    """
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    long_enough = [t for t in terms if len(t) >= 3]
    none = F.array().cast("array<struct<term:string,distance:int,span:string>>")
    if not long_enough:
        return none

    def in_units(chars: Column) -> Column:
        return F.transform(F.array(F.transform(chars, _units)), lambda units: F.array_compact(F.array(*[one(t, chars, units) for t in long_enough])))[0]

    def one(term: str, chars: Column, units: Column) -> Column:
        target = F.array_join(F.transform(F.array(*map(F.lit, term)), _units), "")
        first = F.substring(target, 1, 1)
        starts = F.filter(F.sequence(F.lit(1), F.size(units)), lambda i: F.substring(F.get(units, i - 1), 1, 1) == first)
        if most == 1 and target_is_plain(term):
            starts = F.filter(starts, lambda i: F.array_join(F.slice(chars, i, F.lit(len(term) + 1)), "").rlike("^" + within_one([term])))

        def of_width(n: int) -> Column:
            fit = F.filter(starts, lambda i: i + n - 1 <= F.size(units))
            return F.transform(fit, lambda i: F.named_struct(F.lit("d"), F.levenshtein(F.array_join(F.slice(units, i, F.lit(n)), ""), target, most), F.lit("n"), F.lit(n), F.lit("i"), i, F.lit("s"), F.array_join(F.slice(chars, i, F.lit(n)), "")))

        near = F.filter(F.concat(*map(of_width, (len(term) - 1, len(term), len(term) + 1))), lambda x: x["d"] >= 0)
        hit = lambda best: F.when(best.isNotNull(), F.named_struct(F.lit("term"), F.lit(term), F.lit("distance"), best["d"], F.lit("span"), best["s"]))
        return F.when((F.size(units) > 0) & ~F.contains(F.array_join(chars, ""), F.lit(term)), F.transform(F.array(F.array_min(near)), hit)[0])

    def searched(flat: Column) -> Column:
        return F.transform(F.array(F.filter(F.split(flat, ""), lambda c: c != "")), in_units)[0]

    # most texts have nothing near: a pattern in one pass tells, where units are characters
    if most != 1 or not all(map(target_is_plain, long_enough)):
        return let(flat, searched)
    return let(flat, lambda f: F.when(f.rlike("[\uac00-\ud7a3]") | f.rlike(within_one(long_enough)), searched(f)).otherwise(none))


def target_is_plain(term: str) -> bool:
    """Whether each character of a term is one unit."""
    return not any(0 <= ord(c) - _FIRST < 11172 for c in term)


def within_one(terms: list[str]) -> str:
    """A pattern found in every text with a span that begins as one of the terms does and is within one edit of it."""
    each = []
    for t in terms:
        tail = [re.escape(c) for c in t[1:]]
        edits = ["".join([*tail[:i], ".", *tail[i + 1 :]]) for i in range(len(tail))] + ["".join([*tail[:i], *tail[i + 1 :]]) for i in range(len(tail))] + ["".join([*tail[:i], ".", *tail[i:]]) for i in range(len(tail) + 1)]
        each.append(re.escape(t[0]) + "(?:" + "|".join(dict.fromkeys(["".join(tail), *edits])) + ")")
    return "(?s)(?:" + "|".join(each) + ")"



def text_units(text: Column, window: int = 8) -> Column:
    """The text, its sentences, their clauses, and the full windows of clauses of over ``window`` words; first-seen order, without repeats.

    Sentences end at newlines and at white space after an end mark; clauses at , ; : and dots of omission, and at a dash
    before white space, all left out. Windows move by half their length. Null and blank texts have no units.
    """
    none = F.array().cast("array<string>")
    some = lambda xs: F.filter(xs, lambda x: x != "")

    def windows(clause: Column) -> Column:
        words = F.split(clause, r"(?U)\s+")
        return let(words, lambda w: F.when(F.size(w) > window, F.transform(F.sequence(F.lit(1), F.size(w) - window + 1, F.lit(max(2, window // 2))), lambda i: F.array_join(F.slice(w, i, F.lit(window)), " "))).otherwise(none))

    clauses = lambda s: F.flatten(F.transform(some(F.split(s, r"(?U)\s*(?:[,;:…]+|[-–—]\s+)\s*")), lambda c: F.concat(F.array(c), windows(c))))
    sentences = lambda t: F.flatten(F.transform(some(F.split(t, r"(?U)\s*\n\s*|(?<=[.!?。！？])\s+")), lambda s: F.concat(F.array(s), clauses(s))))
    return let(full_text(text), lambda t: F.when(t == "", none).otherwise(F.array_distinct(F.concat(F.array(t), sentences(t)))))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body, or a lambda in it, names it."""
    return F.transform(F.array(value), body)[0]


def full_text(text: Column) -> Column:
    """The first unit of a text: itself, stripped, blanks and tabs folded."""
    return F.regexp_replace(_strip(F.coalesce(text, F.lit(""))), r"[ \t]{2,}|\t", " ")


def hybrid_text_score(df: DataFrame, row_id: str, text: str, lexicon: Lexicon, unit_scores: DataFrame | None = None, fuzzy: list[tuple[str, str]] = ()) -> DataFrame:
    """row_id, score, unit, classifier_max, lexicon_max: the best over a text's units, or over the text where it has none.

    ``unit_scores`` (unit, score, and row_id if scores depend on the row) are the classifier's; ``unit`` is the first of
    the highest of them. The lexicon's score of a unit is its risk, or .85 of a category's weight for a fuzzy term (term,
    category) if that is more, and at most 1. Nulls and missing scores count as 0.
    """
    of = let(text_units(F.col(text)), lambda u: F.when(F.size(u) > 0, u).otherwise(F.array(F.coalesce(F.col(text), F.lit("")))))
    units = df.select(row_id, F.posexplode_outer(of).alias("i", "unit"))  # never empty; posexplode would compute them once more to filter by their number
    words = [lexicon_score("unit", lexicon)["risk"], F.lit(0.0)]
    for term, category in fuzzy:
        words.append(F.when(F.size(fuzzy_terms(F.col("unit"), [term])) > 0, 0.85 * lexicon[category][0]).otherwise(0.0))
    own = F.lit(0.0)
    if unit_scores is not None:
        on = [*([row_id] if row_id in unit_scores.columns else []), "unit"]  # sorted by the row first, as the grouping needs it
        units = units.join(unit_scores.select(*on, F.col("score").alias("_s")), on, "left")
        own = F.coalesce("_s", F.lit(0.0))
    x = units.withColumns({"_c": own, "_l": F.least(F.lit(1.0), F.greatest(*words))})
    x = x.groupBy(row_id).agg(F.max("_c").alias("classifier_max"), F.max("_l").alias("lexicon_max"), F.max_by("unit", F.struct("_c", -F.col("i"))).alias("unit"))
    return x.withColumn("score", F.greatest("classifier_max", "lexicon_max"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


#: Prototypes are compared with every row, so their number is checked.
MOST_PROTOTYPES = 10_000


def prototype_score(df: DataFrame, row_id: str, embedding: str, prototypes: DataFrame, safe: str = "safe", steep: float = 40.0, margin: float = 0.02, text: str | None = None) -> DataFrame:
    """row_id, risk, margin, category, by_category: cosine to prototypes (category, embedding), best of each category.

    ``prototypes`` (a few sentences a category) is broadcast to the rows; more than ``MOST_PROTOTYPES`` are an error.
    """
    unit = lambda c: F.transform(c, lambda v: v.cast("double") / F.sqrt(F.greatest(dot(F.col(c), F.col(c)), F.lit(1e-24))))
    p = prototypes.select("category", unit("embedding").alias("_p")).groupBy("category").agg(F.collect_list("_p").alias("_ps"))
    all_p = p.agg(F.array_sort(F.collect_list(F.struct("category", "_ps"))).alias("_all"))
    if prototypes.limit(MOST_PROTOTYPES + 1).count() > MOST_PROTOTYPES:
        raise ValueError(f"over {MOST_PROTOTYPES} prototypes")
    e = df.withColumn("_e", unit(embedding)).crossJoin(F.broadcast(all_p))  # one row
    best = F.transform("_all", lambda c: F.named_struct(F.lit("category"), c["category"], F.lit("s"), F.array_max(F.transform(c["_ps"], lambda v: dot(F.col("_e"), v)))))
    x = e.select(row_id, *([text] if text else []), best.alias("b"))
    harm = F.filter("b", lambda c: c["category"] != safe)
    top = F.array_max(F.transform(harm, lambda c, i: F.named_struct(F.lit("s"), c["s"], F.lit("i"), -i, F.lit("c"), c["category"])))
    calm = F.coalesce(F.array_max(F.transform(F.filter("b", lambda c: c["category"] == safe), lambda c: c["s"])), F.lit(0.0))
    x = x.select(row_id, *([text] if text else []), (top["s"] - calm).alias("margin"), top["c"].alias("_c"), F.map_from_entries(F.transform("b", lambda c: F.struct(c["category"], c["s"]))).alias("by_category"))
    risk = 1 / (1 + F.exp(-steep * (F.col("margin") - margin)))
    if text:
        risk = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", 0.0).otherwise(risk)
    return x.select(row_id, risk.alias("risk"), "margin", F.when(F.col("margin") > margin, F.col("_c")).alias("category"), "by_category")


def softmax_risk(probs: Column, safe: str = "safe") -> Column:
    """struct(risk, category) of a class -> probability map: 1 - P(safe), and the top harmful class from .5 on."""
    risk = F.round(1 - F.coalesce(F.try_element_at(probs, F.lit(safe)), F.lit(0.0)), 4)
    harm = F.filter(F.map_entries(probs), lambda e: e["key"] != safe)
    top = F.array_max(F.transform(harm, lambda e, i: F.named_struct(F.lit("v"), e["value"], F.lit("i"), -i, F.lit("k"), e["key"])))
    return F.struct(risk.alias("risk"), F.when(risk >= 0.5, top["k"]).alias("category"))


def ensemble_toxicity(models: Column, benign: list[str], categories: dict[str, str]) -> Column:
    """struct(risk, category): the largest score that any model gives a label that isn't benign; its category from .5 on."""
    entries = F.filter(F.flatten(F.transform(models, lambda m: F.map_entries(m))), lambda e: ~e["key"].isin(*benign))
    top = F.array_max(F.transform(entries, lambda e, i: F.named_struct(F.lit("v"), e["value"], F.lit("i"), -i, F.lit("k"), e["key"])))
    names = F.create_map(*[x for k, v in categories.items() for x in (F.lit(k), F.lit(v))])
    risk = F.coalesce(top["v"], F.lit(0.0))
    return F.struct(risk.alias("risk"), F.when(risk >= 0.5, F.coalesce(F.try_element_at(names, top["k"]), top["k"])).alias("category"))


def combine_text_risk(lexicon: Column, lexicon_top: Column, semantic: Column, fuzzy_distance: Column, learned: Column | None = None) -> Column:
    """struct(risk, source). A learned risk stands alone. Else the larger of lexicon and semantic; a semantic score under
    .3 vetoes the lexicon unless it found a threat. A fuzzy hit adds .75 or .6 by its distance unless the semantic score is under .2."""
    veto = semantic.isNotNull() & (semantic < 0.30) & ~F.coalesce(lexicon_top == "threat", F.lit(False))
    words = F.when(veto, F.lit(0.0)).otherwise(lexicon)
    fuzzy = F.when(fuzzy_distance.isNull() | F.coalesce(semantic < 0.20, F.lit(False)), 0.0).when(fuzzy_distance <= 0, 0.75).otherwise(0.6)
    base = F.greatest(F.coalesce(words, F.lit(0.0)), F.coalesce(semantic, F.lit(0.0)))
    mixed = F.struct(F.greatest(base, fuzzy).alias("risk"), F.when(fuzzy > base, "fuzzy").when(F.coalesce(words, F.lit(0.0)) >= F.coalesce(semantic, F.lit(0.0)), "lexicon").otherwise("semantic").alias("source"))
    return mixed if learned is None else F.when(learned.isNotNull(), F.struct(learned.alias("risk"), F.lit("learned").alias("source"))).otherwise(mixed)


def normalize_text(text: Column) -> Column:
    """Lower case; Hangul syllables, Latin letters and digits, nothing else. For composed text; see ``compose``."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^가-힣a-zA-Z0-9]", ""))


def compose(df: DataFrame, *texts: str) -> DataFrame:
    """``df`` with the texts in Unicode NFC. Only rows with decomposable characters go through Python."""
    import unicodedata

    needs = reduce(or_, [F.coalesce(F.col(t).rlike(r"[\p{M}ᄀ-ᇿ]"), F.lit(False)) for t in texts])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{t: [x if x is None else unicodedata.normalize("NFC", x) for x in f[t]] for t in texts})

    return df.filter(~needs).unionByName(df.filter(needs).mapInPandas(run, df.schema))


def remove_leading_overlap(df: DataFrame, key: str, order: str, text: str, most: int = 20) -> DataFrame:
    """``df`` with fresh: the text without its longest beginning, up to ``most`` tokens, that the stream's last non-empty text ends with.

    Tokens are compared as ``normalize_text`` leaves them, and a token of which nothing is left fits none. A text without
    overlap stays but for white space at its ends; a null text is empty.
    """
    own, prev = f"{text}_own", f"{text}_before"
    x = compose(df.withColumn(own, F.coalesce(F.col(text), F.lit(""))), own)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn(prev, F.last(F.when(_strip(F.col(own)) != "", F.col(own)), ignorenulls=True).over(w))
    tokens = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda v: v != "")

    def fresh(now: Column, same: Column, before: Column) -> Column:
        a, b = F.transform(F.slice(same, F.lit(1), F.lit(most)), normalize_text), F.transform(F.slice(before, F.greatest(F.size(before) - most + 1, F.lit(1)), F.lit(most)), normalize_text)

        def longest(left: Column, right: Column) -> Column:
            sizes = F.sequence(F.lit(0), F.least(F.size(left), F.size(right)))
            return F.array_max(F.filter(sizes, lambda n: (n == 0) | ((F.slice(left, F.lit(1), n) == F.slice(right, F.size(right) - n + 1, n)) & ~F.array_contains(F.slice(left, F.lit(1), n), ""))))

        n = let(F.struct(a.alias("a"), b.alias("b")), lambda v: longest(v["a"], v["b"]))
        return F.when(n > 0, F.array_join(F.slice(now, n + 1, F.size(now)), " "))

    cut = let(F.struct(tokens(F.col(text)).alias("now"), tokens(F.col(own)).alias("same"), tokens(F.col(prev)).alias("before")), lambda v: fresh(v["now"], v["same"], v["before"]))
    return x.withColumn("fresh", F.coalesce(cut, _strip(F.coalesce(F.col(text), F.lit(""))))).drop(own, prev)


def detect_lang(text: Column) -> Column:
    return F.when(F.coalesce(text.rlike("[가-힣]"), F.lit(False)), "ko").otherwise("en")


def weak_label(text: Column, violence: str, slur: str, clean: Column | None = None) -> Column:
    """threat, abuse or safe by two patterns; null where nothing is known."""
    return F.when(text.rlike(violence), "threat").when(text.rlike(slur), "abuse").when(clean if clean is not None else F.lit(False), "safe")


def cap_label(df: DataFrame, label: str, value: str, most: int, row_id: str, seed: int = 0, order: Column | None = None) -> DataFrame:
    """At most ``most`` rows of one label, drawn by a seeded order; all rows of the others. Top-k, no full sort."""
    part = df.filter(F.col(label) == value).orderBy(order if order is not None else F.xxhash64(F.lit(seed), F.col(row_id)), row_id).limit(most)
    return df.filter(~F.coalesce(F.col(label) == value, F.lit(False))).unionByName(part)


def _some(clauses: DataFrame, cell: list[str], target: int, seed: int) -> DataFrame:
    """Of each cell so many clauses, in seeded order, that their ordered pairs are ``target`` or all there are."""
    most = math.isqrt(max(target, 0)) + 2
    n = F.row_number().over(Window.partitionBy(*cell).orderBy(seeded(seed, "text"), "text"))
    return clauses.select(*cell, "text").distinct().withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def seeded(seed: int, text: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(text)))


def _topped(rows: DataFrame, cell: list[str], target: int, seed: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*cell).orderBy("_k", seeded(seed, "text"), "text"))
    return rows.withColumn("_n", n).filter(F.col("_n") <= target).drop("_n", "_k")


def generate_corpus(clauses: DataFrame, connectors: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """category, lang, text: base clauses (category, lang, text), then pairs of one category and language joined by a connector (lang, connector), up to ``target`` a category.

    Only as many clauses of a category and language are paired as ``target`` pairs need; order is seeded.
    """
    cell = ["category", "lang"]
    some = _some(clauses, cell, target, seed)
    pairs = lookup(some.join(some.withColumnRenamed("text", "_b"), cell).filter("text <> _b"), connectors.select("lang", "connector"), "lang", "inner")
    pairs = pairs.select(*cell, F.concat_ws(" ", "text", "connector", "_b").alias("text"), F.lit(1).alias("_k"))
    every = clauses.select(*cell, "text", F.lit(0).alias("_k")).unionByName(pairs).groupBy(*cell, "text").agg(F.min("_k").alias("_k"))
    return _topped(every, ["category"], target, seed)


def generate_templates(terms: DataFrame, templates: DataFrame, tails: DataFrame, held_out: DataFrame, slot: str = "{}") -> DataFrame:
    """label, text: each term (term, label) that isn't held out in each template of its label, alone and with each tail."""
    t = terms.join(held_out.select("term"), "term", "left_anti")
    lines = lookup(t, templates, "label", "inner").select("label", F.replace(F.col("template"), F.lit(slot), F.col("term")).alias("text"), F.lit(True).alias("_on"))
    more = lookup(lines, tails.select("tail", F.lit(True).alias("_on")), "_on", "inner").select("label", F.concat_ws(" ", "text", "tail").alias("text"))
    return lines.drop("_on").unionByName(more).dropDuplicates(["text"])


def generate_testset(clauses: DataFrame, per_cell: int, joiner: str = " ", seed: int = 0) -> DataFrame:
    """category, kind, lang, text: of each cell the base clauses, then joined pairs of as many clauses as that needs, up to ``per_cell``; order is seeded."""
    cell = ["category", "kind", "lang"]
    some = _some(clauses, cell, per_cell, seed)
    pairs = some.join(some.withColumnRenamed("text", "_b"), cell).filter("text <> _b").select(*cell, F.concat_ws(joiner, "text", "_b").alias("text"), F.lit(1).alias("_k"))
    every = clauses.select(*cell, "text", F.lit(0).alias("_k")).unionByName(pairs).groupBy(*cell, "text").agg(F.min("_k").alias("_k"))
    return _topped(every, cell, per_cell, seed)


def decontaminate(df: DataFrame, text: str, held: DataFrame, held_text: str, row_id: str) -> DataFrame:
    """Rows whose text without spaces is in no evaluation set; of repeats the one with the smallest id."""
    squeezed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    bad = held.select(F.md5(squeezed(F.col(held_text))).alias("_k")).distinct()
    x = df.withColumn("_k", F.md5(squeezed(F.col(text)))).join(bad, "_k", "left_anti")
    first = x.groupBy("_k").agg(F.min(row_id).alias(row_id))
    return x.join(first, ["_k", row_id], "left_semi").drop("_k")
