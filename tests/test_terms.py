"""Many terms at once, and label sets, against loops and the expressions for few terms."""

import random

import pytest
from pyspark.sql import functions as F

from modlake.functions import terms as M
from modlake.functions import text as X
from modlake.operators import joins as J


def made_texts(n, alphabet, seed=1, size=60):
    r = random.Random(seed)
    return [None, "", "  ", *["".join(r.choice(alphabet + "  ") for _ in range(r.randint(1, size))) for _ in range(n)]]


def test_ten_thousand_terms_are_contains(spark):
    r = random.Random(4)
    terms = list(dict.fromkeys("".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(10_000)))
    texts = made_texts(60, "abcdéABCD", size=30)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {x.id: x.terms for x in M.containing(df, "text", [*terms, "AB"]).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [w for w in [*terms, "ab"] if w in (t or "").lower()]
    few = ["ab", "cD", "e", "ab", ""]
    same = M.containing(df, "text", few).select("terms", J.containment(df, "text", few).alias("want"))
    assert all(x.terms == x.want for x in same.collect())
    with pytest.raises(ValueError):
        M.containing(df, "text", ["x"] * (M.MOST_TERMS + 1))


@pytest.mark.parametrize("alphabet", ["abc", "가각간나낙난다박", "가나ab1"])
def test_near_terms_are_those_of_the_expression(spark, alphabet):
    r = random.Random(8)
    terms = ["".join(r.choice(alphabet) for _ in range(r.randint(2, 7))) for _ in range(12)]
    texts = made_texts(80, alphabet, 9, 40)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    long_enough = list(dict.fromkeys(t for t in terms if len(t) > 2))
    want = {x.id: x.f for x in df.select("id", X.fuzzy_terms(F.col("text"), long_enough).alias("f")).collect()}
    got = {x.id: x.fuzzy for x in M.fuzzy_containing(df, "text", terms).collect()}
    for i in got:
        assert [tuple(f) for f in got[i]] == [tuple(f) for f in want[i] or []], (texts[i], terms)
    assert sum(len(f) for f in got.values()) > 10


def test_a_thousand_terms(spark):
    r = random.Random(2)
    syllables = [chr(0xAC00 + r.randrange(M.SYLLABLES)) for _ in range(60)]
    terms = list(dict.fromkeys("".join(r.choice(syllables) for _ in range(4)) for _ in range(1000)))
    changed = []
    for t in terms:
        k = r.randrange(1, 4)
        code = ord(t[k]) - M.FIRST
        changed.append(t[:k] + chr(M.FIRST + code // M.FINALS * M.FINALS + (code + 1) % M.FINALS) + t[k + 1 :])  # another final consonant
    got = M.fuzzy_containing(spark.createDataFrame([(c,) for c in changed], "text string"), "text", terms).collect()
    assert all(t in [f.term for f in g.fuzzy] and [f.distance for f in g.fuzzy if f.term == t] == [1] for g, t in zip(got, terms, strict=True))


@pytest.mark.parametrize(("labels", "batch"), [(12, None), (70, None), (200, "b"), (1500, None)])
def test_label_sets_against_a_loop(spark, labels, batch):
    r = random.Random(labels)
    rows = []
    for i in range(160):
        own = r.sample(range(labels), r.randint(0, 6))
        if rows and r.random() < 0.6:
            own = list(set(r.choice(rows)[1]) ^ {r.randrange(labels)})
        rows.append((i, own, i % 3))
    if labels > J.BITMAP:
        rows += [(1000 + k, list(range(k, labels, 2)), 0) for k in range(2)]
    df = spark.createDataFrame([(i, [f"l{x}" for x in s], b) for i, s, b in rows], "id long, labels array<string>, b int")
    for t in (0.5, 0.8, 1.0):
        got = sorted((x.a, x.b, round(x.jaccard, 9)) for x in J.label_similarity(df, "id", "labels", t, batch).collect())
        first = {}
        for i, s, b in rows:
            if s:
                first.setdefault((frozenset(s), b if batch else 0), i)
        want = sorted((min(i, j), max(i, j), round(len(a & c) / len(a | c), 9)) for (a, x), i in first.items() for (c, y), j in first.items() if i < j and x == y and len(a & c) / len(a | c) >= t)
        assert got == want
