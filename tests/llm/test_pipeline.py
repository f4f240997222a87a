"""The pipeline's stages on a small corpus, each against what its operator says."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from modlake.llm import common, forest, mixing, pii, ranking, simhash
from modlake.llm.common import table


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    names = docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    (_, quality), (_, dedup), (_, private), (_, mix), (_, tokens) = corpus_pipeline.STAGES
    a = quality(spark, docs, sf).cache()
    said = ranking.classify(docs, table(spark, sf, "labels")).filter("predicted = 1")
    assert a.columns == names and ids(a) == ids(said) and 0 < a.count() < docs.count()
    b = dedup(spark, a, sf).cache()
    assert b.columns == names and ids(b) == sorted(slow_groups([(r.doc_id, r.text) for r in a.collect()])[1])
    c = private(spark, b, sf).cache()
    assert c.columns == names and ids(c) == ids(b)
    assert all(not pii.base_spans(r.text) for r in c.collect()) and all(r.n_chars == len(r.text) for r in c.collect())
    d = mix(spark, c, sf).cache()
    plan = {r.doc_id: r.whole for r in mixing.mix(c).collect()}
    assert d.columns == names and ids(d) == sorted(i for i, n in plan.items() for _ in range(n))
    e = tokens(spark, d, sf)
    assert e.count() == d.count() and e.filter(F.col("n_tokens") == 0).count() == d.filter("text = ''").count()


def slow_groups(rows):
    """The smallest id of each row's group, and of all groups: pairs of 5-word Jaccard 0.8 or more, one by one."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and (sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    low = {}
    for (i, _), g in zip(rows, root, strict=True):
        low[g] = min(i, low.get(g, i))
    return {i: low[g] for (i, _), g in zip(rows, root, strict=True)}, list(low.values())


def test_run_equals_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
    a, b = (sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in x.collect()) for x in (corpus_pipeline.run(spark, sf), docs))
    assert a == b and a


def test_odd_documents_run_through(spark, tmp_path):
    """Null ids and texts, repeated rows, clashing columns and an empty table: each stage keeps the columns it was given."""
    words = " ".join(f"w{i % 37} v{i % 11}" for i in range(60))
    rows = [(None, words, "en", None, 1), (1, None, "en", "a", 0), (2, words, None, "a", 5), (2, words, None, "a", 5), (3, words + " end", "en", "b", 9), (4, "", "en", "b", 0), (5, "mail x@y.example.com " + words[::-1], "en", None, 4)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("_bad", "_kept", "_whole", "_id", "_copy", "row", "terms", "k1", "node", "component_id"):
        docs = docs.withColumn(c, F.lit(c))
    for given in (docs, docs.limit(0)):
        out = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, "/root/testdata/sf0.001").cache()
            assert out.columns == given.columns, name
            assert all(r["_kept"] == "_kept" and r["row"] == "row" for r in out.collect())
        last = corpus_pipeline.STAGES[-1][1](spark, out, "/root/testdata/sf0.001")
        assert last.count() == out.count()
        assert given.columns[:5] == names
    near = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted((r.doc_id or 0) for r in near.collect()) == [1, 2, 2, 5]  # of equal texts the smallest id, null none; 1 and 4 are wordless


def test_near_copies_are_those_of_brute_force(spark, data):
    """The stage keeps one of each group that pairs of 5-word Jaccard 0.8 or more connect."""
    r = random.Random(3)
    rows = [(x.doc_id, x.text) for x in table(spark, data, "documents").select("doc_id", "text").collect()]
    base = [f"w{r.randrange(500)}" for _ in range(300)]
    for k in range(60):  # near copies on both sides of 0.8, the first words being alike in all
        w = list(base)
        for at in r.sample(range(20, 300), r.randrange(2, 14)):
            w[at] = f"x{r.randrange(9999)}"
        rows.append((10_000 + k, " ".join(w)))
    chain = [f"c{i}" for i in range(400)]
    rows += [(20_000 + k, " ".join(chain[15 * k : 15 * k + 200])) for k in range(8)]
    rows += [(30_000, None), (30_001, " "), (30_002, "One two"), (30_003, "one  TWO"), (30_004, "one two three")]

    want, low = slow_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in forest.near_copies(df, words=5, fingerprints=True, empty_alike=True).collect()}
    assert got == want
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, data).collect())
    assert kept == sorted(low) and len(kept) < len(rows) - 30
    assert simhash.near_duplicates(df).select("component_id").distinct().count() != len(kept)  # op6's rule is another


def test_loose_groups_are_joined(spark):
    """A group whose texts are rarely similar to its first one, and texts far from all, with hot keys."""
    r = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for at in r.sample(range(120), r.choice([1, 1, 2, 3])):
            w[at] = f"x{r.randrange(99)}"
        rows.append((k, " ".join(w)))
    want, low = slow_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (forest.HOT, 60):
        assert {x.doc_id: x.component_id for x in forest.near_copies(df, words=5, hot=hot).collect()} == want
    assert 1 < len(low) < 140


def test_a_task_gives_its_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])
    run = common.lean(lambda batches: (b.slice(1) for b in batches))
    assert [b.to_pydict() for b in run(iter([batch, batch]))] == [{"x": [2]}] * 2 and given == [1]
    early = run(iter([batch, batch]))
    next(early)
    early.close()
    assert given == [1, 1]

    def fails(batches):
        yield next(batches)
        raise ValueError

    with pytest.raises(ValueError):
        list(common.lean(fails)(iter([batch])))
    assert given == [1, 1, 1]
