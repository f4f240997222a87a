"""Operators on pairs: spelling variants, hard negatives and set links, against SQL, loops and odd tables."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from modlake.llm import forest, hardneg, queries, spelling


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    r = con.execute(queries.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.select(*names)) == sorted(r.fetchall(), key=str)


# 11 near copies by sets


def copies_by_loop(rows, words=4, empty_alike=False):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if c < "\x80" else c for c in t or "")
        for sep in "\t\n\x0b\x0c\r":
            w = w.replace(sep, " ")
        w = [x for x in w.split(" ") if x]
        sets.append({tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            alike = 100 * same >= 80 * (len(a) + len(sets[j]) - same) if a or sets[j] else empty_alike
            if alike and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    out = []
    for (i, _), s, root in zip(rows, sets, label, strict=True):
        low = min((k for (k, _), r in zip(rows, label, strict=True) if r == root and k is not None), default=None)
        out.append((i, len(s), low, low == i))
    return sorted(out, key=str)


def drifted(rng, n, lengths=(12, 90), edits=0.02):
    """Texts of which each is an edited copy of an earlier one, as a chain or from one centre."""
    vocabulary = [f"w{k}" for k in range(500)]
    out = [[rng.choice(vocabulary) for _ in range(rng.randint(*lengths))]]
    while len(out) < n:
        w = list(rng.choice(out) if rng.random() < 0.7 else out[0])
        if rng.random() < 0.1:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(*lengths))]
        for k in range(len(w)):
            if rng.random() < edits:
                w[k] = rng.choice(vocabulary)
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("hot", [forest.HOT, 60])
def test_copies_against_a_loop(spark, hot):
    rng = random.Random(2)
    texts = drifted(rng, 250) + drifted(rng, 60, (1, 12), 0.1)
    base = [f"t{k}" for k in range(203)]
    texts += [" ".join(base), " ".join(base[:163]), " ".join(base[:162])]  # 160 of 200 shingles are 0.8, 159 are not
    odd = [None, "", " \t", "One", "one", "a b", "A  b", "same here", "same here", "x" * 70000, "u\x1cv u\x1cv z 1 2", texts[0].upper()]
    rows = list(enumerate(texts + odd)) + [(3, texts[3]), (None, texts[5]), (None, "nobody has this text at all"), (None, None), (7, "another text of an id that is there")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("clash"), "n": F.lit(1), "region": F.lit(0)})
    want = copies_by_loop(rows)
    assert rows_of(forest.near_copies(df, hot=hot)) == want
    assert sum(not r[3] for r in want) > 100
    assert rows_of(forest.near_copies(df, words=5, fingerprints=True, empty_alike=True, hot=hot)) == copies_by_loop(rows, 5, True)
    assert forest.near_copies(df.limit(0)).count() == 0


def test_pairs_of_one_region_stay_linear_where_all_is_one_component():
    rng = np.random.default_rng(0)
    sig = np.tile(rng.integers(0, 256, forest.VALUES), (3000, 1)).astype(np.uint8)
    sig[np.arange(3000), rng.integers(0, forest.VALUES, 3000)] = 7
    n = np.full(3000, 50)
    i, j = forest.neighbours(sig, n, 3, 0.8)
    assert len(i) <= 3 * 3000
    root = np.zeros(3000, int)
    root[:4] = [1, 2, 2, 3]
    i, r = forest.apart(sig, n, root, 0.8)
    assert sorted(zip(i.tolist(), r.tolist(), strict=True)) == [(0, 0), (0, 2), (0, 3), (1, 0), (1, 3), (2, 0), (2, 3), (3, 0)]  # texts outside with roots, however many texts these have


# 12 spelling variants


def variants_by_loop(rows):
    count = {}
    for i, text in rows:
        run = ""
        for ch in (text or "") + " ":
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch.lower() if ch < "\x80" else ch
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                count[run] = count.get(run, 0) + 1
            run = ""
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}

    def distance(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            line, last = [i], line
            for j, y in enumerate(b, 1):
                line.append(min(last[j] + 1, line[-1] + 1, last[j - 1] + (x != y)))
        return line[-1]

    near = {w: [o for o in n if o != w and abs(len(o) - len(w)) < 2 and distance(w, o) == 1] for w in n}
    top = {w: min(near[w], key=lambda o: (-n[o], o), default=None) for w in n}
    form = {w: t if t and n[t] >= 10 * n[w] else None for w, t in top.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_variants_against_a_loop(spark):
    random.seed(5)
    alphabet = "aabbcdÀÿéZ"
    base = ["".join(random.choice(alphabet) for _ in range(random.randint(7, 10))) for _ in range(25)]
    words = []
    for w in base:
        for _ in range(6):
            k = random.randrange(len(w))
            words.append(random.choice([w[:k] + w[k + 1 :], w[:k] + random.choice(alphabet) + w[k + 1 :], w[:k] + random.choice(alphabet) + w[k:]]))
        words += [w] * random.choice([2, 40, 400])
    words += words + ["aaaaaaaaaaaaaaaaaaaaaaaa"] * 3 + ["aaaaaaaaaaaaaaaaaaaaaaaaa"] * 300 + ["x" * 60 + "y"] * 2 + ["x" * 60] * 2 + ["x" * 59 + "zy"] * 25 + ["x" * 30000] * 2 + ["chainaa"] * 4 + ["chainab"] * 60 + ["chainbb"] * 900
    random.shuffle(words)
    texts = [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (3, "¡0 ×÷"), (4, texts[4]), (4, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(7), "key": F.lit(1)})
    want = variants_by_loop(rows)
    assert rows_of(spelling.variants(df)) == want and any(r[1] for r in want) and any(r[2] != (r[1] or r[0]) for r in want)
    assert rows_of(spelling.variants(df, hot=3)) == want  # every subtree dealt out over several tries
    assert spelling.variants(df.limit(0)).count() == 0


def test_one_edit():
    words = ["abcdefg", "abcdef", "abcdefgh", "bbcdefg", "bacdefg", "abcdefg" * 8, "abcdefg" * 8 + "x", "xabcdefg", "aabcdefg", "abcdfg"]
    w = spelling.Words(words)
    pairs = [(i, j) for i in range(len(words)) for j in range(len(words)) if len(words[i]) <= len(words[j])]
    got = w.one_edit(np.array([p[0] for p in pairs]), w, np.array([p[1] for p in pairs]))
    assert list(got) == [spelling.one_edit(words[i], words[j]) for i, j in pairs]
    assert spelling.one_edit("abc", "abd") and spelling.one_edit("abc", "ac") and not spelling.one_edit("abc", "abc") and not spelling.one_edit("abc", "acb")


# 13 hard negatives


def negatives_by_loop(rows):
    rows = {i: (v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows}
    v = {i: [int(np.floor(256 * float(x))) for x in x] for i, (x, _) in rows.items()}
    out = []
    for a in (i for i in rows if i % 50 == 0):
        score = {i: sum(x * y for x, y in zip(v[a], v[i], strict=False)) for i in rows if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][1] == rows[a][1]][:5]:
            fits = [i for i in order if rows[i][1] != rows[a][1] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fits, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("case", ["groups", "ties", "one label", "large", "hot cell"])
def test_negatives_against_a_loop(spark, case):
    rng = np.random.default_rng(3)
    n, dim = 600, 9
    x = rng.normal(size=(n, dim)) * (1e5 if case == "large" else 1)
    if case == "groups":
        x = rng.normal(size=(12, dim))[rng.integers(0, 12, n)] + 0.1 * x
    if case == "ties":
        x = np.round(x)
    if case == "hot cell":
        x[: n // 2] = x[0]
    label = np.zeros(n, int) if case == "one label" else rng.integers(0, 10, n)
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(n)]
    odd = [(700, None, 1), (701, [1.0, None], 1), (702, [float("nan")] * dim, 1), (703, [float("inf")] * dim, 1), (704, [0.5] * dim, None), (None, [0.5] * dim, 1), (750, [], 1), (751, [1.0, 2.0], 1), (3, rows[3][1], rows[3][2])]
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame(rows + odd, schema).withColumns({"score": F.lit("clash"), "shard": F.lit(1), "cell": F.lit(2)})
    want = negatives_by_loop(rows + odd[6:8])
    assert rows_of(hardneg.mine(df)) == want
    assert want or case == "one label"
    assert hardneg.mine(df.limit(0)).count() == 0


def test_cells_come_by_bound_and_hold_every_score():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(3000, 8)), rng.normal(size=8)
    codes = [hardneg.codebook(x[:, :4], 5), hardneg.codebook(x[:, 4:], 6)]
    (a, da), (b, db) = (hardneg.nearest(h, c) for h, c in zip((x[:, :4], x[:, 4:]), codes, strict=True))
    radii = [np.array([da[a == i].max(initial=0) for i in range(5)]), np.array([db[b == i].max(initial=0) for i in range(6)])]
    cells = hardneg.Cells(8, codes, radii, np.bincount(a * 6 + b, minlength=30))
    visits = list(cells.visits(q))
    assert sorted(c for c, _ in visits) == list(range(30)) and [v for _, v in visits] == sorted((v for _, v in visits), reverse=True)
    bound = dict(visits)
    assert all(bound[c] >= s for c, s in zip(a * 6 + b, x @ q, strict=True))


def test_pairs_in_crowded_regions_are_all_found(spark):
    """100 texts of one long shared part (0.77 alike), each with a partner just above the limit (0.81): what deep cuts of a region would part."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    shared, rows = [word() for _ in range(200)], []
    for k in range(50):
        pair = [word() for _ in range(5)]
        rows += [(2 * k + j, " ".join(shared + pair + [word() for _ in range(24)])) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in forest.near_copies(df, hot=2).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}
