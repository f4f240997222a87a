"""Each corpus operator against brute force, or an exact round trip, on small tables with all the odd rows."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from modlake.llm import bpe, graph, licenses, media, mixing, pages, pii, ranking, rules, simhash, suffix
from modlake.llm.common import table

ODD = [None, "", " ", "\n\n", "a", "one two three", "Ünï — 🎉 ÀÀÀ\x00z", "x" * 70000, "same text here", "same text here", "tab\tand\x0bvt\x1cfs"]


def docs(spark, texts, extra=True):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    return df if extra else df.drop("score")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def real(spark, data):
    return table(spark, data, "documents")


@pytest.fixture(scope="module")
def texts(real):
    return {r.doc_id: r.text for r in real.collect()}


# 1 media columns


def test_media_round_trip(spark, texts):
    random.seed(1)
    every = [*ODD, *list(texts.values())[:40], "".join(chr(random.randint(1, 0x2FF)) for _ in range(3000)), "\x80" * 500]
    got = by_id(media.read_media(media.store_media(docs(spark, every))))
    for i, t in enumerate(every):
        raw = (t or "").encode()
        p = media.payload_of(raw)
        assert len(p) % 192 == 0 and len(p) >= 192
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), None)
    assert got[8].feature == got[9].feature and got[8].media_sha256 == got[9].media_sha256
    assert media.read_media(media.store_media(docs(spark, ["x"]).limit(0))).count() == 0
    none = spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_bytes for r in media.read_media(media.store_media(none)).collect()) == [0, 1]


def plain_decode(data):
    """A JPEG's coefficients, bit by bit."""
    p = media.parse(data)
    trees = {}
    for k, body in p["dht"].items():
        code, at, t = 0, 16, {}
        for n in range(1, 17):
            for _ in range(body[n - 1]):
                t[n, code] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        trees[k] = t
    parts = [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", p["data"])]
    mcus, out = p["across"] * p["down"], []
    step = p["dri"] or mcus
    for i, part in enumerate(parts):
        bits, at, pred = "".join(f"{b:08b}" for b in part), 0, Counter()

        def sym(t):
            nonlocal at
            for n in range(1, 17):
                if (v := t.get((n, int(bits[at : at + n], 2)))) is not None:
                    at += n
                    return v
            raise ValueError

        def val(n):
            nonlocal at
            v = int(bits[at : at + n], 2) if n else 0
            at += n
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        for _ in range(min(step, mcus - i * step)):
            for c, td, ta in p["plan"]:
                block = [0] * 64
                pred[c] += val(sym(trees[td]))
                block[0] = pred[c]
                k = 1
                while k < 64:
                    s = sym(trees[16 + ta])
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        block[k] = val(s & 15)
                    k += 1
                out.append(block)
    return np.array(out)


def plain_encode(blocks, comps, dri, w, h):
    """Coefficients of MCUs in order -> a JPEG with sampling and restart interval of the caller's."""
    per = [c for c, (hs, vs) in comps for _ in range(hs * vs)] if len(comps) > 1 else [comps[0][0]]
    bits, segs, pred = "", [], Counter()
    put = lambda code: f"{code[0]:0{code[1]}b}"

    def val(v):
        n = abs(v).bit_length()
        return f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    n_mcus = len(blocks) // len(per)
    for m in range(n_mcus):
        if dri and m and m % dri == 0:
            segs.append(bits)
            bits, pred = "", Counter()
        for j, c in enumerate(per):
            b = blocks[m * len(per) + j]
            d = int(b[0]) - pred[c]
            pred[c] = int(b[0])
            bits += put(media.DC_CODES[abs(d).bit_length()]) + val(d)
            run = 0
            for v in map(int, b[1:]):
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits += put(media.AC_CODES[0xF0])
                    run -= 16
                bits += put(media.AC_CODES[run << 4 | abs(v).bit_length()]) + val(v)
                run = 0
            if run:
                bits += put(media.AC_CODES[0])
    segs.append(bits)
    scan = b""
    for i, s in enumerate(segs):
        s += "1" * (-len(s) % 8)
        scan += bytes(int(s[k : k + 8], 2) for k in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00") + (bytes((255, 0xD0 + i % 8)) if i < len(segs) - 1 else b"")
    seg = media._seg
    sof = struct.pack(">BHHB", 8, h, w, len(comps)) + b"".join(bytes((c, hs << 4 | vs, 0)) for c, (hs, vs) in comps)
    sos = bytes((len(comps),)) + b"".join(bytes((c, 0)) for c, _ in comps) + b"\x00\x3f\x00"
    return b"\xff\xd8" + seg(0xDB, b"\0" + bytes([3] * 64)) + seg(0xC0, sof) + seg(0xC4, b"\0" + media.DC_BODY) + seg(0xC4, b"\x10" + media.AC_BODY) + (seg(0xDD, struct.pack(">H", dri)) if dri else b"") + seg(0xDA, sos) + scan + b"\xff\xd9"


@pytest.mark.parametrize(("comps", "per", "dri", "w", "h"), [([(1, (1, 1))], 1, 0, 40, 24), ([(1, (2, 2)), (2, (1, 1)), (3, (1, 1))], 6, 3, 33, 30), ([(1, (1, 1)), (2, (1, 1)), (3, (1, 1))], 3, 0, 16, 8)])
def test_jpegs_of_others(comps, per, dri, w, h):
    rng = np.random.default_rng(2)
    hm, vm = (max(c[1][0] for c in comps), max(c[1][1] for c in comps)) if len(comps) > 1 else (1, 1)
    n = -(-w // (8 * hm)) * -(-h // (8 * vm)) * per
    blocks = rng.integers(-200, 200, (n, 64)) * (rng.random((n, 64)) < 0.2)
    data = plain_encode(blocks, comps, dri, w, h)
    got = media.decode_many([data, data])[1]
    assert (got["coefs"] == blocks).all() and (plain_decode(data) == blocks).all() and (got["width"], got["height"]) == (w, h)
    thumb = media.thumbnail(media.parse(data), got["coefs"])
    assert thumb.shape == (-(-h // 8), -(-w // 8)) and thumb[0, 0] == np.clip(np.floor(blocks[0, 0] * 3 / 8 + 128.5), 0, 255)


def test_broken_media(spark):
    good = media.encode_many([b"x" * 192])[0]
    files = [(1, good), (2, b"nothing"), (3, None), (4, good[:-60]), (5, b""), (6, good.replace(b"\xff\xc0", b"\xff\xc2"))]
    got = by_id(media.read_media(spark.createDataFrame(files, "doc_id long, media binary")))
    assert got[1].error is None and all(got[i].error and got[i].feature is None for i in (2, 3, 4, 5, 6)) and got[3].media_bytes is None


# 2 mixing


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def fill(weights, caps, budget):
    clamped = set()
    while True:
        free = [i for i in range(len(caps)) if i not in clamped]
        left = budget - sum(caps[i] for i in clamped)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free} if free else {}
        over = {i for i in free if share[i] > caps[i]}
        if not over:
            return [caps[i] if i in clamped else share[i] for i in range(len(caps))]
        clamped |= over


def test_mixing(spark, real):
    random.seed(3)
    many = [" ".join(["w"] * random.choice([0, 1, 5, 20, 400])) for _ in range(1500)]
    for df in (real, docs(spark, [*ODD, *many])):
        rows = df.select("doc_id", "text", "source").collect()
        size = Counter()
        for r in rows:
            size[r.source] += words(r.text)
        order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
        want = dict(zip(order, fill([(3, 1, 2)[i % 3] for i in range(len(order))], [2 * size[s] for s in order], 1.5 * sum(size.values())), strict=True))
        got = mixing.mix(df).collect()
        assert len(got) == len(rows)
        taken = Counter()
        text = {r.doc_id: r.text for r in rows}
        for r in got:
            assert r.size == words(text[r.doc_id]) and r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - want[s]) <= 1 for s in order)
        assert sorted(got) == sorted(mixing.mix(df.repartition(5)).collect())


def test_mixing_of_nothing(spark):
    empty = docs(spark, ["x"]).limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.repeated(empty).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [None, ""])).collect()] == [0, 0]


def test_repetitions(spark):
    df = docs(spark, [f"w{i} x y" for i in range(300)])
    copies = Counter(r.doc_id for r in mixing.repeated(df).collect())
    plan = {r.doc_id: r.whole for r in mixing.mix(df).collect()}
    assert all(copies[i] == n for i, n in plan.items()) and set(plan.values()) <= {0, 1, 2}


# 3 quality rules


def base_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)


def test_rule_statistics(spark, texts):
    random.seed(4)
    every = [*ODD, *texts.values(), *(" ".join(random.choice("ab") for _ in range(random.randint(1, 60))) for _ in range(60)), " ".join(["a b c d e f g h"] * 5)]
    got = by_id(rules.statistics(docs(spark, every)))
    for i, t in enumerate(every):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(t), t and t[:80]


def test_decision_list(spark, data):
    df, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    out = rules.apply_rules(df, labels)
    x = out.join(labels, "doc_id").filter("not base_failed").select("kept", "quality").collect()
    assert sum(r.kept == bool(r.quality) for r in x) / len(x) > 0.97
    assert out.filter("base_failed and kept").count() == 0
    none = by_id(rules.apply_rules(docs(spark, ["w " * 30, "x", " ".join(f"v{i}" for i in range(25)), None]), labels.limit(0)))
    assert [(none[i].base_failed, none[i].kept) for i in range(4)] == [(True, False), (True, False), (False, True), (True, False)]
    assert rules.apply_rules(docs(spark, ["x"]).limit(0), labels).count() == 0


def slow_list(rows):
    """The decision list of rows (y, fold, values by statistic) by plain loops over the rows; thresholds at the given cuts."""
    names, cuts = rows["names"], rows["cuts"]
    at = lambda v, n: sum(v >= c for c in cuts[n])
    data = [(y, fold, {n: at(v[n], n) for n in names}) for y, fold, v in rows["rows"]]
    holds = lambda b, rule: all((b[n] >= k) == (op == ">=") for n, op, k in rule)
    out = []
    while len(out) < rules.MAX_RULES:
        grow, prune = ([d for d in data if (d[1] != 0) == part and not any(holds(d[2], r) for r in out)] for part in (True, False))
        rule = []
        while len(rule) < rules.MAX_CONDITIONS:
            inside = [d for d in grow if holds(d[2], rule)]
            bad = sum(not y for y, _, _ in inside)
            if not bad or bad == len(inside):
                break
            gain, best = 0.0, None
            for n in names:
                for k in range(1, max(d[2][n] for d in inside) + 1):
                    for op in ("<", ">="):
                        hit = [y for y, _, b in inside if holds(b, [(n, op, k)])]
                        b = hit.count(0)
                        if b and (v := b * (np.log2(b / len(hit)) - np.log2(bad / len(inside)))) > gain + 1e-9:
                            gain, best = v, (n, op, k)
            if best is None:
                break
            rule.append(best)
        worth = lambda r: (lambda h: (h.count(0) - h.count(1)) / len(h) if h else -1.0)([y for y, _, b in prune if holds(b, r)])
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=[])
        hit = [y for y, _, b in prune if rule and holds(b, rule)]
        if not rule or hit.count(0) < rules.LEAST or hit.count(0) < rules.PRECISION * len(hit):
            break
        out.append(rule)
    return [[(n, op, cuts[n][k - 1]) for n, op, k in r] for r in out]


def test_learned_list_against_loops(spark):
    rng = random.Random(12)
    rows = []
    for i in range(900):
        words = rng.randint(20, 60)
        symbols, stutter = rng.choice([0, 0, 0, 30]), rng.choice([0, 0, 15])
        bad = symbols > 0 and rng.random() < 0.97 or (stutter > 0 and words > 40 and rng.random() < 0.95)
        rows.append((i, words, words * rng.randint(3, 6), symbols, 0, 0, rng.randint(0, 9), words - rng.randint(0, 5), stutter, 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_distinct long, n_stutter long, y int")
    got = rules.learn(df)
    names = list(rules.STATISTICS)
    values = df.select("y", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold"), *[F.expr(e).cast("double").alias(n) for n, e in rules.STATISTICS.items()]).collect()
    cuts = {n: sorted({x for y, qs in rules.QUANTILES.items() for x in df.filter(f"y = {y}").select(F.percentile_approx(F.expr(rules.STATISTICS[n]).cast("double"), list(qs), 10_000)).first()[0]}) for n in names}
    assert got == slow_list({"names": names, "cuts": cuts, "rows": [(r.y, r.fold, r.asDict()) for r in values]})
    assert len(got) >= 2 and got[0][0][0] == "symbols_per_word"


# 4 quality classifier


def test_classifier_held_out(spark):
    df, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    out = ranking.classify(df, labels)
    x = out.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in x)
    held = [r for r in x if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    noisy = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert by_id(ranking.classify(df, noisy)) == by_id(out)  # held-out labels don't count
    odd = ranking.classify(docs(spark, ODD), labels.limit(0)).collect()
    assert len(odd) == len(ODD) and len({r.score for r in odd}) == 1 and ranking.classify(docs(spark, ODD).limit(0), labels).count() == 0


def test_classifier_learns_from_every_labelled_row(spark):
    """The threshold is the quantile of all 26,000 scores, every row is in pairs, and the weights go by all pairs."""
    rng = np.random.default_rng(1)
    f, y = rng.random((26_000, len(ranking.FEATURES))), (np.arange(26_000) % 13 < 11).astype(int)
    f[:, 1] += 0.3 * y
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(f, y, strict=True))], "id long, f array<double>, y int")
    model = ranking.fit(df)
    scores = np.sort(f @ model["w"])
    assert model["at"] == pytest.approx((scores[3999] + scores[4000]) / 2, abs=1e-9) and np.argmax(model["w"]) == 1
    pairs = ranking.preference_pairs(df, {0: 4_000, 1: 22_000})
    d = np.array([r.d for r in pairs.collect()])
    assert len(d) == 8 * 22_000 and np.allclose(d.mean(0), f[y == 1].mean(0) - f[y == 0].mean(0))
    scale = f.std(0) + 1e-9
    assert np.allclose(model["w"], ranking.newton(lambda w: ranking.sums_of(d / scale, w), len(d), d.shape[1]) / scale, atol=1e-9)


def test_bradley_terry_recovers_order():
    rng = np.random.default_rng(0)
    w, _ = ranking.fit_bradley_terry(rng.normal([2, 0], 1, (400, 2)), rng.normal([0, 0], 1, (400, 2)))
    assert w[0] > 1 and abs(w[1]) < 0.5


# 5 pages


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><div class="cookie-notice"><p>We use cookies, really. Yes.</p></div><header><h1>Site</h1></header>
<div id="menu"><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div><div class="wrap"><div class="post"><h1>Title &amp; more</h1><p>First   paragraph, of some text. It goes on.</p><p>Second <b>bold</b> with a <a href=x>link</a>, and more.</p>
<form><label>Name</label><input></form></div><aside><p>Related stories, long enough to matter.</p></aside></div><section id="comments"><div class="comment"><p>I think this is great, honestly.</p></div></section><footer>&copy; 2024</footer><script>if(a<b){}</script></body></html>"""


def test_pages(spark, data):
    sample = table(spark, data, "pages")
    model = pages.train(sample)
    x = spark.createDataFrame([(1, "u", PAGE, "c"), (2, "u", None, "c"), (3, None, "", "c"), (4, "u", "only words &lt;here&gt;", "c"), (5, "u", "<nav><a>x</a></nav>", "c"), (6, "u", "<p>a<p>b <br>c<script>x", "c")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in pages.extract(x, model=model).collect()}
    assert got[1].text == "Title & more\nFirst paragraph, of some text. It goes on.\nSecond bold with a link, and more."
    assert [got[i].text for i in (2, 3, 4, 5, 6)] == ["", "", "only words <here>", "", "a\nb c"] and all(r.n_chars == len(r.text) for r in got.values())
    import html as h

    for r in sample.collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = [" ".join(h.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", body)]
        assert _text(model, r.html) == "\n".join(p for p in parts if p)
    assert pages.extract(x.limit(0), model=model).count() == 0 and pages.extract(x.limit(0)).count() == 0
    assert [r.text for r in pages.extract(x.filter("page_id = 1").unionByName(x.filter("page_id = 1")), model=model).collect()] == [got[1].text] * 2


def _text(model, source):
    nodes, runs = pages.parse(source)
    x = pages.features(nodes)
    return pages.article(nodes, runs, x, pages.log_odds(model, x))


def _plain(source):
    """A page whose elements and attributes say nothing."""
    return re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(nav|footer|header|aside|form|article|main)\b", r"<\1div", source))


def test_pages_without_marks(spark, data):
    rows = table(spark, data, "pages").collect()
    model = pages.fit(np.concatenate([pages.features(pages.parse(r.html)[0]) for r in rows[:30]]))
    score = []
    for r in rows[30:]:
        a, b = (Counter(_text(model, s).split()) for s in (r.html, _plain(r.html)))
        score.append(2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())))
    assert np.mean(score) > 0.9 and min(score) > 0.5
    used = {pages.FEATURES[j] for split, _ in model["trees"] for chosen in split for j, b in chosen if b <= pages.BINS}
    assert used & {"depth", "link_share", "tag_density", "siblings", "place", "same_siblings", "sibling_chars"}


def test_pages_of_one_kind():
    story = '<nav><ul><li><a href=1>x</a></ul></nav><div class="lead"><h1>Head</h1><p>Some text here. More.</p></div><footer>f</footer>'
    fit = lambda *pages_: pages.fit(np.concatenate([pages.features(pages.parse(h)[0]) for h in pages_]))
    assert _text(fit(story), story) == "Head\nSome text here. More."  # marks of furniture only
    assert _text(fit("<div><p>Hello there. x</p></div>"), story) == "Head\nSome text here. More."  # no mark at all
    assert _text(fit("<nav>x</nav>"), story) == "Head\nSome text here. More."
    media_text = "<article><p>a <object>b</object> <math><mi>c</mi></math> <video>d</article><p>e"
    assert _text(fit(story), media_text).split()[:4] == list("abcd")  # what an element holds is text, and an unclosed one ends with its parent


def test_tags_that_never_end():
    for s in ("<a " * 50000, '<a "' * 20000, "<a<" * 50000, "<" * 100000, '<a b="c>"' * 10000 + ">", "<!--" * 50000):
        began = time.perf_counter()
        nodes, runs = pages.parse(s)
        assert time.perf_counter() - began < 10 and nodes
    assert pages.blocks(pages.parse("a <b <i>c</i> 1 < 2 <a href='x>y'>z</a>")[1], [True] * 9) == "a c 1 < 2 z"


def test_no_kept_node_below_a_dropped_one():
    random.seed(5)
    for _ in range(50):
        nodes, _ = pages.parse("".join(random.choice(["<div>", "</div>", "<p>", "text ", "<nav>", "</nav>"]) for _ in range(40)))
        pages.features(nodes)
        kept = pages.decode(nodes, [random.gauss(0, 2) for _ in nodes])
        assert all(not kept[i] or n.parent < 0 or kept[n.parent] for i, n in enumerate(nodes))


# 6 near-duplicates


def slow_fingerprint(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum((sum(v >> k & 1 for v in h) * 2 > len(h)) << k for k in range(64))


def slow_groups(fps, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_near_duplicates(spark, hot):
    random.seed(6)
    base = " ".join(random.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(random.randint(0, 9)) for _ in range(300))
    near = []
    for _ in range(40):
        w = base.split()
        for _ in range(random.randint(0, 2)):
            w[random.randrange(len(w))] = "zz"
        near.append(" ".join(w).upper() if random.random() < 0.2 else " ".join(w))
    every = [*ODD, *near, *(" ".join(str(random.randint(0, 99)) for _ in range(50)) for _ in range(60))]
    fps = [slow_fingerprint(t) for t in every]
    want = slow_groups(fps)
    got = by_id(simhash.near_duplicates(docs(spark, every), hot=hot))
    assert [got[i].fp % (1 << 64) for i in range(len(every))] == fps and [got[i].component_id for i in range(len(every))] == want
    kept = sorted(r.doc_id for r in simhash.first_of_each(docs(spark, every)).collect())
    assert kept == sorted(set(want))


def test_forest_is_exact():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 50, dtype=np.uint64)) for _ in range(5))]))
    rng.shuffle(fp)
    shard = np.sort(rng.integers(0, 4, len(fp)))
    shard = np.unique(shard, return_inverse=True)[1]
    q, node = simhash.Forest(shard, fp).near(fp, shard, 4)
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if shard[i] == shard[j] and int(fp[i] ^ fp[j]).bit_count() <= 4}
    assert set(zip(q.tolist(), node.tolist(), strict=True)) == want


@pytest.mark.parametrize("shards", [1, 5])
def test_spanning_links_are_complete(shards):
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    near = [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)) for c in centres for k in rng.integers(1, 5, 40)]
    fp = np.unique(np.array([*centres, *near], np.uint64))
    rng.shuffle(fp)
    shard = np.unique(np.sort(rng.integers(0, shards, len(fp))), return_inverse=True)[1]
    root = list(range(len(fp)))
    for i in range(len(fp)):
        for j in range(i):
            if shard[i] == shard[j] and int(fp[i] ^ fp[j]).bit_count() <= 4 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    row, low = simhash.spanning_links(shard, fp)
    got = np.arange(len(fp))
    got[row] = low
    assert got.tolist() == root


def test_dense_shard_is_quick():
    rng = np.random.default_rng(10)
    fp = np.unique(np.uint64(0x123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 40_000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40_000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40_000, dtype=np.uint64)))
    began = time.perf_counter()
    row, low = simhash.spanning_links(np.zeros(len(fp), np.int64), fp)
    assert len(row) == len(fp) - 1 and len(fp) > 20_000 and time.perf_counter() - began < 20


def test_near_duplicates_of_odd_tables(spark):
    assert simhash.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0
    none = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(none).collect()) == [(0, 3), (0, 3), (3, 3), (3, 3)]


def test_components(spark):
    random.seed(8)
    links = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in list(root))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7 personal data


def test_base_spans():
    t = "a.b@c-d.example.com, x@y 1.2.3.4 999.1.1.1 no 4111 1111 1111 1111 or 4111111111111112 +1 (499) 555-6503 +12 1.2.3.4.5 me@@h.org q@w.e@r.ty"
    spans = [(pii.KINDS[k], t[a:z]) for a, z, k in pii.base_spans(t)]
    want = [(k, m[0], m.start()) for k, p in pii._FIND.items() for m in p.finditer(t)]
    luhn = pii._luhn
    ok = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 14 <= len(re.sub("[ -]", "", s)) <= 19 and luhn(re.sub("[ -]", "", s)), "phone": lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15}
    want = sorted(((k, s, i) for k, s, i in want if ok[k](s)), key=lambda x: (x[2], pii.KINDS.index(x[0])))
    assert spans == [(k, s) for k, s, _ in want] and {k for k, _ in spans} == set(pii.KINDS)


def test_email_search_is_the_pattern():
    random.seed(9)
    for _ in range(3000):
        t = "".join(random.choice("ab.@-+ é%") for _ in range(random.randint(0, 25)))
        assert list(pii._email_at(t)) == [m.span() for m in pii._FIND["email"].finditer(t)], t


def test_find_pii(spark, texts):
    every = [*ODD, *texts.values()]
    got = by_id(pii.find(docs(spark, every)))
    for i, t in enumerate(every):
        spans = pii.base_spans(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, z, k in spans)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in range(4)] and r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(r.spans.split(",")) if text else r.spans == ""
    assert pii.find(docs(spark, ["x"]).limit(0)).count() == 0


def slow_terms(every):
    """Disclosing terms and their places in each text, by loops over all texts."""
    found, n = {}, len(every)
    holds, words = [], []
    for t in every:
        spans = pii.base_spans(t or "")
        near = pii.surroundings(t or "", spans)
        holds.append({e for es, _, _ in near for e in es})
        words.append({x for w in (t or "").split() if (x := pii.term_of(w))})
        for es, digest, terms in near:
            for e in es:
                for w in terms:
                    found.setdefault((e, w), set()).add(digest)
    give = set()
    for (e, w), digests in found.items():
        ce, ct, both = sum(e in h for h in holds), sum(w in x for x in words), sum(e in h and w in x for h, x in zip(holds, words, strict=True))
        ic, pmi = np.log2(n / ce), np.log2(n * both / (ct * ce)) if both else -1
        if len(digests) >= pii.MIN_SUPPORT and ic > 0 and pmi >= pii.DISCLOSURE * ic - 1e-9:
            give.add((e, w))
    out = []
    for t, h in zip(every, holds, strict=True):
        base = pii.base_spans(t or "")
        out.append(sorted(m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "") if any(w == pii.term_of(m[0]) and (":" in e or e in h) for e, w in give) and not any(m.start() < z and a < m.end() for a, z, _ in base)))
    return out


def test_disclosing_terms(spark):
    filler = [f"nothing of note number {i} in this text at all, the case without any address, ask away" for i in range(60)]
    hit = [f"please ask Zebulon{'.' if i else ','} about case {i} at zeb@corp.example.com before the end of day {i * 7}. Later, far from any address and after many other words, zebulon! comes up" for i in range(4)]
    copies = ["call me maybe quux at other@corp.example.com today"] * 5
    team = [f"team Falcon {i} at u{i}@falcons.example.org writes text {i * 3}; ask Falcon" for i in range(4)] + ["a Falcon flies alone"]
    alone = ["the case of Zebulon without any address"]
    every = [*filler, *hit, *copies, *team, *alone, None, "", "1.2.3.4 " * 3]
    got = by_id(pii.find(docs(spark, every)))
    for i, want in enumerate(slow_terms(every)):
        have = [(int(a), int(z)) for k, a, z in (s.split(":") for s in got[i].spans.split(",") if s) if k == "term"]
        assert have == want, every[i]
        assert got[i].n_spans == len([s for s in got[i].spans.split(",") if s])
    named = lambda i: [every[i][int(a) : int(z)] for k, a, z in (s.split(":") for s in got[i].spans.split(",") if s) if k == "term"]
    assert all(len([x for x in named(i) if x.lower().startswith("zebulon")]) == 2 for i in range(60, 64)) and named(74) == ["Zebulon"]
    assert all("Falcon" in named(i) for i in range(69, 73)) and named(73) == []  # a shared part marks its own texts only
    assert all("term" not in got[i].spans for i in [*range(60), *range(64, 69)])  # copies are one surrounding
    out = by_id(pii.sanitise(docs(spark, every), n_col="n_chars"))
    assert "zebulon" not in out[60].text.lower() and "[EMAIL]" in out[60].text and out[60].n_chars == len(out[60].text) and out[0].text == filler[0] and out[75].text is None
    assert "Zebulon" not in out[74].text and out[73].text == every[73] and "Falcon" not in out[69].text


def test_sanitise_without_terms(spark):
    every = ["mail a@b.example.com now", None, "", "nothing", "mail a@b.example.com now"]
    clash = docs(spark, every).withColumnRenamed("score", "terms").withColumn("row", F.lit(1)).withColumn("k1", F.lit(2))
    out = by_id(pii.sanitise(clash, n_col="n_chars"))
    assert [out[i].text for i in range(5)] == ["mail [EMAIL] now", None, "", "nothing", "mail [EMAIL] now"] and out[0].k1 == 2 and out[0].terms == "clash" and out[0].n_chars == 16
    assert pii.sanitise(clash.limit(0)).count() == 0


def test_long_numbers_are_searched_once():
    for t in ("1" * 300_000, "1.2." * 60_000, "+1 " * 60_000, "a@" * 60_000):
        began = time.perf_counter()
        pii.base_spans(t)
        assert time.perf_counter() - began < 3


# 8 repeats


def covered(raw, n):
    c = Counter(d[i : i + n] for d in raw for i in range(len(d) - n + 1))
    for d in raw:
        cov = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if c[d[i : i + n]] > 1:
                cov[i : i + n] = True
        yield cov


def brute_repeats(raw):
    out = []
    for d, cov in zip(raw, covered(raw, 400), strict=True):
        rest = bytes(np.frombuffer(d, np.uint8)[~cov])
        out.append((len(d), int(cov.sum()), int((np.diff(np.concatenate([[0], cov.astype(int)])) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffix.HOT, 3])
def test_repeats(spark, hot):
    random.seed(10)
    rnd = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    p, every = rnd(900), []
    for i in range(50):
        x = rnd(random.randint(0, 700))
        if i % 3:
            a = random.randint(0, 300)
            x += p[a : a + random.choice([random.randint(380, 600), random.randint(240, 420)])] + rnd(random.randint(0, 300))
        every.append(x)
    every += [every[5], every[5], "a" * 1500, "ab" * 700, "é" * 450, None, "", rnd(399), "x" * 400, "x" * 400, rnd(37) * 40, "y" * 250, "z" * 251, p[:249], rnd(90) + p[600:850]]
    got = by_id(suffix.without_repeats(docs(spark, every), hot=hot))
    want = brute_repeats([(t or "").encode() for t in every])
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(every))] == want
    assert all(hashlib.sha256(got[i].kept).hexdigest() == got[i].kept_sha256 for i in got)
    assert suffix.without_repeats(docs(spark, ["x"]).limit(0)).count() == 0


def test_intervals_and_groups():
    text = ["abcab", "abcb", "abd", "b", "bc"]
    order = sorted(text)
    lcp = [0] + [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(order, order[1:], strict=False)]
    got = set(suffix.intervals(lcp, 1))
    want = {(m, i, j) for i in range(5) for j in range(i + 1, 5) if (m := min(lcp[i + 1 : j + 1])) and (i == 0 or lcp[i] < m) and (j == 4 or lcp[j + 1] < m)}
    assert got == want
    _, groups = suffix.repeat_groups([(b"xGRAMaa", 1), (b"xGRAMab", 1), (b"yGRAMab", 1)], length=6, gram=4)
    assert sorted((n, sorted(m)) for n, m in groups) == [(5, [0, 1, 2]), (6, [1, 2])]


# 9 BPE


def test_bpe_is_tiktoken(spark, texts):
    path, pattern = bpe.default_vocabulary()
    v = bpe.Vocabulary.of(path, pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=v.ranks, special_tokens={})
    every = [*ODD, *texts.values(), "日本語のテキスト don't I'LL 1234567890123", "aaaa" * 300, "<|endoftext|>", "e" * 3000]
    got = by_id(bpe.decode(bpe.encode(docs(spark, every)), keep_bytes=True))
    at_once = by_id(bpe.encode(docs(spark, every), and_back=True))
    for i, t in enumerate(every):
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert (at_once[i].n_tokens, at_once[i].ids_sha256, at_once[i].decoded_sha256) == (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256)
        assert bytes(got[i].decoded) == (t or "").encode() and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(docs(spark, ["x"]).limit(0)).count() == 0


def test_replay_of_odd_words():
    path, pattern = bpe.default_vocabulary()
    v = bpe.Vocabulary.of(path, pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=v.ranks, special_tokens={})
    random.seed(11)
    w = ["".join(random.choice("ab thesingn eé") for _ in range(random.randint(1, 30))).encode() for _ in range(4000)]
    assert [list(x) for x in v.replay(w)] == [enc._core_bpe.encode_single_piece(x) for x in w]
    small = bpe.Vocabulary(path, pattern)
    bpe_cache, bpe.CACHE = bpe.CACHE, 2
    try:
        assert all(enc.encode_ordinary(t) == small.encode([t])[2].tolist() for t in ("one two", "three four", "one five", ""))
    finally:
        bpe.CACHE = bpe_cache


def test_long_texts_are_taken_by_pieces(monkeypatch):
    path, pattern = bpe.default_vocabulary()
    v = bpe.Vocabulary(path, pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=v.ranks, special_tokens={})
    random.seed(14)
    text = " ".join("".join(random.choice("aeinrst") for _ in range(random.randint(1, 9))) for _ in range(900)) + "  \n é日本"
    for name, value in (("SLICE", 100), ("PIECES", 70), ("CACHE", 100)):
        monkeypatch.setattr(bpe, name, value)
    counts, shas, ids = v.encode([text])
    want = enc.encode_ordinary(text)
    assert ids.tolist() == want and counts == [len(want)] and shas == [hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()]
    assert len(v.table) <= bpe.CACHE + bpe.PIECES


# 10 licences


def slow_places(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    at = [(i, label) for label, p in licenses.BASE for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licences(spark, texts):
    more = ["Licensed under CC BY-NC 4.0.", "MIT-License mit license, GNU general. public license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "general public mit", "the MIT licences", "Apache, License apache license", "mit"]
    every = [*ODD, *texts.values(), *more]
    got = by_id(licenses.scan(docs(spark, every)))
    for i, t in enumerate(every):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow_places(t), t and t[:80]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    n = len(ODD) + len(texts)
    assert got[n].labels == "cc-by-nc" and got[n].score > 0.9 and got[n + 2].labels == "mit" and got[n + 3].labels == "" and got[n + 4].score == 0
    assert licenses.scan(docs(spark, ["x"]).limit(0)).count() == 0


def slow_licences(every):
    """labels and score of each text: every template at every offset."""
    texts = [re.findall(licenses.WORD, "".join(c.lower() if c.isascii() else c for c in t or "")) for t in every]
    index, keys = licenses.postings()
    df = Counter(w for t in texts for w in set(t) & set(index))
    idf = {w: np.log((1 + len(texts)) / (1 + df[w])) + 0.1 for w in index}
    out = []
    for t in texts:
        labels, score = set(), 0.0
        for n, (label, _, sentence) in enumerate(licenses.TEMPLATES):
            places = {p: w for w, ps in index.items() for k, p in ps if k == n}
            full = sum(idf[w] for w in places.values())
            for o in range(-len(sentence.split()), len(t)):  # every offset
                found = {p for p, w in places.items() if 0 <= o + p < len(t) and t[o + p] == w}
                share = sum(idf[places[p]] for p in found) / full
                if found >= set(keys[n]) and share >= licenses.COVER:
                    labels.add(label)
                    score = max(score, share)
        out.append((labels, min(1.0, score)))
    return out


def test_texts_of_several_licences(spark):
    mit, bsd, isc = (next(s for label, _, s in licenses.TEMPLATES[k:] if label == name) for k, name in ((1, "mit"), (0, "bsd"), (0, "isc")))
    rare = "affero mozilla cc0 universal"
    every = [f"{mit}. {bsd}.", f"{bsd} {isc} {mit}", *(f"{rare} and more words, {s} then {rare}" for s in (mit, bsd, isc)), bsd, bsd, "source and binary forms", *(s for _, _, s in licenses.TEMPLATES), " ".join(s for _, _, s in licenses.TEMPLATES), *[f"some other text {i}" for i in range(20)], "released under the mit li\u212aense", "MIT LICENSE \u0130", None, ""]
    got = by_id(licenses.scan(docs(spark, every)))
    for i, (labels, score) in enumerate(slow_licences(every)):
        assert set(filter(None, got[i].labels.split(","))) - set(filter(None, got[i].base_labels.split(","))) <= labels <= set(got[i].labels.split(",")), every[i]
        assert got[i].score == pytest.approx(score), every[i]
    assert got[0].labels == "bsd,mit" and got[1].labels == "bsd,isc,mit" and [got[i].labels for i in (2, 3, 4)] == ["mit", "bsd", "isc"]
