"""Personal data: pattern matches, and terms that give protected values away.

*Base.* Emails, IPv4 addresses, card and phone numbers by pattern and check, leftmost and non-overlapping per kind.

*Disclosure.* A protected entity ``e`` is a matched value, or what it has in common with others (mail domain, network,
number prefix). It carries IC(e) = log2(N / c(e)) bits, N being the documents and c the documents that hold it. A term
``t`` gives away PMI(t; e) = log2(N c(t,e) / (c(t) c(e))) of them; co-occurrence is by document, over the whole corpus.
Terms that stood within ``AROUND`` words of e in at least ``MIN_SUPPORT`` different surroundings are candidates (copies of
one passage are one surrounding, so hapaxes beside an address that is copied around are no evidence); those with PMI(t; e)
of at least ``DISCLOSURE`` of IC(e) are spans of kind ``term``: wherever they stand in any text if e is a value, wherever
they stand in a text that holds e if it is a shared part. ``sanitise`` puts the kind in a span's place.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlake.llm.common import lean, let_go, saved, text_or_empty

KINDS = ("email", "ip", "card", "phone")
_FIND = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),  # a match can begin at the head of a run of digits only
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Words on either side of a protected value that count as its surroundings.
AROUND = 8
#: Different surroundings in which a term must stand with a value.
MIN_SUPPORT = 2
#: Share of a value's information that a term may give away before it is a span.
DISCLOSURE = 0.8
#: Buckets of the candidate filter: bounds what the driver and each task hold of it.
BUCKETS = 1 << 20
#: Distinct terms that a task counts, or words that it knows, before it passes the counts on or forgets; found terms that it passes on at once.
TERMS_AT_ONCE, ROWS_AT_ONCE = 200_000, 2_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TERM = re.compile(r"\w(?:.*\w)?", re.S)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _email_at(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern; the pattern is tried from the first character of each run that holds an @ only."""
    at, done = text.find("@"), 0
    local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in local:
            start -= 1
        m = _FIND["email"].match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place in KINDS) by start, then kind; code points, end exclusive."""
    out = []
    if "@" in text:
        out += [(a, z, 0) for a, z in _email_at(text)]
    for m in _FIND["ip"].finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((*m.span(), 1))
    for m in _FIND["card"].finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((*m.span(), 2))
    if "+" in text:
        for m in _FIND["phone"].finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((*m.span(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def term_of(word: str) -> str:
    """A word as a term: lower case, without the marks around it; empty if it has no letter or digit."""
    m = _TERM.search(word)
    return m[0].lower() if m else ""


def entities(kind: str, value: str) -> list[str]:
    """A matched value as entities: itself, and what it has in common with others (marked by a slash)."""
    value = value.lower()
    if kind == "email":
        part = value.rsplit("@", 1)[1]
    elif kind == "ip":
        part = value.rsplit(".", 1)[0]
    else:
        part = "".join(c for c in value if c in "0123456789")[:6]
    return [f"{kind}:{value}", f"{kind}/{part}"]


def _outside(spans: list[tuple[int, int, int]]) -> Callable[[int, int], bool]:
    """Whether start and end meet none of the spans, which are in order of start."""
    starts, reach = [a for a, _, _ in spans], list(accumulate((z for _, z, _ in spans), max))

    def free(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return k == 0 or reach[k - 1] <= start

    return free


def surroundings(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[list[str], str, list[str]]]:
    """For each protected value: its entities, a digest of the words around it, and these words' terms."""
    out, free = [], _outside(spans)
    for a, z, kind in spans:
        left, right = [], []
        end = a
        while len(left) < AROUND and end > 0:  # backwards, piece by piece, so that a long text costs nothing
            begin = max(0, end - 400)
            part = [(m[0], begin + m.start(), begin + m.end()) for m in _WORD.finditer(text, begin, end)]
            if begin and part:
                part = part[1:] or part
            if not part:
                break
            left = part[-(AROUND - len(left)) :] + left
            end = part[0][1]
        for m in _WORD.finditer(text, z):
            right.append((m[0], *m.span()))
            if len(right) == AROUND:
                break
        near = [w for w, x, y in left + right if free(x, y)]
        digest = xxhash.xxh3_64_hexdigest("\0".join(near).encode())
        out.append((entities(KINDS[kind], text[a:z]), digest, sorted({t for w in near if (t := term_of(w))})))
    return out


def _span_text(spans) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


_NEAR = pa.list_(pa.struct([("entities", pa.list_(pa.string())), ("around", pa.string()), ("terms", pa.list_(pa.string()))]))
_SCAN = "doc_id long, k1 long, k2 long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, near array<struct<entities:array<string>,around:string,terms:array<string>>>"


_HASHES = (xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest)


def _keys(texts: list[str]) -> list[pa.Array]:
    """Two 64-bit hashes of each text."""
    raw = [t.encode() for t in texts]
    return [pa.array(np.array([h(b) for b in raw], np.uint64).view(np.int64)) for h in _HASHES]


def _scan(docs: DataFrame) -> DataFrame:
    """What is found in each text of doc_id, text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts, shas, bases, nears = ([], [], [], []), [], [], []
            for t in texts:
                spans = base_spans(t)
                for k in range(4):
                    counts[k].append(sum(s[2] == k for s in spans))
                bases.append(_span_text((KINDS[k], a, z) for a, z, k in spans))
                shas.append(hashlib.sha256(bases[-1].encode()).hexdigest())
                nears.append([{"entities": e, "around": d, "terms": ws} for e, d, ws in surroundings(t, spans)] if spans else None)
            cols = [batch.column(0), *_keys(texts), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(bases, pa.string()), pa.array(nears, _NEAR)]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _SCAN.split("struct")[0].split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _SCAN)


def _bucket(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode()) % BUCKETS


def _marks(terms: DataFrame) -> np.ndarray:
    """The buckets of the terms: a filter of fixed size that lets some others pass and loses none."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_bucket(t) for t in batch.column(0).to_pylist()], pa.int32())], ["bucket"])

    rows = terms.select("term").distinct().mapInArrow(run, "bucket int").groupBy(F.floor(F.col("bucket") / 32768).alias("at")).agg(F.bitmap_construct_agg(F.pmod(F.col("bucket").cast("long"), F.lit(32768))).alias("bits"))
    wanted = np.zeros(BUCKETS, bool)
    for r in rows.collect():
        wanted[r["at"] * 32768 : (r["at"] + 1) * 32768] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
    return wanted


class Wanted(dict):
    """word as bytes -> its term, if the term's bucket is marked, else an empty string; emptied at a bound."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks

    def __missing__(self, word: bytes) -> str:
        if len(self) > TERMS_AT_ONCE:
            self.clear()
        term = term_of(word.decode())
        self[word] = term = term if term and self.marks[_bucket(term)] else ""
        return term


def _count_terms(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """term, c: documents that hold the term, of the terms whose bucket is wanted."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, term = Counter(), Wanted(wanted).__getitem__

        def out():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "c"])

        for batch in batches:
            for t in batch.column(0):
                words = set(bytes(t.as_buffer()).split())  # of bytes: at the six ASCII spaces
                counts.update(set(map(term, words)))
                if len(counts) > TERMS_AT_ONCE:
                    counts.pop("", 0)
                    yield out()
                    counts.clear()
        counts.pop("", 0)
        if counts:
            yield out()

    return docs.select("text").mapInArrow(run, "term string, c long").groupBy("term").agg(F.sum("c").alias("c"))


def _occurrences(docs: DataFrame, terms: DataFrame, everywhere: DataFrame, with_spans: np.ndarray) -> DataFrame:
    """k1, k2, term, n, places: where the words of ``everywhere`` stand in any text, and those of all ``terms`` in texts with
    base spans (whose buckets are marked), outside of the spans; n is the number of rows with that text."""
    wide, narrow = _marks(everywhere), _marks(terms)
    places = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_all, in_some = Wanted(wide).__getitem__, Wanted(narrow).__getitem__
        for batch in batches:
            rows: list[tuple] = []

            def out():
                cols = list(zip(*rows, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], places)], ["k1", "k2", "term", "places"])

            for t in batch.column(0):
                raw = bytes(t.as_buffer())
                term = in_some if with_spans[xxhash.xxh3_64_intdigest(raw) % BUCKETS] else in_all
                if not any(map(term, words := set(raw.split()))):
                    continue
                text, at = t.as_py(), {}
                hits = {w.decode(): x for w in words if (x := term(w))}
                free = _outside(base_spans(text))
                for m in _WORD.finditer(text):
                    if m[0] in hits and free(*m.span()):
                        at.setdefault(hits[m[0]], []).append({"start": m.start(), "end": m.end()})
                k1, k2 = (int(np.uint64(h(raw)).view(np.int64)) for h in _HASHES)
                rows += [(k1, k2, x, where) for x, where in at.items()]
                if len(rows) > ROWS_AT_ONCE or sum(map(len, at.values())) > ROWS_AT_ONCE:
                    yield out()
                    rows.clear()
            if rows:
                yield out()

    found = docs.select("text").mapInArrow(run, "k1 long, k2 long, term string, places array<struct<start:long,end:long>>")
    found = found.join(terms.select("term").distinct(), "term", "left_semi")
    return found.groupBy("k1", "k2", "term").agg(F.count("*").alias("n"), F.any_value("places").alias("places"))


def disclosing_terms(docs: DataFrame, scanned: DataFrame, min_support: int = MIN_SUPPORT, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame] | None:
    """entity, term, pmi, ic of the terms that give an entity away, and k1, k2, terms: their (start, end) in each text; None without any candidate."""
    each = scanned.filter("base <> ''").select("k1", "k2", F.explode("near").alias("n"))
    near = each.select(F.explode("n.entities").alias("entity"), "n.around", "n.terms").select("entity", "around", F.explode("terms").alias("term"))
    pairs = near.groupBy("entity", "term").agg(F.countDistinct("around").alias("support")).filter(F.col("support") >= min_support)
    pairs = saved(pairs.select("entity", "term"), "pii-pairs")
    wanted = _marks(pairs)
    if not wanted.any():
        return None
    n = float(scanned.count())
    holds = each.select("k1", "k2", F.explode("n.entities").alias("entity"))
    held = scanned.filter("base <> ''").select(F.explode(F.array_distinct(F.flatten("near.entities"))).alias("entity")).groupBy("entity").agg(F.count("*").alias("ce"))
    counted = pairs.join(held, "entity").join(_count_terms(docs, wanted), "term").withColumn("ic", F.log2(F.lit(n) / F.col("ce")))
    # no term in more documents can reach the threshold, wherever it stands
    counted = saved(counted.filter((F.col("ic") > 0) & (F.col("c") <= F.col("ce") * F.pow(F.lit(2.0), (1 - disclosure) * F.col("ic")) + 1e-9)), "pii-counted")
    if not counted.head(1):
        return None
    part = F.col("entity").rlike("^[a-z]+/")
    # a value's terms are marked in any text, those of a shared part where it stands
    found = saved(_occurrences(docs, counted, counted.filter(~part), _text_marks(scanned.filter("base <> ''"))), "pii-occurrences")
    together = holds.distinct().join(found.select("k1", "k2", "term", "n"), ["k1", "k2"]).join(counted.select("entity", "term"), ["entity", "term"], "left_semi")
    cte = together.groupBy("entity", "term").agg(F.sum("n").alias("cte"))
    scored = counted.join(cte, ["entity", "term"]).withColumn("pmi", F.log2(F.lit(n) * F.col("cte") / (F.col("c") * F.col("ce"))))
    scored = saved(scored.filter(F.col("pmi") >= disclosure * F.col("ic") - 1e-9).select("entity", "term", "pmi", "ic"), "pii-terms")
    everywhere = found.join(scored.filter(~part).select("term").distinct(), "term", "left_semi").select("k1", "k2", "places")
    # by text first: a frequent term never meets all texts of a hot entity
    own = holds.filter(part).distinct().join(found.select("k1", "k2", "term"), ["k1", "k2"]).join(scored.select("entity", "term"), ["entity", "term"], "left_semi")
    local = found.join(own.select("k1", "k2", "term"), ["k1", "k2", "term"], "left_semi").select("k1", "k2", "places")
    spans = everywhere.unionByName(local).groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("places")))).alias("terms"))
    return scored, saved(spans, "pii-spans")


def _all_spans(base: str, terms: str):
    """``kind:start:end`` joined by commas, by start, then kind: base spans and disclosing terms."""
    parts = F.transform(F.filter(F.split(base, ","), lambda x: x != ""), lambda x: F.split(x, ":"))
    rank = {k: i for i, k in enumerate((*KINDS, "term"))}
    order = F.create_map(*[x for k, i in rank.items() for x in (F.lit(k), F.lit(i))])
    old = F.transform(parts, lambda p: F.struct(p[1].cast("long").alias("s"), order[p[0]].alias("k"), p[2].cast("long").alias("e"), p[0].alias("n")))
    new = F.transform(F.coalesce(F.col(terms), F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda t: F.struct(t["start"].alias("s"), F.lit(rank["term"]).alias("k"), t["end"].alias("e"), F.lit("term").alias("n")))
    return F.array_join(F.transform(F.array_sort(F.concat(old, new)), lambda x: F.concat_ws(":", x["n"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of every whole text.

    Null texts are empty. Repeated rows give repeated rows, each with the same spans, and count as documents; other
    columns are left out. An empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    scanned = saved(_scan(docs), "pii")
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256"]
    given = disclosing_terms(docs, scanned)
    if given is None:
        out = scanned.select(*names, F.col("base").alias("spans"))
    else:
        out = scanned.drop("near").join(given[1], ["k1", "k2"], "left").select(*names, _all_spans("base", "terms").alias("spans"))
    return out.withColumn("n_spans", F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long"))


def _rewrite(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Base spans become their kind in brackets, and so do terms. What overlaps is one span of the first's kind."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], z)
            if merged[-1][0] == "term":
                merged[-1][0] = kind
        else:
            merged.append([kind, a, z])
    for kind, a, z in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = z
    return "".join([*out, text[at:]])


def sanitise(df: DataFrame, text_col: str = "text", n_col: str | None = None) -> DataFrame:
    """``df`` with protected values and disclosing terms of the text replaced; ``n_col``, if given, gets the new length.

    A null text stays null. Rows whose text holds no disclosing term aren't shuffled; only texts in which the scan found
    something are searched again. Columns of any name stay as they are.
    """
    cols, kinds = df.columns, dict(df.dtypes)
    docs = df.select(F.lit(None).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    scanned = saved(_scan(docs).drop("doc_id", "base_sha256", *(f"n_{k}" for k in KINDS)), "pii")
    marked = _text_marks(scanned.filter("base <> ''"))
    given = disclosing_terms(docs, scanned)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))
    no_terms = F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("terms")
    if given is None:
        rows = rows.select("row", no_terms)
    else:
        keyed = _with_keys(rows, text_col, _text_marks(given[1]))
        rows = keyed.filter("k1 is null").select("row", no_terms).unionByName(keyed.filter("k1 is not null").join(given[1], ["k1", "k2"], "left").select("row", "terms"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = dict(zip(cols, batch.column(0).flatten(), strict=True))
            new = []
            for t, terms in zip(fields[text_col].to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t and (terms or marked[_place(t)]):
                    t = _rewrite(t, [(KINDS[k], a, z) for a, z, k in base_spans(t)] + [("term", x["start"], x["end"]) for x in terms or ()])
                new.append(t)
            fields[text_col] = pa.array(new, fields[text_col].type)
            if n_col:
                fields[n_col] = pa.array([None if t is None else len(t) for t in new], fields[n_col].type)
            yield pa.RecordBatch.from_arrays([fields[c] for c in cols], cols)

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in cols))


def _place(text: str) -> int:
    """The bucket of a text: pmod of its signed hash k1, as BUCKETS is a power of two."""
    return xxhash.xxh3_64_intdigest(text.encode()) % BUCKETS


def _text_marks(texts: DataFrame) -> np.ndarray:
    """The buckets of texts by their hash k1: a filter of fixed size."""
    place = F.pmod("k1", F.lit(BUCKETS))
    rows = texts.groupBy(F.floor(place / 32768).alias("at")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(32768))).alias("bits"))
    marks = np.zeros(BUCKETS, bool)
    for r in rows.collect():
        marks[r["at"] * 32768 : (r["at"] + 1) * 32768] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
    return marks


def _with_keys(rows: DataFrame, text_col: str, marks: np.ndarray) -> DataFrame:
    """row, k1, k2: the text's hashes where its bucket is marked, else null."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).field(text_col).to_pylist()]
            k1, k2 = (k.to_numpy() for k in _keys(texts)) if texts else (np.zeros(0, np.int64),) * 2
            off = ~marks[k1 % BUCKETS]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k1, mask=off), pa.array(k2, mask=off)], ["row", "k1", "k2"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, k1 long, k2 long")
