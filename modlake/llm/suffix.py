"""Removing long repeats with a sparse, distributed suffix array.

A repeat is a 400-byte string that starts at two places of the corpus. Suffixes are taken at anchors only: the
positions whose 200-byte gram has the smallest hash in some 400-byte string around it. Anchors follow from the bytes
alone, so both places of a repeat have one at the same distance from their start; about one position in 100 is one.

Anchors with the same gram form a bucket of the suffix array. Those with the same whole context (200 bytes before, 400
after) are one class; a class of several places is a repeat as far as it reaches. Where a bucket has several classes,
their suffixes are sorted, and a stack scan over the longest common prefixes gives the tree of common-prefix intervals.
Intervals whose members go on differently to the left are the maximal repeat groups; going up the tree, each member
gets the longest left extension that it shares with any other of its interval, hence every repeat through the anchor,
with all its occurrences and not those of neighbours only.

A bucket of more than ``HOT`` classes is not taken into one task: its classes are spread as 400-byte windows, which are
counted by digest.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlake.llm.common import saved, text_or_empty

LENGTH, GRAM = 400, 200
SPAN = LENGTH - GRAM + 1
#: Classes of one gram above which its bucket is spread as windows.
HOT = 50_000
#: Bytes whose grams are hashed at once.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_UP, _DOWN = _powers(BLOCK + LENGTH + 1)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, w: int, ufunc: np.ufunc, fill: np.uint64) -> np.ndarray:
    """ufunc over x[i : i + w], for every i; beyond the end lies ``fill``."""
    n = len(x)
    rows = -(-n // w) + 1
    grid = np.full(rows * w, fill, np.uint64)
    grid[:n] = x
    grid = grid.reshape(rows, w)
    ahead = ufunc.accumulate(grid, axis=1).ravel()
    back = ufunc.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors and their gram hashes, in texts laid one after the other; ends: by byte, the end of its text."""
    places, grams = [], []
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        x = data[at : at + BLOCK + LENGTH - 1]
        end = ends[at : at + BLOCK + LENGTH - 1] - at
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * _UP[: len(x)], out=sums[1:], dtype=np.uint64)
        n = len(x) - GRAM + 1
        gram = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[:n]
        gram ^= gram >> np.uint64(32)
        gram *= np.uint64(0xD6E8FEB86659FD93)
        gram ^= gram >> np.uint64(32)
        place = np.arange(n)
        gram[place + GRAM > end[:n]] = _TOP
        low = _sliding(gram, SPAN, np.minimum, _TOP)
        low[place + LENGTH > end[:n]] = 0
        low[BLOCK:] = 0  # strings that begin in the next block
        # the largest of the minima of the strings that hold a gram: its own hash if it is the smallest of one
        most = _sliding(np.concatenate([np.zeros(SPAN - 1, np.uint64), low]), SPAN, np.maximum, np.uint64(0))[:n]
        hit = np.flatnonzero((most == gram) & (gram != _TOP))
        places.append(hit + at)
        grams.append(gram[hit])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(grams)[first]


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k1, k2, text -> k1, k2, pos, g, ctx, after."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        k1, k2 = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        texts = batch.column(2)
        row = 0
        while row < len(texts):
            raw, rows, size = [], [], 0
            while row < len(texts) and size < BLOCK:
                b = texts[row].as_buffer() if texts[row].is_valid else b""
                if len(b) >= LENGTH:
                    raw.append(bytes(b))
                    rows.append(row)
                    size += len(b)
                row += 1
            if not raw:
                continue
            sizes = np.array([len(b) for b in raw])
            ends = np.cumsum(sizes)
            whole = b"".join(raw)
            place, gram = anchors(np.frombuffer(whole, np.uint8), np.repeat(ends, sizes))
            owner = np.searchsorted(ends, place, "right")
            begin, end = (ends - sizes)[owner], ends[owner]
            left, right = np.minimum(place - begin, LENGTH - GRAM), np.minimum(end - place, LENGTH)
            ctx = [digest(whole[p - x : p + y], x) for p, x, y in zip(place.tolist(), left.tolist(), right.tolist(), strict=True)]
            of = np.array(rows)[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[of]), pa.array(k2[of]), pa.array((place - begin).astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(np.array(ctx, np.uint64).view(np.int64)), pa.array(right.astype(np.int32))],
                ["k1", "k2", "pos", "g", "ctx", "after"],
            )


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of at least ``least``, children before parents.

    lcp[i] is the longest common prefix of the sorted suffixes i - 1 and i; lcp[0] is 0.
    """
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now, first = lcp[i] if i < len(lcp) else 0, i - 1
        while stack[-1][0] > now:
            length, first = stack.pop()
            if length >= least:
                yield length, first, i - 1
        if stack[-1][0] < now:
            stack.append((now, first))


def _common(a: int, b: int, width: int) -> int:
    """Equal leading bytes of two big-endian numbers of ``width`` bytes."""
    return width - (((a ^ b).bit_length() + 7) >> 3)


def repeat_groups(contexts: list[tuple[bytes, int]], length: int = LENGTH, gram: int = GRAM) -> tuple[list[list[tuple[int, int]]], list[tuple[int, list[int]]]]:
    """Of distinct contexts (bytes, bytes before the anchor): covers of each, and the maximal repeat groups.

    A cover (l, r): the bytes from l before the anchor to r after it stand elsewhere too, l + r >= length.
    A group: (common length after the anchor, its members), members with different bytes to the left.
    """
    wide = length - gram
    left = [c[:at][::-1] for c, at in contexts]
    lnum = [int.from_bytes(x.ljust(wide, b"\0"), "big") for x in left]
    right = [c[at:] for c, at in contexts]
    rnum = [int.from_bytes(x.ljust(length, b"\0"), "big") for x in right]
    order = sorted(range(len(contexts)), key=lambda i: right[i])
    lcp = [0] + [min(_common(rnum[a], rnum[b], length), len(right[a]), len(right[b])) for a, b in zip(order, order[1:], strict=False)]
    by_left = sorted(range(len(contexts)), key=lambda i: left[i])
    rank = [0] * len(contexts)
    for r, i in enumerate(by_left):
        rank[i] = r
    best = [-1] * len(contexts)
    covers: list[list[tuple[int, int]]] = [[] for _ in contexts]
    groups = []
    done: list[tuple[int, int, list[int]]] = []  # intervals not yet below another: first, last, left ranks in order

    def shares(i: int, j: int, after: int) -> None:
        n = min(_common(lnum[i], lnum[j], wide), len(left[i]), len(left[j]))
        for x in (i, j):
            if n > best[x]:
                best[x] = n
                if n + after >= length:
                    covers[x].append((n, after))

    for after, first, last in intervals(lcp, gram):
        parts = []
        while done and done[-1][0] >= first:
            parts.append(done.pop())
        ranks = max((p[2] for p in parts), key=len, default=[])
        new = [r for p in parts if p[2] is not ranks for r in p[2]]
        at = first
        for a, z, _ in [*reversed(parts), (last + 1, last, [])]:  # members of no interval below lie between these
            new += [rank[order[k]] for k in range(at, a)]
            at = z + 1
        for r in new:
            at = bisect_left(ranks, r)
            i = by_left[r]
            if at:
                shares(i, by_left[ranks[at - 1]], after)
            if at < len(ranks):
                shares(i, by_left[ranks[at]], after)
            ranks.insert(at, r)
        done.append((first, last, ranks))
        ends = {left[by_left[ranks[0]]][:1], left[by_left[ranks[-1]]][:1]}
        if len(ends) > 1 or b"" in ends:
            groups.append((after, [order[k] for k in range(first, last + 1)]))
    return covers, groups


def _tree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, ctx, before, bytes) in the order of g -> g, ctx, covers. A class may come twice."""
    now, classes = None, {}
    kind = pa.list_(pa.struct([("l", pa.int32()), ("r", pa.int32())]))

    def out(g, classes):
        covers, _ = repeat_groups(list(classes.values()))
        rows = [(c, [{"l": a, "r": b} for a, b in cov]) for c, cov in zip(classes, covers, strict=True) if cov]
        return pa.RecordBatch.from_arrays([pa.array([g] * len(rows), pa.int64()), pa.array([c for c, _ in rows], pa.int64()), pa.array([c for _, c in rows], kind)], ["g", "ctx", "covers"])

    for batch in batches:
        for g, ctx, before, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if g != now:
                if len(classes) > 1:
                    yield out(now, classes)
                now, classes = g, {}
            classes[ctx] = (data, before)
    if len(classes) > 1:
        yield out(now, classes)


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the places of class representatives -> g, ctx, before, bytes, hot, n."""
    names = ["g", "ctx", "before", "bytes", "hot", "n"]
    last = None
    for batch in batches:
        text, at = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("at"))
        k1, k2 = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("k1", "k2"))
        cols: list[list] = [[] for _ in names]
        for i in range(batch.num_rows):
            if (k1[i], k2[i]) == last:  # a copy of the text before
                continue
            last = (k1[i], k2[i])
            b = bytes(text[i].as_buffer())
            for a in at[i].as_py():
                p = a["pos"]
                x = min(p, LENGTH - GRAM)
                for col, v in zip(cols, (a["g"], a["ctx"], x, b[p - x : p + LENGTH], a["hot"], a["n"]), strict=True):
                    col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of hot grams -> g, ctx, n, l, w: every 400-byte string over the anchor's gram by its digest."""
    for batch in batches:
        for g, ctx, before, data, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("g", "ctx", "before", "bytes", "n")), strict=True):
            starts = range(max(0, len(data) - LENGTH + 1))
            lefts = [before - s for s in starts if s <= before]
            w = [xxhash.xxh3_128_digest(data[before - x : before - x + LENGTH]) for x in lefts]
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(w), pa.int64()), pa.array([ctx] * len(w), pa.int64()), pa.array([n] * len(w), pa.int64()), pa.array(lefts, pa.int32()), pa.array(w, pa.binary())], ["g", "ctx", "n", "l", "w"])


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, spans -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept."""
    for batch in batches:
        ids, text, spans = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "spans"))
        rows = []
        for i in range(batch.num_rows):
            b = bytes(text[i].as_buffer())
            kept, at, removed, runs, end = [], 0, 0, 0, -1
            for s in spans[i].as_py() or ():
                a, z = max(s["s"], at), s["e"]
                if s["s"] > end:
                    runs += 1
                end = max(end, z)
                if z > a:
                    kept.append(b[at:a])
                    removed += z - a
                    at = z
            kept.append(b[at:])
            rest = b"".join(kept)
            rows.append((len(b), removed, runs, hashlib.sha256(rest).hexdigest(), rest))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of every whole text.

    Every byte in a 400-byte string that also starts elsewhere goes, judged on the input. Null texts are empty; a text
    under 400 bytes stays whole. Repeated rows count as copies of each other. Other columns are left out.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    docs = docs.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(8), "text"))
    found = docs.select("k1", "k2", "text").mapInArrow(_anchor_batches, "k1 long, k2 long, pos int, g long, ctx long, after int")
    found = saved(found, "anchors")
    classes = found.groupBy("g", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("rep"), F.first("after").alias("after"))
    buckets = classes.groupBy("g").agg(F.count("*").alias("k"), F.sum("n").alias("m")).filter("m > 1").drop("m")
    classes = saved(classes.join(buckets, "g"), "classes")

    before = F.least(F.col("rep.pos"), F.lit(LENGTH - GRAM))
    copied = classes.filter("n > 1").select("g", "ctx", F.struct(before.cast("int").alias("l"), F.col("after").alias("r")).alias("c")).filter(f"c.l + c.r >= {LENGTH}")
    wanted = classes.filter("k > 1").select("rep.k1", "rep.k2", F.struct("rep.pos", "g", "ctx", "n", (F.col("k") > hot).alias("hot")).alias("a")).groupBy("k1", "k2").agg(F.collect_list("a").alias("at"))
    texts = docs.filter(F.octet_length("text") >= LENGTH)
    contexts = saved(texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "at").mapInArrow(_context_batches, "g long, ctx long, before int, bytes binary, hot boolean, n long"), "contexts")
    cover = "covers array<struct<l:int,r:int>>"
    trees = contexts.filter("not hot").select("g", "ctx", "before", "bytes").repartition("g").sortWithinPartitions("g").mapInArrow(_tree_batches, f"g long, ctx long, {cover}").select("g", "ctx", F.explode("covers").alias("c"))
    windows = contexts.filter("hot").dropDuplicates(["g", "ctx"]).mapInArrow(_window_batches, "g long, ctx long, n long, l int, w binary")
    shared = windows.groupBy("g", "l", "w").agg(F.sum("n").alias("m")).filter("m > 1").drop("m")
    spread = windows.join(shared, ["g", "l", "w"]).select("g", "ctx", F.struct("l", (LENGTH - F.col("l")).alias("r")).alias("c"))
    covers = copied.unionByName(trees).unionByName(spread).groupBy("g", "ctx").agg(F.collect_set("c").alias("covers"))
    covers = saved(covers, "covers")  # read anew, both sides of the join are plain shuffles, and Spark splits a class that is copied around

    spans = found.select("k1", "k2", "pos", "g", "ctx").join(covers, ["g", "ctx"]).select("k1", "k2", "pos", F.explode("covers").alias("c"))
    spans = spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct((F.col("pos") - F.col("c.l")).alias("s"), (F.col("pos") + F.col("c.r")).alias("e")))).alias("spans"))
    joined = docs.join(saved(spans, "spans"), ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut_batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
