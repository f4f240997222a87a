"""Hard negatives by an inverted multi-index: two half-space codebooks, cells, and a search that stops on certified windows.

Vectors are cut into two halves; each half has a codebook, and a pair of codewords is a cell. A half's score with an anchor is
at most its codeword's score plus the anchor's half norm times the codeword's radius, over all rows. The multi-sequence
heap takes cells by the sum of two such bounds, highest first; once it is below all that a window can still use, no row is missed.

Cells lie in shards of about ``ROWS`` rows (a larger cell in several), and an anchor goes to the shards of the cells that it visits.
Three passes: a probe of the best cells gives a floor for the positives; all cells above that floor give the positives, and a
floor for the negatives; all cells above this one give the negatives. Each pass streams anchors past a shard's matrix.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modlake.llm.common import discard, hashed_sample, saved

POSITIVES, NEGATIVES, EVERY = 5, 3, 50
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows that codebooks are fitted on; rows of a cell that the number of codewords aims at, and the most codewords of a half.
FIT_ROWS, CELL_ROWS, MOST_CODES = 20_000, 256, 64
#: Most and least rows that a shard aims at, between which a small table has two shards a partition; rows that the probe looks at; scores held at once.
ROWS, LEAST_ROWS, PROBE, AT_ONCE = 16_384, 512, 2_048, 2_000_000
#: Components beyond this are taken as this, so that a score is exact.
LARGEST = 1 << 28
_ROW = "shard int, kind int, vec_id long, label long, v array<double>, want array<long>"


def prepared(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, v: the rows that take part, with labels moved on where the id is divisible by 7 and components floor(256 x)."""
    v = F.col(vector_col)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    i, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(F.lit(256.0) * x.cast("double")).cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST))))
    rows = df.filter(i.isNotNull() & label.isNotNull() & v.isNotNull() & usable).select(i.alias("vec_id"), F.when(i % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole.alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows of ``dim`` numbers; a shorter list ends in zeros."""
    ends = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)
    size = np.diff(ends)
    if (size == dim).all():
        return flat[ends[0] : ends[-1]].reshape(-1, dim)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], size)] = flat[ends[0] : ends[-1]]
    return out


def codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centroids of the rows by Lloyd's rounds, from rows evenly spaced in the given order."""
    codes = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, codes)[0]
        sums, n = np.zeros_like(codes), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        codes[n > 0] = sums[n > 0] / n[n > 0, None]
    return codes


def nearest(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row and the distance to it, never below the true one by more than rounding."""
    near = np.argmin((codes**2).sum(1) - 2 * (x @ codes.T), axis=1)
    return near, np.sqrt(((x - codes[near]) ** 2).sum(1))


class Cells:
    """What the search knows of the index, of bounded size: codebooks, radii, and each cell's rows and shards."""

    def __init__(self, dim: int, codes: list[np.ndarray], radii: list[np.ndarray], counts: np.ndarray, rows: int = ROWS):
        self.dim, self.codes, self.radii, self.counts = dim, codes, radii, counts
        self.blocks = np.maximum(-(-counts // rows), 1)
        before = np.cumsum(counts) - counts
        pack = np.where(self.blocks > 1, -1, before // rows)
        begins = (pack[1:] != pack[:-1]) | (self.blocks[1:] > 1)
        starts = np.concatenate([[0], np.cumsum(np.where(begins, self.blocks[:-1], 0))])
        self.first = starts.astype(np.int64)

    def visits(self, q: np.ndarray) -> Iterator[tuple[int, float]]:
        """(cell, bound of a score in it) by bound, highest first: the multi-sequence heap over both halves' sorted bounds."""
        half = self.dim - self.dim // 2
        bounds = []
        for part, codes, radii in zip((q[:half], q[half:]), self.codes, self.radii, strict=True):
            norm = float(np.sqrt((part**2).sum()))
            reach = codes @ part + norm * radii
            bounds.append(reach + 1e-9 * (np.abs(reach) + norm * (np.sqrt((codes**2).sum(1)) + radii)) + 1e-3)
        order = [np.argsort(-b, kind="stable") for b in bounds]
        one, two = (b[o].tolist() for b, o in zip(bounds, order, strict=True))
        k, heap = len(two), [(-(one[0] + two[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield int(order[0][i]) * k + int(order[1][j]), -bound
            if j + 1 < k:
                heapq.heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(one):  # each pair has one parent
                heapq.heappush(heap, (-(one[i + 1] + two[0]), i + 1, 0))

    def shards(self, q: np.ndarray, floor: float | None, probe: int | None) -> list[int]:
        """Shards of the cells to look at: until ``probe`` rows, or while a score of ``floor`` (None: any) is possible."""
        seen, out = 0, {}
        for cell, bound in self.visits(q):
            if probe is not None and seen >= probe or probe is None and floor is not None and bound < floor:
                break
            if self.counts[cell]:
                seen += self.counts[cell]
                out.update(dict.fromkeys(range(self.first[cell], self.first[cell] + self.blocks[cell])))
        return list(out)


def build(rows: DataFrame) -> tuple[DataFrame, Cells]:
    """(rows as index rows with their shard, cells): codebooks from a bounded sample, radii and counts from all rows."""
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = max(dim or 0, 2)
    half = dim - dim // 2
    k = int(min(max(round((n / CELL_ROWS) ** 0.5), 2), MOST_CODES))
    some = hashed_sample(rows, FIT_ROWS, "vec_id").select("v").toPandas()["v"].tolist()
    x = np.zeros((max(len(some), 1), dim))
    for at, v in enumerate(some):
        x[at, : len(v)] = v
    codes = [codebook(x[:, :half], k), codebook(x[:, half:], k)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), dim)
            (a, da), (b, db) = nearest(x[:, :half], codes[0]), nearest(x[:, half:], codes[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((a * k + b).astype(np.int32)), pa.array(da), pa.array(db)], [*batch.schema.names, "cell", "d1", "d2"])

    assigned = saved(rows.select("vec_id", "label", "v").mapInArrow(assign, "vec_id long, label long, v array<double>, cell int, d1 double, d2 double"), "cells")
    counts, radii = np.zeros(k * k, np.int64), [np.zeros(k), np.zeros(k)]
    for cell, c, d1, d2 in assigned.groupBy("cell").agg(F.count("*"), F.max("d1"), F.max("d2")).collect():  # at most MOST_CODES squared
        counts[cell] = c
        radii[0][cell // k], radii[1][cell % k] = max(radii[0][cell // k], d1), max(radii[1][cell % k], d2)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = Cells(dim, codes, radii, counts, min(max(n // (2 * parts), LEAST_ROWS), ROWS))
    places = rows.sparkSession.createDataFrame([(i, int(f), int(b)) for i, (f, b) in enumerate(zip(cells.first, cells.blocks, strict=True))], "cell int, first int, blocks int")
    placed = assigned.join(F.broadcast(places), "cell").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).cast("int"))
    return placed.select("shard", F.lit(0).alias("kind"), "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("want")), cells


def best(who: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each ``who`` by score, highest first, then id."""
    order = np.lexsort((ids, -score, who))
    w = who[order]
    begin = np.flatnonzero(np.diff(w, prepend=w[0] - 1 if len(w) else 0))
    rank = np.arange(len(w)) - np.repeat(begin, np.diff([*begin, len(w)]))
    return order[rank < k]


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    top = np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * a.shape[1]
    return a @ x.T if top < 1 << 53 else a.astype(np.int64) @ x.astype(np.int64).T


def window(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest score of a negative for positive scores p."""
    return -((-LOW * p) // 100), (HIGH * p) // 100


def _positives(ids, labels, floor, s, rows, row_labels):
    """Rows (kind 0: positive, with id and score) and (kind 1: scores of negatives below a certain positive)."""
    same = labels[:, None] == row_labels[None]
    floors = np.array([w[0] if len(w) else np.iinfo(np.int64).min for w in floor], np.int64)
    hit = same & (s >= floors[:, None]) & (ids[:, None] != rows[None])
    who, at = np.nonzero(hit)
    keep = best(who, s[who, at], rows[at], POSITIVES)
    yield 0, who[keep], at[keep], np.zeros(len(keep), np.int64)
    sure = floors > 0  # the highest negatives within reach of the lowest possible positive
    cap = window(np.where(sure, floors, 0))[1]
    low = np.where(~same & (s <= cap[:, None]) & sure[:, None], s, np.iinfo(np.int64).min if s.dtype.kind == "i" else -np.inf)
    k = min(NEGATIVES, low.shape[1])
    part = np.argpartition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k :]
    who = np.repeat(np.arange(len(low)), k)
    at = part.ravel()
    ok = low[who, at] > np.iinfo(np.int64).min
    yield 1, who[ok], at[ok], np.zeros(int(ok.sum()), np.int64)


def _negatives(ids, labels, want, s, rows, row_labels):
    """Rows (kind 0) with the positive's score, for windows given as (positive score, floor) pairs."""
    n = max(map(len, want), default=0) // 2
    p = np.full((len(want), n), -1, np.int64)
    floors = np.zeros((len(want), n), np.int64)
    for i, w in enumerate(want):
        p[i, : len(w) // 2], floors[i, : len(w) // 2] = w[::2], w[1::2]
    top, low = window(p)[1].max(1), np.where(p < 0, np.iinfo(np.int64).max, floors).min(1)
    who, at = np.nonzero((labels[:, None] != row_labels[None]) & (s >= low[:, None]) & (s <= top[:, None]))
    own = s[who, at].astype(np.int64)
    for j in range(n):
        fits = (p[who, j] >= 0) & (own >= floors[who, j]) & (own <= window(p[who, j])[1])
        w, a = who[fits], at[fits]
        keep = best(w, own[fits], rows[a], NEGATIVES)
        yield 0, w[keep], a[keep], p[w[keep], j]


def _searched(index: DataFrame, cells: Cells, anchors: DataFrame, step, probe: int | None = None) -> DataFrame:
    """anchor_id, kind, p, other, score: what ``step`` finds for each anchor (vec_id, label, v, want, floor) in the shards that it visits."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column(2), cells.dim)
            for at in range(0, batch.num_rows, 256):
                to = [cells.shards(q[i], batch.column(4)[i].as_py(), probe) for i in range(at, min(at + 256, batch.num_rows))]
                rows = pa.array(np.repeat(np.arange(at, at + len(to)), [len(t) for t in to]))
                x = batch.take(rows)
                shard = pa.array(np.array([s for t in to for s in t], np.int32))
                yield pa.RecordBatch.from_arrays([shard, pa.array(np.ones(len(rows), np.int32)), *x.columns[:4]], ["shard", "kind", "vec_id", "label", "v", "want"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, x, rows, row_labels = None, [], [], []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            kinds = batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(shards, prepend=-1) != 0) | (np.diff(kinds, prepend=-1) != 0))
            for a, z in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(a, z - a)
                if shard != shards[a]:
                    shard, x, rows, row_labels = shards[a], [], [], []
                ids, labels, v = part.column(2).to_numpy(), part.column(3).to_numpy(), matrix(part.column(4), cells.dim)
                if kinds[a] == 0:
                    x.append(v), rows.append(ids.copy()), row_labels.append(labels.copy())
                    continue
                if len(x) > 1:
                    x, rows, row_labels = [np.concatenate(x)], [np.concatenate(rows)], [np.concatenate(row_labels)]
                if not x:
                    continue
                some = max(AT_ONCE // len(x[0]), 1)
                want = part.column(5).to_pylist()
                for b in range(0, len(ids), some):
                    own = slice(b, b + some)
                    s = _scores(v[own], x[0])
                    for kind, who, at, p in step(ids[own], labels[own], [w or [] for w in want[own]], s, rows[0], row_labels[0]):
                        cols = [ids[own][who], np.full(len(who), kind, np.int32), p, rows[0][at], s[who, at].astype(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor_id", "kind", "p", "other", "score"])

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    visits = anchors.select("vec_id", "label", "v", "want", "floor").mapInArrow(route, _ROW)
    both = index.unionByName(visits).repartition(parts, "shard").sortWithinPartitions("shard", "kind")
    return both.mapInArrow(search, "anchor_id long, kind int, p long, other long, score long")


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor and positive; exact.

    Rows with a null id, label, vector or component, or one that isn't finite, take no part. Rows that repeat an id count as one,
    that of the smallest label, then vector. Shorter vectors count as if they ended in zeros; an empty one scores 0. Components
    beyond ``LARGEST`` count as that. Equal scores go by the smaller id. Anchors without another row of their label, and
    positives of a negative score, have no rows; an empty table gives none. Other columns are left out.
    """
    rows = saved(prepared(df, id_col, vector_col, label_col), "vectors")
    index, cells = build(rows)
    none = F.lit(None).cast("array<long>")
    anchors = rows.filter(F.col("vec_id") % EVERY == 0)

    probed = _searched(index, cells, anchors.select("*", none.alias("want"), F.lit(None).cast("double").alias("floor")), _positives, PROBE).filter("kind = 0")
    fifth = _first(probed, POSITIVES, "anchor_id").filter(F.col("rank") == POSITIVES).select(F.col("anchor_id").alias("vec_id"), F.col("score").alias("least"))
    sure = anchors.join(fifth, "vec_id", "left").select("vec_id", "label", "v", F.when(F.col("least").isNotNull(), F.array("least")).alias("want"), F.col("least").cast("double").alias("floor"))
    found = saved(_searched(index, cells, sure, _positives), "positives")

    positives = _first(found.filter("kind = 0"), POSITIVES, "anchor_id").select("anchor_id", F.col("other").alias("positive_id"), F.col("score").alias("p"))
    third = _first(found.filter("kind = 1"), NEGATIVES, "anchor_id").filter(F.col("rank") == NEGATIVES).select("anchor_id", F.col("score").alias("third"))
    half = F.ceil(F.col("p") * LOW / 100)
    windows = positives.filter("p >= 0").select("anchor_id", "p").distinct().join(third, "anchor_id", "left").withColumn("least", F.greatest(half, "third"))
    wanted = windows.groupBy("anchor_id").agg(F.flatten(F.sort_array(F.collect_list(F.array("p", "least")))).alias("want"), F.min("least").cast("double").alias("floor"))
    last = anchors.join(wanted.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("vec_id", "label", "v", "want", "floor")
    negatives = _first(_searched(index, cells, last, _negatives), NEGATIVES, "anchor_id", "p")
    out = positives.join(negatives.select("anchor_id", "p", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "p"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("p").alias("positive_score"), "negative_score")
