"""SimHash near-duplicates: fingerprints of word shingles, BK-trees over shards of them, components.

Two fingerprints with at most 4 differing bits agree on at least 2 of 6 bit blocks. Each distinct fingerprint goes to
the 15 shards named by its pairs of blocks; a shard's fingerprints stand in a BK-tree (children keyed by the integer
Hamming distance to the parent), and a search follows only the edges within the radius of the distance at hand. All
shards of a task are built and searched as one forest with numpy. Of a shard's links only a spanning set leaves the
task; components of the links then give the groups.

A shard that more than ``HOT`` distinct fingerprints share is dealt out once more by blocks of its remaining bits
(at most 4 of 5 can differ), so that its trees stand in many tasks. Trees travel with their shard's rows, by the
shuffle: fingerprints grow with the documents, so a broadcast of trees would have no bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlake.llm.common import lean, let_go, only_ids, saved, text_or_empty
from modlake.llm.graph import components

RADIUS = 4
#: Distinct fingerprints in a shard above which it is dealt out once more.
HOT = 20_000
#: Pairs of query and tree size that are searched at once.
SEARCH = 200_000
#: Rotations of the bits in whose order neighbours are linked first, and rows of a shard that all of it is compared with.
TURNS, PIVOTS = (0, 13, 26, 39, 52), 4
#: Characters hashed at once.
SLICE = 1_000_000
_BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def fingerprint_of(text: str, words: int = 4) -> int:
    """The unsigned fingerprint of one text."""
    return int(fingerprints([text], words)[0])


def fingerprints(texts: list[str], words: int = 4) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is 1 if it is set in over half the hashes of a text's shingles."""
    hashes, sizes = [], []
    digest = xxhash.xxh64_digest
    for t in texts:
        w = t.encode().lower().split()  # of bytes: A-Z, and the six ASCII spaces
        n = max(len(w) - words + 1, 1) if w else 0
        if n == 1:
            hashes.append(digest(b" ".join(w), 42))
        elif n:
            joined = b" ".join(w)
            begin = list(accumulate(map(len, w), lambda a, x: a + x + 1, initial=0))
            hashes += [digest(joined[a : z - 1], 42) for a, z in zip(begin, begin[words:], strict=False)]
        sizes.append(n)
    out, counts = np.zeros((len(texts), 64), bool), np.array(sizes)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
        ends = np.cumsum(counts[full])
        votes = np.add.reduceat(bits, ends - counts[full], axis=0, dtype=np.int32)
        out[full] = votes * 2 > counts[full, None]
    return np.packbits(out, axis=1).view(">u8").ravel().astype(np.uint64)


def with_fingerprint(df: DataFrame, text_col: str = "text", words: int = 4, name: str = "fingerprint") -> DataFrame:
    """``df`` with the signed fingerprint of each whole text; a null or wordless text has 0."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` long"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text_col))
            done, texts, size = [], [], 0
            for x in col.to_pylist():
                texts.append(x or "")
                size += len(texts[-1])
                if size > SLICE:
                    done.append(fingerprints(texts, words))
                    texts, size = [], 0
            if texts:
                done.append(fingerprints(texts, words))
            got = np.concatenate(done).view(np.int64) if done else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, name])

    return df.mapInArrow(run, schema)


class Forest:
    """A BK-tree for each shard. ``shard``: sorted numbers from 0; ``fp``: unsigned fingerprints, distinct in a shard."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        self.fp, n = fp, len(fp)
        self.root = np.full(int(shard[-1]) + 1, -1, np.int64)
        self.child = np.full((n, 65), -1, np.int32)
        rows, group = np.arange(n), shard.astype(np.int64)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        while len(rows):  # one level: the first of each group becomes its node, the others go below it by distance
            head = np.flatnonzero(np.diff(group, prepend=-1))
            nodes = rows[head]
            if parent[0] < 0:
                self.root[shard[nodes]] = nodes
            else:
                self.child[parent[head], edge[head]] = nodes
            below = np.ones(len(rows), bool)
            below[head] = False
            owner = np.repeat(nodes, np.diff([*head, len(rows)]))[below]
            rows = rows[below]
            dist = np.bitwise_count(fp[rows] ^ fp[owner]).astype(np.int64)
            order = np.lexsort((rows, dist, owner))
            rows, parent, edge = rows[order], owner[order], dist[order]
            group = parent * 65 + edge

    def near(self, query: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in query, node) of all within the radius; only edges from distance - radius to distance + radius are followed."""
        who, node = np.arange(len(query)), self.root[shard]
        reach = np.arange(-radius, radius + 1)
        found = []
        while len(who):
            dist = np.bitwise_count(query[who] ^ self.fp[node]).astype(np.int64)
            hit = dist <= radius
            found.append((who[hit], node[hit]))
            steps = np.clip(dist[:, None] + reach, 0, 64)
            nxt = self.child[node[:, None], steps]
            ok = nxt >= 0
            ok[:, 1:] &= steps[:, 1:] != steps[:, :-1]
            if (low := dist < radius).any():  # clipped at 0: the first of equal steps counts
                first = np.argmax(steps[low] == 0, axis=1)
                keep = ok[low]
                keep[np.arange(len(first)), first] = nxt[low][np.arange(len(first)), first] >= 0
                ok[low] = keep
            who, node = np.repeat(who, ok.sum(1)), nxt[ok].astype(np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the rows that the links a, b connect the smallest label of theirs, in place."""
    while True:
        la, lb = label[a], label[b]
        if not (apart := la != lb).any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label[:] = label[label]


def _outside(shard: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The rows that are not in the largest component of their shard."""
    pairs, at, n = np.unique(np.stack([shard, label]), axis=1, return_inverse=True, return_counts=True)
    order = np.lexsort((n, pairs[0]))
    largest = order[np.flatnonzero(np.diff(pairs[0][order], append=-1))]
    return np.flatnonzero(~np.isin(at.ravel(), largest))


def spanning_links(shard: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(row, row of the smallest fingerprint that it reaches within its shard) where these differ.

    Neighbours in a few orders, and the first rows of each shard against all of it, are linked first. Every link between
    components then has an end outside of its shard's largest one, so only these rows are looked up in the trees: a dense
    shard, of which most is one component by then, costs as many searches as it has other rows.
    """
    n = len(fp)
    label = np.arange(n)
    if not n:
        return label, label
    near = lambda a, b: (shard[a] == shard[b]) & (np.bitwise_count(fp[a] ^ fp[b]) <= radius)
    for turn in TURNS:
        order = np.lexsort(((fp << np.uint64(turn)) | (fp >> np.uint64((64 - turn) % 64)) if turn else fp, shard))
        hit = near(order[:-1], order[1:])
        _joined(label, order[:-1][hit], order[1:][hit])
    head = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1))
    size = np.diff([*head, n])
    for k in range(PIVOTS):
        pivot = np.repeat(np.where(k < size, head + k, head), size)
        rows = np.flatnonzero(near(pivot, np.arange(n)))
        _joined(label, pivot[rows], rows)
    many = _outside(shard, label)
    many = many[np.repeat(size, size)[many] > 1]
    if len(many):
        forest = Forest(shard, fp)
        ends = np.cumsum(np.repeat(size, size)[many])
        for part in np.split(many, np.searchsorted(ends, np.arange(SEARCH, int(ends[-1]), SEARCH))):
            if len(part):
                who, node = forest.near(fp[part], shard[part], radius)
                _joined(label, part[who], node)
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


@lean
def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) in the order of key -> links a, b. A shard may begin in one batch and end in another."""
    let_go()
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(keys, fps):
        cut = np.diff(keys, prepend=keys[0] - 1 if len(keys) else 0) != 0
        a, b = spanning_links(np.cumsum(cut) - 1, fps.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy()])
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield links(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
    if len(keys):
        yield links(keys, fps)


def _block(at: int, width: int):
    return F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1)


def near_links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """a, b: a spanning set of the links among distinct fingerprints (column fp), complete for components."""
    pairs = list(combinations(range(6), 2))
    key = [_block(*_BLOCKS[i]) * (1 << 30) + _block(*_BLOCKS[j]) * (1 << 16) + F.lit(n) for n, (i, j) in enumerate(pairs)]
    sharded = distinct.select("fp", F.explode(F.array(*key)).alias("key"))
    crowded = saved(sharded.groupBy("key").count().filter(F.col("count") > hot).select("key"), "hot-shards")
    again = []
    for n, (i, j) in enumerate(pairs):
        bits = [b for k, (at, w) in enumerate(_BLOCKS) if k not in (i, j) for b in range(at, at + w)]
        for m in range(5):
            own = bits[m::5]
            part = F.lit(0).cast("long")
            for bit in own:
                part = part * 2 + _block(bit, 1)
            again.append((n, m, part))
    deeper = F.lit(None).cast("array<long>")
    for n in range(len(pairs)):
        deeper = F.when(F.col("key").bitwiseAND(0xFFFF) == n, F.array(*[F.xxhash64("key", F.lit(m), part) for k, m, part in again if k == n])).otherwise(deeper)
    plain = sharded.join(crowded, "key", "left_anti")
    split = sharded.join(crowded, "key", "left_semi").select("fp", F.explode(deeper).alias("key"))
    rows = plain.select("key", "fp").unionByName(split.select("key", "fp"))
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_batches, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, hot: int = HOT) -> DataFrame:
    """doc_id, fp (signed fingerprint), component_id: the smallest doc_id that a row reaches by links of at most 4 bits.

    Null, empty and wordless texts have fingerprint 0 and link like any other. Rows without an id take part; they get
    the smallest id of their group, null if there is none. Repeated rows give repeated rows; other columns are left out.
    """
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    docs = saved(with_fingerprint(slim, words=words, name="fp").select("doc_id", "fp"), "fingerprints")
    each = saved(docs.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    stars = components(near_links(each.select("fp"), hot))
    rooted = each.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return docs.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex16(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the documents whose group has one with a smaller id. Rows that repeat the id kept stay with it."""
    groups = near_duplicates(df, id_col, text_col)
    return only_ids(df, groups.filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id"), id_col)
