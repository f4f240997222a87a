"""Texts as sets of word shingles: hashes, fingerprints, and the whole sets of some texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlake.llm.common import lean

WORDS = 5
#: Marks of the filter of wanted texts; shingles whose votes are counted at once.
MARKS, VOTES = 1 << 19, 1 << 16


def shingles_of(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of the runs of ``words`` words; a shorter text is one shingle, a wordless one has none."""
    w = text.encode().lower().split()  # of bytes: A-Z, and the six ASCII spaces
    if not w:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    size = min(words, len(w))
    x = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        x = (x ^ one[k : k + len(x)]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return np.unique(x.view(np.int64))


def fingerprint_of_set(x: np.ndarray) -> int:
    """Signed SimHash of a set of hashes: a bit is 1 if it is set in over half of them."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(x), VOTES):
        votes += np.unpackbits(x[at : at + VOTES].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(x)).view(">i8")[0])


def node_of(x: np.ndarray) -> int:
    """The hash of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).view(np.int64))


def whole_sets(docs: DataFrame, words: int, nodes: np.ndarray, ids: np.ndarray, no_id: bool) -> DataFrame:
    """node, x: the whole sets of the texts whose node and doc_id are marked, so that of copies mostly one is passed on."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if no_id if i is None else ids[i % MARKS]:
                    x = shingles_of(t.as_py(), words)
                    if nodes[(node := node_of(x)) % MARKS]:
                        lists = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), lists], ["node", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, x array<long>")


def marked(rows: DataFrame, col: str) -> np.ndarray:
    """The buckets of a column of numbers: a filter of fixed size."""
    place = F.pmod(col, F.lit(MARKS))
    maps = rows.filter(F.col(col).isNotNull()).groupBy(F.floor(place / 32768).alias("at")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(32768))).alias("bits")).collect()
    marks = np.zeros(MARKS, bool)
    for r in maps:
        marks[r["at"] * 32768 : (r["at"] + 1) * 32768] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
    return marks
