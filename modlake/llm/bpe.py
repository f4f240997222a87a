"""Byte-level BPE by merge replay over slices of the corpus.

The distinct pieces of a slice (``SLICE`` characters of a task's texts) that a task hasn't met yet are laid out in one symbol array with links to the neighbours. An
inverted index leads from a merge (its rank) to the positions where it applies; merges are taken in rank order and
each touches only the two neighbours of its positions. Where a merge makes a pair of the same or a lower rank, the
rest of that piece waits, so that every piece is merged lowest rank first, leftmost first.

Pieces met before are kept in a table that is emptied at a bound; it changes speed only.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlake.llm.common import KEPT, lean, text_or_empty

#: Pieces in a worker's table after which it is emptied before the next slice.
CACHE = 120_000
#: Characters of text that are cut into pieces and replayed together; a longer text is taken by pieces.
SLICE = 1_000_000
#: Pieces of a longer text that are replayed together.
PIECES = 100_000


def default_vocabulary() -> tuple[str, str]:
    """Rank file and splitting pattern of the default vocabulary, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for t, r in ranks.items():
        out[r] = t
    return out


class Vocabulary:
    """Ranks of a tiktoken file. A token's id is its rank."""

    _open: dict[tuple[str, str], "Vocabulary"] = {}

    def __init__(self, path: str, pattern: str):
        self.ranks = _ranks(path)
        cut = regex.compile(pattern)
        self.split, self.find = cut.findall, cut.finditer
        none = max(self.ranks.values(), default=-1) + 1
        self.none = none
        self.byte_id = np.array([self.ranks.get(bytes([b]), none) for b in range(256)], np.int64)
        self.first = np.full((256, 256), none, np.int64)  # rank of the merge of two bytes
        for t, r in self.ranks.items():
            if len(t) == 2:
                self.first[t[0], t[1]] = r
        get = self.ranks.get  # every pair of tokens that a merge can join, as left << 20 | right
        self.pairs = {left << 20 | right: r for t, r in self.ranks.items() for i in range(1, len(t)) if (left := get(t[:i])) is not None and (right := get(t[i:])) is not None}
        every = np.array([(k >> 20, k & 0xFFFFF, r) for k, r in self.pairs.items()], np.int64).reshape(-1, 3)
        for name, own, other in (("left", 0, 1), ("right", 1, 0)):  # the pairs that a token begins, and those that it ends
            part = every[np.lexsort((every[:, other], every[:, own]))]
            setattr(self, f"{name}_at", np.searchsorted(part[:, own], np.arange(none + 2)))
            setattr(self, f"{name}_with", part[:, other].astype(np.int32))
            setattr(self, f"{name}_rank", part[:, 2].astype(np.int32))
        self.names = [str(i) for i in range(none)]
        self.tokens = _tokens(self.ranks)
        self.forget()

    def forget(self) -> None:
        """Empty the table of pieces: piece -> number, and the ids of each."""
        self.table = Numbering()
        self.id_text: list[str] = []
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @classmethod
    def of(cls, path: str, pattern: str) -> "Vocabulary":
        """One for each worker."""
        if (path, pattern) not in cls._open:
            cls._open[path, pattern] = cls(path, pattern)
        return cls._open[path, pattern]

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each word."""
        out: list[tuple[int, ...]] = [()] * len(words)
        rest = []
        for i, w in enumerate(words):
            if w in self.ranks:
                out[i] = (self.ranks[w],)
            elif w:
                rest.append(i)
        if not rest:
            return out
        flat = np.frombuffer(b"".join(words[i] for i in rest), np.uint8)
        sizes = np.array([len(words[i]) for i in rest])
        ends = np.cumsum(sizes)
        n, none = len(flat), self.none
        first = np.full(n, none, np.int64)
        first[:-1] = self.first[flat[:-1], flat[1:]]
        first[ends - 1] = none
        order = np.argsort(first, kind="stable")
        ranked = first[order]
        order, ranked = order[ranked < none], ranked[ranked < none]
        heads = np.flatnonzero(np.diff(ranked, prepend=-1))
        index = {int(ranked[h]): o.tolist() for h, o in zip(heads, np.split(order, heads[1:]), strict=True)} if len(heads) else {}
        owner_v, here_v, sym_v = np.repeat(np.arange(len(rest), dtype=np.int32), sizes), first.astype(np.int32), self.byte_id[flat].astype(np.int32)
        after_v, before_v = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after_v[ends - 1] = before_v[np.concatenate(([0], ends[:-1]))] = -1
        owner, here, sym, after, before = map(memoryview, (owner_v, here_v, sym_v, after_v, before_v))  # the same cells, one at a time
        heap = sorted(index)
        pair, push, pop = self.pairs.get, heapq.heappush, heapq.heappop

        def due(new: int, at: list[int]) -> None:
            if new in index:
                index[new] += at
            else:
                index[new] = at
                push(heap, new)

        def one_by_one(spots: list[int], rank: int) -> None:
            key, waits = rank << 20, -1
            for i in spots:
                if here[i] != rank:
                    continue
                if waits >= 0 and owner[i] == waits:
                    due(rank, [i])
                    continue
                j = after[i]
                sym[i] = rank
                sym[j] = -1
                here[j] = none
                after[i] = right = after[j]
                if right >= 0:
                    before[right] = i
                    here[i] = new = pair(key | sym[right], none)
                    if new < none:
                        due(new, [i])
                        if new <= rank:
                            waits = owner[i]
                else:
                    here[i] = none
                left = before[i]
                if left >= 0:
                    here[left] = new = pair(sym[left] << 20 | rank, none)
                    if new < none:
                        due(new, [left])
                        if new <= rank:
                            waits = owner[i]

        def touch(at: np.ndarray, partner: np.ndarray, partners: np.ndarray, ranks: np.ndarray) -> None:
            """New ranks of the pairs at ``at``, whose other half is ``partner``."""
            if not len(partners):
                here_v[at] = none
                return
            spot = np.minimum(np.searchsorted(partners, partner), len(partners) - 1)
            new = np.where(partners[spot] == partner, ranks[spot], none)
            here_v[at] = new
            live = new < none
            if live.any():
                at, new = at[live], new[live]
                order = np.argsort(new, kind="stable")
                at, new = at[order].tolist(), new[order]
                cuts = np.flatnonzero(np.diff(new, prepend=-1)).tolist()
                for x, y, r in zip(cuts, [*cuts[1:], len(at)], new[cuts].tolist(), strict=True):
                    due(r, at[x:y])

        while heap:
            rank = pop(heap)
            spots = index.pop(rank)
            if len(spots) < 24:
                spots.sort()
                one_by_one(spots, rank)
                continue
            at = np.array(spots, np.int32)
            at.sort()
            at = at[(here_v[at] == rank) & (np.diff(at, prepend=-1) > 0)]
            same = np.flatnonzero(np.diff(owner_v[at]) == 0)
            if len(same):  # several places in one piece: in order
                many = np.zeros(len(at), bool)
                many[same] = many[same + 1] = True
                one_by_one(at[many].tolist(), rank)
                at = at[~many]
            j = after_v[at]
            right, left = after_v[j], before_v[at]
            sym_v[at], sym_v[j], here_v[j], here_v[at], after_v[at] = rank, -1, none, none, right
            some = right >= 0
            right, mid = right[some], at[some]
            before_v[right] = mid
            x, y = self.left_at[rank], self.left_at[rank + 1]
            touch(mid, sym_v[right], self.left_with[x:y], self.left_rank[x:y])
            left = left[left >= 0]
            x, y = self.right_at[rank], self.right_at[rank + 1]
            touch(left, sym_v[left], self.right_with[x:y], self.right_rank[x:y])
        done = sym_v.tolist()
        start = 0
        for i, e in zip(rest, ends.tolist(), strict=True):
            out[i] = tuple([s for s in done[start:e] if s >= 0])
            start = e
        return out

    def _codes(self, parts: list[list[str]]) -> list[np.ndarray]:
        """Numbers of the pieces in the table; those that are new to it are replayed together."""
        if len(self.table) > CACHE:
            self.forget()
        number, old = self.table.__getitem__, len(self.table)
        codes = [np.array(list(map(number, p)), np.int32) for p in parts]
        if len(self.table) > old:
            new = list(self.table)[old:] if old else list(self.table)
            gc.disable()  # nothing here is cyclic, and the lists are long
            try:
                merged = self.replay([p.encode() for p in new])
            finally:
                gc.enable()
            names = self.names
            self.id_text += [",".join([names[i] for i in ids]) for ids in merged]
            self.length = np.concatenate([self.length, np.array([len(ids) for ids in merged], np.int64)])
            self.start = np.cumsum(self.length) - self.length
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(merged), np.int32)])
        return codes

    def _ids(self, every: np.ndarray) -> np.ndarray:
        """The ids of numbered pieces, one after the other."""
        sizes = self.length[every]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[every] - ends + sizes, sizes)]

    def encode(self, texts: list[str]) -> tuple[list[int], list[str], np.ndarray]:
        """Of texts: the number of ids and the sha256 of the ids as text with commas; all ids one after the other."""
        if len(texts) == 1 and len(texts[0]) > SLICE:
            return self._encode_long(texts[0])
        codes = self._codes([self.split(t) for t in texts])
        text = self.id_text.__getitem__
        shas = [hashlib.sha256(",".join(map(text, c.tolist())).encode()).hexdigest() for c in codes]
        return [int(self.length[c].sum()) for c in codes], shas, self._ids(np.concatenate(codes))

    def _encode_long(self, text: str) -> tuple[list[int], list[str], np.ndarray]:
        """The same of one text, ``PIECES`` at a time, so that the table stays within its bound and them."""
        sha, ids, pieces = hashlib.sha256(), [], map(itemgetter(0), self.find(text))
        while part := list(islice(pieces, PIECES)):
            (codes,) = self._codes([part])
            sha.update((("," if ids else "") + ",".join(map(self.id_text.__getitem__, codes.tolist()))).encode())
            ids.append(self._ids(codes))
        every = np.concatenate(ids)
        return [len(every)], [sha.hexdigest()], every


KEPT.append(Vocabulary._open)


class Numbering(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def slices(sizes: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters; a longer text is a run of its own."""
    at, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, and_back: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, ids: every whole text as token ids, without special tokens.

    Null texts are empty and have no ids. Repeated rows give repeated rows; other columns are left out. ``and_back``
    decodes the ids in the same pass: decoded_sha256 stands in place of ids, as from ``decode``.
    """
    at = default_vocabulary()
    at = (path or at[0], pattern or at[1])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.of(*at)
        for batch in batches:
            column = batch.column(1)
            for a, z in slices(pc.utf8_length(column).to_numpy()):
                counts, shas, ids = v.encode(column.slice(a, z - a).to_pylist())
                ends = np.cumsum([0, *counts], dtype=np.int32)
                if and_back:
                    last = pa.array([decoded_sha256(v.tokens, ids[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string())
                else:
                    last = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), last], ["doc_id", "n_tokens", "ids_sha256", "last"])

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    out = slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, last " + ("string" if and_back else "array<int>"))
    return out.withColumnRenamed("last", "decoded_sha256" if and_back else "ids")


def decoded_sha256(tokens: list[bytes], ids: np.ndarray) -> str:
    return hashlib.sha256(b"".join(map(tokens.__getitem__, ids.tolist()))).hexdigest()


def decode(df: DataFrame, path: str | None = None, pattern: str | None = None, keep_bytes: bool = False) -> DataFrame:
    """The columns of ``df`` but ``ids``, with decoded_sha256 (of the decoded bytes) and, if asked for, the bytes themselves.

    Null ids decode to nothing; an id outside the vocabulary fails the job.
    """
    at = default_vocabulary()
    at = (path or at[0], pattern or at[1])
    rest = df.drop("ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", decoded_sha256 string" + ", decoded binary" * keep_bytes

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(_ranks(at[0]))  # decoding needs no merges
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("ids"))
            shas, raw = [], []
            for i in range(len(col)):
                one = col[i].values
                data = b"".join([tokens[t] for t in one.to_numpy().tolist()]) if one is not None else b""
                shas.append(hashlib.sha256(data).hexdigest())
                if keep_bytes:
                    raw.append(data)
            own = [i for i, n in enumerate(batch.schema.names) if n != "ids"]
            more = [pa.array(shas, pa.string())] + ([pa.array(raw, pa.binary())] if keep_bytes else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), *more], [*(batch.schema.names[i] for i in own), "decoded_sha256"] + ["decoded"] * keep_bytes)

    return df.mapInArrow(run, schema)
