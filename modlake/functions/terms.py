"""Many terms in one pass over a text: exact containment by an automaton, near containment by an index of halves of units.

The index is built once a task from a list whose size is checked; texts go by as Arrow batches. Work for a text does not
grow with the number of terms but for what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Terms that a task builds an index of, at most; a larger list is an error.
MOST_TERMS = 200_000
_FUZZY = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("distance", T.IntegerType()), T.StructField("span", T.StringType())]))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Hangul syllables and how many vowels and finals they are made of: fixed values of Unicode.
FIRST, SYLLABLES, VOWELS, FINALS = 0xAC00, 11172, 21, 28
#: What scalars Unicode calls white space below 256 and above: fixed values of the expression \\s in Java.
_SPACES = " \t\n\x0b\f\r"


def _checked(terms: list[str]) -> list[str]:
    if len(terms) > MOST_TERMS:
        raise ValueError(f"{len(terms)} terms are over {MOST_TERMS}: cut the list, and union the results")
    return terms


def containing(df: DataFrame, text: str, terms: list[str], name: str = "terms") -> DataFrame:
    """``df`` with the terms that each text holds, in the order of the list: ``joins.containment`` for any number of terms.

    Case is ignored. The result of a null text is empty; an empty term is in every text, and repeated terms are found as often as listed.
    """
    low = [t.lower() for t in _checked(terms)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, places, always = ahocorasick.Automaton(), {}, [i for i, t in enumerate(low) if not t]
        for i, t in enumerate(low):
            if t:
                places.setdefault(t, []).append(i)
        for t, at in places.items():
            automaton.add_word(t, at)
        automaton.make_automaton()
        for batch in batches:
            texts = pc.utf8_lower(pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")).to_pylist()
            found = [sorted({i for _, at in (automaton.iter(t) if places else ()) for i in at}.union(always)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[low[i] for i in f] for f in found], pa.list_(pa.string()))], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.StringType()))]))


def units_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units of characters one after the other, where each character's units begin and the last ones end): a Hangul syllable has three."""
    code = points.astype(np.int64) - FIRST
    hangul = (code >= 0) & (code < SYLLABLES)
    begin = np.concatenate([[0], np.cumsum(np.where(hangul, 3, 1))])
    out = np.empty(begin[-1], np.int64)
    at, c = begin[:-1], code[hangul]
    out[at[~hangul]] = points[~hangul]
    out[at[hangul]] = 0x110000 + c // (VOWELS * FINALS)
    out[at[hangul] + 1] = 0x120000 + c // FINALS % VOWELS
    out[at[hangul] + 2] = 0x130000 + c % FINALS
    return out, begin


def _sums(units: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes: those of slices come from differences."""
    mixed = (units.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(units), _PRIME)]), dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power[:-1], dtype=np.uint64)])


_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))


def _slices(sums: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the slices of one size from each place."""
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(sums), _INVERSE)]), dtype=np.uint64)
    return (sums[begin + size] - sums[begin]) * down[begin]


def within_one(a: np.ndarray, b: np.ndarray) -> int:
    """0 or 1 edits between two rows of units, 2 for more."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return 2
    n = len(a)
    differ = np.flatnonzero(a != b[:n])
    at = int(differ[0]) if len(differ) else n
    if len(a) == len(b):
        return min(len(differ), 2)
    return 1 if np.array_equal(a[at:], b[at + 1 :]) else 2


class Halves:
    """Terms by the hashes of the first and the last half of their units: an edit leaves one of the two whole."""

    def __init__(self, terms: list[str]):
        self.terms = [t for t in dict.fromkeys(terms) if len(t) >= 3]
        self.units = [units_of(np.frombuffer(t.encode("utf-32-le"), np.uint32))[0] for t in self.terms]
        self.index: dict[tuple[int, bool], dict[int, list[int]]] = {}
        for k, u in enumerate(self.units):
            half = len(u) // 2
            sums = _sums(u)
            for size, last in ((half, False), (len(u) - half, True)):
                at = np.array([len(u) - size if last else 0])
                self.index.setdefault((size, last), {}).setdefault(int(_slices(sums, at, size)[0]), []).append(k)
        self.sorted = {k: np.array(sorted(v), np.uint64) for k, v in self.index.items()}

    def near(self, text: str) -> list[tuple[str, int, str]]:
        """(term, distance, span) of the terms that the text nearly holds, in the order of the list."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        units, begin = units_of(points)
        sums = _sums(units)
        best: dict[int, tuple[int, int, int]] = {}
        for (size, last), hashes in self.sorted.items():
            ends = begin[1:] if last else begin[:-1]
            at = ends - size if last else ends
            rows = np.flatnonzero((at >= 0) & (at + size <= len(units)))
            got = _slices(sums, at[rows], size)
            hit = hashes[np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)] == got
            for row, h in zip(rows[hit].tolist(), got[hit].tolist(), strict=True):
                for k in self.index[size, last][h]:
                    width = len(self.terms[k])
                    for n in (width - 1, width, width + 1):
                        i = row + 1 - n if last else row
                        if i < 0 or i + n > len(points) or (k in best and (best[k][1:] == (n, i) or best[k] <= (0, n, i))):
                            continue
                        span = units[begin[i] : begin[i + n]]
                        if span[0] == self.units[k][0] and (d := within_one(span, self.units[k])) < 2:
                            best[k] = min(best.get(k, (9, 0, 0)), (d, n, i))
        return [(self.terms[k], best[k][0], text[best[k][2] : best[k][2] + best[k][1]]) for k in sorted(best) if self.terms[k] not in text]


def fuzzy_containing(df: DataFrame, text: str, terms: list[str], name: str = "fuzzy") -> DataFrame:
    """``df`` with (term, distance, span) of the terms within one edit of a span of each text: ``text.fuzzy_terms`` for any number of terms.

    Edits are of units, three a Hangul syllable. Spaces don't count, spans are one character shorter to one longer than the term and begin with its first unit,
    and a term that the text holds is left out. The best distance counts, then the shorter span, then the first. Terms of fewer than
    three characters, and repeated ones, don't. A null text has none.
    """
    halves = _checked(terms)
    gone = str.maketrans("", "", _SPACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Halves(halves)
        kind = pa.list_(pa.struct([("term", pa.string()), ("distance", pa.int32()), ("span", pa.string())]))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [[dict(zip(("term", "distance", "span"), x, strict=True)) for x in index.near((t or "").translate(gone))] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, _FUZZY)]))
