"""Spelling variants: words within one edit, found in a frequency-vector trie.

A word is the vector of its counts of letter groups, the most frequent letters in groups of their own. The trie branches on these
counts one after the other. Two words that differ by one inserted, deleted or replaced letter have vectors that differ by at
most one more in one group and one less in another: a search follows a child with the same count, and spends a
surplus of one and a deficit of one on others. The words of a leaf are compared letter by letter.

The length and the first ``TOP`` counts, hence the top of the trie, are the shuffle key. A word stands in its own subtree and
is looked up in every subtree that the budget allows; of the two words of a pair only one looks for the other. A
task builds the trie of a subtree from its sorted rows and streams the words that are looked up past it; a subtree of more than ``HOT``
words is dealt out over several tries, and what is looked up goes to each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlake.llm.common import discard, saved, text_or_empty

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One in so many occurrences loses a letter; a form is so many times as frequent.
TYPO, RATIO = 31, 10
#: Groups of letters, those that are in the shuffle key, and the count from which all counts are one child.
GROUPS, TOP, MOST = 16, 3, 15
#: Words of one trie; words looked up at once; the longest word that is compared as a row of a matrix.
HOT, LOOKED_UP, WIDE = 50_000, 2_000, 40
_SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def occurrences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, one row for each run of letters of ``LEAST_LENGTH`` or more once the letter that its hash names is gone."""
    text = F.translate(text_or_empty(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"({LETTERS}{{{LEAST_LENGTH},}})"))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    typed = F.when(F.col("h") % TYPO == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(typed.alias("word")).filter(F.length("word") >= LEAST_LENGTH)


def words_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the distinct words of ``LEAST_COUNT`` occurrences or more."""
    return occurrences(df, id_col, text_col).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def letter_groups(counts: dict[int, int]) -> np.ndarray:
    """Group by code point up to 255: the most frequent letters have their own, the others are dealt out, most frequent first."""
    group = np.zeros(256, np.int64)
    alone = GROUPS // 2
    for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c))):
        group[c] = i if i < alone else alone + (i - alone) % (GROUPS - alone)
    return group


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words one after the other, where each begins and the last ends)."""
    text = words.to_pylist()
    flat = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
    return flat, np.cumsum([0, *map(len, text)])


def vectors(words: pa.Array, group: np.ndarray) -> np.ndarray:
    """Counts of the letter groups of each word, at most ``MOST``: capping never widens a difference."""
    flat, ends = _points(words)
    row = np.repeat(np.arange(len(words)), np.diff(ends))
    out = np.bincount(row * GROUPS + group[flat], minlength=len(words) * GROUPS)
    return np.minimum(out, MOST).reshape(len(words), GROUPS).astype(np.int8)


def subtree(length: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """The shuffle key of a length and the first counts."""
    key = length.astype(np.int64)
    for i in range(TOP):
        key = key * (MOST + 1) + tops[:, i]
    return key


def reachable(length: np.ndarray, tops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) of the subtrees in which these words look: those of words one longer, and of equally long ones from their own on."""
    rows = np.arange(len(length))
    yield rows, subtree(length, tops)

    def moved(up: int | None, down: int | None) -> tuple[np.ndarray, np.ndarray]:
        x = tops.astype(np.int64)
        ok = np.ones(len(x), bool)
        for i, step in ((up, 1), (down, -1)):
            if i is not None:
                ok &= (x[:, i] + step >= 0) & (x[:, i] + step <= MOST)
                x[:, i] += step
        return ok, x

    # a count at its cap may stay although a letter is added or taken: such a move is one of the rest
    for up in (None, *range(TOP)):
        ok, x = moved(up, None)
        yield rows[ok], subtree(length[ok] + 1, x[ok])
    for up, down in [(None, i) for i in range(TOP)] + [(i, None) for i in range(TOP)] + [p for a, b in combinations(range(TOP), 2) for p in ((a, b), (b, a))]:
        ok, x = moved(up, down)
        to = subtree(length, x)
        ok &= to > subtree(length, tops)
        yield rows[ok], to[ok]


class Trie:
    """The counts of distinct words as a trie; each leaf is a run of rows in ``order``."""

    def __init__(self, counts: np.ndarray):
        self.order = np.lexsort(counts.T[::-1])
        x = counts[self.order]
        parent = np.zeros(len(x), np.int64)
        self.levels = []
        for g in range(GROUPS):
            new = np.ones(len(x), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (x[1:, g] != x[:-1, g])
            node = np.cumsum(new) - 1
            child = np.full((int(parent[-1]) + 1, MOST + 3), -1, np.int32)  # one empty place on either side
            child[parent[new], x[new, g] + 1] = node[new]
            self.levels.append(child)
            parent = node
        begin = np.flatnonzero(np.diff(parent, prepend=-1))
        self.begin, self.size = begin, np.diff([*begin, len(x)])

    def near(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the words in all leaves within a surplus of one and a deficit of one."""
        who = np.arange(len(counts))
        node = np.zeros(len(counts), np.int64)
        spent = np.zeros(len(counts), np.int8)  # 1: surplus, 2: deficit
        for g, child in enumerate(self.levels):
            at = counts[who, g].astype(np.int64) + 1
            parts = []
            for step, cost in ((0, 0), (1, 1), (-1, 2)):
                ok = (spent & cost) == 0
                nxt = np.where(ok, child[node, at + step], -1)
                ok = nxt >= 0
                parts.append((who[ok], nxt[ok].astype(np.int64), spent[ok] | cost))
            who, node, spent = (np.concatenate(p) for p in zip(*parts, strict=True))
        size = self.size[node]
        row = np.repeat(self.begin[node] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.repeat(who, size), self.order[row]


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes one word of the other."""
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :])


class Words:
    """Words as rows of code points, as far as they aren't longer than ``WIDE``."""

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.array([len(w) for w in words], np.int64)
        self.letters = np.array([w if len(w) <= WIDE else "" for w in words], dtype=f"<U{WIDE + 1}").view(np.uint32).reshape(len(words), WIDE + 1).astype(np.uint8)

    def one_edit(self, i: np.ndarray, other: Words, j: np.ndarray) -> np.ndarray:
        """Whether words i are one edit away from the other's words j; words i are not the longer ones."""
        a, b, n = self.letters[i], other.letters[j], self.length[i]
        longer = other.length[j] - n
        here, ahead = a != b, np.zeros_like(a, bool)
        ahead[:, :-1] = a[:, :-1] != b[:, 1:]
        ahead &= np.arange(WIDE + 1) < n[:, None]
        first = np.argmax(here, axis=1)
        last = np.where(ahead.any(1), WIDE - np.argmax(ahead[:, ::-1], axis=1), -1)
        out = np.where(longer == 0, here.sum(1) == 1, (longer == 1) & (last < first))
        for k in np.flatnonzero(np.maximum(n, other.length[j]) > WIDE):
            out[k] = one_edit(self.words[i[k]], other.words[j[k]])
        return out


def _dealt(words: DataFrame, group: np.ndarray) -> DataFrame:
    """key, kind (0: stands there, 1: is looked up there), word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = batch.slice(at, 4096)
                length = np.array([len(w) for w in x.column(0).to_pylist()], np.int64)
                tops = vectors(x.column(0), group)[:, :TOP]
                for kind, (rows, keys) in [(0, (np.arange(len(length)), subtree(length, tops)))] + [(1, r) for r in reachable(length, tops)]:
                    if len(rows):
                        some = x.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(rows), kind, np.int32)), *some.columns], ["key", "kind", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, kind int, word string, n long")


def _trees(group: np.ndarray):
    """Sorted rows (key, part, kind, word, n) -> word, near, n of near, in both directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, counts, trie, words = None, [], [], None, None
        for batch in batches:
            key, part, kind = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0))
            for a, z in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if (key[a], part[a]) != now:
                    now, kept, counts, trie = (key[a], part[a]), [], [], None
                for at in range(a, z, LOOKED_UP):
                    x = batch.slice(at, min(LOOKED_UP, z - at))
                    v = vectors(x.column(3), group)
                    if kind[a] == 0:
                        kept.append(x.select(["word", "n"])), counts.append(v)
                        continue
                    if not kept:
                        continue
                    if trie is None:
                        table = pa.Table.from_batches(kept).combine_chunks()
                        trie, words, ns = Trie(np.concatenate(counts)), Words(table["word"].to_pylist()), table["n"].to_numpy()
                        own_key = int(key[a])
                    asked = Words(x.column(3).to_pylist())
                    own = subtree(asked.length, v[:, :TOP]) == own_key
                    i, j = trie.near(v)
                    ok = asked.length[i] <= words.length[j]
                    i, j = i[ok], j[ok]
                    ok = asked.one_edit(i, words, j)
                    i, j = i[ok], j[ok]
                    # two words of one subtree and length look for each other: the smaller counts
                    ok = np.array([not s or asked.words[p] < words.words[q] for s, p, q in zip(own[i], i, j, strict=True)], bool)
                    i, j = i[ok], j[ok]
                    one, two = [asked.words[p] for p in i], [words.words[q] for q in j]
                    n1, n2 = x.column(4).to_numpy()[i], ns[j]
                    yield pa.RecordBatch.from_arrays([pa.array(one + two, pa.string()), pa.array(two + one, pa.string()), pa.array(np.concatenate([n2, n1]))], ["word", "near", "m"])

    return run


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """word, near, m (the near word's n): every two words (columns word, n) that are one edit apart, in both directions. Words are distinct."""

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.bincount(_points(batch.column(0))[0], minlength=256)
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(c[at])], ["letter", "c"])

    found = words.select("word").mapInArrow(letters, "letter int, c long").groupBy("letter").agg(F.sum("c")).collect()  # at most an alphabet
    group = letter_groups(dict(map(tuple, found)))
    dealt = _dealt(words, group)
    crowded = dealt.filter("kind = 0").groupBy("key").count().filter(F.col("count") > hot).select("key", F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    own = F.when(F.col("kind") == 0, F.array(F.pmod(F.xxhash64("word"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1))
    dealt = dealt.join(crowded, "key", "left").select("key", F.explode(own).alias("part"), "kind", "word", "n")
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key", "part").sortWithinPartitions("key", "part", "kind").mapInArrow(_trees(group), "word string, near string, m long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (columns word, form) lead in the end. A path at least multiplies n by ``RATIO`` at each step, so it is short."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = saved(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = then
        if not now.filter("moved").head(1):
            return now.select("word", "root")


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences or more.

    A null text has no words; a null id hashes as an empty one. Repeated rows count as often as they stand there, and equal
    counts go by the smaller word in code-point order. A text may be of any length, a word too. An empty table gives no rows, and other
    columns are left out.
    """
    words = saved(words_of(df, id_col, text_col), "words")
    pairs = near_words(words, hot)
    near = saved(pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("top")), "near-words")
    joined = words.join(near, "word", "left")
    form = F.when(-F.col("top.m") >= RATIO * F.col("n"), F.col("top.near"))
    about = saved(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("top.m")).alias("form_n")), "forms")
    out = about.join(roots(about.filter("form is not null").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
