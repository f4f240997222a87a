"""Near copies by set similarity: an LSH forest of MinHash signatures proposes pairs, whole sets confirm them.

A text is the set of its word shingles. ``TREES`` trees sort all signatures, each by its own order of the signature's values; texts
with a long common prefix stand side by side. A region of a tree is all texts with the same first ``DEPTHS[0]`` values, however many. Two texts
of similarity ``s`` share a region in some tree but for a chance of (1 - s^4)^TREES: 7e-10 at 0.8.

In a region, pairs whose signatures agree in ``AGREE`` values are candidates: a pair of similarity 0.8 or more agrees less with a
chance of 3e-7. The first round takes neighbours by longest common prefix, and each text with the first of its region; for this round
only, a region of more than ``HOT`` texts is cut by more values. What its confirmed links leave in different components is then compared
with all others of its regions, whole ones: a text outside of a region's largest component visits each other component that has a
candidate for it, and is held against all whole sets of that component at once. A region of more than ``HOT`` texts is laid out in
blocks of about ``HOT`` visiting by ``HOT`` staying texts, each in a task of its own. So a class of copies isn't compared in all its
pairs, no partner is left out, and the links are complete for components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlake.llm import simhash
from modlake.llm.common import discard, lean, let_go, only_ids, saved, text_or_empty
from modlake.llm.graph import components
from modlake.llm.shingles import WORDS, fingerprint_of_set, marked, node_of, shingles_of, whole_sets

TREES, DEPTHS = 40, (4, 8, 12, 16)
VALUES = TREES * DEPTHS[0]
#: Values of two signatures that agree at least: five standard deviations below what a similarity of 0.8 makes them.
AGREE = 103
#: Texts of a region above which it is cut for the first round and in blocks for the second; neighbours on each side in the first round; signatures compared at once.
HOT, BESIDE, AT_ONCE = 20_000, 2, 100_000
#: Shingles whose values are computed at once; shingles of a component that one task holds.
SLICE, PART = 2_048, 500_000
_RNG = np.random.default_rng(11)
_XOR, _ODD = (_RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32) for _ in range(2))
_ODD |= np.uint32(1)
#: Each tree's order of the values: its own DEPTHS[0] first, then the others in an order of its own.
ORDERS = np.stack([np.concatenate([own := np.arange(t * DEPTHS[0], (t + 1) * DEPTHS[0]), _RNG.permutation(np.setdiff1d(np.arange(VALUES), own))]) for t in range(TREES)])


def signature_of(x: np.ndarray) -> np.ndarray:
    """The MinHash signature of a set of 64-bit hashes, a byte a value."""
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    half = (x.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(half), SLICE):
        h = half[at : at + SLICE, None] ^ _XOR
        h *= _ODD
        np.minimum(low, h.min(axis=0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _described(docs: DataFrame, words: int, fingerprint: bool) -> DataFrame:
    """doc_id, node (hash of the set), n, fp, sig of each text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            nodes, sizes, fps, sigs = [], [], [], []
            for t in batch.column(1):
                x = shingles_of(t.as_py(), words)
                nodes.append(node_of(x)), sizes.append(len(x)), sigs.append(signature_of(x).tobytes())
                fps.append(fingerprint_of_set(x) if fingerprint else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "node", "n", "fp", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, n long, fp long, sig binary")


def _keys(nodes: DataFrame, depth: int) -> DataFrame:
    """region, tree, node: the hash of each tree's first ``depth`` values. ``nodes``: node, sig, trees (null: all of them)."""
    weights = np.random.default_rng(depth).integers(0, 1 << 63, (TREES, depth, 256), dtype=np.int64).view(np.uint64)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, VALUES)
                rows, trees = np.divmod(np.arange(len(sig) * TREES), TREES)
                if part.column(2).null_count < len(part):
                    own = part.column(2).to_pylist()
                    rows, trees = np.repeat(np.arange(len(sig)), [len(t) for t in own]), np.array([t for o in own for t in o], np.int64)
                key = trees.astype(np.uint64)
                for j in range(depth):
                    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) ^ weights[trees, j, sig[rows, ORDERS[trees, j]]]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(trees.astype(np.int32)), part.column(0).take(pa.array(rows))], ["region", "tree", "node"])

    return nodes.select("node", "sig", "trees").mapInArrow(run, "region long, tree int, node long")


def regions(nodes: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables of region, tree, node: the regions of two to ``hot`` texts; the larger ones; and these cut to about ``hot``, for the first round.

    A cut goes by more values, and what is larger at the last depth is dealt out by a hash.
    """
    now, out, whole, crowded, used = nodes.withColumn("trees", F.lit(None).cast("array<int>")), None, None, None, []
    for depth in DEPTHS:
        keys = saved(_keys(now, depth), "forest-keys")
        used.append(keys)
        counts = keys.groupBy("region").count()
        if depth == DEPTHS[-1]:
            parts = keys.join(counts, "region").withColumn("region", F.when(F.col("count") <= hot, F.col("region")).otherwise(F.xxhash64("region", F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / hot)))))
            part = parts.filter("count > 1").select("region", "tree", "node")
        else:
            part = keys.join(counts.filter(f"count between 2 and {hot}").select("region"), "region").select("region", "tree", "node")
        if whole is None:
            whole, out = saved(part, "regions"), part.limit(0)
        else:
            out = out.unionByName(part)
        large = saved(counts.filter(F.col("count") > hot).select("region"), "large-regions")
        used.append(large)
        if crowded is None:
            crowded = saved(keys.join(large, "region", "left_semi").select("region", "tree", "node"), "crowded")
        if depth == DEPTHS[-1] or not large.head(1):
            break
        deeper = keys.join(large, "region", "left_semi").groupBy("node").agg(F.collect_list("tree").alias("trees"))  # at most TREES
        now = nodes.join(deeper, "node")
    cut = saved(out, "cut-regions")
    discard(*used)
    return whole, crowded, cut


def _estimated(sig: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Values in which signatures i and j agree; -1 where the sizes don't allow the similarity."""
    out = np.full(len(i), -1, np.int64)
    fits = np.flatnonzero(np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
    for at in range(0, len(fits), AT_ONCE):
        k = fits[at : at + AT_ONCE]
        out[k] = (sig[i[k]] == sig[j[k]]).sum(1)
    return out


def neighbours(sig: np.ndarray, n: np.ndarray, tree: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of a region: texts beside each other in the tree's order, and each with the first."""
    order = np.argsort(np.ascontiguousarray(sig[:, ORDERS[tree]]).view(f"S{VALUES}").ravel(), kind="stable") if len(sig) > 2 else np.arange(len(sig))
    pairs = [(order[:-k], order[k:]) for k in range(1, min(BESIDE, len(sig) - 1) + 1)] + [(np.full(len(sig) - 1, order[0]), order[1:])]
    i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
    ok = _estimated(sig, n, i, j, similarity) >= AGREE
    return i[ok], j[ok]


def apart(sig: np.ndarray, n: np.ndarray, root: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, root of another component) of a region: each text outside of the largest component, with each other one that has a candidate for it."""
    kinds, own, count = np.unique(root, return_inverse=True, return_counts=True)
    main = np.argmax(count)
    some_i, some_r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    outside = np.flatnonzero(own != main)
    step = max(AT_ONCE // len(sig), 1)
    for at in range(0, len(outside), step):
        i = np.repeat(outside[at : at + step], len(sig))
        j = np.tile(np.arange(len(sig)), len(outside[at : at + step]))
        ok = (own[i] != own[j]) & ((own[j] == main) | (i < j))
        i, j = i[ok], j[ok]
        ok = _estimated(sig, n, i, j, similarity) >= AGREE
        pairs = np.unique(i[ok] * len(kinds) + own[j[ok]])
        some_i.append(pairs // len(kinds)), some_r.append(kinds[pairs % len(kinds)])
    return np.concatenate(some_i), np.concatenate(some_r)


def across(sig: np.ndarray, n: np.ndarray, node: np.ndarray, root: np.ndarray, main: int, comes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(node, root of another component) of a block: each text that comes with each component of which a staying text is a candidate for it.

    As ``apart`` does for a whole region: of two texts outside of the largest component ``main``, the one of the smaller node comes to the other.
    """
    stay = np.flatnonzero(~comes)
    stay = stay[np.argsort(n[stay], kind="stable")]
    sizes, sigs = n[stay], sig[stay]
    some_a, some_r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(comes):
        low, high = np.searchsorted(sizes, similarity * n[i] - 1e-9), np.searchsorted(sizes, n[i] / similarity + 1e-9, "right")
        j = stay[low + np.flatnonzero((sigs[low:high] == sig[i]).sum(1, dtype=np.uint8) >= AGREE)]
        found = np.unique(root[j[(root[j] != root[i]) & ((root[j] == main) | (node[i] < node[j]))]])
        some_a.append(np.full(len(found), node[i])), some_r.append(found)
    return np.concatenate(some_a), np.concatenate(some_r)


def blocks(crowded: DataFrame, hot: int) -> DataFrame:
    """region (a block's), tree, node, root, main, comes: the blocks of crowded regions (region, tree, node, root) of more than one component.

    ``main`` is a region's largest component. Each block has one part of the texts outside of it, which come, and one part of all texts, which stay.
    """
    sizes = crowded.groupBy("region", "root").count().groupBy("region").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("most"))
    sizes = sizes.filter("n > most").select("region", "main", F.ceil(F.col("n") / hot).cast("int").alias("stays"), F.ceil((F.col("n") - F.col("most")) / hot).cast("int").alias("comers"))
    x = crowded.join(sizes, "region")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    stay = x.withColumns({"p": part("stays"), "comes": F.lit(False)}).withColumn("q", all_of("comers"))
    come = x.filter("root <> main").withColumns({"q": part("comers"), "comes": F.lit(True)}).withColumn("p", all_of("stays"))
    return stay.unionByName(come).select(F.xxhash64("region", "p", "q").alias("region"), "tree", "node", "root", "main", "comes")


def _candidates(rows: DataFrame, first: bool, similarity: float) -> DataFrame:
    """a, b of each region of ``rows`` (region, tree, node, n, sig, root; main and comes for ``blocks``): ``neighbours``, or texts and the roots that are apart from them."""
    own = ["region", "tree", "node", "n", "sig", "root", *(c for c in ("main", "comes") if c in rows.columns)]

    def pairs(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        node, n, root = (t[c].to_numpy() for c in ("node", "n", "root"))
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, VALUES)
        if first:
            i, j = neighbours(sig, n, t["tree"][0].as_py(), similarity)
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        elif "comes" in own:
            a, b = across(sig, n, node, root, t["main"][0].as_py(), t["comes"].to_numpy(), similarity)
        else:
            i, b = apart(sig, n, root, similarity)
            a = node[i]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        kept = []
        for batch in batches:
            if not batch.num_rows:
                continue
            region = batch.column(0).to_numpy()
            cuts = [*np.flatnonzero(np.diff(region, prepend=region[0] - 1)), batch.num_rows]
            if kept and kept[-1].column(0)[0].as_py() != region[0]:
                yield pairs(pa.Table.from_batches(kept))
                kept = []
            for a, z in zip(cuts, cuts[1:], strict=False):
                kept.append(batch.slice(a, z - a))
                if z < batch.num_rows:
                    yield pairs(pa.Table.from_batches(kept))
                    kept = []
        if kept:
            yield pairs(pa.Table.from_batches(kept))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*own).repartition(parts, "region").sortWithinPartitions("region")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b, similar: each pair by its whole sets."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b").join(sets.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a")
    both = both.select("a", "b", (F.size("xa") + F.size("xb")).alias("n"), F.size(F.array_intersect("xa", "xb")).alias("same"))
    hundredths = round(100 * similarity)
    return both.select("a", "b", (100 * F.col("same") >= hundredths * (F.col("n") - F.col("same"))).alias("similar"))


def _met(visits: DataFrame, rooted: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: the texts of component ``b``'s root (rooted: node, root) that are similar to text ``a``, for each of the visits (a, b).

    A component's whole sets go to a task once, in parts of about ``PART`` shingles, as an index from shingle to texts; the
    visiting texts stream past it. So a class of copies costs rows for its texts, not for pairs of them.
    """
    parts = rooted.join(visits.select(F.col("b").alias("root")).distinct(), "root", "left_semi").join(sets, "node").select("root", "node", "x")
    sizes = parts.groupBy("root").agg(F.ceil(F.sum(F.size("x")) / PART).cast("int").alias("parts"))
    stay = parts.join(sizes, "root").select("root", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "node", "x")
    come = visits.join(sizes, visits["b"] == sizes["root"]).select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), F.col("a").alias("node"))
    come = come.join(sets, "node").select("root", "part", "kind", "node", "x")
    hundredths = round(100 * similarity)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        now, nodes, lists, index = None, [], [], None
        for batch in batches:
            root, part, kind, node = (batch.column(i).to_numpy() for i in range(4))
            ends, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            a, b = [], []
            for r in range(batch.num_rows):
                x = flat[ends[r] : ends[r + 1]]
                if (root[r], part[r]) != now:
                    now, nodes, lists, index = (root[r], part[r]), [], [], None
                if kind[r] == 0:
                    nodes.append(node[r]), lists.append(x.copy())
                    continue
                if not nodes:
                    continue
                if index is None:
                    size = np.array([len(z) for z in lists])
                    values = np.concatenate(lists)
                    order = np.argsort(values, kind="stable")
                    index = (values[order], np.repeat(np.arange(len(lists)), size)[order], size, np.array(nodes))
                values, owner, size, names = index
                low, high = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
                many = high - low
                at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                same = np.bincount(owner[at], minlength=len(size))
                hit = np.flatnonzero(100 * same >= hundredths * (size + len(x) - same))
                a += [node[r]] * len(hit)
                b += names[hit].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stay.unionByName(come).repartition(n, "root", "part").sortWithinPartitions("root", "part", "kind").mapInArrow(run, "a long, b long")


def _links(nodes: DataFrame, docs: DataFrame, words: int, similarity: float, first: DataFrame | None, hot: int) -> DataFrame:
    """node, root: components of the similar nodes."""
    whole, crowded, cut = regions(nodes.select("node", "sig"), hot)
    where = whole.unionByName(cut)
    twins = nodes.groupBy("sig").agg(F.min("node").alias("a"), F.count("*").alias("c")).filter("c > 1").join(nodes.select("sig", "node"), "sig").select("a", F.col("node").alias("b"))
    begin = twins if first is None else twins.unionByName(first)
    begin = saved(begin.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first-pairs")
    taking_part = whole.select("node").unionByName(crowded.select("node")).unionByName(begin.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    of = saved(nodes.join(taking_part, "node", "left_semi").select("node", "low"), "forest-nodes")
    sets = saved(whole_sets(docs, words, marked(of, "node"), marked(of, "low"), bool(of.filter("low is null").head(1))).join(of.select("node"), "node", "left_semi").dropDuplicates(["node"]), "forest-sets")

    described = where.join(nodes.select("node", "n", "sig"), "node")
    pairs = begin.unionByName(_candidates(described.withColumn("root", F.col("node")), True, similarity)).distinct()
    near = saved(_confirmed(pairs, sets, similarity).filter("similar").select("a", "b"), "confirmed")
    roots = components(near)

    with_root = lambda rows: rows.join(roots, "node", "left").select("region", "tree", "node", F.coalesce("root", "node").alias("root"))
    rooted = saved(with_root(whole), "rooted")
    split = rooted.groupBy("region").agg((F.min("root") != F.max("root")).alias("split")).filter("split").select("region")
    some = rooted.join(split, "region", "left_semi").join(nodes.select("node", "n", "sig"), "node")
    visits, members = _candidates(some, False, similarity), rooted.select("node", "root")
    large = []
    if crowded.head(1):
        large = [saved(with_root(crowded), "rooted-crowded")]
        laid = blocks(large[0], hot).join(nodes.select("node", "n", "sig"), "node")
        visits, members = visits.unionByName(_candidates(laid, False, similarity)).distinct(), members.unionByName(large[0].select("node", "root"))
    visits = saved(visits, "visits")
    more = saved(_met(visits, members.distinct(), sets, similarity), "met")
    done = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))
    discard(whole, crowded, cut, begin, of, sets, near, rooted, *large, visits, more)
    return done


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, similarity: float = 0.8, fingerprints: bool = False, empty_alike: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that a row reaches by similar pairs), kept (whether it is the row's own).

    Sets are of distinct shingles of ``words`` words; a shorter text is one shingle. Null, empty and wordless texts have an empty set,
    which is linked with nothing, or with ``empty_alike`` with one another. ``similarity`` is in whole hundredths and 0.8 or more. Rows without an id take part; they get the
    smallest id of their group, or null where there is none (and are kept then only). Repeated rows give repeated rows; equal sets are alike. An
    empty table gives no rows, and other columns are left out. With ``fingerprints``, SimHash neighbours are the first candidates.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("similarity is from 0.8 to 1: signatures and trees are made for it")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sets = saved(_described(docs, words, fingerprints), "signatures")
    nodes = saved(sets.filter(F.lit(empty_alike) | (F.col("n") > 0)).groupBy("node").agg(F.min("doc_id").alias("low"), *[F.any_value(c).alias(c) for c in ("n", "fp", "sig")]), "distinct")
    first = simhash_pairs(nodes) if fingerprints else None
    rooted = nodes.join(_links(nodes, docs, words, similarity, first, hot), "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = sets.select("doc_id", "node", F.col("n").alias("n_shingles")).join(rooted.join(smallest, "root").select("node", "component_id"), "node", "left")
    component = F.when(F.col("n_shingles").isNotNull() if empty_alike else F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: texts of one fingerprint, and the first texts of fingerprints within ``simhash.RADIUS`` bits, by BK-trees."""
    by_fp = saved(nodes.groupBy("fp").agg(F.min("node").alias("first")), "distinct-fingerprints")
    same = nodes.join(by_fp, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = simhash.near_links(by_fp.select("fp"))
    near = links.join(by_fp.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = 0.8) -> DataFrame:
    """``df`` without the documents whose group has one with a smaller id. Rows that repeat the id kept stay with it.

    Candidates are SimHash neighbours first, then those of the forest. Null, empty and wordless texts are one group; a group without any id
    keeps its rows. Columns of any name stay as they are.
    """
    groups = near_copies(df, id_col, text_col, words, similarity, fingerprints=True, empty_alike=True)
    return only_ids(df, groups.filter("kept").select("doc_id"), id_col)
