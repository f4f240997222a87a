"""Quality classifier: Bradley-Terry ranking of documents.

Documents win or lose against each other: each pair joins a document of label 1 and one of label 0, and the scores'
difference is the log-odds that the first wins. Scores are linear in a document's features, so that the logistic loss
goes over feature differences and needs no intercept. Every labelled document is in pairs: both labels are ranked by a
hash, and the ranks are joined in ``PAIRS_EACH`` shifts. Pairs stay in Spark; a Newton step is one pass of sums over them. The
threshold is a quantile of all labelled documents' scores: the share of label 0 among them. The result's score is
the logistic of the distance to it, shifted so that the threshold is at ``CUT``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlake.core import global_rank
from modlake.llm.common import discard, lean, let_go, only_ids, saved, text_or_empty

CUT = 0.3
#: Preference pairs for each labelled row of the more frequent label; Newton's steps at most, the ridge, the change that ends the steps.
PAIRS_EACH, STEPS, RIDGE, SETTLED = 8, 50, 1e-3, 1e-8
FEATURES = ("symbols", "upper", "exclaim", "digits", "repeats", "distinct", "stutter", "word_length", "marks", "dup_lines", "length")


def features_of(text: str) -> list[float]:
    """Shares and rates of one whole text; none depends on language."""
    words = text.split()
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n, chars = max(len(words), 1), max(int(raw.sum()), 1)
    of = lambda s: float(raw[list(s.encode())].sum())
    upper, lower = float(raw[65:91].sum()), float(raw[97:123].sum())
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    distinct = len(set(words))
    return [
        min(of("#*$%&|<>") / n, 1.0), upper / max(upper + lower, 1.0), min(of("!") / n, 1.0), float(raw[48:58].sum()) / chars,
        max(0.0, 1.0 - distinct / min(n, 12 * math.sqrt(n))), distinct / n, sum(map(str.__eq__, words, words[1:])) / n,
        min(chars / n, 20.0) / 20, min(of("()[]{}_=;:/\\@^~") / n, 1.0), 1.0 - len(set(lines)) / max(len(lines), 1), math.log1p(n) / 10,
    ]


def with_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with the features of the whole text as array f."""
    rest = df.drop(text_col)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema) + "f array<double>"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            flat = np.array([features_of(t or "") for t in batch.column(at).to_pylist()], np.float64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES)), pa.array(flat))
            own = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), lists], [*(batch.schema.names[i] for i in own), "f"])

    return df.mapInArrow(run, schema)


def sums_of(diff: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The gradient and the Hessian of the logistic loss of some pairs' differences at ``w``, summed up and flat."""
    p = 1 / (1 + np.exp(-np.clip(diff @ w, -40, 40)))
    return np.concatenate([diff.T @ (p - 1), ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray], n: int, size: int, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights of the least mean logistic loss with a ridge; ``sums`` gives ``sums_of`` all ``n`` pairs at some weights."""
    w = np.zeros(size)
    for _ in range(steps):
        got = sums(w) / n
        step = np.linalg.solve(got[size:].reshape(size, size) + ridge * np.eye(size), got[:size] + ridge * w)
        w = w - step
        if np.abs(step).max() < SETTLED:
            break
    return w


def fit_bradley_terry(good: np.ndarray, bad: np.ndarray, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and scales of a linear score such that logistic(score(a) - score(b)) is the chance that a beats b, from arrays."""
    scale = np.concatenate([good, bad]).std(0) + 1e-9
    rng = np.random.default_rng(seed)
    n = PAIRS_EACH * max(len(good), len(bad))
    diff = (good[rng.integers(0, len(good), n)] - bad[rng.integers(0, len(bad), n)]) / scale
    return newton(lambda w: sums_of(diff, w), n, diff.shape[1]), scale


def preference_pairs(labelled: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """d: the differences of features of pairs, label 1 less label 0. Each row of the more frequent label is in ``PAIRS_EACH`` pairs, each of the rarer one in as many as make up for it."""
    ranked = {y: global_rank(labelled.filter(F.col("y") == y).select("id", "f"), F.xxhash64("id", F.lit(y)), "id", "f", name="r") for y in (0, 1)}
    rare = 0 if sizes[0] <= sizes[1] else 1
    shift = F.explode(F.sequence(F.lit(0), F.lit(PAIRS_EACH - 1)))
    many = ranked[1 - rare].select(F.col("f").alias("g"), "r", shift.alias("k"))
    # shifts are spread over the rarer label, so that a row doesn't meet neighbours only
    many = many.select("g", F.pmod(F.col("r") + F.floor(F.col("k") * sizes[rare] / PAIRS_EACH), F.lit(sizes[rare])).alias("at"))
    both = many.join(ranked[rare].select("f", (F.col("r") - 1).alias("at")), "at")
    good, bad = ("f", "g") if rare == 1 else ("g", "f")
    return both.select(F.zip_with(good, bad, lambda a, b: a - b).alias("d"))


def fit(labelled: DataFrame) -> dict:
    """A model from all rows (id, f, y): weights by feature, and the threshold. Without both labels every score is the same."""
    size = len(FEATURES)
    known = labelled.filter("y in (0, 1)")
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return {"w": [0.0] * size, "at": 0.0}
    scale = np.array(known.agg(*[F.stddev_pop(F.col("f")[i]) for i in range(size)]).first(), float) + 1e-9
    pairs = saved(preference_pairs(known, sizes), "preference-pairs")

    def sums(w: np.ndarray) -> np.ndarray:
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + size * size)
            for batch in batches:
                total += sums_of(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) / scale, w)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

        return np.sum([r.s for r in pairs.mapInArrow(run, "s array<double>").collect()], axis=0)  # a row for each task

    w = newton(sums, PAIRS_EACH * max(sizes.values()), size) / scale
    discard(pairs)
    # the quantile of all labelled scores at the share of label 0
    scores = global_rank(known.select("id", _dot(w).alias("s")), "s", "id", name="r")
    below = min(sizes[0], sum(sizes.values()) - 1)
    return {"w": w.tolist(), "at": scores.filter(F.col("r").isin(below, below + 1)).agg(F.avg("s")).first()[0]}


def _dot(w: Iterable[float]) -> Column:
    return sum((F.col("f")[i] * F.lit(float(x)) for i, x in enumerate(w)), F.lit(0.0))


def score_of(model: dict):
    """Score of a features column f, in 0 to 1."""
    z = _dot(model["w"]) - F.lit(model["at"]) + F.lit(math.log(CUT / (1 - CUT)))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for each row; learned from the labels of rows that aren't held out.

    An id is held out if the crc32 of its decimal text is a multiple of 5 (a null id isn't, and has no label). Null
    texts count as empty and get a score like any other. An id with several labels or rows counts as often.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    feats = saved(with_features(docs).withColumn("held_out", held), "features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("y is not null")
    learn = saved(feats.filter("not held_out").join(known, "doc_id").select(F.col("doc_id").alias("id"), "f", "y"), "labelled")
    score = score_of(fit(learn))
    return feats.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def accepted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the classifier predicts to be good. Where rows repeat an id (null is one), one rejected text rejects them all."""
    return only_ids(df, classify(df, labels, id_col, text_col).filter("predicted = 0").select("doc_id"), id_col, "left_anti")
