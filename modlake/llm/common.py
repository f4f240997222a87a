"""Helpers shared by the corpus operators: tables of the shared folder (from the core) and text expressions."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlake.core import discard, saved, shared_dir
from modlake.plans.base import table

__all__ = ["KEPT", "WORD", "discard", "hashed_sample", "lean", "let_go", "only_ids", "saved", "shared_dir", "table", "text_or_empty"]

#: The separators of words in every contract here: space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def only_ids(df: DataFrame, ids: DataFrame, id_col: str, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose id is among ``ids`` (one column; null is an id), or with left_anti the others. ``df`` may have columns of any name."""
    own = f"id_{uuid.uuid4().hex}"
    return df.join(ids.toDF(own).distinct(), df[id_col].cast("long").eqNullSafe(F.col(own)), how)


#: What operators keep in a Python worker from task to task; Spark uses a worker again for other stages.
KEPT: list[dict] = []


def let_go() -> None:
    """Free what an earlier stage has left in this Python worker, and give the memory back."""
    if any(KEPT):
        for kept in KEPT:
            kept.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Give the memory that this Python worker has freed back to the system; else Arrow and the C library keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of mapInArrow, which gives its memory back at the end of a task: an executor has a worker for each step that ever ran at once,
    and they wait for later stages beside the JVM's full heap."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def hashed_sample(df: DataFrame, most: int, *cols: str) -> DataFrame:
    """``most`` rows of ``df``, or all if there are fewer, by the order of a hash of ``cols``.

    Rows are thinned to little more than ``most`` by their hash first, so that a task has only its share to send.
    """
    n = df.count()
    h = F.xxhash64(*cols)
    share = min(1.0, (most + 6 * most**0.5 + 10) / max(n, 1))
    thin = df.filter(F.shiftrightunsigned(h, 11) < int(share * (1 << 53)))
    return thin.orderBy(h, *cols).limit(most)
