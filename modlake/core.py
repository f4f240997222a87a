"""Building blocks of the operators: hashed uniforms, global ranks, recurrences, ordered folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder where it is unset."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="modlake-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Cuts the lineage: what follows survives the loss of executors without computing ``df`` anew, and reads the columns it needs only.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``saved`` from the shared folder, when all that reads them has been written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hashed_uniform(seed: int | str, *cols: Column | str) -> Column:
    """A uniform in [0, 1) from the first 13 hex digits of md5 over ``seed|a|b``: it depends on these only, and other engines can reproduce it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def global_rank(df: DataFrame, *order: Column | str, name: str = "rank", sums: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with its 1-based rank in a total order, and running sums up to and with each row (null adds nothing).

    Rows are range-partitioned once; each task numbers and sums its sorted range as Arrow batches and writes it.
    Partition totals go to a prefix table of one row a partition, which is added when the rows are read again: one
    shuffle, and no task holds more than its range. ``order`` should end in a unique column.
    """
    sums = sums or {}
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    wide = df.select("*", *[s.alias(f"_s_{k}") for k, s in sums.items()])
    kinds = dict(wide.dtypes)
    whole = [f"_s_{k}" for k in sums if kinds[f"_s_{k}"] in ("tinyint", "smallint", "int", "bigint")]
    wide = wide.select(*df.columns, *[F.coalesce(F.col(f"_s_{k}").cast("long" if f"_s_{k}" in whole else "double"), F.lit(0)).alias(f"_s_{k}") for k in sums])
    ranged = wide.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_n", F.lit(1).cast("long"))
    running = ["_n", *[f"_s_{k}" for k in sums]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = dict.fromkeys(running, 0)
        for batch in batches:
            cols, names = list(batch.columns), batch.schema.names
            for c in running if batch.num_rows else ():
                i = names.index(c)
                cols[i] = pc.add(pc.cumulative_sum(cols[i]), pa.scalar(upto[c], cols[i].type))
                upto[c] = cols[i][-1].as_py()
            yield pa.RecordBatch.from_arrays(cols, names)

    ranged = saved(ranged.mapInArrow(run, ranged.schema), "ranged")
    totals = ranged.groupBy("_p").agg(F.max("_n").alias("_n"), *[F.max_by(f"_s_{k}", "_n").alias(f"_s_{k}") for k in sums])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = totals.select("_p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in running])
    out = ranged.join(F.broadcast(offsets), "_p")
    return out.select(*[F.col(c) for c in df.columns], (F.col("_n") + F.col("_n_0")).alias(name), *[(F.col(f"_s_{k}") + F.col(f"_s_{k}_0")).alias(k) for k in sums])


def running_sums(df: DataFrame, key: str, *order: Column | str, **sums: Column) -> DataFrame:
    """``df`` with sums running over each key's rows in order, up to and with each row.

    A key of any share of the rows is spread over tasks: sums run over all rows by (key, order), less what they were
    where the key began. ``order`` should be unique within a key.
    """
    own = {f"_own_{n}": c for n, c in sums.items()}
    wide = df.withColumns(own)
    ranked = global_rank(wide, F.col(key), *order, name="_rank", sums={n: F.col(f"_own_{n}") for n in sums})
    starts = ranked.groupBy(F.col(key).alias("_key")).agg(*[F.min_by(F.col(n) - F.col(f"_own_{n}"), "_rank").alias(f"_at_{n}") for n in sums])
    out = ranked.join(starts, F.col(key).eqNullSafe(F.col("_key")))
    return out.select(*[F.col(c) for c in df.columns], *[(F.col(n) - F.col(f"_at_{n}")).alias(n) for n in sums])


def changes(col: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it, from the second on. Nulls are equal to each other, and so are NaNs."""
    a, b = col.slice(0, max(len(col) - 1, 0)), col.slice(1)
    if not len(b):
        return np.zeros(0, bool)
    if pa.types.is_nested(col.type):
        return np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], bool)
    differ = pc.fill_null(pc.not_equal(a, b), False)
    if pa.types.is_floating(col.type):
        differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return pc.or_(differ, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def same_key(a: object, b: object) -> bool:
    """Whether two keys are one: as Spark groups them, null with null and NaN with NaN."""
    return a == b or (a != a and b != b)


def decayed(df: DataFrame, key: str, order: list[str], x: Column, keep: float, gain: float, first: float, name: str) -> DataFrame:
    """``df`` with the recurrence y = keep * y + gain * x over each key's rows in order; the first x of a key gives first * x.

    A null x keeps y, and y is null before the first x. Rows are range-partitioned by (key, order), so one key of any share is spread over
    tasks. Every value is that of a loop over the key's rows, to the last bit: each sorted range goes through its rows as if nothing came
    before, then the rows of a range's first key are gone through again from what the range before ends with, until no range ends with
    another value. As old values fade, one such round does for ranges of some hundred rows. ``order`` should be unique within a key.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = df.withColumns({"_x": x.cast("double"), "_k": F.col(key)})
    ranged = wide.repartitionByRange(n, F.col("_k"), *order).sortWithinPartitions("_k", *order).withColumn("_p", F.spark_partition_id())
    out = T.StructType([*ranged.schema.fields, *T._parse_datatype_string("_n long, _open boolean, _c double").fields])

    def gone_through(values: list, begins: list, starts: list, y: float | None) -> list:
        got = []
        for v, begin, start in zip(values, begins, starts, strict=True):
            if begin:
                y = start
            if v is not None and v == v:
                y = first * v if y is None else keep * y + gain * v
            got.append(y)
        return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, opened, y = None, 0, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            keys = batch.column(names.index("_k"))
            begins = np.concatenate([[rows > 0 and not same_key(last, keys[0].as_py())], changes(keys)])
            last = keys[-1].as_py()
            c = gone_through(batch.column(names.index("_x")).to_pylist(), begins.tolist(), [None] * len(keys), y)
            own = opened & (np.cumsum(begins) == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(rows + 1, rows + len(c) + 1)), pa.array(own), pa.array(c, pa.float64())], [*names, "_n", "_open", "_c"])
            rows, opened, y = rows + len(c), opened and not begins.any(), c[-1]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = None
        for batch in batches:
            names = batch.schema.names
            begins = [at == 1 for at in batch.column(names.index("_n")).to_pylist()]
            c = gone_through(batch.column(names.index("_x")).to_pylist(), begins, batch.column(names.index("_y")).to_pylist(), y)
            y = c[-1] if c else y
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) if f == "_c" else batch.column(i) for i, f in enumerate(names)], names)

    done = saved(ranged.mapInArrow(run, out), "decayed")
    ends = done.groupBy("_p").agg(F.min_by("_k", "_n").alias("head"), F.max_by(F.struct("_k", "_open", "_c"), "_n").alias("tail")).orderBy("_p").collect()  # a row for each range
    tails, come, fixed = {r["_p"]: r["tail"]["_c"] for r in ends}, {}, None
    while True:
        brought = {r["_p"]: tails[b["_p"]] for b, r in zip(ends, ends[1:], strict=False) if same_key(b["tail"]["_k"], r["head"]) and tails[b["_p"]] is not None}
        if brought == come:
            break
        come = brought
        rows = done.filter("_open").join(F.broadcast(df.sparkSession.createDataFrame(list(come.items()), "_p int, _y double")), "_p")
        rows = rows.repartition(n, "_p").sortWithinPartitions("_p", "_n")
        if fixed is not None:
            discard(fixed)
        fixed = saved(rows.mapInArrow(again, rows.schema), "decayed-again")
        whole = [r["_p"] for r in ends if r["tail"]["_open"] and r["_p"] in come]
        tails |= {r["_p"]: r["y"] for r in fixed.filter(F.col("_p").isin(whole)).groupBy("_p").agg(F.max_by("_c", "_n").alias("y")).collect()}  # a row for each range of one key
    if fixed is not None:
        done = done.filter(~(F.col("_open") & F.col("_p").isin(list(come)))).select(*df.columns, "_c").unionByName(fixed.select(*df.columns, "_c"))
    return done.select(*df.columns, F.col("_c").alias(name))


Step = Callable[[dict, dict], tuple[dict, dict | None]]


def ordered_fold(df: DataFrame, key: str, order: list[str], step: Step, init: dict, schema: str, reads: list[str] | None = None) -> DataFrame:
    """A sequential rule over each key's rows in order: ``step(state, row) -> (state, extra columns or None)``.

    None drops the row. ``schema`` names the extra columns; ``reads`` the columns that the step looks at (all, if unset). Rows are shuffled by
    key and sorted in their partition; one small state is carried over Arrow batches, so no key has to fit into memory.
    Columns stay in Arrow: integers of any size and nulls come out as they went in, and null is a key like any other. The same ``step`` drives the
    streams.
    """
    extra = T._parse_datatype_string(schema)
    out = T.StructType([*df.schema.fields, *extra.fields])
    kinds = {f.name: to_arrow_type(f.dataType) for f in extra.fields}
    names = list(reads if reads is not None else df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, dict(init), False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key))
            begins = np.concatenate([[not begun or not same_key(now, keys[0].as_py())], changes(keys)])
            now, begun = keys[-1].as_py(), True
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
            keep, more = [], {n: [] for n in kinds}
            for i, values in enumerate(zip(*columns, strict=True)):
                if begins[i]:
                    state = dict(init)
                state, new = step(state, dict(zip(names, values, strict=True)))
                if new is not None:
                    keep.append(i)
                    for n in kinds:
                        more[n].append(new[n])
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(more[n], k) for n, k in kinds.items()]], [*batch.schema.names, *kinds])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out)
