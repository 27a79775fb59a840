"""Helpers shared by the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import plain_unions

#: Rows in one Arrow batch handed to Python; bounds the memory of a worker on tables of long texts.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_ROWS rows, so that a batch of long texts fits a Python worker; and unions plain."""
    plain_unions(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000") or 10000) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only a local session without one (tests) gets its own."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        given = tempfile.mkdtemp(prefix="inkwell-checkpoint-")
    spark.sparkContext.setCheckpointDir(given)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: the lineage ends, a lost executor costs nothing.

    Its shuffle files go as soon as it is written; the session's own setting for that comes back.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a frame keeps the setting that it was made under
    finally:
        spark.conf.set(_CLEANUP, before)


def drop(*frames: DataFrame) -> None:
    """Delete the files of frames from `cut` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def apart(df: DataFrame) -> DataFrame:
    """df as the small side of a join by the keys it was just aggregated by.

    The aggregation and the join would share one exchange, and adaptive execution then can't split a hot key of the
    other side; with a rebalance in between, both sides of the join have exchanges of their own and it can.
    """
    return df.hint("rebalance")


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """This Python worker's object of that name, kept from task to task. What other operators held is let go when it is made."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def release() -> None:
    """Give memory that a finished task has freed back to the system, so that reused workers stay small."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # another C library


def map_rows(df: DataFrame, columns: dict[str, str | Column], fn: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema) -> DataFrame:
    """Apply fn to each Arrow batch of the chosen columns.

    columns: name -> column of df; fn gets name -> Python list and returns the lists of `schema`.
    """
    bounded_batches(df.sparkSession)
    picked = df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)
        release()

    return picked.mapInArrow(run, spark_schema(schema))


_TYPES = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean", pa.binary(): "binary", pa.float32(): "float"}


def spark_type(t: pa.DataType) -> str:
    return f"array<{spark_type(t.value_type)}>" if pa.types.is_list(t) else _TYPES[t]


def spark_schema(schema: pa.Schema) -> str:
    """The DDL of an Arrow schema."""
    return ", ".join(f"`{f.name}` {spark_type(f.type)}" for f in schema)


def held_out(doc_id: int | None) -> bool:
    """The evaluation fold: crc32 of the id's decimal text is a multiple of 5 (a null id counts as 0 text)."""
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0


def held_out_column(doc_id: Column) -> Column:
    """held_out as a column."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learning_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y: one label for each document of the learning fold.

    Rows without id or label are left out; where an id has several labels, the largest counts.
    """
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out_column(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def sigmoid(x):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def filter_rows(df: DataFrame, columns: dict[str, str | Column], keep: Callable[[dict[str, list]], list[bool]]) -> DataFrame:
    """The rows of df, with all their columns, for which keep says so; one pass, no shuffle."""
    bounded_batches(df.sparkSession)
    names = [f"_k{i}" for i in range(len(columns))]
    ordered = [F.col(f"`{c}`") for c in df.columns]
    extended = df.select(*ordered, *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in zip(names, columns.values(), strict=True)])
    width, keys = len(ordered), list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                mask = keep({k: b.column(width + i).to_pylist() for i, k in enumerate(keys)})
                yield b.select(list(range(width))).filter(pa.array(mask, pa.bool_()))
        release()

    return extended.mapInArrow(run, df.schema)


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """df's columns as one column `row`, beside the given ones, whose names then can't clash with df's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def one_of_each(df: DataFrame, **keys: Column) -> DataFrame:
    """The keys and, packed as `row`, one row of df for each of their values; equal ones meet in the tasks that read them, before any shuffle."""
    return packed(df, **keys).groupBy(*keys).agg(F.first("row").alias("row"))


def id_keys(doc_id: Column) -> tuple[Column, Column]:
    """Two columns without nulls that are equal where ids are, null among them."""
    return F.coalesce(doc_id, F.lit(0)), doc_id.isNull()
