"""Shared helpers of the corpus operators: reading tables, tables written in the shared folder, prefix sums.

Nothing here collects rows of the corpus; what comes to the driver is bounded by a parameter or by the
number of partitions and is said so where it happens.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that separates words: space and the ASCII controls from tab to carriage return.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: ASCII letters; only these change under `ascii_lower`.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset, tables go below the warehouse on a single machine;
    on a cluster it is an error, as executors may not share that."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return at.rstrip("/")


#: Tables of the open scopes, of each thread its own.
_open: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scratch", default=())


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here and the rows,
    with any partition ids in them, stay as they are when an executor is lost."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    for tables in _open.get()[-1:]:
        tables.append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables stored inside are deleted at the end, but for those that are taken out with kept()."""
    tables: list[DataFrame] = []
    scope = _open.set((*_open.get(), tables))
    try:
        yield tables
    finally:
        _open.reset(scope)
        discard(*tables)


def kept(df: DataFrame) -> DataFrame:
    """df, a stored table, belongs to the scratch() around this one, if any."""
    scopes = _open.get()
    if scopes:
        scopes[-1][:] = [t for t in scopes[-1] if t is not df]
        for outer in scopes[-2:-1]:
            outer.append(df)
    return df


def discard(*tables: DataFrame) -> None:
    """Delete tables written by stored() that nothing will read again."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def trimmed(run: Callable) -> Callable:
    """A task's function over Arrow batches that gives freed memory back to the system when it ends: Python workers live on between
    tasks and stages, and what their allocators keep counts against the executor."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def at_most_in_a_batch(spark: SparkSession, rows: int) -> str:
    """Let the session hand `rows` rows at most to a Python task at a time; what it was before. Rows that hold whole texts or
    sets wait outside of the executor's heap, twice where they come back."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(rows, int(before))))
    return before


def in_small_batches(operator: Callable, rows: int = 500) -> Callable:
    """The operator on a DataFrame with at_most_in_a_batch(rows) in what it runs before it returns."""

    @wraps(operator)
    def run(df: DataFrame, *args, **options):
        before = at_most_in_a_batch(df.sparkSession, rows)
        try:
            return operator(df, *args, **options)
        finally:
            df.sparkSession.conf.set(BATCH, before)

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def named(df: DataFrame, name: str) -> Column:
    """The input column of this very name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII texts take the fast path of lower()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shuffle_key(seed: int, *cols: Column) -> Column:
    """A seeded 60-bit pseudo-random key of the columns, the same in every run."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def range_dealt(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Range-partition by keys and write the result with its partition number in `_pid`."""
    n = partitions(df.sparkSession)
    return stored(df.repartitionByRange(n, *[F.col(k) for k in keys]).withColumn("_pid", F.spark_partition_id()), label)


def running(dealt: DataFrame, keys: list[str], value: Column, name: str, group: list[str] | None = None) -> DataFrame:
    """Inclusive running sum of value over the order of keys, inside each group, of a range_dealt table.

    Two levels: sums of each partition (as many rows as partitions and groups meet) give each its
    offset, a window inside one partition does the rest. So no task holds a whole group.
    """
    group = group or []
    sums = dealt.groupBy("_pid", *group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_pid").alias("_opid"), *[F.col(g).alias(f"_o{g}") for g in group], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_pid", *group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    on = F.col("_pid") == F.col("_opid")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_o{g}"))
    return dealt.withColumn(name, F.sum(value).over(inside)).join(offsets, on, "left").withColumn(name, F.col(name) + F.col("_offset")).drop("_offset", "_opid", *[f"_o{g}" for g in group])


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores at its end until no column in taken has it (Spark ignores case)."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name
