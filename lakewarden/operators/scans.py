"""Scans along ordered keys that no task holds whole: what a row needs from before it is carried over range partitions.

Rows are range-partitioned by key and order and written, so a hot key spreads over partitions. Each (partition, key) leaves a short summary; summaries
are folded along the partitions, as many rows as partitions and keys meet; what comes out is handed to the next partition.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby
from math import fsum

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def dealt_by(rows: DataFrame, key: list[str], order: list[str], stored) -> DataFrame:
    """rows written by range of (key, order), with the number of their partition in _pid."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *key, *order).withColumn("_pid", F.spark_partition_id()))


def with_neighbours(rows: DataFrame, key: list[str], order: list[str], values: list[str], stored) -> DataFrame:
    """rows with `before` and `first`: structs of the values of the key's row before and of its first row. order is total within a key; the first row's `before` is
    null."""
    dealt = dealt_by(rows, key, order, stored)
    row, place = F.struct(*values), F.struct(*order)
    ends = dealt.groupBy(*key, "_pid").agg(F.max_by(row, place).alias("_last"), F.min_by(row, place).alias("_first"))
    along = Window.partitionBy(*key).orderBy("_pid")  # a row a partition that the key meets
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_pid").alias("_p"), F.lag("_last").over(along).alias("_carried"), F.first("_first").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("first"))
    on = F.col("_pid") == F.col("_p")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy("_pid", *key).orderBy(*order)
    out = dealt.withColumn("_here", F.lag(row).over(inside)).withColumn("_n", F.row_number().over(inside)).join(ends, on)
    return out.withColumn("before", F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_here"))).drop("_pid", "_here", "_n", "_p", "_carried", *[f"_k{i}" for i in range(len(key))])


def _segments(alpha: float, window: int):
    """Of each key in a partition's ordered rows (key, value): its rows, the average's map (what it adds), its first value and its last ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("_pid", pa.int32()), ("n", pa.int64()), ("adds", pa.float64()), ("first", pa.float64()), ("tail", pa.list_(pa.float64()))])
        rows = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("key", "_pid", "value")], strict=True))
        out = []
        for (key, pid), group in groupby(rows, lambda r: r[:2]):
            n, adds, first, tail = 0, 0.0, None, deque(maxlen=window - 1)
            for _, _, x in group:
                first = x if n == 0 else first
                adds = (1 - alpha) * adds + alpha * x
                n += 1
                tail.append(x)
            out.append((key, pid, n, adds, first, list(tail)))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _handed_on(alpha: float, window: int):
    """Segments of a key in order -> the average and the values before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("_pid", pa.int32()), ("average", pa.float64()), ("tail", pa.list_(pa.float64()))])
        current, average, tail = None, None, deque(maxlen=window - 1)
        for batch in batches:
            out = []
            for key, pid, n, adds, first, own in zip(*[batch.column(c).to_pylist() for c in ("key", "_pid", "n", "adds", "first", "tail")], strict=True):
                if current is None or key != current[0]:
                    current, average, tail = (key,), first, deque(maxlen=window - 1)  # before its first value the average is that value
                out.append((key, pid, average, list(tail)))
                average = (1 - alpha) ** n * average + adds
                tail.extend(own)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * 4, schema, strict=True)], schema=schema)

    return run


def _applied(alpha: float, window: int, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        average, last = 0.0, deque(maxlen=window)
        for batch in batches:
            carries, values = batch.column("_carry").to_pylist(), batch.column("value").to_pylist()
            rows, averages, variances = [], [], []
            for i, (carry, x) in enumerate(zip(carries, values, strict=True)):
                if carry is not None:
                    average, last = x, deque(carry, maxlen=window)
                    continue
                average = average + alpha * (x - average)
                last.append(x)
                mean = fsum(last) / len(last)
                rows.append(i)
                averages.append(average)
                variances.append(fsum((v - mean) ** 2 for v in last) / len(last))
            part = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(averages, pa.float64()), pa.array(variances, pa.float64())], names=[*kept, "ema", "variance"])

    return run


def ema_scan(rows: DataFrame, key: str, order: list[str], value: str, stored, alpha: float = 0.1, window: int = 20) -> DataFrame:
    """rows with the exponential moving average of value in each key's order, seeded by its first, and the population variance of the last `window` values.

    A step of the average is an affine map, so a partition's rows of a key compose to one map, (1 - alpha)^n and what they add: summaries are folded along the partitions,
    then each partition goes on from what it is handed. Rows pass in the order of time through a task a batch at a time; none holds a key. Null values are an error
    to the fold: filter them first."""
    dealt = dealt_by(rows.withColumn("value", F.col(value).cast("double")), [key], order, stored)
    told = F.col(key).cast("string").alias("key")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(n, "_pid").sortWithinPartitions("_pid", key, *order)
    segments = stored(ordered.select(told, "_pid", "value").mapInArrow(_segments(alpha, window), "key string, _pid int, n long, adds double, first double, tail array<double>"))
    handed = segments.repartition(n, "key").sortWithinPartitions("key", "_pid").mapInArrow(_handed_on(alpha, window), "key string, _pid int, average double, tail array<double>")
    # what is handed on stands before the rows of its key and partition
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != key]
    key_type = rows.schema[key].dataType
    heads = handed.select(F.col("key").cast(key_type).alias(key), *nothing, F.col("average").alias("value"), F.col("_pid"), F.col("tail").alias("_carry"))
    both = dealt.withColumn("_carry", F.lit(None).cast("array<double>")).unionByName(heads)
    streamed = both.repartition(n, "_pid", key).sortWithinPartitions("_pid", key, F.col("_carry").isNull(), *order)
    kept = rows.columns
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("ema double, variance double").fields])
    return streamed.mapInArrow(_applied(alpha, window, kept), schema)
