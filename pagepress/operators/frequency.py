"""Byte frequencies, entropy and Huffman sizes of text or binary columns.

Bytes are counted in numpy, a batch of rows at a time: a row of input gives at most 256 rows, whatever its length.
"""

from __future__ import annotations

from heapq import heapify, heappop, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUFFMAN_HEADER = 4 + 1 + 256 * 8


STEP = 1 << 20  # bytes counted at a time


def _counts(column: pa.Array):
    """(first row, counts): tables of 256 counts for each of some rows; null counts as empty."""
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = min(lo + 1000, max(lo + 1, int(np.searchsorted(offs, offs[lo] + STEP, "right")) - 1), len(column))
        out = np.zeros((hi - lo) * 256, np.int64)
        for a in range(int(offs[lo]), int(offs[hi]), STEP):  # more than one step only where one row is longer
            z = min(a + STEP, int(offs[hi]))
            row = np.repeat(np.arange(hi - lo), np.diff(np.clip(offs[lo : hi + 1], a, z)))
            out += np.bincount(row * 256 + data[a:z], minlength=len(out))
        yield lo, out.reshape(-1, 256)
        lo = hi


def byte_histogram(rows: DataFrame, key: str, content: str, unique: bool = False) -> DataFrame:
    """key, byte (0 to 255), n. unique: no key has two rows, so that nothing need be shuffled. Null and empty content gives no rows."""

    def run(batches):
        for b in batches:
            for lo, counts in _counts(b.column(1)):
                at, byte = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + at)), pa.array(byte.astype(np.int32)), pa.array(counts[at, byte])], names=["key", "byte", "n"])

    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content")).mapInArrow(run, f"key {kind}, byte int, n long")
    if not unique:
        out = out.groupBy("key", "byte").agg(F.sum("n").alias("n"))
    return out.withColumnRenamed("key", key)


def histogram_report(histogram: DataFrame, key: str) -> DataFrame:
    """Checks of a frequency table, a row for each key: symbols outside 0 to 255, symbols listed twice, and counts below 1."""
    bad = ~F.col("byte").between(0, 255) | F.col("byte").isNull()
    return histogram.groupBy(key).agg(F.count_if(bad).alias("bad_symbols"), (F.count("byte") - F.count_distinct("byte")).alias("repeated_symbols"), F.count_if(F.col("n").isNull() | (F.col("n") < 1)).alias("bad_counts"))


def entropy(histogram: DataFrame, key: str) -> DataFrame:
    """Bits per byte: log2(N) - sum(n*log2(n))/N, so that one pass over the counts is enough."""
    n = F.col("n").cast("double")
    return histogram.groupBy(key).agg((F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy"), F.count("*").alias("distinct_bytes"), F.sum("n").alias("n_bytes"))


def code_bits(counts) -> int:
    """Total bits of the Huffman code of some counts: the sum of all merges of the two smallest."""
    heap, bits = [int(n) for n in counts], 0
    if len(heap) == 1:
        return heap[0]
    heapify(heap)
    while len(heap) > 1:
        both = heappop(heap) + heap[0]
        heapreplace(heap, both)
        bits += both
    return bits


def merged_bits(counts: Column) -> Column:
    """code_bits of a column of arrays, each of 256 counts at most."""

    @F.pandas_udf("long")
    def apply(column: pd.Series) -> pd.Series:
        return column.map(code_bits)

    return apply(counts)


def huffman_bits(histogram: DataFrame, key: str) -> DataFrame:
    """key, n_bytes, distinct_bytes, bits, size (flushed) and size_unflushed (whole bytes only)."""
    grouped = histogram.groupBy(key).agg(F.sum("n").alias("n_bytes"), F.collect_list("n").alias("counts"))  # 256 at most
    out = grouped.withColumn("bits", merged_bits(F.col("counts")))
    return out.select(key, "n_bytes", F.size("counts").cast("long").alias("distinct_bytes"), "bits", (HUFFMAN_HEADER + F.ceil(F.col("bits") / 8)).cast("long").alias("size"), (HUFFMAN_HEADER + F.floor(F.col("bits") / 8)).cast("long").alias("size_unflushed"))


def kraft(lengths: DataFrame, key: str, length: str = "length") -> DataFrame:
    """key, kraft (sum of 2^-length over used symbols) and whether the code is complete, under-full or over-full."""
    total = F.sum(F.when(F.col(length) > 0, F.pow(F.lit(2.0), -F.col(length))).otherwise(0.0))
    return lengths.groupBy(key).agg(total.alias("kraft")).withColumn("verdict", F.when(F.col("kraft") > 1, "over-full").when(F.col("kraft") < 1, "under-full").otherwise("complete"))
