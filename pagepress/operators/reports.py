"""Run summaries, archive sizes and chart rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import axis_label, axis_maximum, format_file_size, rounded, savings_percent, shorten_file_name, tick_unit

ARCHIVE_HEADER = 9
ENTRY_OVERHEAD = 19


def entry_size(path: Column, compressed: Column) -> Column:
    return ENTRY_OVERHEAD + F.octet_length(path) + compressed


def entry_savings(rows: DataFrame) -> DataFrame:
    """Adds savings and net_savings (with the entry's metadata) in percent to path, original, compressed."""
    o, c = F.col("original"), F.col("compressed")
    return rows.withColumn("savings", F.round(savings_percent(o, c), 6)).withColumn("net_savings", F.round(savings_percent(o, entry_size(F.col("path"), c)), 6))


def archive_summary(rows: DataFrame) -> DataFrame:
    """Files, original bytes, the archive's bytes with headers, savings."""
    sums = rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("original"), F.lit(0)).cast("long").alias("original"), (F.coalesce(F.sum(entry_size(F.col("path"), F.col("compressed"))), F.lit(0)) + ARCHIVE_HEADER).cast("long").alias("archive"))
    return sums.withColumn("savings", F.round(savings_percent(F.col("original"), F.col("archive")), 6))


def run_summary(rows: DataFrame) -> DataFrame:
    """Of path, original, compressed, error: processed and failed files, totals of the processed, overall savings."""
    ok = F.col("error").isNull()
    sums = rows.agg(F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("original"))), F.lit(0)).cast("long").alias("original"), F.coalesce(F.sum(F.when(ok, F.col("compressed"))), F.lit(0)).cast("long").alias("compressed"))
    return sums.withColumn("savings", F.round(savings_percent(F.col("original"), F.col("compressed")), 6)).withColumn("original_text", format_file_size(F.col("original"))).withColumn("compressed_text", format_file_size(F.col("compressed")))


def chart_rows(rows: DataFrame, name: str = "name") -> DataFrame:
    o, c = F.col("original"), F.col("compressed")
    return rows.select(F.col(name), shorten_file_name(F.col(name)).alias("label"), o, c, (o - c).alias("savings"), F.round(savings_percent(o, c), 6).alias("savings_percent"))


def chart_axis(rows: DataFrame) -> DataFrame:
    top = rows.agg(axis_maximum(F.col("original"), F.col("compressed")).alias("axis_max"))
    return top.withColumn("tick", tick_unit(F.col("axis_max"))).withColumn("label", axis_label(F.col("axis_max")))


def stats_text(rows: DataFrame, algorithm: Column) -> DataFrame:
    """Adds text, a line of a codec's statistics, to original, compressed."""
    o, c = F.col("original"), F.col("compressed")
    percent = rounded(F.when(o > 0, 100.0 * c / o).otherwise(F.lit(0.0)), 2)
    return rows.withColumn("text", F.format_string("[%s] original: %d bytes, compressed: %d bytes, ratio: %.2f%%, savings: %.2f%%", algorithm, o, c, percent, rounded(F.when(o > 0, 100 - percent).otherwise(F.lit(100.0)), 2)))
