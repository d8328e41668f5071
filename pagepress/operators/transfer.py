"""Transfer times over network profiles, and the estimates and reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_duration, format_duration_short, format_file_size, format_size_short, rounded, savings_percent
from ..plans import dims

SLOW_START = 1 << 20


def transfer_ms(size: Column, mbps: Column, latency: Column) -> Column:
    """0 for nothing; else milliseconds on the wire and one latency, three above one MiB."""
    wire = F.call_function("div", size.cast("long") * 1000, mbps.cast("long") * 125_000)  # whole numbers, as doubles are not exact from 2**53
    return F.when(size <= 0, F.lit(0)).otherwise(wire + latency * F.when(size > SLOW_START, 3).otherwise(1)).cast("long")


def estimate(rows: DataFrame, original: str = "original", compressed: str = "compressed") -> DataFrame:
    """Every row on every profile (nine rows, broadcast): down and up times, what is saved, and the advice tier."""
    on = rows.crossJoin(F.broadcast(dims.profiles(rows.sparkSession)))
    o, c = F.col(original), F.col(compressed)
    for way, mbps in (("down", "download_mbps"), ("up", "upload_mbps")):
        on = on.withColumn(f"{way}_original_ms", transfer_ms(o, F.col(mbps), F.col("latency_ms"))).withColumn(f"{way}_compressed_ms", transfer_ms(c, F.col(mbps), F.col("latency_ms")))
        on = on.withColumn(f"{way}_saved_ms", F.col(f"{way}_original_ms") - F.col(f"{way}_compressed_ms"))
    return on.withColumn("savings_percent", rounded(savings_percent(o, c), 6)).withColumn("tier", tier(F.col("down_saved_ms")))


def tier(saved_ms: Column) -> Column:
    return F.when(saved_ms > 3_600_000, "bandwidth costs").when(saved_ms > 60_000, "waiting times").when(saved_ms > 1000, "responsiveness").when(saved_ms > 0, "slight").otherwise("none")


def batch_estimate(rows: DataFrame, original: str = "original", compressed: str = "compressed") -> DataFrame:
    """The sums of both sizes, estimated once, so that latency counts once."""
    return estimate(rows.agg(F.coalesce(F.sum(original), F.lit(0)).cast("long").alias(original), F.coalesce(F.sum(compressed), F.lit(0)).cast("long").alias(compressed)), original, compressed)


def report(estimates: DataFrame) -> DataFrame:
    """Adds report, the estimate as text, and line, the same in one line; both are null where a size is."""
    o, c = F.col("original"), F.col("compressed")
    text = F.concat_ws(
        "\n",
        F.format_string("Network: %s (down %d Mbps, up %d Mbps, latency %d ms)", "profile", "download_mbps", "upload_mbps", "latency_ms"),
        F.concat(F.lit("Original: "), format_file_size(o), F.lit(", compressed: "), format_file_size(c), F.lit(", saved: "), format_file_size(o - c), F.format_string(" (%.1f%%)", rounded(F.col("savings_percent"), 1))),
        F.concat(F.lit("Transfer: "), format_duration(F.col("down_original_ms")), F.lit(", compressed: "), format_duration(F.col("down_compressed_ms")), F.lit(", saved: "), format_duration(F.col("down_saved_ms"))),
        F.concat(F.lit("Improves: "), F.col("tier")),
    )
    line = F.concat(F.col("profile"), F.lit(": "), format_size_short(o), F.lit(" -> "), format_size_short(c), F.lit(", "), format_duration_short(F.col("down_original_ms")), F.lit(" -> "), format_duration_short(F.col("down_compressed_ms")))
    known = o.isNotNull() & c.isNotNull()
    return estimates.withColumn("report", F.when(known, text)).withColumn("line", F.when(known, line))
