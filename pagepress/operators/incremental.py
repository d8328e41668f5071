"""Incremental runs against a manifest of fingerprints: path, md5, size, and what was made of it.

The manifest is a table (Parquet, keyed by path); joins are equi-joins on the path, left to AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_file_size, savings_percent

MANIFEST = "path string, md5 string, size long, compressed boolean, compressed_path string, compressed_size long, algorithm string, seq long"


def fingerprint(resources: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return resources.select(F.col(path).alias("path"), F.md5(F.col(content).cast("binary")).alias("md5"), F.octet_length(F.col(content)).cast("long").alias("size"))


def status(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """current with status: new, modified, unchanged, or unchanged_skipped (kept as it was not worth compressing)."""
    old = manifest.select("path", F.col("md5").alias("_md5"), "compressed", "compressed_size")
    what = F.when(F.col("_md5").isNull(), "new").when(F.col("_md5") != F.col("md5"), "modified").when(F.col("compressed"), "unchanged").otherwise("unchanged_skipped")
    return current.join(old, "path", "left").withColumn("status", what).drop("_md5")


def has_changed(current: DataFrame, manifest: DataFrame) -> DataFrame:
    return status(current, manifest).select("path", F.col("status").isin("new", "modified").alias("changed"))


def lookup(manifest: DataFrame, path: str) -> DataFrame:
    """The row of a path, or none; on a Parquet manifest the path is pushed down to the scan."""
    return manifest.where(F.col("path") == path)


def modified_or_new(current: DataFrame, manifest: DataFrame) -> DataFrame:
    return current.join(manifest.select("path", "md5"), ["path", "md5"], "left_anti")


def unchanged(current: DataFrame, manifest: DataFrame) -> DataFrame:
    return current.join(manifest.where("compressed").select("path", "md5"), ["path", "md5"], "left_semi")


def outcome(original: Column, compressed: Column) -> Column:
    """Whether a result is worth keeping: only if it is smaller."""
    return F.when(compressed < original, "compressed").otherwise("skipped")


def upsert(manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    """fresh rows replace those of the same path and keep the old place in the order; new ones follow."""
    both = manifest.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("path")
    ranked = both.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_new"), F.desc("seq")))).withColumn("seq", F.min("seq").over(w))
    return ranked.where("_rank = 1").drop("_rank", "_new")


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """Counts and sizes; reference_savings mixes all originals with compressed sizes, savings compares like with like."""
    done = F.col("compressed")
    sums = manifest.agg(
        F.count("*").alias("files"), F.count_if(done).alias("compressed_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("original"),
        F.coalesce(F.sum(F.when(done, F.col("compressed_size"))), F.lit(0)).cast("long").alias("compressed"), F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)).cast("long").alias("original_of_compressed"),
    )
    return sums.withColumn("reference_savings", F.round(savings_percent(F.col("original"), F.col("compressed")), 6)).withColumn("savings", F.round(savings_percent(F.col("original_of_compressed"), F.col("compressed")), 6))


def incremental_summary(rows: DataFrame) -> DataFrame:
    """Of status() rows: counts, and bytes saved by unchanged files (from the manifest)."""
    same = F.col("status") == "unchanged"
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("new", "modified")).alias("changed"), F.count_if(same).alias("unchanged"), F.count_if(F.col("status") == "unchanged_skipped").alias("unchanged_skipped"), F.coalesce(F.sum(F.when(same, F.col("size") - F.col("compressed_size"))), F.lit(0)).cast("long").alias("bytes_saved_unchanged"))


def duplicate_content(fingerprints: DataFrame) -> DataFrame:
    """md5, copies, bytes that one copy would do without; only contents that occur twice or more."""
    return fingerprints.groupBy("md5").agg(F.count("*").alias("copies"), F.min("path").alias("first_path"), F.sum("size").cast("long").alias("bytes"), F.max("size").alias("size")).where("copies > 1").select("md5", "copies", "first_path", (F.col("bytes") - F.col("size")).alias("redundant_bytes"))


def describe(manifest: DataFrame) -> DataFrame:
    """A line of text for each fingerprint, in path order."""
    line = F.concat_ws(" ", "path", "md5", format_file_size(F.col("size")), F.when(F.col("compressed"), F.concat(F.lit("-> "), format_file_size(F.col("compressed_size")), F.format_string(" (%.1f%%)", savings_percent(F.col("size"), F.col("compressed_size"))))).otherwise("not compressed"))
    return manifest.select("path", line.alias("line")).orderBy("path")


def totals_text(totals: DataFrame) -> DataFrame:
    """Adds text, manifest_totals in one line; 0 % where there is nothing."""
    line = F.format_string("files: %d, compressed: %d, size: %s, compressed size: %s, savings: %.2f%%", "files", "compressed_files", format_file_size(F.col("original")), format_file_size(F.col("compressed")), F.round("reference_savings", 2))
    return totals.withColumn("text", line)


def detail(manifest: DataFrame) -> DataFrame:
    """path and text, a fingerprint in several lines."""
    done, none = F.col("compressed"), F.lit("none")
    saved = F.when(done, F.col("size") - F.col("compressed_size")).otherwise(0)
    percent = F.when(done, F.round(savings_percent(F.col("size"), F.col("compressed_size")), 2)).otherwise(F.lit(0.0))
    lines = {
        "File": F.regexp_extract("path", r"([^/]*)$", 1), "Path": F.col("path"), "MD5": F.col("md5"), "Size": format_file_size(F.col("size")), "Compressed": F.when(done, "yes").otherwise("no"),
        "Codec": F.coalesce("algorithm", none), "Compressed size": F.when(done, format_file_size(F.col("compressed_size"))).otherwise(none), "Saved": F.format_string("%d bytes (%.2f%%)", saved, percent),
    }
    return manifest.select("path", F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in lines.items()]).alias("text"))


def to_text(manifest: DataFrame) -> DataFrame:
    """Pipe-separated rows, seven fields, in order."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return manifest.orderBy("seq").select(F.concat_ws("|", s("path"), s("md5"), s("size"), s("compressed"), s("compressed_path"), F.coalesce(F.col("compressed_size"), F.lit(0)).cast("string"), s("algorithm")).alias("value"))


def from_text(lines: DataFrame) -> DataFrame:
    """Rows of to_text with their line number as seq (columns value, seq); headers, comments and short rows are passed over."""
    p = F.split("value", r"\|")
    at = lambda i: F.get(p, F.lit(i))
    kept = lines.where(~F.col("value").startswith("#") & ~F.col("value").rlike("^(VERSION|CREATED|UPDATED|ALGORITHM):") & (F.size(p) >= 4))
    return kept.select(at(0).alias("path"), at(1).alias("md5"), at(2).try_cast("long").alias("size"), (F.lower(at(3)) == "true").alias("compressed"), F.nullif(at(4), F.lit("")).alias("compressed_path"), F.coalesce(at(5).try_cast("long"), F.lit(0)).alias("compressed_size"), F.nullif(at(6), F.lit("")).alias("algorithm"), "seq")
