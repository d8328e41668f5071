"""Incremental compression as a stream of new files; the manifest's md5 stays the source of truth.

The file stream remembers paths, so a file that is rewritten in place is not seen again: run the batch form for those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.codecs import compress_routed
from ..operators.incremental import MANIFEST, modified_or_new
from ..operators.routing import route


def compress_new(resources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows, with payload, for what the manifest doesn't hold in its present form. resources: path, name, content."""
    data = F.col("content").cast("binary")
    current = resources.select("path", "name", data.alias("content"), F.md5(data).alias("md5"), F.octet_length(data).cast("long").alias("size"))
    done = compress_routed(route(modified_or_new(current, manifest)))
    kept = F.col("stored_strategy") != 0
    return done.select("path", "md5", "size", kept.alias("compressed"), F.when(kept, F.concat("path", F.lit(".compressed"))).alias("compressed_path"), F.when(kept, F.col("compressed_size")).otherwise(0).cast("long").alias("compressed_size"), F.when(kept, F.col("strategy_name")).alias("algorithm"), F.unix_micros(F.current_timestamp()).alias("seq"), "payload")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each path of the appended manifest table; empty where there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.parquet(path)
    latest = F.max_by(F.struct(*[c for c in rows.columns if c not in ("path", "payload")]), "seq")
    return rows.groupBy("path").agg(latest.alias("r")).select("path", "r.*")


def stream_folder(spark: SparkSession, folder: str, manifest: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Compresses files as they arrive in folder and appends to the manifest table, once for each micro-batch."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    named = files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")

    def each(rows: DataFrame, batch: int) -> None:
        compress_new(rows, load_manifest(rows.sparkSession, manifest)).write.mode("append").parquet(manifest)

    out = named.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
