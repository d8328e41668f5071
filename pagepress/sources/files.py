"""Directory scans as DataFrames: name, path, length, content. Content is read only where a query selects it."""

from __future__ import annotations

from collections.abc import Sequence
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_extension, relative_path


def read_files(spark: SparkSession, path: str | Sequence[str], recursive: bool = True, glob: str | None = None) -> DataFrame:
    """All files below path (hidden ones too), or only those directly in it."""
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(paths)
    # The source passes over hidden and empty files; their listing, without contents, adds them.
    hidden, blank = _passed_over(spark, paths, recursive, glob)
    if hidden:
        files = files.unionByName(spark.createDataFrame(hidden, "path string, millis long, length long").repartition(len(hidden)).mapInPandas(_fetch, "path string, millis long, length long, content binary").withColumn("modificationTime", F.timestamp_millis("millis")).drop("millis"))
    if blank:
        none = spark.createDataFrame(blank, "path string, millis long").select("path", F.timestamp_millis("millis").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
        files = files.where("length > 0").unionByName(none)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "path", "modificationTime", "length", "content")


def _fetch(frames):
    from pyarrow import fs

    for f in frames:
        content = []
        for uri in f["path"]:
            files, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))
            with files.open_input_stream(path, compression=None) as stream:
                content.append(stream.read())
        yield f.assign(content=content)


def read_headers(spark: SparkSession, path: str | Sequence[str], size: int = 12, recursive: bool = True) -> DataFrame:
    """name, path, length and header, the first bytes of each file: files are listed, and of each no more is read."""
    from .wzip import file_system

    def run(frames):
        for f in frames:
            heads = []
            for uri in f["path"]:
                files, at = file_system(uri if "://" in uri else uri.replace("file:/", "file:///", 1))
                with files.open_input_stream(at, compression=None, buffer_size=0) as stream:
                    heads.append(stream.read(size))
            yield f.assign(header=heads)

    listed = read_files(spark, path, recursive).select("name", "path", "length")
    return listed.mapInPandas(run, "name string, path string, length long, header binary")


def sniff_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """path and kind, told from each file's first bytes."""
    from ..operators.routing import sniff

    return read_headers(spark, path).select("path", sniff(F.col("header")).alias("kind"))


def _passed_over(spark: SparkSession, paths: Sequence[str], recursive: bool, glob: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int]]]:
    hidden, blank, conf = [], [], spark._jsparkSession.sessionState().newHadoopConf()
    for p in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            continue
        base, listed = fs.getFileStatus(root).getPath().toUri().getPath(), fs.listFiles(root, recursive)
        while listed.hasNext():
            f = listed.next()
            inside = f.getPath().toUri().getPath()[len(base) :].strip("/").split("/")
            if glob and not fnmatch(f.getPath().getName(), glob):
                continue
            if f.getLen() == 0:
                blank.append((f.getPath().toString(), f.getModificationTime()))
            elif any(x[:1] in ("_", ".") for x in inside if x):
                hidden.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    return hidden, blank


def visible(files: DataFrame, extensions: Sequence[str] | None = None) -> DataFrame:
    """Files whose names don't begin with a dot, of the extensions (lower case, without dot) if any are given."""
    out = files.where(~F.col("name").startswith("."))
    return out.where(file_extension(F.col("name")).isin(*extensions)) if extensions else out


def relative(files: DataFrame, base: str) -> DataFrame:
    """Adds relative, the path below base."""
    plain = F.regexp_replace("path", "^[a-z0-9+.-]+:/+", "/")
    return files.withColumn("relative", relative_path(plain, base))


def read_all(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files and directories together, each path once; missing ones are passed over."""
    found = []
    for p in dict.fromkeys(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            found.append(p)
    if not found:
        return spark.createDataFrame([], "name string, path string, modificationTime timestamp, length long, content binary")
    return read_files(spark, found).dropDuplicates(["path"])


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """path, width, height (-1 where a file is no image) and rows of RGB bytes (Spark gives BGR; see rgb_array)."""
    images = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).option("recursiveFileLookup", "true").load(path)
    return images.select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def rgb_array(data: bytes, width: int, height: int, channels: int):
    import numpy as np

    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, 2) if channels == 1 else x[:, :, 2::-1]


def image_payloads(images: DataFrame, quality: int = 5) -> DataFrame:
    """path, lzw_image, pooling_image and png of read_images rows, which the JVM has decoded whatever their format; null where a file is no image."""
    from ..operators.codecs import png_encode, pooling_encode, rgb_encode

    def run(frames):
        for f in frames:
            pixels = [rgb_array(bytes(d), w, h, c) if w > 0 else None for d, w, h, c in zip(f["data"], f["width"], f["height"], f["channels"], strict=True)]
            made = {"lzw_image": rgb_encode, "pooling_image": lambda x: pooling_encode(x, quality), "png": png_encode}
            yield f[["path"]].assign(**{n: [None if x is None else make(x) for x in pixels] for n, make in made.items()})

    return images.mapInPandas(run, "path string, lzw_image binary, pooling_image binary, png binary")


COMPRESSED = ".compressed"


def write_compressed(packed: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """Writes each row's payload as <path>.compressed below folder, path being relative; path, bytes, error."""
    from .wzip import put_files

    return put_files(packed.select(F.concat(path, F.lit(COMPRESSED)).alias("path"), "payload"), folder, content="payload")


def original_name(path: Column) -> Column:
    """The name of what a compressed file holds."""
    return F.regexp_replace(path, r"(\.compressed|\.huff)$", "")


def read_compressed(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """path, name, content and error of compressed files, single or below folders; payloads tell their codec."""
    from ..operators.codecs import try_decompress

    files = read_files(spark, path).where(F.col("name").rlike(r"\.(compressed|huff)$"))
    got = files.select("path", original_name(F.col("name")).alias("name"), F.when(F.col("length") == 0, F.struct(F.lit(b"").alias("content"), F.lit(None).cast("string").alias("error"))).otherwise(try_decompress(F.col("content"))).alias("got"))
    return got.select("path", "name", "got.content", "got.error")


def decompress_all(manifest: DataFrame) -> DataFrame:
    """path, content, error for every compressed row of a manifest; files that are gone or damaged have an error.

    Files are read where their row is, on executors, a batch of rows at a time.
    """
    from ..operators.codecs import decompress_any
    from .wzip import file_system

    def run(frames):
        for f in frames:
            rows = []
            for path, where in zip(f["path"], f["compressed_path"], strict=True):
                try:
                    files, at = file_system(where if "://" in where or not where.startswith("file:") else where.replace("file:", "file://", 1))
                    with files.open_input_stream(at, compression=None) as stream:
                        rows.append((path, decompress_any(stream.read()), None))
                except (ValueError, OSError) as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "content", "error"], dtype=object)

    wanted = manifest.where(F.col("compressed") & F.col("compressed_path").isNotNull()).select("path", "compressed_path")
    return wanted.mapInPandas(run, "path string, content binary, error string")
