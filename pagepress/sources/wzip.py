"""The archive format as a Python data source: spark.read.format("wzip").load(path), df.write.format("wzip").save(path).

An archive has magic WZIP, version 1 (u8), the number of entries (u32), then for each entry the path's length (u16),
the path (UTF-8), original and stored sizes (i64), the strategy (u8) and the payload; all big-endian.  A reader is
planned for each file, and its entries stream as Arrow batches.  A write makes one archive from each partition;
write_archive makes a single one in a given order.  Files are read and written through Arrow's file systems, so the
folder may be on any store that they know; as the number of entries comes first, entries are written beside the
archive and copied behind its header.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAGIC, VERSION = b"WZIP", 1
SCHEMA = "path string, original_size long, strategy_id int, payload binary"


def header(entries: int) -> bytes:
    return MAGIC + struct.pack(">BI", VERSION, entries)


def entry(path: str, original: int, strategy: int, payload: bytes) -> bytes:
    name = path.encode()
    if len(name) > 65535:
        raise ValueError("a path of more than 65535 bytes")
    return struct.pack(">H", len(name)) + name + struct.pack(">qqB", original, len(payload), strategy) + payload


def entries(stream) -> Iterator[tuple[str, int, int, bytes]]:
    def read(n: int) -> bytes:
        got = stream.read(n)
        if len(got) != n:
            raise ValueError("an archive ends early")
        return got

    if read(4) != MAGIC:
        raise ValueError("not an archive")
    version, count = struct.unpack(">BI", read(5))
    if version != VERSION:
        raise ValueError(f"archive version {version}")
    for _ in range(count):
        path = read(struct.unpack(">H", read(2))[0]).decode()
        original, stored, strategy = struct.unpack(">qqB", read(17))
        if original < 0 or stored < 0:
            raise ValueError("a negative size")
        yield path, original, strategy, read(stored)


def safe_path(path: str) -> PurePosixPath:
    """path below the folder that an archive is unpacked to; others raise."""
    p = PurePosixPath(path.replace("\\", "/"))
    if p.is_absolute() or ".." in p.parts or not p.parts:
        raise ValueError(f"an entry outside the archive's folder: {path}")
    return p


@dataclass
class FilePart(InputPartition):
    file: str


@dataclass
class Written(WriterCommitMessage):
    draft: str
    final: str


BATCH_BYTES = 4 << 20
_ROWS = pa.schema([("path", pa.string()), ("original_size", pa.int64()), ("strategy_id", pa.int32()), ("payload", pa.binary())])


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _archives(files: fs.FileSystem, path: str) -> list[str]:
    if files.get_file_info(path).type != fs.FileType.Directory:
        return [path]
    return sorted(f.path for f in files.get_file_info(fs.FileSelector(path)) if f.is_file and f.path.endswith(".wzip"))


def _put(files: fs.FileSystem, path: str, rows) -> int:
    """Writes an archive of rows (path, original_size, strategy_id, payload); their number."""
    body, n = f"{path}.body", 0
    with files.open_output_stream(body, compression=None) as out:
        for name, original, strategy, payload in rows:
            out.write(entry(name, original, strategy, bytes(payload)))
            n += 1
    with files.open_output_stream(path, compression=None) as out, files.open_input_stream(body, compression=None) as entries_:
        out.write(header(n))
        while part := entries_.read(BATCH_BYTES):
            out.write(part)
    files.delete_file(body)
    return n


class WzipReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [FilePart(f) for f in _archives(*file_system(self.path))]

    def read(self, partition: FilePart):
        files, held, size = file_system(self.path)[0], [], 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ROWS, strict=True)], schema=_ROWS)
        with files.open_input_stream(partition.file, compression=None) as stream:
            for row in entries(stream):
                held.append(row)
                size += len(row[3])
                if size > BATCH_BYTES or len(held) >= 2000:
                    yield make()
                    held, size = [], 0
        if held:
            yield make()


class WzipWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        files, path = file_system(self.path)
        files.create_dir(path, recursive=True)
        final = f"{path}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.wzip"
        draft = f"{final}.draft"
        _put(files, draft, ((r["path"], r["original_size"], r["strategy_id"], r["payload"]) for r in rows))
        return Written(draft, final)

    def commit(self, messages) -> None:
        files, path = file_system(self.path)
        if self.overwrite and files.get_file_info(path).type == fs.FileType.Directory:
            for f in _archives(files, path):
                files.delete_file(f)
        for m in messages:
            if m is not None:
                files.move(m.draft, m.final)

    def abort(self, messages) -> None:
        files, _ = file_system(self.path)
        for m in messages:
            if m is not None and files.get_file_info(m.draft).type == fs.FileType.File:
                files.delete_file(m.draft)


class WzipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wzip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WzipReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WzipWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WzipSource)


def write_archive(rows: DataFrame, file: str) -> int:
    """One archive of rows (path, original_size, strategy_id, payload) in path order; the number of entries.

    Rows stream to the driver a partition at a time, as one file can have one writer only.
    """
    files, path = file_system(file)
    draft = f"{path}.draft"
    n = _put(files, draft, (tuple(r) for r in rows.select("path", "original_size", "strategy_id", "payload").orderBy("path").toLocalIterator()))
    if not n:
        files.delete_file(draft)
        raise ValueError("no files to archive")
    files.move(draft, path)
    return n


def put_files(rows: DataFrame, folder: str, path: str = "path", content: str = "content") -> DataFrame:
    """Writes each row's content (null is passed over) below folder, on a store that executors share; path, bytes, error.

    A file is written under another name and renamed when whole; a row that can't be written has its error.
    """

    def run(frames):
        files, root = file_system(folder)
        for f in frames:
            size, error = [], []
            for name, data in zip(f["path"], f["content"], strict=True):
                try:
                    to = f"{root}/{safe_path(name)}"
                    if data is not None:
                        files.create_dir(to.rpartition("/")[0], recursive=True)
                        draft = f"{to}.{uuid.uuid4().hex}.draft"
                        with files.open_output_stream(draft, compression=None) as out:
                            out.write(bytes(data))
                        files.move(draft, to)
                    size.append(None if data is None else len(data))
                    error.append(None)
                except (ValueError, OSError) as e:
                    size.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield f.assign(bytes=size, error=error)[["path", "bytes", "error"]].astype({"bytes": "Int64"})

    return rows.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, bytes long, error string")


def extract(rows: DataFrame, folder: str) -> DataFrame:
    """put_files of unpacked rows (path, content); paths that leave the folder raise."""
    got = put_files(rows, folder)
    return got.select("path", F.when(F.col("error").isNotNull(), F.raise_error("error").cast("long")).otherwise(F.col("bytes")).alias("bytes"))
