"""Byte-level scanning shared by the text operators.

Texts arrive as Arrow batches and are scanned as numpy byte arrays, a quarter of a megabyte at a time, so the memory of a
Python worker is bounded by one batch plus a constant, however long the texts are.  Words, lines and windows are
told apart by 64-bit hashes: two of n different strings collide with probability below n*n/2**65.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
PIECE = 1 << 18  # bytes scanned at a time
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20  # of the Arrow batches that Python workers hold
GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def keys(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(GOLDEN) + U(seed)) | U(1)


_BASE = 0x5851F42D4C957F2D | 1
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = keys(256, 11)
WORD_BYTE = np.where(IS_SPACE, U(0), _BYTE)
LOWER_BYTE = WORD_BYTE[LOWER]
LINE_BYTE = _BYTE.copy()
LINE_BYTE[10] = U(0)
WINDOW = keys(64, 23)
_pow: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if "n" not in _pow or len(_pow["n"]) < n:
        size = max(n, PIECE + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for name, base in (("n", _BASE), ("inv", inverse)):
                x = np.full(size, base, dtype=U)
                x[0] = 1
                _pow[name] = np.multiply.accumulate(x)
    return _pow["n"], _pow["inv"]


class Piece:
    """Consecutive whole texts of a batch: rows lo..hi, their bytes, and the offsets of each text in them."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offs: np.ndarray):
        self.lo, self.hi, self.data, self.offs = lo, hi, data, offs

    def words(self) -> None:
        """Sets start, end (exclusive), row (from lo) of each word and first, the number of words before each text."""
        solid = ~IS_SPACE[self.data]
        n = len(solid)
        begins = np.zeros(n + 1, bool)
        begins[self.offs] = True
        edge = begins[:n].copy()
        edge[1:] |= ~solid[:-1]
        if n:
            edge[0] = True
        self.start = np.flatnonzero(solid & edge)
        last = begins[1 : n + 1].copy()
        last[:-1] |= ~solid[1:]
        if n:
            last[-1] = True
        self.end = np.flatnonzero(solid & last) + 1
        self.first = np.searchsorted(self.start, self.offs)
        self.row = np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))

    def lines(self) -> None:
        """Sets line_start, line_end, line_row and line_first for texts cut at every \\n; an empty text is one empty line."""
        n = len(self.data)
        cuts = np.flatnonzero(self.data == 10)
        row = np.searchsorted(self.offs, cuts, "right") - 1
        starts = np.concatenate([self.offs[:-1], cuts + 1])
        owner = np.concatenate([np.arange(self.hi - self.lo), row])
        order = np.lexsort((starts, owner))
        self.line_start, self.line_row = starts[order], owner[order]
        following = np.append(self.line_start[1:], n)
        closes = np.append(self.line_row[1:] != self.line_row[:-1], True) if len(self.line_row) else np.zeros(0, bool)
        self.line_end = np.where(closes, self.offs[1:][self.line_row], following - 1)
        self.line_first = np.searchsorted(self.line_row, np.arange(self.hi - self.lo + 1))


_caches: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """A dictionary that lasts in a Python worker until it works for another owner (see ``pieces``)."""
    return _caches.setdefault(owner, {})


def pieces(column: pa.Array, limit: int = PIECE, owner: str = "") -> Iterator[Piece]:
    """Cuts a batch of texts (null counts as empty) into pieces of about ``limit`` bytes, each of whole texts.

    Workers serve one stage after another: what other owners have cached is dropped first.
    """
    for name, held in _caches.items():
        if name != owner:
            held.clear()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Piece(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi
    release()


def release() -> None:
    """Gives freed memory back to the system, so that workers which wait between tasks are small."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):
    _trim = None


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray, gaps: bool = False) -> np.ndarray:
    """A hash for each non-empty span start..end of data; table holds a key for each byte.

    gaps: bytes between spans may have keys other than 0."""
    out = np.zeros(len(start), U)
    k = 0
    with np.errstate(over="ignore"):
        while k < len(start):
            a = int(start[k])
            to = int(np.searchsorted(end, a + PIECE, "right"))
            if to <= k:  # one span that is longer than a piece
                total, at = 0, a
                while at < end[k]:
                    part = data[at : min(at + PIECE, int(end[k]))]
                    p, _ = powers(PIECE)
                    total = (total + int((table[part] * p[: len(part)]).sum(dtype=U)) * pow(_BASE, at - a, 1 << 64)) % (1 << 64)
                    at += PIECE
                out[k] = U(total)
                k += 1
                continue
            s = start[k:to] - a
            part = data[a : int(end[to - 1])]
            p, inv = powers(len(part) + 1)
            x = table[part] * p[: len(part)]
            if gaps:
                both = np.stack([s, end[k:to] - a], 1).ravel()
                out[k:to] = np.add.reduceat(np.append(x, U(0)), both)[::2] * inv[s]
            else:
                out[k:to] = np.add.reduceat(x, s) * inv[s]
            k = to
        return mix(out + (end - start).astype(U) * U(GOLDEN))


def windows_hash(words: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start indices and hashes of the windows of k words that lie within one text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), U)
        for i in range(k):
            total += words[at + i] * WINDOW[i]
        return at, mix(total)


def crc_rest(column: pa.Array, m: int) -> np.ndarray:
    """crc32 of each id's decimal text, modulo m; a null id counts as an empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if v is None else str(v).encode()) % m for v in column.to_pylist()], np.int64)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it, and bounds the batches that they hold.

    Rows of whole texts are large: Spark's 10000 of them would be tens of megabytes on both sides of the pipe.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        option = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(option)
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(option, str(most))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="pagepress-")
        atexit.register(shutil.rmtree, found[7:], True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_tables: dict[str, SparkSession] = {}  # staged tables that are still there


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, and survives lost executors.

    The write's shuffle files are let go with it, as nothing reads them again.  The table is there until ``drop``, the
    end of a ``scratch`` block around, or the end of the program.
    """
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(option, None)
    spark.conf.set(option, "true")
    if not _tables:
        atexit.register(_drop, _tables)
    _tables[path] = spark
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(option, before) if before is not None else spark.conf.unset(option)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    _drop([df._staged_at for df in tables])


def _drop(paths) -> None:
    for path in list(paths):
        if spark := _tables.pop(path, None):
            try:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            except (Py4JError, OSError):  # the session has ended before
                return


@contextlib.contextmanager
def scratch():
    """Tables that are staged within the block are dropped at its end; its results must be written or collected by then."""
    before = set(_tables)
    try:
        yield
    finally:
        _drop([x for x in _tables if x not in before])


BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: int = 64, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, a staged table, marked for broadcast if its rows take at most ``most`` bytes; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def line_mask(at: str) -> Column:
    """From a column of sorted line numbers (from 0) an array that is true at each of them; looked up in constant time."""
    gap = lambda x, k: (x - F.coalesce(F.get(at, k - 1), F.lit(-1)) - 1).cast("int")
    return F.flatten(F.transform(at, lambda x, k: F.concat(F.array_repeat(F.lit(False), gap(x, k)), F.array(F.lit(True)))))


def without_lines(text: Column | str, mask: str) -> Column:
    """text without the lines where mask is true."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.coalesce(F.get(mask, i), F.lit(False))), "\n")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in columns.items()], schema=schema)
