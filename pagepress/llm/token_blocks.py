"""Token-ID output in patched frame-of-reference blocks.

A file is a run of segments.  A segment has, little-endian: 8 bytes of magic, four u64 (documents, ids, blocks,
payload bytes), the documents' ids (i64) and whether each is set (u8), their lengths (u32, end id included), the
start of each block in the payload (u32, the block index), and the payload.  A block holds 128 ids (the last is
padded): minimum (u32), width (u8), number of exceptions (u8), 4*width words (u32) with the ids less the minimum
packed at that width, then for each exception its place (u8) and its whole difference (u32).  The width is that of
the block's 90th percentile; what needs more bits is an exception.

Ids are in ascending order of doc_id over the files, which range partitions make; each is written under another name
and renamed when whole, so a task that runs again leaves one file.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import LOWER_BYTE, U, batch, cache, fresh, pieces, ship, spans_hash, table

MAGIC = b"PFORSEG1"
BLOCK = 128
PERCENT = 90
SEGMENT_IDS = 1 << 18
END = 2
CACHED_WORDS = 400_000
LEAST_BITS, SLOT_SHIFTS = 16, (42, 20)  # slots: two places of at most 22 bits in a word's hash
_MARK = re.compile(rb"[\xcc\xcd]")  # lead bytes of combining marks
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True



def bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def encode(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The block index and the payload of ids (unsigned 32-bit)."""
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint32), b""
    x = np.full(blocks * BLOCK, ids[-1], np.uint64)
    x[: len(ids)] = ids
    x = x.reshape(blocks, BLOCK)
    low = x.min(1)
    x -= low[:, None]
    width = bits(np.partition(x, BLOCK * PERCENT // 100, axis=1)[:, BLOCK * PERCENT // 100])
    odd = (x >> width[:, None].astype(np.uint64)) > 0
    n_odd = odd.sum(1)
    size = 6 + 16 * width + 5 * n_odd
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(at[-1]), np.uint8)
    head = np.zeros((blocks, 6), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5] = width, n_odd
    out[at[:-1, None] + np.arange(6)] = head
    for w in np.unique(width[width > 0]):
        g = np.flatnonzero(width == w)
        v = x[g] & np.uint64((1 << int(w)) - 1)
        packed = np.zeros((len(g), 4 * int(w)), np.uint64)
        for i in range(BLOCK):
            word, off = divmod(i * int(w), 32)
            moved = v[:, i] << np.uint64(off)
            packed[:, word] |= moved & np.uint64(0xFFFFFFFF)
            if off + w > 32:
                packed[:, word + 1] |= moved >> np.uint64(32)
        out[at[g][:, None] + 6 + np.arange(16 * int(w))] = packed.astype("<u4").view(np.uint8).reshape(len(g), -1)
    b, place = np.nonzero(odd)
    if len(b):
        rank = np.arange(len(b)) - np.concatenate([[0], np.cumsum(n_odd)])[b]
        where = at[b] + 6 + 16 * width[b] + 5 * rank
        out[where] = place
        out[where[:, None] + 1 + np.arange(4)] = x[b, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return at[:-1].astype(np.uint32), out.tobytes()


def decode(index: np.ndarray, payload: bytes, n: int) -> np.ndarray:
    data, at = np.frombuffer(payload, np.uint8), index.astype(np.int64)
    if not len(at):
        return np.zeros(0, np.uint32)
    low = np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<u4").ravel().astype(np.uint64)
    width, n_odd = data[at + 4].astype(np.int64), data[at + 5].astype(np.int64)
    x = np.zeros((len(at), BLOCK), np.uint64)
    for w in np.unique(width[width > 0]):
        g = np.flatnonzero(width == w)
        packed = np.ascontiguousarray(data[at[g][:, None] + 6 + np.arange(16 * int(w))]).view("<u4").astype(np.uint64)
        mask, v = np.uint64((1 << int(w)) - 1), np.zeros((len(g), BLOCK), np.uint64)
        for i in range(BLOCK):
            word, off = divmod(i * int(w), 32)
            got = packed[:, word] >> np.uint64(off)
            if off + w > 32:
                got = got | (packed[:, word + 1] << np.uint64(32 - off))
            v[:, i] = got & mask
        x[g] = v
    if n_odd.any():
        b = np.repeat(np.arange(len(at)), n_odd)
        rank = np.arange(len(b)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
        where = at[b] + 6 + 16 * width[b] + 5 * rank
        x[b, data[where].astype(np.int64)] = np.ascontiguousarray(data[where[:, None] + 1 + np.arange(4)]).view("<u4").ravel()
    return (x + low[:, None]).ravel()[:n].astype(np.uint32)


def segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    index, payload = encode(ids)
    head = np.array([len(doc_ids), len(ids), len(index), len(payload)], "<u8").tobytes()
    return b"".join([MAGIC, head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is not None for x in doc_ids], np.uint8).tobytes(), lengths.astype("<u4").tobytes(), index.astype("<u4").tobytes(), payload])


def segments(stream):
    """(doc ids, lengths, ids) of each segment of a file."""
    while magic := stream.read(8):
        if magic != MAGIC:
            raise ValueError("not a token file")
        docs, n, blocks, size = (int(x) for x in np.frombuffer(stream.read(32), "<u8"))
        ids, known = np.frombuffer(stream.read(8 * docs), "<i8"), np.frombuffer(stream.read(docs), np.uint8)
        lengths, index = np.frombuffer(stream.read(4 * docs), "<u4"), np.frombuffer(stream.read(4 * blocks), "<u4")
        payload = stream.read(size)
        if len(payload) != size:
            raise ValueError("a token file ends early")
        yield [int(x) if k else None for x, k in zip(ids, known, strict=True)], lengths, decode(index, payload, n)


class WordTokenizer:
    """Encodes texts by their ASCII-space-separated words, each encoded by the tokenizers library once and remembered.

    That gives the library's ids of the whole text for tokenizers whose normalizer and pre-tokenizer never join what
    such a space parts, and drop the space, like the lower-casing word-end BPE that is used here (tested against it).
    As that pre-tokenizer parts letters from commas and full stops and its normalizer lower-cases, words are looked up
    in ASCII lower case and without a comma or stop after a letter.  Texts with combining marks, whose composition
    depends on case, or with what may be a special token go to the library whole, as do all texts for tokenizers of
    another kind.  Remembered words are found by a 64-bit hash and their length, in a table of two slots a word; the first CACHED_WORDS
    are remembered, in tables that grow with them, and others are encoded by the library each time.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        vocab = self.tok.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.folds = "Lowercase" in spec and "</w>" in spec
        self.bits, self.used, self.pool, self.filled = LEAST_BITS, 1, np.zeros(1 << LEAST_BITS, np.uint32), 0
        self.key, (self.bytes, self.at, self.n) = np.zeros(0, U), (np.zeros(0, np.int32) for _ in range(3))
        self.grow()

    def library(self, words: list[bytes]) -> list[np.ndarray]:
        """The library's ids of each word. Words of letters are one run each, which ends with the one id that closes a word."""
        texts = [w.decode() for w in words]
        out: list = [None] * len(words)
        plain = [i for i, t in enumerate(texts) if t.isalpha() and (t.isascii() or unicodedata.is_normalized("NFC", t))]
        for lo in range(0, len(plain), 2000):
            some = plain[lo : lo + 2000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(texts[i] for i in some)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.closes[ids]) + 1
            if len(cut) == len(some) and cut[-1] == len(ids):
                for i, x in zip(some, np.split(ids, cut[:-1]), strict=True):
                    out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def grow(self) -> None:
        """Twice as many slots, and room for a word in every fourth of them."""
        self.bits += 1
        more = (1 << self.bits) // 4 - len(self.key)
        self.key, self.bytes, self.at, self.n = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.key, self.bytes, self.at, self.n))
        self.slots, left = np.zeros(1 << self.bits, np.int32), np.arange(1, self.used, dtype=np.int32)
        for shift in SLOT_SHIFTS:
            slot = (self.key[left] >> U(shift)) & U((1 << self.bits) - 1)
            free = self.slots[slot] == 0
            self.slots[slot[free]] = left[free]
            left = left[self.slots[slot] != left]

    def find(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entries of words by hash and length; 0 for words that aren't remembered."""
        out = np.zeros(len(h), np.int64)
        for shift in SLOT_SHIFTS:
            got = self.slots[(h >> U(shift)) & U((1 << self.bits) - 1)]
            out = np.where((got > 0) & (self.key[got] == h) & (self.bytes[got] == size), got, out)
        return out

    def keep(self, h: int, size: int, at: int, n: int) -> None:
        if self.used >= CACHED_WORDS:
            return
        if self.used >= len(self.key):
            self.grow()
        for shift in SLOT_SHIFTS:
            slot = (h >> shift) & ((1 << self.bits) - 1)
            if not self.slots[slot]:
                self.slots[slot] = e = self.used
                self.key[e], self.bytes[e], self.at[e], self.n[e] = h, size, at, n
                self.used += 1
                return

    def add(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Appends to the pool; where each begins, and its number of ids."""
        n = np.array([len(x) for x in ids], np.int64)
        total = int(n.sum())
        while self.filled + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + total] = np.concatenate(ids) if ids else []
        at = self.filled + np.cumsum(n) - n
        self.filled += total
        return at, n

    def encode(self, p, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a piece, each closed by end, and the number of each text's."""
        raw = p.data.tobytes()
        if not self.folds or b"<|" in raw or _MARK.search(raw):
            each = [self.tok.encode_batch_fast([raw[a:z].decode()], add_special_tokens=False)[0].ids + [end] for a, z in zip(p.offs[:-1], p.offs[1:], strict=True)] if not self.folds else self.apart(p, raw, end)
            return np.concatenate([np.array(x, np.uint32) for x in each]), np.array([len(x) for x in each], np.int64)
        p.words()
        # Units: words without a comma or stop after a letter, then that on its own.
        last, before = p.data[p.end - 1], p.data[np.maximum(p.end - 2, 0)]
        cut = ((last == 44) | (last == 46)) & (p.end - p.start > 1) & _LETTER[before]
        place = np.arange(len(cut)) + np.cumsum(cut) - cut
        start, stop = np.zeros(len(cut) + int(cut.sum()), np.int64), np.zeros(len(cut) + int(cut.sum()), np.int64)
        start[place], stop[place] = p.start, p.end - cut
        start[place[cut] + 1], stop[place[cut] + 1] = p.end[cut] - 1, p.end[cut]
        first = np.append(place, len(start))[p.first]
        h, size = spans_hash(p.data, start, stop, LOWER_BYTE), stop - start
        entry = self.find(h, size)
        at, n = self.at[entry], self.n[entry]
        new = np.flatnonzero(entry == 0)
        if len(new):
            mark = self.filled
            _, one, which = np.unique(h[new] + size[new].astype(U), return_index=True, return_inverse=True)
            low = raw.lower()
            ids = self.library([low[start[i] : stop[i]] for i in new[one].tolist()])
            where, many = self.add(ids)
            at[new], n[new] = where[which], many[which]
            used = self.used
            for i, a, m in zip(new[one].tolist(), where.tolist(), many.tolist(), strict=True):
                self.keep(int(h[i]), int(size[i]), a, m)
        # Every text's end is a unit too.
        tail, _ = self.add([np.array([end], np.uint32)])
        at, n = np.insert(at, first[1:], tail[0]), np.insert(n, first[1:], 1)
        bounds = np.concatenate([[0], np.cumsum(n)])
        out = self.pool[np.repeat(at - bounds[:-1], n) + np.arange(bounds[-1])]
        self.filled -= 1
        if len(new) and self.used == used:
            self.filled = mark
        offs = bounds[first + np.arange(len(first))]
        return out, np.diff(offs)

    def apart(self, p, raw: bytes, end: int) -> list:
        """Each text of a piece: those that the library must see whole, and the others as pieces of their own."""
        from .core import Piece

        out = []
        for i, (a, z) in enumerate(zip(p.offs[:-1].tolist(), p.offs[1:].tolist(), strict=True)):
            if b"<|" in raw[a:z] or _MARK.search(raw[a:z]):
                out.append(self.tok.encode_batch_fast([raw[a:z].decode()], add_special_tokens=False)[0].ids + [end])
            else:
                out.append(self.encode(Piece(i, i + 1, p.data[a:z], np.array([0, z - a])), end)[0])
        return out


def tokenizer(spec: str) -> WordTokenizer:
    held, key = cache("tokens"), hash(spec)
    if key not in held:
        held.clear()
        held[key] = WordTokenizer(spec)
    return held[key]


def _files(uri: str):
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, end: int = END) -> list[tuple[str, int]]:
    """Writes the ids of all rows of docs in ascending doc_id (null first; then by a hash of the text); the files in order, with their numbers of ids.

    A null or empty text has the end id alone; repeated rows are written each.  The list has an entry for each
    partition.  The tokenizer's file is read by the driver and sent to the executors.
    """
    spark = docs.sparkSession
    with open(tokenizer_file) as f:
        spec = spark.sparkContext.broadcast(f.read())

    def write(batches):
        from pyspark import TaskContext

        tok, part = tokenizer(spec.value), TaskContext.get().partitionId()
        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        name, draft = f"{path}/part-{part:07d}.pfor", f"{path}/.draft-{part}-{uuid.uuid4().hex}"
        total, held, ids, lengths, out = 0, 0, [], [], None

        def close():
            nonlocal out, total
            if out is None:
                out = files.open_output_stream(draft, compression=None)
            flat = np.concatenate(ids)
            out.write(segment(names[: len(names)], np.concatenate(lengths), flat))
            total += len(flat)

        names: list[int | None] = []
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for p in pieces(b.column(1), owner="tokens"):
                got, n = tok.encode(p, end)
                names += doc_ids[p.lo : p.hi]
                ids.append(got)
                lengths.append(n)
                held += len(got)
                if held >= SEGMENT_IDS:
                    close()
                    names, held, ids, lengths = [], 0, [], []
        if names:
            close()
        if out is not None:
            out.close()
            files.move(draft, name)
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n": [total]})

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    # The hash parts rows of one id, so that no task must take them all.
    dealt = base.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    rows = dealt.mapInArrow(write, "part long, file string, n long").collect()
    scheme = folder[: folder.index("://") + 3] if "://" in folder else ""
    return [(scheme + r["file"] if scheme == "file://" else f"{folder}/{r['file'].rpartition('/')[2]}", r["n"]) for r in sorted(rows, key=lambda r: r["part"])]


def read_token_files(spark: SparkSession, listed: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; start counts the ids of all before it."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, path = _files(name)
                with files.open_input_stream(path, compression=None) as stream:
                    for doc_ids, lengths, ids in segments(stream):
                        cut = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                        raw = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
                        yield batch(schema, doc_id=doc_ids, start=at + cut[:-1], n_tokens=lengths.astype(np.int64), ids_crc32=crc)
                        at += len(ids)

    starts = np.concatenate([[0], np.cumsum([n for _, n in listed])]).astype(int).tolist()
    rows = [(name, at) for (name, _), at in zip(listed, starts, strict=False)]
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    kind = StructType([StructField("file", StringType()), StructField("at", LongType())])
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), kind)
    return frame.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """Writes docs as token files in the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32 of every row.

    Null and empty texts have the end id alone; a null doc_id comes first; rows of one id are in the order of their
    texts' hashes; very long texts are one segment; an empty table gives no rows; other columns are ignored.
    """
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("word_bpe_49k.json")
    folder = fresh(spark, "tokens")
    return read_token_files(spark, write_token_files(docs, folder if "://" in folder else folder.replace("file:/", "/"), tokenizer_file))


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: token_output of docs, odd rows and tables as there."""
    ship(spark)
    return token_output(spark, docs)
