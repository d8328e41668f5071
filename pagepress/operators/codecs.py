"""Byte codecs, and the Arrow-batched functions that run them over a column.

Each codec is a pair of plain functions on bytes, so that it can be tested without Spark; ``CODECS`` is the registry
that user codecs join too.  Empty input gives empty output.  A payload that can't be decoded raises ValueError.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dims import DICTIONARY, FIRST_TOKEN

# Raw deflate: BROT, then the stream.


def deflate(data: bytes, level: int = 9) -> bytes:
    if not data:
        return b""
    c = zlib.compressobj(min(9, max(1, level)), zlib.DEFLATED, -15)
    return b"BROT" + c.compress(data) + c.flush()


def inflate(payload: bytes) -> bytes:
    if not payload:
        return b""
    if payload[:4] != b"BROT":
        raise ValueError("not a deflate payload")
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(payload[4:]) + d.flush()
    except zlib.error as e:
        raise ValueError(f"a damaged deflate payload: {e}") from e
    if not d.eof:
        raise ValueError("a deflate payload ends early")
    return out


# Dictionary tokens: WDCT, version 1, then tokens.

_BY_FIRST: dict[int, list[tuple[bytes, int]]] = {}
for _i, _s in sorted(enumerate(DICTIONARY), key=lambda x: -len(x[1])):
    _BY_FIRST.setdefault(ord(_s[0]), []).append((_s.encode(), FIRST_TOKEN + _i))


def webdict(data: bytes) -> bytes:
    if not data:
        return b""
    out, at = bytearray(b"WDCT\x01"), 0
    while at < len(data):
        b = data[at]
        for seed, token in _BY_FIRST.get(b, ()):
            if data.startswith(seed, at):
                out.append(token)
                at += len(seed)
                break
        else:
            out += bytes((0xFF, 0, b)) if b >= 0x80 else bytes((b,))
            at += 1
    return bytes(out)


def unwebdict(payload: bytes) -> bytes:
    if not payload:
        return b""
    if payload[:4] != b"WDCT" or len(payload) < 5:
        raise ValueError("not a dictionary payload")
    out, at = bytearray(), 5
    while at < len(payload):
        b = payload[at]
        if b == 0xFF:
            if at + 2 >= len(payload):
                raise ValueError("a dictionary payload ends early")
            out.append(payload[at + 2])
            at += 3
        else:
            if b < 0x80:
                out.append(b)
            elif b - FIRST_TOKEN < len(DICTIONARY):
                out += DICTIONARY[b - FIRST_TOKEN].encode()
            else:
                raise ValueError(f"no dictionary entry {b}")
            at += 1
    return bytes(out)


# Huffman: HUFF, a count byte (0 stands for 256), 256 frequencies (u64), bits from the least significant on.


class Leaf(NamedTuple):
    symbol: int


def huffman_codes(counts: dict[int, int]) -> dict[int, str]:
    """Codes by repeated merging of the two least (count, lowest symbol): 0 to the left, 1 to the right."""
    if len(counts) == 1:
        return {next(iter(counts)): "0"}
    heap = [(n, s, Leaf(s)) for s, n in counts.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        (n, s, a), (m, t, b) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (n + m, min(s, t), (a, b)))
    codes: dict[int, str] = {}
    todo = [(heap[0][2], "")] if heap else []
    while todo:
        node, code = todo.pop()
        if isinstance(node, Leaf):
            codes[node.symbol] = code
        else:
            todo += [(node[1], code + "1"), (node[0], code + "0")]
    return codes


STEP = 1 << 16  # symbols packed, or bits looked up, at a time


class _Packer:
    """Appends fields of bits, least significant first, to bytes; numpy does a field's bits for many fields at once."""

    def __init__(self):
        self.left, self.out = np.zeros(0, np.uint8), []

    def add(self, table: np.ndarray, size: np.ndarray) -> None:
        """Rows of a table of bits, and how many of each row count."""
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first, size)
        bits = np.concatenate([self.left, table[np.repeat(np.arange(len(size)), size), at]])
        whole = len(bits) // 8 * 8
        self.out.append(np.packbits(bits[:whole], bitorder="little").tobytes())
        self.left = bits[whole:]

    def bytes(self) -> bytes:
        return b"".join(self.out) + np.packbits(self.left, bitorder="little").tobytes()


def _encode(data: bytes, codes: dict[int, str], stop: int | None = None) -> bytes:
    most = max(map(len, codes.values()))
    table, size = np.zeros((max(codes) + 1, most), np.uint8), np.zeros(max(codes) + 1, np.int64)
    for s, c in codes.items():
        table[s, : len(c)], size[s] = np.frombuffer(c.encode(), np.uint8) - 48, len(c)
    raw, packer = np.frombuffer(data, np.uint8), _Packer()
    for lo in range(0, len(raw), STEP):
        x = raw[lo : lo + STEP]
        packer.add(table[x], size[x])
    if stop is not None:
        packer.add(table[[stop]], size[[stop]])
    return packer.bytes()


def _peeks(data: bytes, lo: int, n: int, width: int) -> list[int]:
    """The next width (16 at most) bits from each bit lo..lo+n of data on, with zeros after its end."""
    part = data[lo >> 3 : (lo + n >> 3) + 4]
    b = np.frombuffer(part + bytes(4), np.uint8).astype(np.uint32)
    at = np.arange(lo & 7, (lo & 7) + n)
    k = at >> 3
    return ((b[k] | b[k + 1] << 8 | b[k + 2] << 16) >> (at & 7) & ((1 << width) - 1)).tolist()


def _decode(data: bytes, codes: dict[int, str], total: int | None = None, stop: int | None = None) -> bytes:
    """Symbols until there are total or one is stop. A table gives all whole codes of the next bits at once."""
    width = 12 if len(data) > 1 << 14 else 8
    inverse, longest = {c: s for s, c in codes.items()}, max(map(len, codes.values()))
    one: list[tuple[int, int] | None] = [None] * (1 << width)
    for s, c in codes.items():
        if len(c) <= width and s != stop:
            for k in range(int(c[::-1], 2), 1 << width, 1 << len(c)):
                one[k] = (s, len(c))
    runs, used = [], []
    for k in range(1 << width):
        at, got = 0, []
        while (x := one[k >> at]) and at + x[1] <= width:
            got.append(x[0])
            at += x[1]
        runs.append(bytes(got))
        used.append(at)
    out, at, end = bytearray(), 0, 8 * len(data)
    while at < end and (total is None or len(out) < total):
        peeks, base = _peeks(data, at, min(STEP, end - at), width), at
        while at - base < len(peeks) and (total is None or len(out) < total):
            k = peeks[at - base]
            if used[k]:
                out += runs[k]
                at += used[k]
                continue
            code = ""  # stop, or longer than the table's
            while code not in inverse:
                if at >= end or len(code) > longest:
                    raise ValueError("a payload of codes ends early")
                code += "1" if data[at >> 3] >> (at & 7) & 1 else "0"
                at += 1
            if inverse[code] == stop:
                return bytes(out)
            out.append(inverse[code])
    if total is None or len(out) < total:
        raise ValueError("a payload of codes ends early")
    return bytes(out[:total])


def huffman(data: bytes) -> bytes:
    if not data:
        return b""
    counts = Counter(data)
    head = struct.pack(">256Q", *(counts.get(b, 0) for b in range(256)))
    return b"HUFF\x00" + head + _encode(data, huffman_codes(counts))


def unhuffman(payload: bytes) -> bytes:
    if not payload:
        return b""
    if payload[:4] != b"HUFF" or len(payload) < 2053:
        raise ValueError("not a Huffman payload")
    counts = {i: n for i, n in enumerate(struct.unpack(">256Q", payload[5:2053])) if n}
    total, codes = sum(counts.values()), huffman_codes(counts)
    if sum(n * len(codes[s]) for s, n in counts.items()) > 8 * (len(payload) - 2053):
        raise ValueError("a Huffman payload ends early")
    return _decode(payload[2053:], codes, total)


# Canonical Huffman, framed: 257 code lengths of a byte each (symbol 256 ends the stream), then bits.

SYMBOLS, STOP = 257, 256


def canonical_lengths(counts: dict[int, int]) -> list[int]:
    """Depth of every symbol of the tree by (count, lowest symbol); padded to two symbols; 0 where unused."""
    padded = {s: n for s, n in counts.items() if n}
    for s in range(SYMBOLS):
        if len(padded) >= 2:
            break
        padded.setdefault(s, 0)
    codes = huffman_codes(padded)
    return [len(codes.get(s, "")) for s in range(SYMBOLS)]


def check_lengths(lengths: list[int]) -> None:
    """Raises unless the lengths make a complete code (Kraft sum 1)."""
    if any(n < 0 for n in lengths) or sum(n > 0 for n in lengths) < 2:
        raise ValueError("a canonical code needs two symbols and no negative length")
    most = max(lengths)
    total = sum(1 << (most - n) for n in lengths if n)
    if total != 1 << most:
        raise ValueError("under-full code" if total < 1 << most else "over-full code")


def canonical_codes(lengths: list[int]) -> dict[int, str]:
    """Codes in order of (length, symbol), counted upwards."""
    check_lengths(lengths)
    codes, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        codes[s] = format(code, f"0{n}b")
        code, before = code + 1, n
    return codes


def canonical(data: bytes) -> bytes:
    if not data:
        return b""
    lengths = canonical_lengths(Counter(data) | Counter({STOP: 1}))
    if max(lengths) > 255:
        raise ValueError("a code length of more than a byte")
    return bytes(lengths) + _encode(data, canonical_codes(lengths), STOP)


def uncanonical(payload: bytes) -> bytes:
    if not payload:
        return b""
    if len(payload) < SYMBOLS:
        raise ValueError("not a canonical payload")
    return _decode(payload[SYMBOLS:], canonical_codes(list(payload[:SYMBOLS])), stop=STOP)


# LZ77: LZ77, window (u16), lookahead (u8, 0 stands for 256), length (u32), little-endian, then bits.

WINDOW, LOOKAHEAD, SHORTEST = 4096, 256, 3
BLOCK = 16  # bytes compared at a time


class Token(NamedTuple):
    pos: int
    literal: int | None
    offset: int
    length: int


def lz77_tokens(data: bytes, window: int = WINDOW, lookahead: int = LOOKAHEAD) -> Iterator[Token]:
    """Greedy tokens; of the longest matches the farthest.

    Each search is for a match longer than the best so far, from the left of the window on, so the first one found is the farthest of its length.
    """
    lookahead = min(lookahead, 258)
    if not 1 <= window <= 65535:
        raise ValueError("the window must fit 16 bits")
    at, n = 0, len(data)
    while at < n:
        best, where, most = SHORTEST - 1, 0, min(lookahead, n - at)
        c = max(0, at - window) - 1
        while best < most and (c := data.find(data[at : at + best + 1], c + 1, at + best)) >= 0:
            best, where = best + 1, c
            while best + BLOCK <= most and data[c + best : c + best + BLOCK] == data[at + best : at + best + BLOCK]:
                best += BLOCK
            while best < most and data[c + best] == data[at + best]:
                best += 1
        if best >= SHORTEST:
            yield Token(at, None, at - where - 1, best)
            at += best
        else:
            yield Token(at, data[at], 0, 1)
            at += 1


def _width(n: int) -> int:
    return max(1, (n - 1).bit_length())


def lz77(data: bytes, window: int = WINDOW, lookahead: int = LOOKAHEAD) -> bytes:
    """Literals take 1+8 bits, matches 1, the offset's and the length's (less one), least significant first."""
    if not data:
        return b""
    lookahead = min(lookahead, 256)
    wide, long = _width(window), _width(lookahead)
    packer, tokens = _Packer(), lz77_tokens(data, window, lookahead)
    while held := list(islice(tokens, STEP)):
        # A flag, then a byte, or the offset and the length.
        field = np.array([(t.literal << 1) if t.literal is not None else 1 | t.offset << 1 | (t.length - 1) << (1 + wide) for t in held], np.int64)
        size = np.array([9 if t.literal is not None else 1 + wide + long for t in held], np.int64)
        packer.add((field[:, None] >> np.arange(max(9, 1 + wide + long)) & 1).astype(np.uint8), size)
    return b"LZ77" + struct.pack("<HBI", window, lookahead & 255, len(data)) + packer.bytes()


def unlz77(payload: bytes) -> bytes:
    if not payload:
        return b""
    if payload[:4] != b"LZ77" or len(payload) < 11:
        raise ValueError("not an LZ77 payload")
    window, lookahead, size = struct.unpack("<HBI", payload[4:11])
    wide, long = _width(window), _width(lookahead or 256)
    bits, at, out, end = payload[11:], 0, bytearray(), 8 * (len(payload) - 11)
    need = 1 + wide + long
    while len(out) < size:
        field = int.from_bytes(bits[at >> 3 : (at + need >> 3) + 1], "little") >> (at & 7)
        at += need if field & 1 else 9
        if at > end:
            raise ValueError("an LZ77 payload ends early")
        if field & 1:
            back, k = (field >> 1 & ((1 << wide) - 1)) + 1, (field >> (1 + wide) & ((1 << long) - 1)) + 1
            if back > len(out):
                raise ValueError("an LZ77 match before the start")
            run = bytes(out[-back:]) if back <= k else bytes(out[-back : len(out) - back + k])
            out += (run * (k // len(run) + 1))[:k]
        else:
            out.append(field >> 1 & 255)
    return bytes(out[:size])


# Images: zlib of RGB rows (LZW1), and that of a mean-pooled image (POOL). Headers are big-endian.


def rgb_encode(rgb: np.ndarray, kind: int = 1) -> bytes:
    h, w, _ = rgb.shape
    raw = np.ascontiguousarray(rgb, np.uint8).tobytes()
    body = zlib.compress(raw, 9)
    return b"LZW1" + struct.pack(">5i", kind, w, h, len(raw), len(body)) + body


def rgb_decode(payload: bytes) -> np.ndarray:
    if payload[:4] != b"LZW1" or len(payload) < 24:
        raise ValueError("not an RGB payload")
    _, w, h, size, n = struct.unpack(">5i", payload[4:24])
    try:
        raw = zlib.decompress(payload[24 : 24 + n])
    except zlib.error as e:
        raise ValueError(f"a damaged RGB payload: {e}") from e
    if len(raw) != size or size != 3 * w * h:
        raise ValueError("an RGB payload of another size")
    return np.frombuffer(raw, np.uint8).reshape(h, w, 3)


def pool_rgb(rgb: np.ndarray, p: int) -> np.ndarray:
    if p <= 1:
        return rgb
    h, w, c = rgb.shape
    oh, ow = max(1, h // p), max(1, w // p)
    if h < p or w < p:
        return np.array([[[int(rgb[y * p : (y + 1) * p, x * p : (x + 1) * p, k].mean()) for k in range(c)] for x in range(ow)] for y in range(oh)], np.uint8)
    return (rgb[: oh * p, : ow * p].astype(np.int64).reshape(oh, p, ow, p, c).sum((1, 3)) // (p * p)).astype(np.uint8)


def upscale_rgb(rgb: np.ndarray, w: int, h: int) -> np.ndarray:
    sh, sw, _ = rgb.shape
    return rgb[np.minimum(np.arange(h) * sh // h, sh - 1)[:, None], np.minimum(np.arange(w) * sw // w, sw - 1)]


def pooling_encode(rgb: np.ndarray, quality: int = 5) -> bytes:
    p = min(10, max(1, quality))
    small = pool_rgb(rgb, p)
    body = rgb_encode(small)
    return b"POOL" + struct.pack(">iiBiiii", rgb.shape[1], rgb.shape[0], p, small.shape[1], small.shape[0], 1, len(body)) + body


def pooling_decode(payload: bytes) -> np.ndarray:
    if payload[:4] != b"POOL" or len(payload) < 29:
        raise ValueError("not a pooled payload")
    w, h, _, _, _, _, n = struct.unpack(">iiBiiii", payload[4:29])
    return upscale_rgb(rgb_decode(payload[29 : 29 + n]), w, h)


def png_encode(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1)], 1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows, 9)) + part(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """RGB rows of a PNG that is not interlaced, of any colour type and depth; alpha is dropped, 16 bits are cut to 8."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, parts, palette, head = 8, [], b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) != n:
            raise ValueError("a PNG ends early")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[6] or head[3] not in PNG_CHANNELS or not head[0] or not head[1]:
        raise ValueError("a PNG of a kind that isn't read here")
    w, h, depth, colour = head[:4]
    channels = PNG_CHANNELS[colour]
    stride, step = (w * channels * depth + 7) // 8, max(1, channels * depth // 8)
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(f"a damaged PNG: {e}") from e
    if len(raw) < h * (stride + 1):
        raise ValueError("a PNG ends early")
    rows = np.frombuffer(raw, np.uint8)[: h * (stride + 1)].reshape(h, stride + 1)
    out, above = np.zeros((h, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(h):
        out[y] = above = _unfiltered(int(rows[y, 0]), rows[y, 1:], above, step)
    if depth == 16:
        out = out[:, ::2]
    elif depth < 8:
        out = (np.unpackbits(out, axis=1).reshape(h, -1, depth) @ (1 << np.arange(depth)[::-1])).astype(np.uint8)
        if colour == 0:
            out = (out.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    x = out[:, : w * channels].reshape(h, w, channels)
    if colour == 3:
        table = np.frombuffer(palette, np.uint8)[: len(palette) // 3 * 3].reshape(-1, 3)
        if int(x.max()) >= len(table):
            raise ValueError("a PNG colour outside its palette")
        return table[x[..., 0]]
    return np.repeat(x[..., :1], 3, 2) if channels < 3 else np.ascontiguousarray(x[..., :3])


PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:  # a running sum for each byte of a pixel
        full = np.zeros(-(-len(row) // step) * step, np.uint8)
        full[: len(row)] = row
        return np.cumsum(full.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(row)]
    if kind not in (3, 4):
        raise ValueError("a PNG filter that does not exist")
    x, up, out = row.tolist(), above.tolist(), [0] * (len(row) + step)
    for i, v in enumerate(x):
        a, b = out[i], up[i]  # out is a pixel ahead
        if kind == 3:
            guess = (a + b) >> 1
        else:
            c = up[i - step] if i >= step else 0
            da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if da <= db and da <= dc else b if db <= dc else c
        out[i + step] = (v + guess) & 255
    return np.array(out[step:], np.uint8)


def lzw_image(data: bytes) -> bytes:
    return rgb_encode(png_decode(data)) if data else b""


def unlzw_image(payload: bytes) -> bytes:
    return png_encode(rgb_decode(payload)) if payload else b""


def pooling_image(data: bytes, quality: int = 5) -> bytes:
    return pooling_encode(png_decode(data), quality) if data else b""


def unpooling_image(payload: bytes) -> bytes:
    return png_encode(pooling_decode(payload)) if payload else b""


# The registry, and columns.

CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "none": (bytes, bytes), "deflate": (deflate, inflate), "webdict": (webdict, unwebdict), "huffman": (huffman, unhuffman),
    "canonical": (canonical, uncanonical), "lz77": (lz77, unlz77), "lzw_image": (lzw_image, unlzw_image), "pooling_image": (pooling_image, unpooling_image),
}
LOSSLESS = ("deflate", "webdict", "huffman", "canonical", "lz77")
ALIASES = {"brotli": "deflate", "lzwimage": "lzw_image", "poolingimage": "pooling_image"}
BY_STRATEGY = {0: "none", 1: "webdict", 2: "lz77", 3: "lzw_image", 4: "pooling_image", 5: "deflate", 6: "huffman"}
MAGICS = {b"BROT": "deflate", b"WDCT": "webdict", b"HUFF": "huffman", b"LZ77": "lz77", b"LZW1": "lzw_image", b"POOL": "pooling_image"}


def register(name: str, compress: Callable[[bytes], bytes], decompress: Callable[[bytes], bytes], strategy: int | None = None) -> int:
    """Adds a codec, under a strategy id (one byte) that archives carry; by default the next free one. The id."""
    key = name.lower()
    known = {v: k for k, v in BY_STRATEGY.items()}
    if strategy is None:
        strategy = known.get(key, max(BY_STRATEGY) + 1)
    if not 0 <= strategy <= 255 or BY_STRATEGY.get(strategy, key) != key:
        raise ValueError(f"strategy id {strategy} is taken or no byte")
    CODECS[key], BY_STRATEGY[strategy] = (compress, decompress), key
    return strategy


def codec(name: str) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    key = ALIASES.get(name.lower(), name.lower())
    if key not in CODECS:
        raise ValueError(f"unknown codec {name}")
    return CODECS[key]


def codec_of_payload(payload: bytes) -> str:
    """The codec that a payload's first bytes name."""
    if payload[:4] not in MAGICS:
        raise ValueError("a payload of no known codec")
    return MAGICS[payload[:4]]


def decompress_any(payload: bytes) -> bytes:
    return codec(codec_of_payload(payload))[1](payload) if payload else b""


RESULT = "content binary, error string"


def _result(run: Callable[..., bytes], *args) -> tuple[bytes | None, str | None]:
    try:
        return run(*args), None
    except (ValueError, struct.error, OverflowError, MemoryError) as e:
        return None, f"{type(e).__name__}: {e}"


def _column(run: Callable[[bytes], bytes]):
    @F.pandas_udf("binary")
    def apply(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else run(bytes(x)))

    return apply


def _tried(run: Callable[[bytes], bytes]):
    @F.pandas_udf(RESULT)
    def apply(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else _result(run, bytes(x)) for x in data], columns=["content", "error"], dtype=object)

    return apply


def dealt(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as there are cores, at least: a codec takes longer than the shuffle of what it reads."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def compress(content: Column, name: str) -> Column:
    """The payload of a binary column; content that the codec can't take fails the query (see try_compress)."""
    return _column(codec(name)[0])(content.cast("binary"))


def decompress(content: Column, name: str) -> Column:
    return _column(codec(name)[1])(content.cast("binary"))


def try_compress(content: Column, name: str) -> Column:
    """A struct of content and error: what can't be packed leaves an error in its row and the others alone."""
    return _tried(codec(name)[0])(content.cast("binary"))


def try_decompress(payload: Column, name: str | None = None) -> Column:
    """A struct of content and error; without a name the codec is told by the payload's first bytes."""
    return _tried(codec(name)[1] if name else decompress_any)(payload.cast("binary"))


def decompress_text(payload: Column, name: str = "deflate") -> Column:
    return F.decode(decompress(payload, name), "UTF-8")


def deflate_at(content: Column, level: Column | int) -> Column:
    """Raw deflate at a level of 1 to 9 (others are moved into that range), which may be a column."""

    @F.pandas_udf("binary")
    def apply(data: pd.Series, levels: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else deflate(bytes(x), int(n)) for x, n in zip(data, levels, strict=True)], dtype=object)

    return apply(content.cast("binary"), (level if isinstance(level, Column) else F.lit(level)).cast("int"))


def _by_strategy(side: int):
    table = {i: codec(name)[side] for i, name in BY_STRATEGY.items()}

    def run(strategy, data):
        if strategy not in table:
            raise ValueError(f"no codec has strategy id {strategy}")
        return table[strategy](data)

    @F.pandas_udf(RESULT)
    def apply(strategy: pd.Series, data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else _result(run, None if pd.isna(s) else int(s), bytes(x)) for s, x in zip(strategy, data, strict=True)], columns=["content", "error"], dtype=object)

    return apply


def compress_routed(resources: DataFrame, content: str = "content") -> DataFrame:
    """Adds payload, compressed_size and stored_strategy by strategy_id.

    What doesn't get smaller, and what its codec can't take, such as an image that is no readable PNG, is stored as it is.
    """
    data = F.col(content).cast("binary")
    tried = resources.withColumn("_tried", _by_strategy(0)(F.col("strategy_id"), data))
    packed = F.col("_tried.content")
    better = packed.isNotNull() & (F.octet_length(packed) < F.octet_length(data)) & (F.col("strategy_id") != 0)
    out = tried.withColumns({"payload": F.when(better, packed).otherwise(data), "stored_strategy": F.when(better, F.col("strategy_id")).otherwise(0)})
    return out.drop("_tried").withColumn("compressed_size", F.octet_length("payload").cast("long"))


def decompress_routed(rows: DataFrame, payload: str = "payload", strategy: str = "stored_strategy", errors: bool = False) -> DataFrame:
    """Adds content, by each row's strategy id; damaged payloads and unknown ids raise, or with errors, fill error."""
    got = rows.withColumn("_got", _by_strategy(1)(F.col(strategy), F.col(payload)))
    error = F.col("_got.error")
    if errors:
        return got.withColumns({"content": F.col("_got.content"), "error": error}).drop("_got")
    return got.withColumn("content", F.when(error.isNotNull(), F.raise_error(error).cast("binary")).otherwise(F.col("_got.content"))).drop("_got")


def lz77_token_rows(rows: DataFrame, key: str, content: str, window: int = WINDOW, lookahead: int = LOOKAHEAD) -> DataFrame:
    """key, pos, is_literal, literal, offset, length: a row for each token."""
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, data in zip(f[key], f["_data"], strict=True):
                got = [(k, t.pos, t.literal is not None, t.literal, t.offset, t.length) for t in lz77_tokens(bytes(data or b""), window, lookahead)]
                if got:
                    yield pd.DataFrame(got, columns=[key, "pos", "is_literal", "literal", "offset", "length"])

    return dealt(rows.select(key, F.col(content).cast("binary").alias("_data"))).mapInPandas(run, f"{key} {kind}, pos int, is_literal boolean, literal int, offset int, length int")


def code_table(histogram: DataFrame, key: str) -> DataFrame:
    """key, byte, label, n, code, length of each document's Huffman code (ties by lowest symbol), 256 rows a key at most, bytes ascending."""
    kind = dict(histogram.dtypes)[key]

    def run(batches):
        for b in batches:
            rows, place = [], []
            for i, counts in enumerate(b.column(1).to_pylist()):
                counts = {x["byte"]: x["n"] for x in counts}
                codes = huffman_codes(counts)
                rows += [(s, f"'{chr(s)}'" if 32 <= s < 127 else f"0x{s:02X}", n, codes[s], len(codes[s])) for s, n in counts.items()]
                place += [i] * len(counts)
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int32()), strict=True))], names=["key", "byte", "label", "n", "code", "length"])

    listed = histogram.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("byte", "n"))).alias("counts"))  # 256 at most
    return listed.select(F.col(key).alias("key"), "counts").mapInArrow(run, f"key {kind}, byte int, label string, n long, code string, length int").withColumnRenamed("key", key)


def code_summary(codes: DataFrame, key: str) -> DataFrame:
    return codes.groupBy(key).agg(F.count("*").alias("distinct_bytes"), F.min("length").alias("shortest"), F.max("length").alias("longest"), F.sum(F.col("n") * F.col("length")).alias("bits"), F.sum("n").alias("n_bytes"))


def tree_text(codes: dict[int, str]) -> str:
    """The code's tree, a node a line, two spaces for each level; leaves show their byte."""
    inverse, lines, todo = {c: s for s, c in codes.items()}, [], [""]
    while todo:
        at = todo.pop()
        leaf = inverse.get(at)
        lines.append("  " * len(at) + (f"{at or '-'}: 0x{leaf:02X}" if leaf is not None else at or "root"))
        todo += [at + b for b in "10" if leaf is None and any(c.startswith(at + b) for c in inverse)]
    return "\n".join(lines)
