import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagepress.operators import codecs as c
from pagepress.operators import routing

LOSSLESS = ["deflate", "webdict", "huffman", "canonical", "lz77"]
FIXTURES = [b"", b"A", b"A" * 1000, bytes(range(256)), b"AAAAAAABBBBBCCCC", b"ABABABA", b"ABRACADABRA", "<div>日本語</div>".encode(), b"x" * 300 + b"y" + b"x" * 300, b'<html><head charset="utf-8"><div></div>' * 3]


@pytest.mark.parametrize("name", LOSSLESS)
@pytest.mark.parametrize("data", FIXTURES)
def test_round_trip(name, data):
    pack, unpack = c.codec(name)
    assert unpack(pack(data)) == data


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=600), st.sampled_from(LOSSLESS))
def test_random_round_trip(data, name):
    pack, unpack = c.codec(name)
    assert unpack(pack(data)) == data


@pytest.mark.parametrize("name", LOSSLESS)
def test_damage_raises(name):
    pack, unpack = c.codec(name)
    good = pack(b"some text with <div> and more text " * 20)
    for bad in (b"NOT_THIS", good[: len(good) - 3]):
        try:
            assert unpack(bad) != b"some text with <div> and more text " * 20
        except ValueError:
            pass
    if name != "canonical":
        with pytest.raises(ValueError):
            unpack(b"NOT_THIS")


def test_sizes():
    codes = c.huffman_codes({ord(k): "ABRACADABRA".count(k) for k in "ABRCD"})
    assert sum(len(codes[b]) for b in b"ABRACADABRA") == 23
    assert len(c.huffman(b"ABRACADABRA")) == 2053 + 3
    assert [(t.literal, t.offset, t.length) for t in c.lz77_tokens(b"ABABABA")] == [(65, 0, 1), (66, 0, 1), (None, 1, 5)]
    assert len(c.lz77(b"ABABABA")) == 11 + -(-(9 * 2 + 21) // 8)
    assert c.webdict(b"<div>a</div>")[5:] == bytes([0x80 + 6, ord("a"), 0x80 + 7])


def test_lz77_takes_the_farthest_of_the_longest():
    def slow(data, at, window=4096, most=256):
        best, where = 0, 0
        for j in range(max(0, at - window), at):
            k = 0
            while k < min(most, len(data) - at) and data[j + k] == data[at + k]:
                k += 1
            if k > best:
                best, where = k, j
        return best, where

    data = bytes(random.Random(1).choice(b"abc") for _ in range(400))
    for t in c.lz77_tokens(data):
        best, where = slow(data, t.pos)
        assert (t.literal is None) == (best >= 3)
        if t.literal is None:
            assert (t.length, t.pos - 1 - t.offset) == (best, where)


def test_canonical_checks():
    c.check_lengths([1, 2, 2])
    for bad in ([1, 1, 1], [2, 2, 2], [1], [-1, 1, 1]):
        with pytest.raises(ValueError):
            c.check_lengths(bad)
    assert c.canonical_codes([1, 2, 2]) == {0: "0", 1: "10", 2: "11"}


def test_images():
    y, x = np.mgrid[0:200, 0:200]
    rgb = np.stack([x * 255 // 200, y * 255 // 200, (x + y) * 255 // 400], 2).astype(np.uint8)
    assert (c.rgb_decode(c.rgb_encode(rgb)) == rgb).all()
    blank = np.zeros((300, 300, 3), np.uint8)
    assert (c.rgb_decode(c.rgb_encode(blank)) == blank).all()
    for q in (1, 2, 5, 8):
        back = c.pooling_decode(c.pooling_encode(rgb, q))
        assert back.shape == rgb.shape
    assert (c.pooling_decode(c.pooling_encode(rgb, 1)) == rgb).all()
    assert struct.unpack(">II", c.png_encode(rgb)[16:24]) == (200, 200)
    with pytest.raises(ValueError):
        c.pooling_decode(b"POOL")


def test_png():
    """Every colour type, depth and filter, against a plain encoder."""
    rng = np.random.default_rng(2)
    for colour, channels, depth in ((0, 1, 8), (2, 3, 8), (3, 1, 8), (4, 2, 8), (6, 4, 8), (0, 1, 1), (0, 1, 2), (0, 1, 4), (3, 1, 4), (0, 1, 16), (2, 3, 16), (6, 4, 16)):
        w, h = 13, 11
        x = rng.integers(0, 1 << depth, (h, w, channels))
        raw = np.array([[int(b) for v in row.ravel() for b in f"{v:0{depth}b}"] for row in x], np.uint8)
        lines, step, above, out = np.packbits(raw, axis=1), max(1, channels * depth // 8), None, b""
        for y, line in enumerate(lines.tolist()):
            above, kind = above or [0] * len(line), y % 5
            left = [0] * step + line
            corner = [0] * step + above

            def paeth(a, b, c):
                return min((a, b, c), key=lambda v: abs(a + b - c - v))

            guess = [(0, a, b, (a + b) // 2, paeth(a, b, c))[kind] for a, b, c in zip(left, above, corner, strict=False)]
            out += bytes([kind, *((v - g) % 256 for v, g in zip(line, guess, strict=True))])
            above = line
        part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        palette = rng.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8)
        data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + (part(b"PLTE", palette.tobytes()) if colour == 3 else b"") + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")
        want = palette[x[..., 0]] if colour == 3 else (x >> 8 if depth == 16 else x * 255 // ((1 << depth) - 1))
        want = np.repeat(want[..., :1], 3, 2) if channels < 3 and colour != 3 else want[..., :3]
        assert (c.png_decode(data) == want).all(), (colour, depth)
        for bad in (data[:40], data[:-30], b"NOT" + data, data.replace(b"IDAT", b"IDOT")):
            with pytest.raises(ValueError):
                c.png_decode(bad)


@pytest.mark.parametrize("name", ["lzw_image", "pooling_image"])
def test_image_codecs(name):
    y, x = np.mgrid[0:60, 0:80]
    rgb = np.stack([x * 3, y * 4, x + y], 2).astype(np.uint8)
    pack, unpack = c.codec(name)
    payload = pack(c.png_encode(rgb))
    back = c.png_decode(unpack(payload))
    assert back.shape == rgb.shape and payload[:4] == (b"LZW1" if name == "lzw_image" else b"POOL")
    assert (back == (rgb if name == "lzw_image" else c.upscale_rgb(c.pool_rgb(rgb, 5), 80, 60))).all()
    assert c.decompress_any(payload) == unpack(payload) and pack(b"") == unpack(b"") == b""
    with pytest.raises(ValueError):
        pack(b"no image")


def test_layouts():
    """The framed canonical stream has a byte for each of 257 lengths; bits are packed from the least significant on."""
    lengths = c.canonical_lengths({65: 3, 66: 1, 67: 1, 256: 1})
    codes = c.canonical_codes(lengths)
    payload = c.canonical(b"ABACA")
    assert payload[:257] == bytes(lengths)
    bits = "".join(codes[b] for b in b"ABACA") + codes[256]
    assert payload[257:] == bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    data = bytes(random.Random(3).choices(range(256), [2.0 ** -(i % 40) for i in range(256)], k=200_000))
    for name in ("huffman", "canonical"):
        pack, unpack = c.codec(name)
        assert unpack(pack(data)) == data
    codes = c.huffman_codes({b: data.count(b) for b in set(data)})
    bits = "".join(codes[b] for b in data[:5000])
    packed = c.huffman(data)[2053:]
    assert "".join(f"{b:08b}"[::-1] for b in packed[: len(bits) // 8]) == bits[: len(bits) // 8 * 8]


def test_columns(spark):
    """Errors stay in their rows; levels may be a column; unknown strategy ids raise."""
    rows = spark.createDataFrame([(1, bytearray(c.deflate(b"abc" * 50)), 1, 5), (2, bytearray(b"BROT\xff"), 9, 5), (3, None, 5, 5), (4, bytearray(b"what"), 1, 77)], "id int, payload binary, level int, strategy int")
    got = {r["id"]: (r["t"]["content"], r["t"]["error"]) for r in rows.select("id", c.try_decompress(F.col("payload"), "deflate").alias("t")).collect()}
    assert bytes(got[1][0]) == b"abc" * 50 and got[3] == (None, None) and "ValueError" in got[2][1] and got[4][0] is None
    assert {r["id"] for r in rows.select("id", c.try_decompress(F.col("payload")).alias("t")).where("t.error is null").collect()} == {1, 3}
    back = {r["id"]: (r["content"], r["error"]) for r in c.decompress_routed(rows, strategy="strategy", errors=True).collect()}
    assert bytes(back[1][0]) == b"abc" * 50 and "strategy id 77" in back[4][1]
    with pytest.raises(Exception, match="strategy id 77"):
        c.decompress_routed(rows.where("id = 4"), strategy="strategy").collect()
    assert c.decompress_routed(rows.where("id = 1"), strategy="strategy").select(F.decode("content", "UTF-8")).first()[0] == "abc" * 50
    sizes = [r[0] for r in spark.range(1, 10, 4).select(F.octet_length(c.deflate_at(F.lit(bytes(range(256)) * 40), F.col("id").cast("int")))).collect()]
    assert sizes == [len(c.deflate(bytes(range(256)) * 40, n)) for n in (1, 5, 9)]
    assert spark.range(1).select(c.decompress_text(c.compress(F.lit("naïve").cast("binary"), "deflate"))).first()[0] == "naïve"


def test_images_are_routed(spark):
    y, x = np.mgrid[0:120, 0:120]
    png = c.png_encode(np.random.default_rng(1).integers(0, 256, (120, 120, 3)).astype(np.uint8))
    rows = spark.createDataFrame([("a.png", bytearray(png)), ("b.jpg", bytearray(b"\xff\xd8\xff" + bytes(400))), ("c.html", bytearray(b"<div></div>" * 40))], "name string, content binary")
    packed = c.compress_routed(routing.route(rows))
    got = {r["name"]: r for r in packed.collect()}
    assert got["a.png"]["stored_strategy"] == 4 and bytes(got["a.png"]["payload"][:4]) == b"POOL" and got["b.jpg"]["stored_strategy"] == 0 and got["c.html"]["stored_strategy"] == 5
    back = {r["name"]: bytes(r["content"]) for r in c.decompress_routed(packed.drop("content")).collect()}
    assert c.png_decode(back["a.png"]).shape == (120, 120, 3) and back["c.html"] == b"<div></div>" * 40 and back["b.jpg"][:3] == b"\xff\xd8\xff"


def test_registry():
    new = c.register("Reversed", lambda b: b[::-1], lambda b: b[::-1])
    assert new > 6 and c.register("reversed", lambda b: b[::-1], lambda b: b[::-1]) == new and c.BY_STRATEGY[new] == "reversed"
    with pytest.raises(ValueError):
        c.register("other", bytes, bytes, 5)
    assert c.codec("REVERSED")[0](b"ab") == b"ba"
    assert c.codec("Brotli")[0] is c.deflate
    with pytest.raises(ValueError):
        c.codec("none such")


def test_tree_text():
    text = c.tree_text(c.huffman_codes({65: 2, 66: 1, 67: 1}))
    assert text.split("\n") == ["root", "  0: 0x41", "  1", "    10: 0x42", "    11: 0x43"]
    assert c.tree_text({9: "0"}).split("\n") == ["root", "  0: 0x09"]
