import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagepress.operators import codecs, incremental, routing
from pagepress.sources import files, wzip
from pagepress.streaming import ingest


def tree(folder):
    for name, data in {"index.html": b"<html><div></div></html>" * 20, "css/style.css": b"color:red;" * 30, "images/icon.png": bytes(100), ".hidden": b"h", "empty.txt": b""}.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)


def test_scans(spark, tmp_path):
    tree(tmp_path)
    every = files.read_files(spark, str(tmp_path))
    assert {r["name"] for r in every.select("name").collect()} == {"index.html", "style.css", "icon.png", ".hidden", "empty.txt"}
    assert files.read_files(spark, str(tmp_path), recursive=False).count() == 3
    assert {r["name"] for r in files.visible(every, ["html", "css"]).collect()} == {"index.html", "style.css"}
    assert "css/style.css" in {r["relative"] for r in files.relative(every, str(tmp_path)).collect()}
    assert files.read_all(spark, [str(tmp_path), str(tmp_path / "missing"), str(tmp_path / "index.html")]).count() == 5


def test_headers(spark, tmp_path):
    tree(tmp_path)
    (tmp_path / "a.dat").write_bytes(bytes.fromhex("89504E470D0A1A0A0000000D") + bytes(1 << 20))
    got = {r["name"]: bytes(r["header"]) for r in files.read_headers(spark, str(tmp_path)).collect()}
    assert got["a.dat"] == bytes.fromhex("89504E470D0A1A0A0000000D") and got["empty.txt"] == b"" and got[".hidden"] == b"h" and got["style.css"] == b"color:red;co"
    kinds = {r["path"].rpartition("/")[2]: r["kind"] for r in files.sniff_files(spark, str(tmp_path)).collect()}
    assert kinds["a.dat"] == "PNG" and kinds["index.html"] == "UNKNOWN"


def test_fingerprint_text(spark):
    rows = spark.createDataFrame([("/z/b", "m2", 2048, False, None, 0, None, 1), ("/z/a", "m1", 1000, True, "/a.c", 400, "Brotli", 2)], incremental.MANIFEST)
    assert [tuple(r) for r in incremental.describe(rows).collect()] == [("/z/a", "/z/a m1 1000 B -> 400 B (60.0%)"), ("/z/b", "/z/b m2 2.00 KB not compressed")]
    got = {r["path"]: r["text"].split("\n") for r in incremental.detail(rows).collect()}
    assert got["/z/a"] == ["File: a", "Path: /z/a", "MD5: m1", "Size: 1000 B", "Compressed: yes", "Codec: Brotli", "Compressed size: 400 B", "Saved: 600 bytes (60.00%)"]
    assert got["/z/b"][4:] == ["Compressed: no", "Codec: none", "Compressed size: none", "Saved: 0 bytes (0.00%)"]
    assert incremental.totals_text(incremental.manifest_totals(rows)).first()["text"] == "files: 2, compressed: 1, size: 2.98 KB, compressed size: 400 B, savings: 86.88%"
    assert incremental.totals_text(incremental.manifest_totals(rows.where("false"))).first()["text"] == "files: 0, compressed: 0, size: 0 B, compressed size: 0 B, savings: 0.00%"
    assert incremental.lookup(rows, "/z/a").count() == 1 and incremental.lookup(rows, "a").count() == 0


def test_archive(spark, tmp_path):
    tree(tmp_path / "in")
    wzip.register(spark)
    rows = files.relative(files.read_files(spark, str(tmp_path / "in")), str(tmp_path / "in"))
    packed = codecs.compress_routed(routing.route(rows)).select(F.col("relative").alias("path"), F.col("length").alias("original_size"), F.col("stored_strategy").alias("strategy_id"), "payload")
    file = str(tmp_path / "a.wzip")
    assert wzip.write_archive(packed, file) == 5
    back = codecs.decompress_routed(spark.read.format("wzip").load(file), strategy="strategy_id")
    assert {r["path"]: bytes(r["content"]) for r in back.collect()}["index.html"] == b"<html><div></div></html>" * 20
    assert wzip.extract(back, str(tmp_path / "out")).count() == 5
    assert (tmp_path / "out/images/icon.png").read_bytes() == bytes(100)
    packed.write.format("wzip").mode("append").save(str(tmp_path / "many"))
    assert spark.read.format("wzip").load(str(tmp_path / "many")).count() == 5


def test_archive_refuses():
    assert list(wzip.entries(io.BytesIO(wzip.header(1) + wzip.entry("a", 1, 0, b"x")))) == [("a", 1, 0, b"x")]
    for bad in (b"NOPE", wzip.header(1), wzip.header(1) + wzip.entry("a", 1, 0, b"x")[:-1]):
        with pytest.raises(ValueError):
            list(wzip.entries(io.BytesIO(bad)))
    for path in ("../x", "/x", "a/../../x", ""):
        with pytest.raises(ValueError):
            wzip.safe_path(path)


def test_manifest_text(spark):
    rows = spark.createDataFrame([("/a", "m1", 1000, True, "/a.c", 400, "Brotli", 1), ("/b", "m2", 2000, True, "/b.c", 800, "Brotli", 2)], incremental.MANIFEST)
    lines = spark.createDataFrame([("#x Manifest v1", 0), ("VERSION:1", 1), ("short|row", 2)], "value string, seq long").union(incremental.to_text(rows).withColumn("seq", F.lit(9).cast("long")))
    assert sorted(tuple(r)[:7] for r in incremental.from_text(lines).collect()) == sorted(tuple(r)[:7] for r in rows.collect())
    t = incremental.manifest_totals(rows).first()
    assert (t["original"], t["compressed"], t["files"], t["savings"]) == (3000, 1200, 2, 60.0)


def test_stream(spark, tmp_path):
    tree(tmp_path / "in")
    run = lambda: ingest.stream_folder(spark, str(tmp_path / "in"), str(tmp_path / "manifest"), str(tmp_path / "cp")).awaitTermination()
    run()
    assert ingest.load_manifest(spark, str(tmp_path / "manifest")).count() == 3
    (tmp_path / "in/new.html").write_bytes(b"<div></div>" * 50)
    run()
    got = ingest.load_manifest(spark, str(tmp_path / "manifest"))
    assert got.count() == 4 and got.where("path like '%new.html' and compressed").count() == 1


def test_compressed_files(spark, tmp_path):
    """Each file beside its name with .compressed, read back singly, by folder and from a manifest; damaged ones have an error."""
    tree(tmp_path / "in")
    rows = files.relative(files.read_files(spark, str(tmp_path / "in")), str(tmp_path / "in"))
    packed = codecs.compress_routed(routing.route(rows)).where("stored_strategy <> 0").select(F.col("relative").alias("path"), "payload")
    got = files.write_compressed(packed, str(tmp_path / "out")).collect()
    assert {r["path"] for r in got} == {"index.html.compressed", "css/style.css.compressed", "images/icon.png.compressed"} - ({"images/icon.png.compressed"} if len(got) == 2 else set())
    (tmp_path / "out/bad.html.compressed").write_bytes(b"BROT\xff\xff")
    back = {r["name"]: r for r in files.read_compressed(spark, str(tmp_path / "out")).collect()}
    assert bytes(back["index.html"]["content"]) == b"<html><div></div></html>" * 20 and back["bad.html"]["error"] and back["bad.html"]["content"] is None
    assert files.read_compressed(spark, str(tmp_path / "out/css/style.css.compressed")).first()["name"] == "style.css"
    manifest = spark.createDataFrame([(f"/x/{n}", "m", 1, True, str(tmp_path / "out" / f"{n}.compressed"), 1, "Brotli", 1) for n in ("index.html", "bad.html", "gone.html")] + [("/x/skipped", "m", 1, False, None, 0, None, 2)], incremental.MANIFEST)
    all_ = {r["path"]: r for r in files.decompress_all(manifest).collect()}
    assert set(all_) == {"/x/index.html", "/x/bad.html", "/x/gone.html"} and bytes(all_["/x/index.html"]["content"]) == b"<html><div></div></html>" * 20
    assert all_["/x/bad.html"]["error"] and "FileNotFound" in all_["/x/gone.html"]["error"]
    errors = wzip.put_files(spark.createDataFrame([("../up", bytearray(b"x")), ("ok", bytearray(b"x"))], "path string, content binary"), str(tmp_path / "put"))
    assert {r["path"]: r["error"] is None for r in errors.collect()} == {"../up": False, "ok": True}


def test_images_of_any_format(spark, tmp_path):
    """The JVM decodes; rows hold both image codecs' payloads and a PNG."""
    rgb = np.random.default_rng(5).integers(0, 256, (30, 40, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(codecs.png_encode(rgb))
    (tmp_path / "b.png").write_bytes(b"no image")
    got = {r["path"].rpartition("/")[2]: r for r in files.image_payloads(files.read_images(spark, str(tmp_path))).collect()}
    assert (codecs.rgb_decode(bytes(got["a.png"]["lzw_image"])) == rgb).all() and (codecs.png_decode(bytes(got["a.png"]["png"])) == rgb).all()
    assert codecs.pooling_decode(bytes(got["a.png"]["pooling_image"])).shape == rgb.shape and got["b.png"]["lzw_image"] is None


def test_overwrite(spark, tmp_path):
    wzip.register(spark)
    rows = spark.createDataFrame([(f"{i}.txt", 3, 0, bytearray(b"abc")) for i in range(5000)], "path string, original_size long, strategy_id int, payload binary").repartition(2)
    for _ in range(2):
        rows.write.format("wzip").mode("overwrite").save(f"file://{tmp_path}/many")
        assert spark.read.format("wzip").load(f"file://{tmp_path}/many").count() == 5000
    assert {f.suffix for f in (tmp_path / "many").iterdir()} == {".wzip"}
