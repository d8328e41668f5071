import hashlib
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
from pagepress.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(map(str, (tuple(r) for r in df.select(cols).collect())))
    assert rows
    if name in SQL:
        rel = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({SQL[name]})")
        assert rows == sorted(map(str, rel.fetchall()))
    else:
        assert all(r["same"] for r in df.select("same").collect()) if "same" in cols else True


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_sizes_without_sql(spark, texts):
    """Codec queries against the codecs, and LZ77 against a search of the whole window."""
    for r in QUERIES["deflate_size"](spark, SF).collect():
        c = zlib.compressobj(9, zlib.DEFLATED, -15)
        assert r["compressed"] == 4 + len(c.compress(texts[r["doc_id"]]) + c.flush()) and r["original"] == len(texts[r["doc_id"]])
    small = {i for i, t in texts.items() if 0 < len(t) < 700}
    got = {r["doc_id"]: r for r in QUERIES["lz77_tokens"](spark, SF).collect()}
    for i in small:
        t, at, literals, lengths = texts[i], 0, 0, []
        while at < len(t):
            best = max((k for k in range(3, min(256, len(t) - at) + 1) if t.find(t[at : at + k], max(0, at - 4096), at + k - 1) >= 0), default=0)
            literals += not best
            lengths += [best] if best else []
            at += best or 1
        assert (got[i]["literals"], got[i]["matches"], got[i]["longest"]) == (literals, len(lengths), max(lengths, default=1))
    for r in QUERIES["codec_roundtrip"](spark, SF).where("codec = 'lz77'").collect():
        g = got.get(r["doc_id"])
        assert r["compressed"] == (g["size"] if g else 0)


def test_code_table(spark, texts):
    """Codes are prefix-free, of least total length, and listed by byte."""
    rows = {}
    for r in QUERIES["huffman_code_table"](spark, SF).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    bits = {r["doc_id"]: r["bits"] for r in QUERIES["huffman_size"](spark, SF).collect()}
    for i, t in rows.items():
        codes = sorted(r["code"] for r in t)
        assert not any(b.startswith(a) for a, b in zip(codes, codes[1:], strict=False))
        assert [r["byte"] for r in t] == sorted(set(texts[i])) and all(len(r["code"]) == r["length"] and r["n"] == texts[i].count(r["byte"]) for r in t)
        assert sum(r["n"] * r["length"] for r in t) == bits[i]


def test_archives(spark):
    """Payloads against the codecs, entries against the pages."""
    from pagepress.operators import codecs

    pages = {r["page_id"]: r["html"].encode() if isinstance(r["html"], str) else bytes(r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["smart_archive"](spark, SF).collect():
        html, name = pages[r["page_id"]], codecs.BY_STRATEGY[r["strategy_id"]]
        try:
            size = len(codecs.codec(name)[0](html))
        except ValueError:
            size = len(html)  # no image
        assert r["compressed_size"] == min(size, len(html)) and r["original"] == len(html) and r["stored_strategy"] == (r["strategy_id"] if size < len(html) else 0)
        assert r["entry_size"] == 19 + len(r["name"]) + r["compressed_size"] and r["same"]
    got = {r["path"]: r for r in QUERIES["wzip_entries"](spark, SF).collect()}
    assert {p: r["md5"] for p, r in got.items()} == {f"p/{i}.html": hashlib.md5(t).hexdigest() for i, t in pages.items()}
    assert all(r["original_size"] == len(pages[int(p[2:-5])]) and r["stored_size"] <= r["original_size"] for p, r in got.items())


def test_large_transfer_times_are_whole(spark):
    """Sizes whose thousandfold no double holds."""
    from pyspark.sql import functions as F

    from pagepress.operators.transfer import transfer_ms

    small = spark.createDataFrame([(9_007_199_254_741 + i,) for i in range(50)], "size long")
    got = [(r[0], r[1]) for r in small.select("size", transfer_ms(F.col("size"), F.lit(3), F.lit(0))).collect()]
    assert all(g == s * 1000 // 375_000 for s, g in got)


def _differ(duck, df, sql):
    """Rows of df, whose column v goes to SQL's, beside what sql makes of v where it differs."""
    got = {r["v"]: tuple(r)[1:] for r in df.collect()}
    values = ", ".join(f"({v}::bigint)" for v in got)
    want = {r[0]: tuple(r[1:]) for r in duck.execute(f"SELECT v, {sql} FROM (VALUES {values}) t(v)").fetchall()}
    return {v: (got[v], want[v]) for v in got if got[v] != want[v]}


def test_durations_and_sizes_as_in_sql(spark, duck):
    """Values that end in 5 (as doubles a little less or more than a half), and hours that no double holds."""
    from pyspark.sql import functions as F

    from pagepress import queries
    from pagepress.functions import text as fx

    ms = [*range(1005, 60_000, 10), *range(63_000, 9_000_000, 30_030), 3_600_000 * 10**12 - 1, 2**62, -5]
    v = F.col("v")
    rows = spark.createDataFrame([(x,) for x in ms], "v long")
    assert not _differ(duck, rows.select(v, fx.format_duration(v), fx.format_duration_short(v)), f"{queries._DURATION('v')}, {queries._SHORT('v')}")
    sizes = [x + k for x in (1 << 10, 1 << 20, 1 << 30, 1 << 40) for k in range(0, x // 2, x // 200 | 1)]
    rows = spark.createDataFrame([(x,) for x in sizes], "v long")
    assert not _differ(duck, rows.select(v, fx.format_file_size(v), fx.format_size_short(v)), f"{queries._FSIZE('v')}, {queries._MB('v')}")
    labels = [*range(1050, 1_000_000, 950), *range(1_050_000, 9_000_000, 50_000)]
    rows = spark.createDataFrame([(x,) for x in labels], "v long")
    assert not _differ(duck, rows.select(v, fx.axis_label(v)), "CASE WHEN v >= 1e6 THEN printf('%.1fM', round(v / 1e6, 1)) ELSE printf('%.1fK', round(v / 1e3, 1)) END")


def test_stats_text_as_in_sql(spark, duck):
    """Percentages that end in 5, of sizes 400 to 20000."""
    from pyspark.sql import functions as F

    from pagepress.operators.reports import stats_text

    v = F.col("v")
    rows = spark.createDataFrame([(c * 100_000 + o,) for o in (400, 1600, 2000, 8000, 20_000) for c in range(1, o, o // 400)], "v long").withColumn("original", v % 100_000).withColumn("compressed", F.floor(v / 100_000))
    percent = "round(100.0 * (v // 100000) / (v % 100000), 2)"
    want = f"printf('[%s] original: %d bytes, compressed: %d bytes, ratio: %.2f%%, savings: %.2f%%', 'WebDict', v % 100000, v // 100000, {percent}, round(100 - {percent}, 2))"
    assert not _differ(duck, stats_text(rows, F.lit("WebDict")).select("v", "text"), want)


def test_transfer_report_as_in_sql(spark, duck):
    """The query over 10 times the documents, whose durations end in 5, and savings that do."""
    from pyspark.sql import functions as F

    from pagepress.operators import transfer

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    cols = ["source", "profile", "report", "line"]
    rows = sorted(tuple(r) for r in QUERIES["transfer_report"](spark, "/root/testdata/sf0.01").select(cols).collect())
    assert rows == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({SQL['transfer_report']})").fetchall())
    v = F.col("v")
    sizes = spark.createDataFrame([(c,) for c in range(1, 2000)], "v long").withColumn("original", F.lit(2000).cast("long")).withColumn("compressed", v)
    got = transfer.report(transfer.estimate(sizes)).where("profile = '5G'").select("v", F.regexp_extract("report", r"\(([^()]*%)\)", 1))
    assert not _differ(duck, got, "printf('%.1f%%', round(round((1 - v / 2000) * 100, 6), 1))")


def test_transfer_report_without_texts(spark, tmp_path):
    """A source with no text but null has no sizes, and so no report, as in the SQL."""
    rows = [(1, None, "nulls"), (2, "x" * 123_457, "some"), (3, None, "some"), (4, "y", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {(r.source, r.profile, r.report, r.line) for r in QUERIES["transfer_report"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(f"SELECT source, profile, report, line FROM ({SQL['transfer_report']})").fetchall())


def test_histogram_report(spark):
    from pagepress.operators.frequency import byte_histogram, histogram_report

    rows = spark.createDataFrame([(1, 5, 2), (1, 5, 1), (1, 300, 1), (2, 7, 0), (3, 1, 1)], "key int, byte int, n long")
    got = {r["key"]: tuple(r)[1:] for r in histogram_report(rows, "key").collect()}
    assert got == {1: (1, 1, 0), 2: (0, 0, 1), 3: (0, 0, 0)}
    twice = spark.createDataFrame([("a", "xy" * 700_000), ("a", "x"), ("b", None), ("c", "")], "k string, t string")
    assert sorted(map(tuple, byte_histogram(twice, "k", "t").collect())) == [("a", 120, 700_001), ("a", 121, 700_000)]


def test_entry(spark):
    assert entry.entry(spark).count() == 18
    assert set(entry.oracle_sql()) <= set(entry.queries())
