"""The library's queries by name, and the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as fx
from .operators import codecs, frequency, images, incremental, reports, routing, transfer, webdict
from .plans import dims

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ENDINGS = (".html", ".HTM", ".css", ".js", ".svg", ".jpg", ".PNG", ".webp", ".woff2", ".ico", ".bin", ".xyz", "")
MIMES = ("text/html", "application/json", "image/svg+xml", "image/png", "font/woff2", "application/octet-stream", "video/mp4", "text/css")
HEADS = ("FFD8FFE000104A46", "89504E470D0A1A0A0000000D", "474946383961", "524946461000000057454250", "5249464610000000AAAAAAAA", "FFD8", "3C68746D6C3E3C626F64793E")


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import atexit
        import shutil
        import tempfile

        found = tempfile.mkdtemp(prefix="pagepress-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", f"file://{found}")
    return found.rstrip("/")


def _pick(values, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _sql_pick(values, n: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({n} % {len(values)} AS INTEGER) + 1]"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as resources: a name with one of thirteen endings, the first bytes' hex, and the size."""
    p = table(spark, sf, "pages")
    name = F.concat(F.lit("r"), F.col("page_id").cast("string"), _pick(ENDINGS, F.col("page_id")))
    return p.select("page_id", name.alias("name"), _pick(HEADS, F.floor(F.col("page_id") / 3)).alias("head"), _pick(MIMES, F.col("page_id")).alias("mime"), F.octet_length("html").cast("long").alias("size"))


_NAMED = f"""WITH r AS (SELECT page_id, 'r' || page_id || {_sql_pick(ENDINGS, "page_id")} AS name, {_sql_pick(HEADS, "(page_id // 3)")} AS head,
  {_sql_pick(MIMES, "page_id")} AS mime, CAST(strlen(html) AS BIGINT) AS size FROM pages),
x AS (SELECT *, lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS ext FROM r)"""
_EXT_LISTS = {s: ", ".join(f"'{x}'" for x in xs) for s, xs in dims.EXTENSIONS.items()}
_MAPPED = "CASE " + " ".join(f"WHEN ext IN ({xs}) THEN {s}" for s, xs in _EXT_LISTS.items()) + " END"
_SNIFF = """CASE WHEN length(head) < 8 THEN 'UNKNOWN' WHEN head LIKE 'FFD8FF%' THEN 'JPEG' WHEN head LIKE '89504E470D0A1A0A%' THEN 'PNG'
  WHEN head LIKE '474946383761%' OR head LIKE '474946383961%' THEN 'GIF'
  WHEN head LIKE '52494646%' AND length(head) >= 24 AND substr(head, 17, 8) = '57454250' THEN 'WEBP' ELSE 'UNKNOWN' END"""
_SAFE = ", ".join(f"'{x}'" for x in dims.SAFE_EXTENSIONS)
_SUSPICIOUS = f"(lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) NOT IN ({_SAFE}))"


@query(f"{_NAMED} SELECT page_id, name, CAST(coalesce({_MAPPED}, 5) AS INTEGER) AS strategy_id FROM x")
def dispatch_strategy(spark, sf):
    return _named(spark, sf).select("page_id", "name", routing.strategy_by_extension(F.col("name")).alias("strategy_id"))


@query(f"{_NAMED} SELECT page_id, name, CASE WHEN lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) IN ({', '.join(repr(x) for x in dims.FACTORY_IMAGE)}) THEN 'POOLING_IMAGE' ELSE 'BROTLI' END AS codec FROM x")
def factory_type(spark, sf):
    return _named(spark, sf).select("page_id", "name", routing.factory_type(fx.extension(F.col("name"))).alias("codec"))


@query(f"""{_NAMED}, m AS (SELECT page_id, CASE WHEN page_id % 9 = 8 THEN NULL ELSE mime END AS mime FROM r)
SELECT page_id, mime, CAST(CASE WHEN mime IS NULL THEN 0 WHEN regexp_matches(mime, 'html|css|javascript|text|xml|json') THEN 5 WHEN mime LIKE '%image%' THEN 4
  WHEN regexp_matches(mime, 'font|octet-stream') THEN 2 ELSE 0 END AS INTEGER) AS strategy_id FROM m""")
def dispatch_mime(spark, sf):
    rows = _named(spark, sf).withColumn("mime", F.when(F.col("page_id") % 9 == 8, None).otherwise(F.col("mime")))
    return rows.select("page_id", "mime", routing.strategy_by_mime(F.col("mime")).alias("strategy_id"))


@query(f"""{_NAMED}, k AS (SELECT *, {_SNIFF} AS kind, coalesce({_MAPPED}, 5) AS s FROM x)
SELECT page_id, name, kind, CAST(CASE WHEN s = 5 AND {_SUSPICIOUS} AND kind <> 'UNKNOWN' THEN 4 ELSE s END AS INTEGER) AS strategy_id FROM k""")
def dual_check_routing(spark, sf):
    rows = _named(spark, sf).withColumn("kind", routing.sniff(F.unhex("head")))
    return rows.select("page_id", "name", "kind", routing.dual_check(F.col("name"), F.col("kind")).alias("strategy_id"))


_DISPLAY = "CASE {0} " + " ".join(f"WHEN {i} THEN '{d}'" for _, d, i, _ in dims.CODECS) + " END"


@query(f"""{_NAMED}, m AS (SELECT page_id, mime, coalesce({_MAPPED}, 5) AS a, CASE WHEN regexp_matches(mime, 'html|css|javascript|text|xml|json') THEN 5 WHEN mime LIKE '%image%' THEN 4 WHEN regexp_matches(mime, 'font|octet-stream') THEN 2 ELSE 0 END AS b FROM x)
SELECT page_id, {_DISPLAY.format('a')} AS by_extension, {_DISPLAY.format('b')} AS by_mime FROM m""")
def codec_names(spark, sf):
    return _named(spark, sf).select("page_id", routing.codec_by_extension(F.col("name")).alias("by_extension"), routing.codec_by_mime(F.col("mime")).alias("by_mime"))


_TYPED = f"""k AS (SELECT *, {_SNIFF} AS kind, {_MAPPED} AS s FROM x),
t AS (SELECT *, CASE WHEN s = 5 THEN 'WEB_TEXT' WHEN s = 4 OR (s IS NULL AND kind <> 'UNKNOWN') THEN 'IMAGE' WHEN s = 2 THEN 'BINARY_FONT' ELSE 'OTHER' END AS resource_type FROM k)"""


@query(f"""{_NAMED}, {_TYPED}, g AS (SELECT resource_type, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM t GROUP BY 1 HAVING sum(size) > 0)
SELECT resource_type, files, bytes, round(bytes * 100.0 / (SELECT CAST(sum(bytes) AS DOUBLE) FROM g), 4) AS share,
  CAST(list_position([{', '.join(repr(x) for x in dims.RESOURCE_TYPES)}], resource_type) AS BIGINT) AS ordinal FROM g""")
def resource_type_share(spark, sf):
    rows = _named(spark, sf).withColumn("kind", routing.sniff(F.unhex("head")))
    return routing.size_by_type(rows.withColumn("resource_type", routing.resource_type(F.col("name"), F.col("kind"))), F.col("size"))


@query(f"{_NAMED} SELECT page_id, head, {_SNIFF} AS kind FROM x")
def magic_sniff(spark, sf):
    return _named(spark, sf).select("page_id", "head", routing.sniff(F.unhex("head")).alias("kind"))


@query(f"{_NAMED} SELECT page_id, name, {_SUSPICIOUS} AS suspicious FROM x")
def suspicious_ext(spark, sf):
    return _named(spark, sf).select("page_id", "name", routing.suspicious_extension(fx.extension(F.col("name"))).alias("suspicious"))


@query(f"""{_NAMED} SELECT page_id, name, ext AS with_dot, regexp_extract(name, '^.+\\.([^.]+)$', 1) AS without_dot, lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) AS file_ext,
regexp_extract(name, '^.+(\\.[^.]*)$', 1) AS kept_dot FROM x""")
def ext_parse(spark, sf):
    n = F.col("name")
    return _named(spark, sf).select("page_id", "name", fx.extension_with_dot(n).alias("with_dot"), fx.extension(n).alias("without_dot"), fx.file_extension(n).alias("file_ext"), fx.extension_kept_dot(n).alias("kept_dot"))


_SQL_STRATEGIES = dims.sql_values(dims.STRATEGIES, "strategy_id, strategy_name")


@query(f"{_NAMED} SELECT page_id, s.strategy_id, s.strategy_name FROM (SELECT page_id, CAST(coalesce({_MAPPED}, 5) AS INTEGER) AS strategy_id FROM x) JOIN (SELECT CAST(strategy_id AS INTEGER) AS strategy_id, strategy_name FROM {_SQL_STRATEGIES}) s USING (strategy_id)")
def strategy_labels(spark, sf):
    """The extension and strategy maps as broadcast dimension joins."""
    ext = dims.extensions(spark).drop("resource_type")
    rows = _named(spark, sf).withColumn("ext", fx.extension_with_dot(F.col("name"))).join(F.broadcast(ext), "ext", "left").withColumn("strategy_id", F.coalesce("strategy_id", F.lit(5)))
    return rows.join(F.broadcast(dims.strategies(spark)), "strategy_id").select("page_id", "strategy_id", "strategy_name")


_CODECS = dims.sql_values([(a, b, c, d) for a, b, c, d in dims.CODECS], "codec, display_name, strategy_id, description")


@query(f"SELECT codec, display_name, CAST(strategy_id AS INTEGER) AS strategy_id, description FROM {_CODECS}")
def codec_listing(spark, sf):
    return dims.codecs(spark)


@query(f"""WITH n AS (SELECT page_id, {_sql_pick([c[1] for c in dims.CODECS] + ["Other"], "page_id")} AS codec FROM pages)
SELECT page_id, codec, CAST(coalesce(strategy_id, {dims.ARCHIVE_FALLBACK}) AS INTEGER) AS strategy_id FROM n LEFT JOIN {_CODECS} ON display_name = n.codec""".replace("SELECT page_id, codec,", "SELECT page_id, n.codec,"))
def archive_codec_strategy(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", _pick([c[1] for c in dims.CODECS] + ["Other"], F.col("page_id")).alias("codec"))
    return rows.select("page_id", "codec", routing.archive_strategy(F.col("codec")).alias("strategy_id"))


_SAVE = lambda o, c: f"CASE WHEN {o} > 0 THEN round((1 - ({c}) / {o}) * 100, 6) ELSE 0 END"
_FSIZE = lambda b: f"CASE WHEN {b} < 1024 THEN {b} || ' B' WHEN {b} < 1048576 THEN printf('%.2f KB', round({b} / 1024.0, 2)) WHEN {b} < 1073741824 THEN printf('%.2f MB', round({b} / 1048576.0, 2)) ELSE printf('%.2f GB', round({b} / 1073741824.0, 2)) END"

# Byte statistics.

_HIST = """WITH p AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS pair FROM documents),
h AS (SELECT doc_id, CAST(('0x' || pair) AS INTEGER) AS byte, count(*) AS n FROM p GROUP BY ALL)"""


@query(f"{_HIST} SELECT doc_id, byte, n FROM h")
def byte_histogram(spark, sf):
    return frequency.byte_histogram(table(spark, sf, "documents"), "doc_id", "text", unique=True)


@query(f"{_HIST} SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy, count(*) AS distinct_bytes, CAST(sum(n) AS BIGINT) AS n_bytes FROM h GROUP BY doc_id")
def byte_entropy(spark, sf):
    return frequency.entropy(byte_histogram(spark, sf), "doc_id").withColumn("entropy", F.round("entropy", 6))


_BITS = f"""WITH RECURSIVE p AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS pair FROM documents),
h AS (SELECT doc_id, pair, count(*) AS n FROM p GROUP BY ALL),
l AS (SELECT doc_id, list_sort(list(n)) AS q, count(*) AS k, CAST(sum(n) AS BIGINT) AS n_bytes FROM h GROUP BY doc_id),
m AS (SELECT doc_id, CASE WHEN k = 1 THEN list_concat([CAST(0 AS BIGINT)], q) ELSE q END AS q, CAST(0 AS BIGINT) AS bits FROM l
  UNION ALL SELECT doc_id, list_sort(list_append(q[3:], q[1] + q[2])), bits + q[1] + q[2] FROM m WHERE len(q) > 1),
b AS (SELECT doc_id, max(bits) AS bits FROM m GROUP BY doc_id)
SELECT doc_id, n_bytes, k AS distinct_bytes, bits, CAST({frequency.HUFFMAN_HEADER} + (bits + 7) // 8 AS BIGINT) AS size, CAST({frequency.HUFFMAN_HEADER} + bits // 8 AS BIGINT) AS size_unflushed FROM b JOIN l USING (doc_id)"""


@query(_BITS)
def huffman_size(spark, sf):
    return frequency.huffman_bits(byte_histogram(spark, sf), "doc_id")


@query("""WITH l AS (SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN [1, 2, 3, 3] WHEN doc_id % 3 = 1 THEN [1, 2, 3, 0] ELSE [1, 1, 2] END) AS length FROM documents)
SELECT doc_id, sum(CASE WHEN length > 0 THEN pow(2.0, -length) ELSE 0 END) AS kraft, CASE WHEN sum(CASE WHEN length > 0 THEN pow(2.0, -length) ELSE 0 END) > 1 THEN 'over-full'
  WHEN sum(CASE WHEN length > 0 THEN pow(2.0, -length) ELSE 0 END) < 1 THEN 'under-full' ELSE 'complete' END AS verdict FROM l GROUP BY doc_id""")
def kraft_check(spark, sf):
    a = lambda *x: F.array(*[F.lit(i) for i in x])
    lengths = F.when(F.col("doc_id") % 3 == 0, a(1, 2, 3, 3)).when(F.col("doc_id") % 3 == 1, a(1, 2, 3, 0)).otherwise(a(1, 1, 2))
    return frequency.kraft(table(spark, sf, "documents").select("doc_id", F.explode(lengths).alias("length")), "doc_id")


_PATTERN = webdict.PATTERN.replace("'", "''")


@query(f"""WITH f AS (SELECT page_id, html, regexp_replace(html, '{_PATTERN}', chr(1), 'g') AS folded FROM pages),
a AS (SELECT *, CAST(length(regexp_replace(folded, '[^\\x00-\\x7F]', '', 'g')) AS BIGINT) AS ascii FROM f)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS original, CAST(len(regexp_extract_all(html, '{_PATTERN}')) AS BIGINT) AS matches, CAST(length(html) - length(folded) AS BIGINT) AS saved,
  CAST(CASE WHEN strlen(html) = 0 THEN 0 ELSE 5 + ascii + 3 * (strlen(folded) - ascii) END AS BIGINT) AS size FROM a""")
def webdict_stats(spark, sf):
    return webdict.webdict_stats(table(spark, sf, "pages"), "page_id", "html")


@query(f"""WITH u AS (SELECT unnest(regexp_extract_all(html, '{_PATTERN}')) AS seed FROM pages), g AS (SELECT seed, count(*) AS n FROM u GROUP BY seed)
SELECT seed, CAST(token AS INTEGER) AS token, n FROM g JOIN {dims.sql_values([(dims.FIRST_TOKEN + i, s) for i, s in enumerate(dims.DICTIONARY)], "token, d")} ON d = seed""")
def webdict_token_usage(spark, sf):
    return webdict.token_usage(table(spark, sf, "pages"), "html")


@query(f"SELECT CAST(token AS INTEGER) AS token, seed, printf('[0x%02X->%s]', token, seed) AS label FROM {dims.sql_values([(dims.FIRST_TOKEN + i, s) for i, s in enumerate(dims.DICTIONARY)], 'token, seed')}")
def webdict_dictionary(spark, sf):
    return dims.dictionary(spark)


# Codecs: no SQL; tests hold them against round trips and layouts.


@query()
def codec_roundtrip(spark, sf):
    """Sizes by each codec and whether it gives the text back."""
    docs = codecs.dealt(table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content")))
    out = None
    for name in codecs.LOSSLESS:
        packed = docs.withColumn("payload", codecs.compress(F.col("content"), name))
        part = packed.select("doc_id", F.lit(name).alias("codec"), F.octet_length("content").cast("long").alias("original"), F.octet_length("payload").cast("long").alias("compressed"), (codecs.decompress(F.col("payload"), name) == F.col("content")).alias("same"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def deflate_size(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    packed = docs.withColumn("compressed", F.octet_length(codecs.compress(F.col("content"), "brotli")).cast("long"))
    return packed.select("doc_id", F.octet_length("content").cast("long").alias("original"), "compressed", F.round(fx.savings_percent(F.octet_length("content"), F.col("compressed")), 4).alias("savings"))


@query()
def lz77_tokens(spark, sf):
    """Literals, matches and encoded size of every text."""
    rows = codecs.lz77_token_rows(table(spark, sf, "documents"), "doc_id", "text")
    sums = rows.groupBy("doc_id").agg(F.count_if("is_literal").alias("literals"), F.count_if(~F.col("is_literal")).alias("matches"), F.max("length").alias("longest"))
    return sums.withColumn("size", (11 + F.ceil((9 * F.col("literals") + 21 * F.col("matches")) / 8)).cast("long"))


@query(f"""{_HIST.replace('WITH p', 'WITH RECURSIVE p')},
m AS (SELECT doc_id, list_sort(list({{'n': n, 's': byte, 'leaves': [{{'byte': byte, 'n': n, 'code': ''}}]}})) AS q FROM h GROUP BY doc_id
  UNION ALL SELECT doc_id, list_sort(list_append(q[3:], {{'n': q[1].n + q[2].n, 's': least(q[1].s, q[2].s), 'leaves': list_concat(
    list_transform(q[1].leaves, lambda x: {{'byte': x.byte, 'n': x.n, 'code': '0' || x.code}}), list_transform(q[2].leaves, lambda x: {{'byte': x.byte, 'n': x.n, 'code': '1' || x.code}}))}})) FROM m WHERE len(q) > 1),
l AS (SELECT doc_id, unnest(q[1].leaves) AS x FROM m WHERE len(q) = 1),
c AS (SELECT doc_id, x.byte AS byte, x.n AS n, CASE WHEN x.code = '' THEN '0' ELSE x.code END AS code FROM l)
SELECT doc_id, byte, CASE WHEN byte BETWEEN 32 AND 126 THEN chr(39) || chr(byte) || chr(39) ELSE printf('0x%02X', byte) END AS label, n, code, CAST(length(code) AS INTEGER) AS length FROM c""")
def huffman_code_table(spark, sf):
    return codecs.code_table(byte_histogram(spark, sf), "doc_id")


@query(f"""SELECT doc_id, sum(pow(2.0, -length)) AS kraft, CASE WHEN sum(pow(2.0, -length)) < 1 THEN 'under-full' ELSE 'complete' END AS verdict FROM ({SQL['huffman_code_table']}) GROUP BY doc_id""")
def kraft_of_codes(spark, sf):
    """The codes of the texts themselves: complete, but for texts of one byte value."""
    return frequency.kraft(huffman_code_table(spark, sf), "doc_id")


@query(f"""{_HIST.replace('WITH p', 'WITH RECURSIVE p')},
m AS (SELECT doc_id, list_sort(list({{'n': n, 's': byte, 'lo': 0, 'hi': 0}})) AS q, CAST(0 AS BIGINT) AS bits, count(*) AS distinct_bytes, CAST(sum(n) AS BIGINT) AS n_bytes FROM h GROUP BY doc_id
  UNION ALL SELECT doc_id, list_sort(list_append(q[3:], {{'n': q[1].n + q[2].n, 's': least(q[1].s, q[2].s), 'lo': 1 + least(q[1].lo, q[2].lo), 'hi': 1 + greatest(q[1].hi, q[2].hi)}})), bits + q[1].n + q[2].n, distinct_bytes, n_bytes FROM m WHERE len(q) > 1)
SELECT doc_id, distinct_bytes, greatest(q[1].lo, 1) AS shortest, greatest(q[1].hi, 1) AS longest, CASE WHEN distinct_bytes = 1 THEN n_bytes ELSE bits END AS bits, n_bytes FROM m WHERE len(q) = 1""")
def huffman_code_summary(spark, sf):
    return codecs.code_summary(huffman_code_table(spark, sf), "doc_id")


@query()
def smart_archive(spark, sf):
    """Pages routed, compressed by their strategy, and read back: strategy, sizes, entry size with metadata, same."""
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("r"), F.col("page_id").cast("string"), _pick(ENDINGS, F.col("page_id"))).alias("name"), F.col("html").cast("binary").alias("content"))
    text_only = routing.route(p.withColumn("name", F.when(F.col("page_id") % 13 == 8, "x.html").otherwise(F.col("name"))))
    packed = codecs.compress_routed(text_only).withColumnRenamed("content", "given")
    back = codecs.decompress_routed(packed)
    return back.select("page_id", "name", "strategy_id", "stored_strategy", F.octet_length("given").cast("long").alias("original"), "compressed_size", reports.entry_size(F.col("name"), F.col("compressed_size")).cast("long").alias("entry_size"), (F.col("given") == F.col("content")).alias("same"))


@query()
def wzip_entries(spark, sf):
    """Every page through an archive on the shared folder and back."""
    from .sources import wzip

    wzip.register(spark)
    folder = f"{_shared(spark)}/wzip-{uuid.uuid4().hex}"
    rows = table(spark, sf, "pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").cast("binary").alias("content"))
    packed = codecs.compress_routed(routing.route(rows))
    packed.select(F.col("name").alias("path"), F.octet_length("content").cast("long").alias("original_size"), F.col("stored_strategy").alias("strategy_id"), "payload").write.format("wzip").mode("append").save(folder)
    back = codecs.decompress_routed(spark.read.format("wzip").load(folder), strategy="strategy_id")
    return back.select("path", "original_size", "strategy_id", F.octet_length("payload").cast("long").alias("stored_size"), F.md5("content").alias("md5"))


# Images.

_SIDE = 12


@query(f"""WITH p AS (SELECT doc_id AS image, CAST(i % {_SIDE} AS INTEGER) AS x, CAST(i // {_SIDE} AS INTEGER) AS y, CAST((doc_id * 31 + i * 7) % 256 AS INTEGER) AS r, CAST((n_chars + i) % 256 AS INTEGER) AS g, CAST((i * i) % 256 AS INTEGER) AS b
  FROM documents, range(0, {_SIDE * (_SIDE - 1)}) t(i))
SELECT image, CAST(x // 5 AS INTEGER) AS x, CAST(y // 5 AS INTEGER) AS y, CAST(sum(r) // count(*) AS INTEGER) AS r, CAST(sum(g) // count(*) AS INTEGER) AS g, CAST(sum(b) // count(*) AS INTEGER) AS b
FROM p WHERE x < 10 AND y < 10 GROUP BY ALL""")
def mean_pool_grid(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("image"), "n_chars")
    i = F.col("i")
    px = docs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(_SIDE * (_SIDE - 1) - 1))))
    px = px.select("image", (i % _SIDE).cast("int").alias("x"), F.floor(i / _SIDE).cast("int").alias("y"), ((F.col("image") * 31 + i * 7) % 256).cast("int").alias("r"), ((F.col("n_chars") + i) % 256).cast("int").alias("g"), ((i * i) % 256).cast("int").alias("b"))
    return images.mean_pool(px, docs.select("image", F.lit(_SIDE).alias("w"), F.lit(_SIDE - 1).alias("h")), 5)


@query("""WITH s AS (SELECT region.r_regionkey AS image, CAST(4 AS INTEGER) AS w, CAST(3 AS INTEGER) AS h, CAST(10 AS INTEGER) AS tw, CAST(9 + r_regionkey AS INTEGER) AS th FROM region),
t AS (SELECT image, CAST(tx AS INTEGER) AS x, CAST(ty AS INTEGER) AS y, CAST(least(tx * w // tw, w - 1) AS INTEGER) AS sx, CAST(least(ty * h // th, h - 1) AS INTEGER) AS sy FROM s, range(0, 10) a(tx), range(0, 20) b(ty) WHERE ty < th)
SELECT image, x, y, CAST(image * 50 + sx * 10 + sy AS INTEGER) AS v FROM t""")
def upscale_nn(spark, sf):
    sizes = table(spark, sf, "region").select(F.col("r_regionkey").alias("image"), F.lit(4).alias("w"), F.lit(3).alias("h"), F.lit(10).alias("tw"), (9 + F.col("r_regionkey")).alias("th"))
    px = sizes.select("image", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("x")).select("image", "x", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("y")).withColumn("v", (F.col("image") * 50 + F.col("x") * 10 + F.col("y")).cast("int"))
    return images.upscale(px, sizes, channels=("v",))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) AS n FROM embeddings)
SELECT vec_id, CAST(i // 5 AS INTEGER) AS at, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM e WHERE i < (n // 5) * 5 GROUP BY ALL""")
def mean_pool_vector(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = e.select("vec_id", F.size("embedding").alias("n"), F.posexplode("embedding").alias("i", "v")).where(F.col("i") < F.floor(F.col("n") / 5) * 5)
    return rows.groupBy("vec_id", F.floor(F.col("i") / 5).cast("int").alias("at")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


# Incremental runs. The old manifest is derived from the documents: some missing, some with another md5, some skipped.


def _current(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.concat(F.lit("/site/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", "doc_id")
    return docs.select("doc_id", "path", F.md5(F.col("text").cast("binary")).alias("md5"), F.octet_length("text").cast("long").alias("size"))


def _packed(spark, sf) -> DataFrame:
    """_current with packed, the dictionary codec's size of the text."""
    docs = webdict.with_stats(table(spark, sf, "documents").select("doc_id", "source", "text"), "text").withColumnRenamed("size", "packed")
    return docs.select("doc_id", F.concat(F.lit("/site/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.md5(F.col("text").cast("binary")).alias("md5"), F.col("original").alias("size"), "packed")


def _manifest(spark, sf) -> DataFrame:
    d = F.col("doc_id")
    rows = _packed(spark, sf).where(d % 5 != 0).withColumn("compressed", (d % 4 != 1) & (F.col("packed") < F.col("size")))
    return rows.select("path", F.when(d % 7 == 0, F.md5(F.lit("old").cast("binary"))).otherwise(F.col("md5")).alias("md5"), "size", "compressed", F.when(F.col("compressed"), F.col("packed")).otherwise(0).cast("long").alias("compressed_size"), F.lit("WebDict").alias("algorithm"), d.alias("seq"))


_CURRENT = "c AS (SELECT doc_id, '/site/' || source || '/' || doc_id || '.txt' AS path, md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS size FROM documents)"
_FOLDED = lambda text: f"regexp_replace({text}, '{_PATTERN}', chr(1), 'g')"
_ENCODED = "CAST(5 + length(regexp_replace(folded, '[^\\x00-\\x7F]', '', 'g')) + 3 * (strlen(folded) - length(regexp_replace(folded, '[^\\x00-\\x7F]', '', 'g'))) AS BIGINT)"
_MANIFEST = f"""WITH {_CURRENT}, e AS (SELECT doc_id, {_ENCODED} AS packed FROM (SELECT doc_id, {_FOLDED('text')} AS folded FROM documents)),
k AS (SELECT c.*, packed, doc_id % 4 <> 1 AND packed < size AS compressed FROM c JOIN e USING (doc_id) WHERE doc_id % 5 <> 0),
m AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN md5('old') ELSE md5 END AS md5, size, compressed, CAST(CASE WHEN compressed THEN packed ELSE 0 END AS BIGINT) AS compressed_size FROM k),
s AS (SELECT c.*, m.compressed, m.compressed_size, CASE WHEN m.path IS NULL THEN 'new' WHEN m.md5 <> c.md5 THEN 'modified' WHEN m.compressed THEN 'unchanged' ELSE 'unchanged_skipped' END AS status FROM c LEFT JOIN m USING (path))"""


@query(f"""{_MANIFEST} SELECT c.path, m.md5 IS NOT NULL AS found FROM c LEFT JOIN m ON m.path = c.path WHERE c.path LIKE '%/7.txt'""")
def manifest_lookup(spark, sf):
    """The manifest's row of each file of one name."""
    wanted = _current(spark, sf).where(F.col("path").endswith("/7.txt")).select("path")
    return wanted.join(_manifest(spark, sf).select("path", F.lit(True).alias("found")), "path", "left").select("path", F.coalesce("found", F.lit(False)).alias("found"))


@query(f"{_MANIFEST} SELECT path, status FROM s")
def inc_status(spark, sf):
    return incremental.status(_current(spark, sf), _manifest(spark, sf)).select("path", "status")


@query(f"{_MANIFEST} SELECT path, status IN ('new', 'modified') AS changed FROM s")
def inc_has_changed(spark, sf):
    return incremental.has_changed(_current(spark, sf), _manifest(spark, sf))


@query(f"{_MANIFEST} SELECT path, md5, size FROM s WHERE status IN ('new', 'modified')")
def inc_modified(spark, sf):
    return incremental.modified_or_new(_current(spark, sf), _manifest(spark, sf)).select("path", "md5", "size")


@query(f"{_MANIFEST} SELECT path, md5, size FROM s WHERE status = 'unchanged'")
def inc_unchanged(spark, sf):
    return incremental.unchanged(_current(spark, sf), _manifest(spark, sf)).select("path", "md5", "size")


@query(f"""{_MANIFEST} SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('new', 'modified')) AS changed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged,
count(*) FILTER (WHERE status = 'unchanged_skipped') AS unchanged_skipped, CAST(coalesce(sum(size - compressed_size) FILTER (WHERE status = 'unchanged'), 0) AS BIGINT) AS bytes_saved_unchanged FROM s""")
def inc_summary(spark, sf):
    return incremental.incremental_summary(incremental.status(_current(spark, sf), _manifest(spark, sf)))


@query(f"""{_MANIFEST}, t AS (SELECT count(*) AS files, count(*) FILTER (WHERE compressed) AS compressed_files, CAST(sum(size) AS BIGINT) AS original, CAST(sum(compressed_size) FILTER (WHERE compressed) AS BIGINT) AS compressed,
CAST(sum(size) FILTER (WHERE compressed) AS BIGINT) AS original_of_compressed FROM m)
SELECT *, round((1 - compressed / original) * 100, 6) AS reference_savings, round((1 - compressed / original_of_compressed) * 100, 6) AS savings FROM t""")
def manifest_totals(spark, sf):
    return incremental.manifest_totals(_manifest(spark, sf))


@query(f"""{_MANIFEST}, f AS (SELECT path, md5, size, 'new' AS algorithm FROM s WHERE status IN ('new', 'modified'))
SELECT coalesce(f.path, m.path) AS path, coalesce(f.md5, m.md5) AS md5, coalesce(f.algorithm, 'WebDict') AS algorithm FROM m FULL JOIN f ON m.path = f.path""")
def manifest_upsert(spark, sf):
    fresh = incremental.modified_or_new(_current(spark, sf), _manifest(spark, sf))
    rows = fresh.select("path", "md5", "size", F.lit(False).alias("compressed"), F.lit(0).cast("long").alias("compressed_size"), F.lit("new").alias("algorithm"), (F.col("doc_id") + 1_000_000_000).alias("seq"))
    return incremental.upsert(_manifest(spark, sf), rows).select("path", "md5", "algorithm")


@query(f"""{_MANIFEST} SELECT path || '|' || md5 || '|' || size || '|' || CASE WHEN compressed THEN 'true' ELSE 'false' END || '||' || compressed_size || '|WebDict' AS value FROM m""")
def manifest_text(spark, sf):
    return incremental.to_text(_manifest(spark, sf).withColumn("compressed_path", F.lit(None).cast("string")))


@query(f"WITH {_CURRENT} SELECT md5, count(*) AS copies, min(path) AS first_path, CAST(sum(size) - max(size) AS BIGINT) AS redundant_bytes FROM c GROUP BY md5 HAVING count(*) > 1")
def duplicate_content(spark, sf):
    return incremental.duplicate_content(_current(spark, sf))


@query(f"{_MANIFEST} SELECT c.path, size, packed, CASE WHEN packed < size THEN 'compressed' ELSE 'skipped' END AS outcome FROM c JOIN e USING (doc_id)")
def skip_not_smaller(spark, sf):
    return _packed(spark, sf).select("path", "size", "packed", incremental.outcome(F.col("size"), F.col("packed")).alias("outcome"))


@query(f"""{_MANIFEST} SELECT path, CASE WHEN size > 0 THEN round(compressed_size / size, 6) ELSE 0.0 END AS ratio, CASE WHEN size > 0 THEN round((1 - compressed_size / size) * 100, 6) ELSE 0.0 END AS savings,
size - compressed_size AS saved, CASE WHEN size > 0 THEN round(compressed_size / size, 6) ELSE 1.0 END AS dispatch_ratio FROM m""")
def fingerprint_metrics(spark, sf):
    s, c = F.col("size"), F.col("compressed_size")
    return _manifest(spark, sf).select("path", F.round(fx.ratio(s, c), 6).alias("ratio"), F.round(fx.savings_percent(s, c), 6).alias("savings"), (s - c).alias("saved"), F.round(fx.ratio(s, c, 1.0), 6).alias("dispatch_ratio"))


# Transfer times.


def _sized(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").groupBy("source").agg((F.sum(F.octet_length("text")) * 100).cast("long").alias("original"))
    return docs.withColumn("compressed", F.floor(F.col("original") * 3 / 10).cast("long"))


_PROFILES = dims.sql_values([(i, *p) for i, p in enumerate(dims.PROFILES)], "ordinal, profile, down, up, latency")
_MS = lambda size, mbps: f"CAST(CASE WHEN {size} <= 0 THEN 0 ELSE {size} * 1000 // ({mbps} * 125000) + latency * CASE WHEN {size} > 1048576 THEN 3 ELSE 1 END END AS BIGINT)"
_SIZED = f"""WITH d AS (SELECT source, CAST(sum(strlen(text)) * 100 AS BIGINT) AS original FROM documents GROUP BY source), z AS (SELECT *, CAST(original * 3 // 10 AS BIGINT) AS compressed FROM d),
e AS (SELECT z.*, profile, {_MS('original', 'down')} AS down_original_ms, {_MS('compressed', 'down')} AS down_compressed_ms, {_MS('original', 'up')} AS up_original_ms, {_MS('compressed', 'up')} AS up_compressed_ms FROM z, {_PROFILES})"""


@query(f"SELECT CAST(ordinal AS INTEGER) AS ordinal, profile, CAST(down AS BIGINT) AS download_mbps, CAST(up AS BIGINT) AS upload_mbps, CAST(latency AS INTEGER) AS latency_ms FROM {_PROFILES}")
def network_profiles(spark, sf):
    return dims.profiles(spark)


@query(f"{_SIZED} SELECT source, profile, down_original_ms, down_compressed_ms, down_original_ms - down_compressed_ms AS down_saved_ms, CASE WHEN original > 0 THEN round((1 - compressed / original) * 100, 6) ELSE 0 END AS savings_percent FROM e")
def transfer_profiles(spark, sf):
    return transfer.estimate(_sized(spark, sf)).select("source", "profile", "down_original_ms", "down_compressed_ms", "down_saved_ms", "savings_percent")


@query(f"{_SIZED} SELECT source, profile, up_original_ms, up_compressed_ms, up_original_ms - up_compressed_ms AS up_saved_ms FROM e")
def transfer_upload(spark, sf):
    return transfer.estimate(_sized(spark, sf)).select("source", "profile", "up_original_ms", "up_compressed_ms", "up_saved_ms")


@query(f"""WITH d AS (SELECT source, CAST(sum(strlen(text)) * 100 AS BIGINT) AS original FROM documents GROUP BY source), z AS (SELECT CAST(sum(original) AS BIGINT) AS original, CAST(sum(original * 3 // 10) AS BIGINT) AS compressed FROM d)
SELECT profile, original, compressed, {_MS('original', 'down')} AS down_original_ms, {_MS('compressed', 'down')} AS down_compressed_ms FROM z, {_PROFILES}""")
def transfer_batch(spark, sf):
    return transfer.batch_estimate(_sized(spark, sf)).select("profile", "original", "compressed", "down_original_ms", "down_compressed_ms")


@query(f"""{_SIZED}, t AS (SELECT *, down_original_ms - down_compressed_ms AS saved FROM e)
SELECT source, profile, CASE WHEN saved > 3600000 THEN 'bandwidth costs' WHEN saved > 60000 THEN 'waiting times' WHEN saved > 1000 THEN 'responsiveness' WHEN saved > 0 THEN 'slight' ELSE 'none' END AS tier FROM t""")
def transfer_tier(spark, sf):
    return transfer.estimate(_sized(spark, sf)).select("source", "profile", "tier")


_DURATION = lambda v: f"CASE WHEN {v} < 1000 THEN {v} || ' ms' WHEN {v} < 60000 THEN printf('%.2f s', round({v} / 1000.0, 2)) WHEN {v} < 3600000 THEN ({v} // 60000) || ' min ' || ({v} % 60000 // 1000) || ' s' ELSE ({v} // 3600000) || ' h ' || ({v} % 3600000 // 60000) || ' min' END"
_SHORT = lambda v: f"CASE WHEN {v} < 1000 THEN {v} || ' ms' WHEN {v} < 60000 THEN printf('%.2f s', round({v} / 1000.0, 2)) ELSE printf('%.1f min', round({v} / 60000.0, 1)) END"
_MB = lambda b: f"CASE WHEN {b} < 1024 THEN {b} || ' B' WHEN {b} < 1048576 THEN printf('%.2f KB', round({b} / 1024.0, 2)) ELSE printf('%.2f MB', round({b} / 1048576.0, 2)) END"


@query(f"""{_SIZED}, t AS (SELECT e.*, p.down, p.up, p.latency AS lag, original - compressed AS less, down_original_ms - down_compressed_ms AS saved FROM e JOIN {_PROFILES.replace(') t(', ') p(')} USING (profile))
SELECT source, profile, printf('Network: %s (down %d Mbps, up %d Mbps, latency %d ms)', profile, down, up, lag) || chr(10) || 'Original: ' || {_FSIZE('original')} || ', compressed: ' || {_FSIZE('compressed')} || ', saved: ' || {_FSIZE('less')}
  || printf(' (%.1f%%)', round(round((1 - compressed / original) * 100, 6), 1)) || chr(10) || 'Transfer: ' || {_DURATION('down_original_ms')} || ', compressed: ' || {_DURATION('down_compressed_ms')} || ', saved: ' || {_DURATION('saved')} || chr(10) || 'Improves: '
  || CASE WHEN saved > 3600000 THEN 'bandwidth costs' WHEN saved > 60000 THEN 'waiting times' WHEN saved > 1000 THEN 'responsiveness' WHEN saved > 0 THEN 'slight' ELSE 'none' END AS report,
  profile || ': ' || {_MB('original')} || ' -> ' || {_MB('compressed')} || ', ' || {_SHORT('down_original_ms')} || ' -> ' || {_SHORT('down_compressed_ms')} AS line FROM t""")
def transfer_report(spark, sf):
    return transfer.report(transfer.estimate(_sized(spark, sf))).select("source", "profile", "report", "line")


# Reports.


@query(f"""{_MANIFEST}, t AS (SELECT count(*) AS files, count(*) FILTER (WHERE compressed) AS done, CAST(sum(size) AS BIGINT) AS original, CAST(coalesce(sum(compressed_size) FILTER (WHERE compressed), 0) AS BIGINT) AS packed FROM m)
SELECT printf('files: %d, compressed: %d, size: %s, compressed size: %s, savings: %.2f%%', files, done, {_FSIZE('original')}, {_FSIZE('packed')}, round(round((1 - packed / original) * 100, 6), 2)) AS text FROM t""")
def manifest_totals_text(spark, sf):
    return incremental.totals_text(incremental.manifest_totals(_manifest(spark, sf))).select("text")


@query(f"""{_MANIFEST} SELECT path, 'File: ' || regexp_extract(path, '([^/]*)$', 1) || chr(10) || 'Path: ' || path || chr(10) || 'MD5: ' || md5 || chr(10) || 'Size: ' || {_FSIZE('size')} || chr(10) || 'Compressed: ' || CASE WHEN compressed THEN 'yes' ELSE 'no' END
  || chr(10) || 'Codec: WebDict' || chr(10) || 'Compressed size: ' || CASE WHEN compressed THEN {_FSIZE('compressed_size')} ELSE 'none' END || chr(10) || 'Saved: '
  || printf('%d bytes (%.2f%%)', CASE WHEN compressed THEN size - compressed_size ELSE 0 END, CASE WHEN compressed THEN round((1 - compressed_size / size) * 100, 2) ELSE 0.0 END) AS text FROM m""")
def fingerprint_detail(spark, sf):
    return incremental.detail(_manifest(spark, sf))


@query(f"""{_MANIFEST} SELECT doc_id, printf('[%s] original: %d bytes, compressed: %d bytes, ratio: %.2f%%, savings: %.2f%%', 'WebDict', size, packed, round(100.0 * packed / size, 2), round(100 - round(100.0 * packed / size, 2), 2)) AS text FROM c JOIN e USING (doc_id)""")
def stats_text(spark, sf):
    rows = _packed(spark, sf).withColumnsRenamed({"size": "original", "packed": "compressed"})
    return reports.stats_text(rows, F.lit("WebDict")).select("doc_id", "text")


@query(f"""WITH f AS (SELECT page_id, html, {_FOLDED('html')} AS folded FROM pages)
SELECT page_id, printf('Dictionary: {len(dims.DICTIONARY)} entries' || chr(10) || 'Original: %d bytes' || chr(10) || 'Encoded: %d bytes' || chr(10) || 'Matches: %d' || chr(10) || 'Characters saved: %d',
  strlen(html), {_ENCODED}, CAST(len(regexp_extract_all(html, '{_PATTERN}')) AS BIGINT), length(html) - length(folded)) AS report FROM f""")
def webdict_report(spark, sf):
    return webdict.report(webdict.webdict_stats(table(spark, sf, "pages"), "page_id", "html")).select("page_id", "report")


def _files(spark, sf) -> DataFrame:
    """Pages as files of a run, with the dictionary codec's sizes; some are empty, some have failed."""
    p = F.col("page_id")
    pages = table(spark, sf, "pages").select("page_id", F.concat(F.lit("r"), p.cast("string"), _pick(ENDINGS, p)).alias("name"), F.when(p % 17 == 0, "").otherwise(F.col("html")).alias("html"))
    rows = webdict.with_stats(pages, "html").withColumnRenamed("size", "compressed")
    return rows.select("page_id", F.concat(F.lit("site/"), F.col("name")).alias("path"), "name", "original", "compressed", F.when(p % 11 == 0, "failed").alias("error"))


_FILES = _NAMED + f""", o AS (SELECT page_id, 'site/' || name AS path, name, CASE WHEN page_id % 17 = 0 THEN '' ELSE html END AS html FROM x JOIN (SELECT page_id, html FROM pages) USING (page_id)),
f AS (SELECT page_id, path, name, CAST(strlen(html) AS BIGINT) AS original, CASE WHEN html = '' THEN 0 ELSE {_ENCODED} END AS compressed, CASE WHEN page_id % 11 = 0 THEN 'failed' END AS error FROM (SELECT *, {_FOLDED('html')} AS folded FROM o))"""


@query(f"""{_FILES}, t AS (SELECT count(*) FILTER (WHERE error IS NULL) AS processed, count(*) FILTER (WHERE error IS NOT NULL) AS failed, CAST(coalesce(sum(original) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS original,
CAST(coalesce(sum(compressed) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS compressed FROM f) SELECT *, {_SAVE('original', 'compressed')} AS savings, {_FSIZE('original')} AS original_text, {_FSIZE('compressed')} AS compressed_text FROM t""")
def run_summary(spark, sf):
    return reports.run_summary(_files(spark, sf))


@query(f"""{_FILES}, t AS (SELECT count(*) AS files, CAST(sum(original) AS BIGINT) AS original, CAST(sum(19 + strlen(path) + compressed) + 9 AS BIGINT) AS archive FROM f) SELECT *, {_SAVE('original', 'archive')} AS savings FROM t""")
def archive_overhead(spark, sf):
    return reports.archive_summary(_files(spark, sf))


@query(f"{_FILES} SELECT page_id, {_SAVE('original', 'compressed')} AS savings, {_SAVE('original', '19 + strlen(path) + compressed')} AS net_savings FROM f")
def archive_entry_savings(spark, sf):
    return reports.entry_savings(_files(spark, sf)).select("page_id", "savings", "net_savings")


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * l_extendedprice * (l_orderkey % 5)) AS BIGINT) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, b, {_FSIZE('b')} AS size_text, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.2f KB', round(b / 1024.0, 2)) ELSE printf('%.2f MB', round(b / 1048576.0, 2)) END AS short_text FROM t""")
def size_format(spark, sf):
    b = F.floor(F.col("l_extendedprice") * F.col("l_extendedprice") * (F.col("l_orderkey") % 5)).cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", b.alias("b")).withColumn("size_text", fx.format_file_size(F.col("b"))).withColumn("short_text", fx.format_size_short(F.col("b")))


@query("""WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice * (o_orderkey % 60)) AS BIGINT) AS ms FROM orders)
SELECT o_orderkey, ms, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN printf('%.2f s', round(ms / 1000.0, 2)) WHEN ms < 3600000 THEN (ms // 60000) || ' min ' || (ms % 60000 // 1000) || ' s' ELSE (ms // 3600000) || ' h ' || (ms % 3600000 // 60000) || ' min' END AS duration,
CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN printf('%.2f s', round(ms / 1000.0, 2)) ELSE printf('%.1f min', round(ms / 60000.0, 1)) END AS short_text FROM t""")
def duration_format(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 60)).cast("long").alias("ms"))
    return rows.withColumn("duration", fx.format_duration(F.col("ms"))).withColumn("short_text", fx.format_duration_short(F.col("ms")))


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '.html' WHEN p_partkey % 3 = 1 THEN p_name ELSE 'x' || p_partkey || '.css' END AS name FROM part)
SELECT p_partkey, name, CASE WHEN length(name) <= 15 THEN name WHEN contains(name, '.') AND length(regexp_replace(name, '\\.[^.]*$', '')) > 10 THEN substr(name, 1, 7) || '...' || regexp_extract(name, '(\\.[^.]*)$', 1) ELSE substr(name, 1, 12) || '...' END AS label FROM t""")
def shorten_name(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat("p_name", F.lit(".html"))).when(k % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("x"), k.cast("string"), F.lit(".css")))
    return table(spark, sf, "part").select("p_partkey", name.alias("name")).withColumn("label", fx.shorten_file_name(F.col("name")))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * power(10, l_orderkey % 6) / 100) AS DOUBLE) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, v, CASE WHEN v <= 1024 THEN 200.0 WHEN v <= 1e4 THEN 2e3 WHEN v <= 1e5 THEN 2e4 WHEN v <= 1e6 THEN 2e5 WHEN v <= 1e7 THEN 2e6 WHEN v <= 1e8 THEN 2e7 ELSE v / 5 END AS tick FROM t""")
def tick_unit(spark, sf):
    v = F.floor(F.col("l_extendedprice") * F.pow(F.lit(10), F.col("l_orderkey") % 6) / 100).cast("double")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v")).withColumn("tick", fx.tick_unit(F.col("v")))


@query("""WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice * 10 * (o_orderkey % 3)) AS DOUBLE) AS v FROM orders)
SELECT o_orderkey, CASE WHEN v >= 1e6 THEN printf('%.1fM', round(v / 1e6, 1)) WHEN v >= 1e3 THEN printf('%.1fK', round(v / 1e3, 1)) ELSE printf('%.0f', v) END AS label,
CASE WHEN v >= 1e6 THEN printf('%.1f MB', round(v / 1e6, 1)) WHEN v >= 1e3 THEN printf('%.1f KB', round(v / 1e3, 1)) ELSE printf('%.0f B', v) END AS bytes_label FROM t""")
def axis_label(spark, sf):
    v = F.floor(F.col("o_totalprice") * 10 * (F.col("o_orderkey") % 3)).cast("double")
    return table(spark, sf, "orders").select("o_orderkey", fx.axis_label(v).alias("label"), fx.axis_bytes_label(v).alias("bytes_label"))


@query(f"{_FILES} SELECT greatest(max(greatest(original, compressed)) * 1.2, 1024.0) AS axis_max FROM f".replace("* 1.2", "* CAST(1.2 AS DOUBLE)").replace("1024.0)", "CAST(1024 AS DOUBLE))"))
def chart_axis(spark, sf):
    return reports.chart_axis(_files(spark, sf)).select("axis_max")


@query(f"{_FILES} SELECT name, original, compressed, original - compressed AS savings, {_SAVE('original', 'compressed')} AS savings_percent FROM f")
def chart_data(spark, sf):
    return reports.chart_rows(_files(spark, sf)).drop("label")


@query("SELECT DISTINCT '/up/' || (page_id // 2) || '.html' AS path FROM pages")
def dedupe_paths(spark, sf):
    return table(spark, sf, "pages").select(F.concat(F.lit("/up/"), F.floor(F.col("page_id") / 2).cast("string"), F.lit(".html")).alias("path")).dropDuplicates(["path"])


@query(f"""{_NAMED}, h AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN '.' || name ELSE name END AS name FROM x)
SELECT page_id, name FROM h WHERE name NOT LIKE '.%' AND lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) IN ('html', 'css', 'png')""")
def filter_ext_hidden(spark, sf):
    from .sources.files import visible

    rows = _named(spark, sf).withColumn("name", F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("."), "name")).otherwise(F.col("name")))
    return visible(rows, ["html", "css", "png"]).select("page_id", "name")


@query("SELECT count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages")
def selected_totals(spark, sf):
    return table(spark, sf, "pages").agg(F.count("*").alias("files"), F.sum(F.octet_length("html")).cast("long").alias("bytes"))


@query("SELECT page_id, md5(html) AS md5, lower(hex(encode(substr(url, 1, 8)))) AS head_hex, true AS verified FROM pages")
def content_hashes(spark, sf):
    b = F.col("html").cast("binary")
    return table(spark, sf, "pages").select("page_id", fx.md5_text(F.col("html")).alias("md5"), fx.bytes_to_hex(F.substring("url", 1, 8).cast("binary")).alias("head_hex"), fx.verify_md5(b, F.upper(F.md5(b))).alias("verified"))


@query("SELECT page_id, regexp_replace(url, '^https?://', '') AS path, CASE WHEN starts_with(url, 'https://') THEN substr(url, 8) ELSE url END AS relative FROM pages WHERE url IS NOT NULL")
def path_relative(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").where(u.isNotNull()).select("page_id", F.regexp_replace(u, "^https?://", "").alias("path"), fx.relative_path(u, "https:/").alias("relative"))


@query(f"{_NAMED} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'named.wzip' WHEN page_id % 3 = 1 THEN 'folder.wzip' ELSE regexp_replace(name, '(.)\\.[^.]*$', '\\1') || '.wzip' END AS archive FROM x")
def archive_names(spark, sf):
    p = F.col("page_id")
    return _named(spark, sf).select("page_id", fx.archive_name(F.when(p % 3 == 0, "named"), F.when(p % 3 == 1, "folder"), F.col("name"), F.lit(False), F.lit("0")).alias("archive"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Pages routed and sized by the dictionary codec, summed by resource type, timed on every network profile."""
    pages = table(spark, sf, "pages")
    kind = routing.resource_type(F.regexp_replace("url", "[?#].*$", ""), routing.sniff(F.col("html").cast("binary")))
    routed = webdict.with_stats(pages.select("html", kind.alias("resource_type")), "html")
    totals = routed.groupBy("resource_type").agg(F.count("*").alias("files"), F.sum("original").cast("long").alias("original"), F.sum("size").cast("long").alias("compressed"))
    return transfer.estimate(totals).select("resource_type", "files", "original", "compressed", "profile", "down_original_ms", "down_compressed_ms", "down_saved_ms", "savings_percent", "tier")


@query(f"""WITH f AS (SELECT page_id, html, regexp_replace(html, '{_PATTERN}', chr(1), 'g') AS folded, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[^.]*)$', 1)) AS ext FROM pages),
a AS (SELECT *, length(regexp_replace(folded, '[^\\x00-\\x7F]', '', 'g')) AS ascii, {_MAPPED} AS s FROM f),
g AS (SELECT CASE WHEN s = 5 THEN 'WEB_TEXT' WHEN s = 4 THEN 'IMAGE' WHEN s = 2 THEN 'BINARY_FONT' ELSE 'OTHER' END AS resource_type, count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS original,
  CAST(sum(CASE WHEN strlen(html) = 0 THEN 0 ELSE 5 + ascii + 3 * (strlen(folded) - ascii) END) AS BIGINT) AS compressed FROM a GROUP BY 1),
e AS (SELECT g.*, profile, {_MS('original', 'down')} AS down_original_ms, {_MS('compressed', 'down')} AS down_compressed_ms FROM g, {_PROFILES}), t AS (SELECT *, down_original_ms - down_compressed_ms AS down_saved_ms FROM e)
SELECT *, {_SAVE('original', 'compressed')} AS savings_percent, CASE WHEN down_saved_ms > 3600000 THEN 'bandwidth costs' WHEN down_saved_ms > 60000 THEN 'waiting times' WHEN down_saved_ms > 1000 THEN 'responsiveness' WHEN down_saved_ms > 0 THEN 'slight' ELSE 'none' END AS tier FROM t""")
def web_compression_report(spark, sf):
    return flagship(spark, sf)

