"""Line dedup by distinct-site spread, in DataFrame operations only.

A HyperLogLog sketch of sites is aggregated for each line hash (partly before the shuffle, then merged), so a line
that most sites carry meets no single task with all its rows.  Lines whose estimate is near the threshold get an
exact distinct count.  Lines of at least SITES sites are boilerplate and are removed from every text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import BROADCAST_BYTES, drop, line_mask, staged, table, without_lines

SITES = 8
LOG_K = 12
MARGIN = 0.25  # relative; fifteen standard errors of a sketch with 2**12 registers


def normal_line(line: Column) -> Column:
    """ASCII lower case, runs of white space as one space, none at the ends."""
    return F.translate(F.trim(F.regexp_replace(line, r"[ \t\r\x0B\f]+", " ")), string.ascii_uppercase, string.ascii_lowercase)


def lines_of(docs: DataFrame, site: str) -> DataFrame:
    """k1, k2 (of the row's id and text), site, and hashes of the text's lines in order; null for lines without words."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), normal_line)
    base = docs.select(*_keys(), F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit("\x00null"))).alias("site"), lines.alias("lines"))
    return base.select("k1", "k2", "site", F.transform("lines", lambda x: F.when(x != "", F.xxhash64(x))).alias("hashes"))


def _keys() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("k2")]


def spread_lines(hashed: DataFrame, sites: int = SITES) -> DataFrame:
    """hash of each line that at least sites sites carry."""
    rows = hashed.select("site", F.explode("hashes").alias("hash")).where("hash is not null")
    sketch = rows.groupBy("hash").agg(F.hll_sketch_agg("site", LOG_K).alias("sketch"))
    guess = staged(sketch.select("hash", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") > sites * (1 - MARGIN) - 1), "spread")
    sure = guess.where(F.col("sites") > sites * (1 + MARGIN) + 1).select("hash")
    near = guess.where(F.col("sites") <= sites * (1 + MARGIN) + 1).select("hash")
    exact = rows.join(near, "hash", "left_semi").groupBy("hash").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= sites).select("hash")
    return sure.union(exact)


def remove_spread_lines(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """docs with text without its boilerplate lines, and n_lines and n_removed_lines.

    A null text stays null and counts as one empty line; lines without words are never removed; a null site is a site
    of its own; repeated rows are cleaned alike; an empty table stays empty.  A column that is named like one of the
    two added ones is replaced.
    """
    hashed = staged(lines_of(docs, site), "lines")
    spread = staged(spread_lines(hashed, sites), "boilerplate")
    found = hashed.select("k1", "k2", F.posexplode("hashes").alias("at", "hash")).join(spread, "hash")
    gone = staged(found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("at")).alias("at")), "gone")
    drop(hashed, spread)
    bytes_ = gone.agg(F.sum(160 + F.array_max("at"))).first()[0] or 0
    gone = gone.select("k1", "k2", F.size("at").cast("long").alias("n"), line_mask("at").alias("mask"))
    keyed = docs.select(F.struct("*").alias("doc"), *_keys())
    met = keyed.join(F.broadcast(gone) if bytes_ <= BROADCAST_BYTES else gone, ["k1", "k2"], "left")
    text = F.col("doc.text")
    new = {
        "text": F.when(F.col("mask").isNull(), text).otherwise(without_lines(text, "mask")),
        "n_lines": F.when(text.isNull(), 1).otherwise(F.size(F.split(text, "\n"))).cast("long"),
        "n_removed_lines": F.coalesce("n", F.lit(0)).cast("long"),
    }
    names = [*(c for c in docs.columns if c not in ("n_lines", "n_removed_lines")), "n_lines", "n_removed_lines"]
    return met.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in names))


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_spread_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


_FROM, _TO = string.ascii_uppercase, string.ascii_lowercase
OP9_SQL = rf"""
WITH l AS (
  SELECT doc_id, source, i, line,
         translate(trim(regexp_replace(line, '[ \t\r\x0B\f]+', ' ', 'g'), ' '), '{_FROM}', '{_TO}') AS norm
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
b AS (SELECT norm FROM l WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT coalesce(source, chr(1))) >= {SITES}),
k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE b.norm IS NOT NULL) AS n_removed_lines,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.norm IS NULL), '') AS kept
  FROM l LEFT JOIN b ON l.norm = b.norm GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed_lines, length(kept) AS kept_chars, md5(kept) AS kept_md5 FROM k
"""
