"""Quality rules: word and repetition rules of a text, then lines that too many documents of a host carry.

Lines are normalised (ASCII lower case, digits as 0, runs of spaces as one) and hashed with their host.  For each
such line the distinct documents are counted; documents are told apart by the whole set of their normalised lines, so
exact copies of one document count as one and a copied document is not taken for boilerplate.  A line above
max(min_docs, share * documents of the host) is removed; a document that keeps less than ten words or less than a fifth
of its words is depleted.

quality_rules gives the counts and verdicts, clean_texts the documents that stay, without the removed lines.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import BROADCAST_BYTES, GOLDEN, LINE_BYTE, LOWER, WORD_BYTE, U, batch, line_mask, mix, pieces, powers, ship, spans_hash, staged, table, windows_hash, without_lines

MIN_DOCS, SHARE = 20, 0.10
LEAST_WORDS, LEAST_PART = 10, 0.2
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS.encode())] = 1
_NORMAL = LOWER.copy()
_NORMAL[48:58] = 48
NORMAL_BYTE = WORD_BYTE[_NORMAL]
ROWS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("host", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), *[(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("line_keys", pa.list_(pa.int64())), ("line_at", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64())), ("name", pa.int64())])
SCHEMA = ", ".join(f"{f.name} {'array<long>' if pa.types.is_list(f.type) else 'long'}" for f in ROWS)


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def _twice(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: the hashes that their row has twice or more, and those with an equal one before."""
    with np.errstate(over="ignore"):
        k = mix(h + row.astype(U) * U(GOLDEN))
    order = np.argsort(k, kind="stable")
    k = k[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    later[order] = same[:-1]
    twice[order] = same[:-1] | same[1:]
    return twice, later


def _names(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts a hash of its set of line hashes."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.append(True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])) if len(h) else np.zeros(0, bool)
    out = np.zeros(n, U)
    with np.errstate(over="ignore"):
        np.add.at(out, r[new], mix(x[new] + U(GOLDEN)))
        return mix(out)


def measure(batches):
    """Rows (doc_id, text, host hash, k1, k2) to ROWS; uid tells rows apart, whatever their ids are."""
    from pyspark import TaskContext

    uid = TaskContext.get().partitionId() << 40
    for b in batches:
        host = b.column(2).to_numpy(zero_copy_only=False).view(U)
        ids = b.column(0).cast(pa.int64())
        for p in pieces(b.column(1)):
            p.words()
            p.lines()
            m = p.hi - p.lo
            chars = (p.data & 0xC0) != 0x80
            solid = WORD_BYTE[p.data] != 0
            w = spans_hash(p.data, p.start, p.end, WORD_BYTE)
            at, h = windows_hash(w, p.row, 5)
            at = at[_twice(h, p.row[at])[0]]
            cover = np.zeros(len(w) + 6, np.int64)
            cover[at] += 1
            cover[at + 5] -= 1
            covered = np.cumsum(cover)[: len(w)] > 0
            a, z = np.searchsorted(p.start, p.line_start), np.searchsorted(p.start, p.line_end)
            full = z > a
            a, z, row = a[full], z[full], p.line_row[full]
            place = (np.arange(len(full)) - p.line_first[p.line_row])[full]
            raw = spans_hash(p.data, p.line_start[full], p.line_end[full], LINE_BYTE, gaps=True)
            later = _twice(raw, row)[1]
            with np.errstate(over="ignore"):
                if len(a):
                    pw, inv = powers(len(w) + 1)
                    line = mix(np.add.reduceat(spans_hash(p.data, p.start, p.end, NORMAL_BYTE) * pw[: len(w)], a) * inv[a] + (z - a).astype(U))
                    keyed = mix(line + host[p.lo : p.hi][row] * U(GOLDEN))
                else:
                    line = keyed = np.zeros(0, U)
            offs = np.searchsorted(row, np.arange(m + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offs), pa.array(x)) for x in (keyed.view(np.int64), place, (z - a).astype(np.int64))]
            yield batch(ROWS, uid=uid + np.arange(m), doc_id=ids.slice(p.lo, m), host=host[p.lo : p.hi].view(np.int64), k1=b.column(3).slice(p.lo, m), k2=b.column(4).slice(p.lo, m), n_words=np.diff(p.first), word_chars=per_row(chars & solid, p.offs), n_symbols=per_row(_SYMBOL[p.data], p.offs), n_dup_lines=np.bincount(row[later], minlength=m), n_repeat_words=np.bincount(p.row[covered], minlength=m), line_keys=lists[0], line_at=lists[1], line_words=lists[2], name=_names(line, row, m).view(np.int64))
            uid += m


def quality_rules(docs: DataFrame, host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """A row for each row of docs: doc_id, the counts, base_failed, n_removed_lines, n_kept_words, kept.

    A null or empty text has no words and fails; a null host is a host of its own; repeated rows count as copies (one
    document) and are judged alike; a null doc_id is returned as it is.  An empty table gives no rows; columns other
    than doc_id, text and the host are ignored.
    """
    return _judged(docs, host_col, min_docs, share).drop("uid", "k1", "k2", "gone_at")


def _keys(host_col: str) -> list[Column]:
    """Two hashes of a row's id, host and text: rows that agree in them are judged alike."""
    host = F.col(host_col).cast("string")
    return [F.xxhash64("doc_id", F.lit(0), host, F.lit(0), "text"), F.xxhash64("text", F.lit(1), host, F.lit(1), "doc_id")]


def _judged(docs: DataFrame, host_col: str, min_docs: int, share: float) -> DataFrame:
    host = F.xxhash64(F.coalesce(F.col(host_col).cast("string"), F.lit("\x00null")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), host.alias("host"), *(k.alias(n) for n, k in zip(("k1", "k2"), _keys(host_col), strict=True)))
    rows = staged(base.mapInArrow(measure, SCHEMA), "measured")
    limits = rows.groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.count("*") * F.lit(share)).alias("limit"))
    lines = rows.select("host", "name", F.explode(F.array_distinct("line_keys")).alias("key"))
    often = lines.distinct().groupBy("host", "key").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    often = staged(often.join(limits, "host").where(F.col("docs") > F.col("limit")).select("host", "key"), "often")
    found = rows.select("uid", "host", F.explode(F.arrays_zip("line_keys", "line_at", "line_words")).alias("x")).select("uid", "host", F.col("x.line_keys").alias("key"), F.col("x.line_at").alias("at"), F.col("x.line_words").alias("words"))
    removed = found.join(often, ["host", "key"], "left_semi").groupBy("uid").agg(F.count("*").alias("n_removed_lines"), F.sum("words").alias("gone"), F.sort_array(F.collect_list("at")).alias("gone_at"))
    out = rows.drop("line_keys", "line_at", "line_words", "name", "host").join(removed, "uid", "left").na.fill(0, ["n_removed_lines", "gone"])
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    out = out.withColumn("n_kept_words", F.col("n_words") - F.col("gone"))
    depleted = (F.col("n_removed_lines") > 0) & ((F.col("n_kept_words") < LEAST_WORDS) | (F.col("n_kept_words") < LEAST_PART * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("gone")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def rules_sql(min_docs: int = MIN_DOCS, share: float = SHARE) -> str:
    """quality_rules of documents as DuckDB SQL; ids are taken to be distinct."""
    space, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(source, chr(1) || 'null') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
l AS (SELECT doc_id, host, line, trim(regexp_replace(regexp_replace(translate(line, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[0-9]', '0', 'g'), '{space}', ' ', 'g'), ' ') AS norm, len(regexp_extract_all(line, '{word}')) AS words
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM t)),
d AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM l WHERE words > 0 GROUP BY ALL) GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g), range(0, 5) x(k) WHERE n > 1 GROUP BY doc_id),
names AS (SELECT doc_id, host, list_sort(list(DISTINCT norm)) AS name FROM l WHERE words > 0 GROUP BY ALL),
often AS (SELECT l.host, l.norm, count(DISTINCT name) AS docs FROM l JOIN names USING (doc_id) WHERE words > 0 GROUP BY l.host, l.norm),
gone AS (SELECT o.host, norm FROM often o JOIN (SELECT host, count(*) AS n FROM t GROUP BY host) h ON o.host = h.host WHERE docs > greatest({min_docs}, n * CAST({share} AS DOUBLE))),
x AS (SELECT doc_id, count(*) AS n_removed_lines, CAST(sum(words) AS BIGINT) AS lost FROM l JOIN gone USING (host, norm) WHERE words > 0 GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{space}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(lost, 0) AS lost FROM t LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - lost AS n_kept_words FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines, base_failed, n_kept_words,
  NOT base_failed AND NOT (n_removed_lines > 0 AND (n_kept_words < {LEAST_WORDS} OR n_kept_words < {LEAST_PART} * n_words)) AS kept FROM v
"""


OP3_SQL = rules_sql()


def clean_texts(docs: DataFrame, host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """The rows of docs that the rules keep, their texts without the removed lines, and n_removed_lines (long).

    Nulls, repeated rows and an empty table are judged as by quality_rules, so null and empty texts go; other columns
    stay as they are, but one named n_removed_lines is replaced.
    """
    verdict = _judged(docs, host_col, min_docs, share).where(~F.col("kept") | (F.col("n_removed_lines") > 0))
    at = F.when(F.col("kept"), F.col("gone_at"))  # a rejected row's lines are not cut
    verdict = staged(verdict.select("k1", "k2", "kept", at.alias("at")).dropDuplicates(["k1", "k2"]), "verdicts")
    size = verdict.agg(F.sum(160 + F.coalesce(F.array_max("at"), F.lit(0)))).first()[0] or 0
    verdict = verdict.select("k1", "k2", "kept", F.size("at").cast("long").alias("gone"), line_mask("at").alias("mask"))
    keyed = docs.select(F.struct("*").alias("doc"), *(k.alias(n) for n, k in zip(("k1", "k2"), _keys(host_col), strict=True)))
    met = keyed.join(F.broadcast(verdict) if size <= BROADCAST_BYTES else verdict, ["k1", "k2"], "left").where(F.coalesce("kept", F.lit(True)))
    cut = F.when(F.col("mask").isNull(), F.col("doc.text")).otherwise(without_lines("doc.text", "mask"))
    new = {"text": cut, "n_removed_lines": F.when(F.col("mask").isNull(), F.lit(0)).otherwise(F.col("gone")).cast("long")}
    names = [*(c for c in docs.columns if c != "n_removed_lines"), "n_removed_lines"]
    return met.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in names))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """clean_texts of docs, with n_chars of the texts that lost lines; rows without id go, as no decision can be carried to them."""
    ship(spark)
    good = clean_texts(docs).where("doc_id is not null")
    if "n_chars" in docs.columns:
        n = F.when(F.col("n_removed_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        good = good.withColumn("n_chars", n)
    return good.select(docs.columns)
