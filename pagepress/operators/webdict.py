"""Dictionary-token sizes in SQL functions: one alternation, longest entries first."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dims import DICTIONARY

PATTERN = "|".join(re.escape(s) for s in sorted(DICTIONARY, key=len, reverse=True))
HEADER = 5
MARK = "\x01"


def _factored(words: set[str]) -> str:
    """An alternation of words by common beginnings, that prefers the longest: few of its branches are tried at each place."""
    rest: dict[str, set[str]] = {}
    for w in words - {""}:
        rest.setdefault(w[0], set()).add(w[1:])
    parts = []
    for c in sorted(rest):
        tail, more = c, rest[c]
        while len(more) == 1 or ("" not in more and len({w[0] for w in more}) == 1):  # one way on
            if more == {""}:
                break
            first = next(iter(more))[0]
            tail, more = tail + first, {w[1:] for w in more}
        parts.append(re.escape(tail) + (_factored(more) if more != {""} else ""))
    body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return f"(?:{body})?" if "" in words else body


FACTORED = _factored(set(DICTIONARY))


def match_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(FACTORED))


def with_stats(rows: DataFrame, text: str) -> DataFrame:
    """Adds original, matches, saved and size: header, a byte for each ASCII character or match, three for other bytes. One scan of the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    marks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(MARK), F.lit("")))
    cols = rows.withColumn("_folded", F.regexp_replace(t, FACTORED, MARK))
    folded = F.col("_folded")
    ascii_only = F.length(F.regexp_replace(folded, "[^\x00-\x7F]+", ""))
    size = HEADER + ascii_only + 3 * (F.octet_length(folded) - ascii_only)
    original = F.octet_length(t)
    counts = {"original": original, "matches": marks(folded) - marks(t), "saved": F.length(t) - F.length(folded), "size": F.when(original == 0, F.lit(0)).otherwise(size)}
    return cols.withColumns({n: c.cast("long") for n, c in counts.items()}).drop("_folded")


def webdict_stats(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, original, matches, saved and size of with_stats."""
    return with_stats(rows.select(key, F.col(text).alias("_text")), "_text").select(key, "original", "matches", "saved", "size")


def report(rows: DataFrame) -> DataFrame:
    """Adds report, the statistics of webdict_stats rows as text."""
    line = "Dictionary: %d entries\nOriginal: %d bytes\nEncoded: %d bytes\nMatches: %d\nCharacters saved: %d"
    return rows.withColumn("report", F.format_string(line, F.lit(len(DICTIONARY)), "original", "size", "matches", "saved"))


def token_usage(rows: DataFrame, text: str) -> DataFrame:
    """seed, token and how often each dictionary entry is matched over all rows."""
    found = rows.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({FACTORED})"), F.lit(1))).alias("seed")).groupBy("seed").agg(F.count("*").alias("n"))
    at = F.array_position(F.array(*[F.lit(s) for s in DICTIONARY]), F.col("seed"))
    return found.select("seed", (127 + at).cast("int").alias("token"), "n")
