"""License scans: Aho-Corasick finds identifier tags and notice phrases in whole texts; a shunting-yard parser
evaluates and/or/with licence expressions of the tags.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import LOWER, batch, pieces, table

# Phrases and their labels. The first four are the base ones.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {"gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "bsd license": "bsd", "isc license": "isc", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0", "the unlicense": "unlicense", "all rights reserved": "proprietary", "eclipse public license": "epl"}
TAG = "spdx license identifier"
# How freely a text under a label may be used, 0 to 1; others count as UNKNOWN.
FREEDOM = {"cc0": 1.0, "unlicense": 1.0, "mit": 1.0, "isc": 1.0, "bsd": 1.0, "apache": 1.0, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.5, "agpl": 0.4, "cc-by-nd": 0.3, "cc-by-nc": 0.2, "proprietary": 0.0}
UNKNOWN = 0.25
_FAMILY = re.compile(r"^(cc0|cc-by-nc|cc-by-sa|cc-by-nd|cc-by|agpl|lgpl|gpl|apache|mit|isc|bsd|mpl|epl|unlicense)(?:[-.0-9]|$)")
_PIECE = re.compile(r"\s*(\(|\)|[A-Za-z0-9.\-+:]+)")
RANK = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    """The family of a licence identifier, else the identifier itself, in lower case."""
    name = identifier.lower().rstrip("+")
    m = _FAMILY.match(name)
    return m[1] if m else name


def leading(words: list[str]) -> tuple[int, list[str]]:
    """How many of the first words make the longest licence expression, and it in postfix order; one pass over them."""
    out, stack, operand, depth, best = [], [], False, 0, (0, 0, [])
    for n, text in enumerate(words, 1):
        at = 0
        while at < len(text):
            m = _PIECE.match(text, at)
            if not m:
                return best[0], out[: best[1]] + best[2]
            at, word = m.end(), m[1]
            rank = RANK.get(word.lower())
            if word == "(":
                if operand:
                    return best[0], out[: best[1]] + best[2]
                stack.append(word)
                depth += 1
            elif word == ")":
                if not depth or not operand:
                    return best[0], out[: best[1]] + best[2]
                while stack[-1] != "(":
                    out.append(stack.pop())
                stack.pop()
                depth -= 1
            elif rank:
                if not operand:
                    return best[0], out[: best[1]] + best[2]
                while stack and RANK.get(stack[-1], 0) >= rank:
                    out.append(stack.pop())
                stack.append(word.lower())
                operand = False
            else:
                if operand:
                    return best[0], out[: best[1]] + best[2]
                out.append(word)
                operand = True
        if operand and not depth:  # then the stack holds an operator of each rank at most
            best = n, len(out), stack[::-1]
    return best[0], out[: best[1]] + best[2]


def to_postfix(text: str) -> list[str] | None:
    """The identifiers and operators of a licence expression in postfix order; None where it is malformed."""
    words = text.split()
    n, out = leading(words)
    return out if n and n == len(words) else None


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels named and freedom: of an or, the freer side's; of an and, the stricter's; an exception changes nothing."""
    stack: list[tuple[set[str], float]] = []
    for word in postfix:
        if word in RANK:
            b, a = stack.pop(), stack.pop()
            if word != "with":
                few, many = sorted((a[0], b[0]), key=len)
                many |= few  # no other part has this set
                a = (many, (max if word == "or" else min)(a[1], b[1]))
            stack.append(a)
        else:
            x = label_of(word)
            stack.append(({x}, FREEDOM.get(x, UNKNOWN)))
    return stack[0]


_EXPRESSION = re.compile(rb"spdx-license-identifier:[ \t]*([^\n\r]+?)(?=spdx-license-identifier:|[\n\r]|\Z)")
_JOIN = np.full(256, 32, np.uint8)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _JOIN[_c] = _c
_JOIN[65:91] = LOWER[65:91]
_JOIN = _JOIN.tobytes()


def _expression(text: bytes) -> list[str] | None:
    """The longest leading part of a tag's line that is an expression (notices often go on after it)."""
    words = text.decode("utf-8", "replace").replace("*/", " ").replace("-->", " ").strip().split()
    return leading(words)[1] or None


def scanner():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        auto.add_word(f" {phrase} ", phrase)
    auto.make_automaton()
    return auto


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan_text(auto, text: bytes):
    """(n_words, n_base, first, last, base labels, labels, score) of a text."""
    words = text.translate(_JOIN).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits = [(end - len(p) - 1, p) for end, p in auto.iter(line)]
    if not hits:
        return len(words), 0, None, None, "", "", 0.0
    base = [at for at, p in hits if p in BASE]
    base_labels = {BASE[p] for _, p in hits if p in BASE}
    labels = base_labels | {NOTICES[p] for _, p in hits if p in NOTICES}
    freedom = [FREEDOM[x] for x in labels]
    if any(p == TAG for _, p in hits):
        for tag in _EXPRESSION.finditer(text.lower()):
            if found := _expression(tag[1]):
                more, free = evaluate(found)
                labels |= more
                freedom.append(free)
    spot = lambda at: line.count(" ", 0, at)
    return len(words), len(base), spot(min(base)) if base else None, spot(max(base)) if base else None, ",".join(sorted(base_labels)), ",".join(sorted(labels)), min(freedom, default=0.0)


def _scan(batches):
    auto = scanner()
    for b in batches:
        for p in pieces(b.column(1)):
            raw = p.data.tobytes()
            rows = [scan_text(auto, raw[a:z]) for a, z in zip(p.offs[:-1], p.offs[1:], strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield batch(_ROWS, doc_id=b.column(0).slice(p.lo, p.hi - p.lo), **{f.name: list(c) for f, c in zip(list(_ROWS)[1:], cols, strict=True)})


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    score is the freedom of the strictest notice or expression found, 0 where there is none.  A null or empty text
    has no words and empty labels; a null doc_id stays; repeated rows are scanned alike; very long texts and expressions
    are scanned whole; an empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return base.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
