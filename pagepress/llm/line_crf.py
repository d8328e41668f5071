"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

Each line has measures of its own and of the lines before and after it.  Forward-backward gives each line's marginal
of being good; weighted by the lines' lengths they add up to the document's quality.  Labels mark documents, so each
line of a training document starts with its document's label.  The field is fitted on at most SAMPLE labelled rows
(those with the least hashed ids, as far as they have LINES lines together); scoring covers every line of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import LINE_BYTE, WORD_BYTE, batch, crc_rest, drop, pieces, spans_hash, staged, table, windows_hash
from .quality_rules import _twice

FOLDS, HELD_OUT = 3, 1
SAMPLE, LINES = 4000, 200_000  # documents and lines that the field is fitted on, at most
STEPS, RATE, DECAY = 120, 0.15, 1e-4
OWN = 15


def _flag(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _BAR, _BANG, _COMMA, _STOP = (_flag(x) for x in (b"#*$%&<>=_~^", b"|", b"!", b",;:", b".!?"))
_UPPER, _LETTER, _DIGIT, _WIDE = _flag(bytes(range(65, 91))), _flag(bytes([*range(65, 91), *range(97, 123)])), _flag(bytes(range(48, 58))), _flag(bytes(range(128, 256)))


def _between(flags: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[z] - total[a]).astype(np.float64)


def line_features(p) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(measures of each line with a word, its length in bytes, offsets of the texts' lines) of a piece of texts."""
    p.words()
    p.lines()
    w = spans_hash(p.data, p.start, p.end, WORD_BYTE)
    a, z = np.searchsorted(p.start, p.line_start), np.searchsorted(p.start, p.line_end)
    full = z > a
    a, z, row, s, e = a[full], z[full], p.line_row[full], p.line_start[full], p.line_end[full]
    offs = np.searchsorted(row, np.arange(p.hi - p.lo + 1))
    n, size = (z - a).astype(np.float64), (e - s).astype(np.float64)
    d = p.data
    same = np.zeros(len(w), bool)
    same[1:] = (w[1:] == w[:-1]) & (p.row[1:] == p.row[:-1])
    skip = np.zeros(len(w), bool)
    skip[2:] = (w[2:] == w[:-2]) & (p.row[2:] == p.row[:-2])
    at, h = windows_hash(w, p.row, 5)
    at = at[_twice(h, p.row[at])[0]]
    cover = np.zeros(len(w) + 6, np.int64)
    cover[at] += 1
    cover[at + 5] -= 1
    covered = np.cumsum(cover)[: len(w)] > 0
    dup = _twice(spans_hash(d, s, e, LINE_BYTE, gaps=True), row)[1] if len(s) else np.zeros(0, bool)
    letters = _between(_LETTER[d], s, e)
    last = p.data[p.end[z - 1] - 1] if len(z) else np.zeros(0, np.uint8)
    unit = lambda x: np.minimum(x, 1.0)
    x = np.stack([
        np.ones(len(n)), unit(5 * _between(_SYMBOL[d], s, e) / size), unit(2 * _between(_BAR[d], s, e) / n), unit(_between(_UPPER[d], s, e) / np.maximum(letters, 1)),
        unit(_between(_BANG[d], s, e) / n), unit(3 * _between(_DIGIT[d], s, e) / size), _between(same, a, z) / n, _between(skip, a, z) / n, unit(np.log1p(n) / 6),
        unit(size / n / 16), _STOP[last].astype(float), unit(3 * _between(_COMMA[d], s, e) / n), dup.astype(float), unit(_between(_WIDE[d], s, e) / size), _between(covered, a, z) / n,
    ], 1) if len(n) else np.zeros((0, OWN))
    return x, size, offs


def with_neighbours(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Adds the measures of the line before and of the line after; 0 at the ends of a text."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    inner = offs[:-1][np.diff(offs) > 0]
    before[inner] = 0
    after[offs[1:][np.diff(offs) > 0] - 1] = 0
    return np.concatenate([x, before, after], 1)


class Field:
    """Two states; score of a line in state 1 is its features' weighted sum, in state 0 zero; and of neighbours, step."""

    def __init__(self, weight: np.ndarray, step: np.ndarray, empty: float = 0.5):
        self.weight, self.step, self.empty = weight, step, empty

    def marginals(self, emit: np.ndarray, offs: np.ndarray, pairs: bool = False):
        """P(good) of each line by forward-backward; with pairs also the expected counts of neighbouring states."""
        out, expect = np.zeros(len(emit)), np.zeros((2, 2))
        count = np.diff(offs)
        level = np.frexp(count.astype(float))[1]
        for k in np.unique(level[count > 0]):
            docs = np.flatnonzero((level == k) & (count > 0))
            m, most = count[docs], int(count[docs].max())
            at = np.minimum(offs[docs][:, None] + np.arange(most), len(emit) - 1)
            on = np.arange(most) < m[:, None]
            e = np.where(on, emit[at], 0.0)
            f, b = np.zeros((most, len(docs), 2)), np.zeros((most, len(docs), 2))
            f[0, :, 1] = e[:, 0]
            t = self.step
            for i in range(1, most):
                x = np.logaddexp(f[i - 1, :, :1] + t[0], f[i - 1, :, 1:] + t[1])
                x[:, 1] += e[:, i]
                f[i] = np.where(on[:, i, None], x, f[i - 1])
            for i in range(most - 2, -1, -1):
                y = b[i + 1].copy()
                y[:, 1] += e[:, i + 1]
                x = np.logaddexp(t[:, 0] + y[:, :1], t[:, 1] + y[:, 1:])
                b[i] = np.where(on[:, i + 1, None], x, 0.0)
            s = f + b
            good = 1 / (1 + np.exp(np.clip(s[..., 0] - s[..., 1], -500, 500)))
            out[at[on]] = good.T[on]
            if pairs and most > 1:
                z = np.logaddexp(f[-1, :, 0], f[-1, :, 1])
                y = b[1:].copy()
                y[..., 1] += e.T[1:]
                joint = np.exp(np.clip(f[:-1, :, :, None] + t[None, None] + y[:, :, None, :] - z[None, :, None, None], -500, 0))
                expect += joint[on.T[1:]].sum(0)
        return (out, expect) if pairs else out

    @classmethod
    def train(cls, x: np.ndarray, offs: np.ndarray, label: np.ndarray) -> Field:
        """x: features of all lines with their neighbours'; label: 0 or 1 of each text. Adam on the log-likelihood."""
        count = np.diff(offs)
        line = np.repeat(label, count).astype(float)
        field = cls(np.zeros(x.shape[1]), np.zeros((2, 2)), float(label.mean()) if len(label) else 0.5)
        if not len(x):
            return field
        inner = np.maximum(count - 1, 0)
        target = np.array([[inner[label == 0].sum(), 0], [0, inner[label == 1].sum()]], float)
        theta, m1, m2 = np.zeros(x.shape[1] + 4), 0.0, 0.0
        for t in range(1, STEPS + 1):
            field.weight, field.step = theta[:-4], theta[-4:].reshape(2, 2)
            good, expect = field.marginals(x @ field.weight, offs, pairs=True)
            grad = np.concatenate([x.T @ (good - line), (expect - target).ravel()]) / len(label)
            grad += DECAY * theta + np.concatenate([np.zeros(x.shape[1]), 0.05 * theta[-4:]])
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
            theta = theta - RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        field.weight, field.step = theta[:-4], theta[-4:].reshape(2, 2)
        return field

    def score(self, x: np.ndarray, size: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals; texts without lines get the share of good training texts."""
        good = self.marginals(with_neighbours(x, offs) @ self.weight, offs)
        total = np.concatenate([[0], np.cumsum(good * size)])
        weight = np.concatenate([[0], np.cumsum(size)])
        w = weight[offs[1:]] - weight[offs[:-1]]
        return np.where(w > 0, (total[offs[1:]] - total[offs[:-1]]) / np.maximum(w, 1), self.empty).clip(0, 1)


_LINES = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("x", pa.binary())])


def _measured(batches):
    """Rows (doc_id, text, label, h) to _LINES."""
    for b in batches:
        for p in pieces(b.column(1)):
            x, _, offs = line_features(p)
            m = p.hi - p.lo
            yield batch(_LINES, doc_id=b.column(0).slice(p.lo, m), h=b.column(3).slice(p.lo, m), label=b.column(2).slice(p.lo, m), n=np.diff(offs), x=[x[i:j].astype(np.float32).tobytes() for i, j in zip(offs[:-1], offs[1:], strict=True)])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> Field:
    """Fits the field on at most sample labelled ids outside the held-out fold and at most lines of their lines.

    An id with several labels has the least; of several rows with one id, the one with the least hashed text is taken.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold != HELD_OUT)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("label"))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(known), "doc_id")  # at most sample rows
    measured = staged(rows.select("doc_id", "text", "label", F.xxhash64("text").alias("h")).mapInArrow(_measured, "doc_id long, h long, label long, n long, x binary"), "lines")
    one = measured.groupBy("doc_id").agg(F.min(F.struct("h", "n")).alias("one")).select("doc_id", "one.*")  # at most sample rows
    before = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    one = one.withColumn("total", before).where(F.col("total") <= lines).select("doc_id", "h")
    got = measured.join(F.broadcast(one), ["doc_id", "h"]).groupBy("doc_id").agg(F.min(F.struct("x", "n", "label")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").collect()
    drop(measured)
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(-1, OWN).astype(float)
    offs = np.concatenate([[0], np.cumsum([r["n"] for r in got])]).astype(np.int64)
    return Field.train(with_neighbours(x, offs), offs, np.array([r["label"] for r in got], np.int64))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts get the share of good training texts; a null doc_id is not held out (crc32 of nothing is 0)
    and never learned from; repeated rows are scored alike and learned from once; very long texts are scored whole, a line
    after the other; without labels every score is 0.5.  An empty table gives no rows; other columns are ignored.
    """
    field = fit(docs, labels, sample, lines)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for b in batches:
            held = crc_rest(b.column(0), FOLDS) == HELD_OUT
            for p in pieces(b.column(1)):
                score = shared.value.score(*line_features(p))
                yield batch(schema, doc_id=b.column(0).slice(p.lo, p.hi - p.lo), held_out=held[p.lo : p.hi], score=score, predicted=(score >= 0.5).astype(np.int32))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
