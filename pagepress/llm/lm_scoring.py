"""LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Corpus counts cover every training text: word counts, and the counts of pairs of the 1023 most counted words, with all
others as class 0, that are neighbours or have one word between them.  On the first table the noise-contrastive objective is taken
over all pairs, with NOISE words drawn for each of them, anew every REDRAW steps.  It gives vectors q (contexts), r and b (words) whose
products, normalised over the classes, are log-probabilities.  The word before the last adds a vector d to the last one's q;
as scores add up, the sums over the classes for all pairs of contexts are one matrix product of exponentials, so both tables
suffice for d too, which is fitted by Newton steps of its penalised likelihood.

Every other word of the corpus, however rare, then has two vectors of its own: as a context q0 + d, from the classes that
follow it, and as a word s, from the classes before it, each by a Newton step of its penalised likelihood from 0, with the
core's vectors fixed; of the step's halvings the likeliest is taken (0 among them).  A word of class 0 has P(class 0) times (c+0.1) exp((q - mean q).s) / Z, where q is its
context's (q0 for contexts of class 0) and Z sums over all words of the class and one that was never seen.  Their rows
meet in a shuffle by word, so the number of words is bounded by the corpus alone and nothing of it is held in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import LOWER_BYTE, U, batch, crc_rest, drop, pieces, spans_hash, staged, table

HELD_OUT, SMOOTH = 10, 0.1
VOCAB = 1024
PARTS = (1.0, 0.5, 0.25, 0.125, 0.0625)  # of a word's Newton step, tried besides 0
WIDTH, NOISE, STEPS, RATE, PRIOR = 32, 10.0, 160, 0.08, 3.0
REDRAW = 40  # steps that drawn noise serves
BEFORE_ROUNDS, BEFORE_PRIOR = 8, 10.0
END = np.int64(-(0x5DEECE66D))  # the key of the end token
COUNTS = pa.schema([("word", pa.int64()), ("n", pa.int64())])


def _tokens(p) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens of a piece, each text's end token after its words, and the offsets of the texts' tokens."""
    p.words()
    w = spans_hash(p.data, p.start, p.end, LOWER_BYTE).view(np.int64)
    w = np.insert(w, p.first[1:], END)
    return w, p.first + np.arange(len(p.first))


def _sum_by(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], (np.add.reduceat(n, first) if len(first) else n)


def _train_rows(b: pa.RecordBatch) -> pa.Array:
    """The texts of a batch that are learned from."""
    return b.column(1).filter(pa.array(crc_rest(b.column(0), HELD_OUT) != 0))


def count_words(batches):
    held, size = [], 0
    for b in batches:
        for p in pieces(_train_rows(b)):
            k, n = np.unique(_tokens(p)[0], return_counts=True)
            held.append((k, n))
            size += len(k)
            if size > 2_000_000:
                held = [_sum_by(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield batch(COUNTS, word=held[0][0], n=held[0][1])
                    held, size = [], 0
    if held:
        k, n = _sum_by(*map(np.concatenate, zip(*held, strict=True)))
        yield batch(COUNTS, word=k, n=n)


class Head:
    """The most counted words: counts by key, and the model's ids (0: all other words). The end token has an id in any case."""

    def __init__(self, word: np.ndarray, n: np.ndarray, vocab: int):
        rank = np.empty(len(word), np.int64)
        rank[np.lexsort((word, -n, word != END))] = np.arange(1, len(word) + 1)
        order = np.argsort(word)
        self.word, self.n = word[order], n[order]
        self.id = np.where(rank < vocab, rank, 0)[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the head (any where the word isn't there) and whether it is."""
        at = np.minimum(np.searchsorted(self.word, keys), max(0, len(self.word) - 1))
        return at, (self.word[at] == keys if len(self.word) else np.zeros(len(keys), bool))

    def ids(self, at: np.ndarray, found: np.ndarray) -> np.ndarray:
        return np.where(found, self.id[at], 0) if len(self.word) else np.zeros(len(at), np.int64)


def contexts(ids: np.ndarray, offs: np.ndarray, end: int) -> np.ndarray:
    """The model id before each token; before a text's first token, the end token's."""
    prev = np.empty_like(ids)
    prev[1:] = ids[:-1]
    prev[offs[:-1]] = end
    return prev


def _pairs(shared, vocab: int):
    """Counts of class pairs: (word before, word) as before * vocab + word, and behind them those of the word before that."""

    def run(batches):
        head: Head = shared.value
        end = int(head.ids(*head.find(np.array([END])))[0])
        total, held, size = np.zeros(2 * vocab * vocab, np.int64), [], 0
        for b in batches:
            for p in pieces(_train_rows(b)):
                w, offs = _tokens(p)
                ids = head.ids(*head.find(w))
                prev = contexts(ids, offs, end)
                held += [(at * vocab + ids).astype(np.int32) for at in (prev, vocab + contexts(prev, offs, end))]
                size += 2 * len(ids)
                if size > 2_000_000:
                    np.add(total, np.bincount(np.concatenate(held), minlength=len(total)), out=total)
                    held, size = [], 0
        if held:
            np.add(total, np.bincount(np.concatenate(held), minlength=len(total)), out=total)
        at = np.flatnonzero(total)
        yield batch(COUNTS, word=at, n=total[at])

    return run


class LogBilinear:
    def __init__(self, q: np.ndarray, r: np.ndarray, b: np.ndarray):
        self.q, self.r, self.b, self.d = q, r, b, np.zeros_like(q)

    def log_probs(self, context: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of all words after each of a batch of contexts; each row sums to 1."""
        s = self.q[context] @ self.r.T + self.b
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural log-probabilities after the last word alone (last, word), what the word before it adds (before, word),
        and the logarithm of the sum over all words after both (before, last)."""
        v = len(self.q)
        one = np.concatenate([self.log_probs(np.arange(i, min(i + 256, v))) for i in range(0, v, 256)])
        add = self.d @ self.r.T
        return one, add, np.log(np.exp(add) @ np.exp(one).T)

    def fit_before(self, skips: np.ndarray, both: np.ndarray, rounds: int = BEFORE_ROUNDS, prior: float = BEFORE_PRIOR) -> None:
        """Fits d. Counts: skips (word before the last, word), both (word before the last, last).

        Newton steps with a bound of the curvature; a word's step that lowers its penalised likelihood is halved."""
        r, one = self.r.astype(np.float64), np.exp(self.tables()[0].astype(np.float64))
        skips, both = skips.astype(np.float64), both.astype(np.float64)
        d, size, square = np.zeros_like(r), np.ones(len(r)), (r[:, :, None] * r[:, None, :]).reshape(len(r), -1)

        def value(d):
            return ((skips @ r) * d).sum(1) - (both * np.log(np.exp(np.clip(d @ r.T, -30, 30)) @ one.T)).sum(1) - prior / 2 * (d * d).sum(1)

        best = value(d)
        for _ in range(rounds):
            e = np.exp(np.clip(d @ r.T, -30, 30))
            m = e * ((both / (e @ one.T)) @ one)  # expected counts (before, word)
            total = np.maximum(m.sum(1), 1e-9)
            mean = (m @ r) / total[:, None]
            curve = (m @ square).reshape(len(r), r.shape[1], -1) - total[:, None, None] * mean[:, :, None] * mean[:, None, :] + prior * np.eye(r.shape[1])
            step = np.linalg.solve(curve, ((skips - m) @ r - prior * d)[:, :, None])[:, :, 0]
            new = d + size[:, None] * step
            got = value(new)
            better = got > best
            d, best, size = np.where(better[:, None], new, d), np.where(better, got, best), np.where(better, size, size / 2)
        self.d = d.astype(np.float32)

    @classmethod
    def train(cls, pairs: np.ndarray, width: int = WIDTH, noise: float = NOISE, steps: int = STEPS, rate: float = RATE, seed: int = 5) -> LogBilinear:
        """pairs: counts (contexts, words). Adam on the noise-contrastive objective of all pairs and as many times noise drawn words."""
        v = len(pairs)
        rng = np.random.default_rng(seed)
        n = max(1.0, float(pairs.sum()))
        data = (pairs / n).astype(np.float32)
        unigram = (pairs.sum(0) + SMOOTH) / (n + SMOOTH * v)
        expected = noise * pairs.sum(1, keepdims=True) * unigram[None, :]
        shift = np.log(noise * unigram).astype(np.float32)
        model = cls(*(rng.normal(0, 0.1, (v, width)).astype(np.float32) for _ in range(2)), np.log(unigram).astype(np.float32))
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (model.q, model.r, model.b)]
        for t in range(1, steps + 1):
            if (t - 1) % REDRAW == 0:  # noise words for every pair, as a table of counts
                base = (rng.poisson(expected) / n).astype(np.float32)
            d = model.q @ model.r.T + (model.b - shift)
            p = 1 / (1 + np.exp(-np.clip(d, -30, 30)))
            g = base * p - data * (1 - p)
            lr = rate * min(1.0, 2.0 * (1 - (t - 1) / steps))
            for x, grad, (m1, m2) in zip((model.q, model.r, model.b), (g @ model.r, g.T @ model.q, g.sum(0)), state, strict=True):
                if x.ndim == 2:
                    grad = grad + PRIOR / n * x  # a Gaussian prior, which a small corpus needs
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                x -= lr * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-12 + 1e-3 * np.sqrt(m2.max()))
        return model


SCORED = "piece long, at long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, model double, before array<int>, word long, uses binary"
_SCORED = pa.schema([("piece", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("model", pa.float64()), ("before", pa.list_(pa.int32())), ("word", pa.int64()), ("uses", pa.binary())])
PARTITION = 1 << 32  # numbers of pieces that a partition has
GROUPED = 2_000_000  # uses that a Python worker gathers by word at a time


def _lists(kind: pa.DataType, first: np.ndarray, flat: np.ndarray) -> pa.Array:
    if pa.types.is_binary(kind):
        return pa.Array.from_buffers(kind, len(first) - 1, [None, pa.py_buffer((first * flat.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))


def _score(shared, vocab: int):
    """A row for each text, with what the head gives, and a row for each word of class 0 in a piece, with its uses.

    A piece here is as many texts as have GROUPED uses.
    A use is ((row in the piece) * 2 + learned from) * 2 vocab + (class after it, or vocab + class before it)."""

    none = lambda f, k: pa.nulls(k, _SCORED.field(f).type)
    room = (1 << 32) // (4 * vocab)  # rows that a use can number

    def grouped(piece, held):
        key, use = map(np.concatenate, zip(*held, strict=True))
        order = np.argsort(key, kind="stable")
        key, use = key[order], use[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        for k in range(0, len(first), 10_000):
            cut = np.append(first, len(key))[k : k + 10_001]
            c = len(cut) - 1
            yield batch(_SCORED, piece=np.full(c, piece), **{f: none(f, c) for f in ("at", "doc_id", "held_out", "n_tokens", "n_known", "logs", "model", "before")}, word=key[cut[:-1]], uses=_lists(pa.binary(), cut - cut[0], use[cut[0] : cut[-1]]))

    def run(batches):
        from pyspark import TaskContext

        head, (one, add, norm) = shared.value
        logs = np.log10(head.n + SMOOTH)
        piece = TaskContext.get().partitionId() * PARTITION
        held, size, base = [], 0, 0
        for b in batches:
            rest = crc_rest(b.column(0), HELD_OUT) == 0
            for p in pieces(b.column(1)):
                w, offs = _tokens(p)
                m = p.hi - p.lo
                row = np.repeat(np.arange(m), np.diff(offs))
                at, found = head.find(w)
                ids = head.ids(at, found)
                own = np.where(found, logs[at], 0.0) if len(logs) else np.zeros(len(w))
                last = contexts(w, offs, END)
                end = int(head.ids(*head.find(np.array([END])))[0])
                prev = contexts(ids, offs, end)
                before = contexts(prev, offs, end)
                model = np.where(prev > 0, one[prev, ids] + add[before, ids] - norm[before, prev], 0.0) / np.log(10)
                far, after = np.flatnonzero(ids == 0), np.flatnonzero(prev == 0)
                if held and (size > GROUPED or base + m > room):
                    yield from grouped(piece, held)
                    held, size, base, piece = [], 0, 0, piece + 1
                learned = (base + row) * 2 + ~rest[p.lo : p.hi][row]
                use = np.concatenate([learned[after] * 2 * vocab + ids[after], (learned[far] * 2 + 1) * vocab + prev[far]])
                held.append((np.concatenate([last[after], w[far]]), use.astype(np.uint32)))
                size += len(use)
                classes = _lists(pa.list_(pa.int32()), np.searchsorted(row[far], np.arange(m + 1)), prev[far].astype(np.int32))
                yield batch(_SCORED, piece=np.full(m, piece), at=base + np.arange(m), doc_id=b.column(0).slice(p.lo, m), held_out=rest[p.lo : p.hi], n_tokens=np.diff(offs), n_known=np.bincount(row[found], minlength=m), logs=np.bincount(row, own, m), model=np.bincount(row, model, m), before=classes, word=none("word", m), uses=none("uses", m))
                base += m
        if held:
            yield from grouped(piece, held)

    return run


class Own:
    """The vectors of words of class 0, from counts of the classes after and before them."""

    def __init__(self, net: LogBilinear, seen: np.ndarray):
        self.start = net.log_probs(np.array([0]))[0]
        self.p = np.exp(self.start)
        m = seen[:, 0].astype(np.float64)
        self.m = (m / m.sum() if m.any() else np.full(len(m), 1 / len(m))).astype(np.float32)
        self.after, self.before = self._axes(net.r.astype(np.float64), self.p), self._axes(net.q.astype(np.float64), self.m)

    @staticmethod
    def _axes(x: np.ndarray, share: np.ndarray):
        """x, centred, along the axes of its covariance, and the variances."""
        x = x - share @ x
        size, axes = np.linalg.eigh((x * share[:, None]).T @ x)
        return x @ axes, np.maximum(size, 0)

    @staticmethod
    def _step(side, word: np.ndarray, cls: np.ndarray, n: np.ndarray, expected) -> np.ndarray:
        """What a step for each word adds to the scores of all classes; word and cls: the uses that are learned from.

        expected: of such additions, the negative part of the log-likelihood for one use of each word."""
        x, size = side
        g = np.zeros((len(n), x.shape[1]))
        if len(word):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            g[word[first]] = np.add.reduceat(x[cls], first)
        d = g / (n[:, None] * size + PRIOR)
        adds = np.clip(d @ x.T, -30, 30).astype(np.float32)
        gain, norm = (g * d).sum(1), (d * d).sum(1) * PRIOR / 2
        best, part = -n * expected(0 * adds[:1]), np.zeros(len(n), np.float32)
        for a in PARTS:
            value = a * gain - n * expected(np.float32(a) * adds) - a * a * norm
            part = np.where(value > best, np.float32(a), part)
            best = np.maximum(value, best)
        return adds * part[:, None]

    def contexts(self, word, cls, n) -> np.ndarray:
        """Natural log-probabilities of all classes after each word; each row sums to 1."""
        s = self.start + self._step(self.after, word, cls, n, lambda x: np.log(np.exp(x) @ self.p))
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))

    def lifts(self, word, cls, n) -> np.ndarray:
        """What each class before a word adds to its log-share of class 0, before Z."""
        return self._step(self.before, word, cls, n, lambda x: np.exp(x) @ self.m)


LIFTED = "piece long, at long, known long, more double, model double"
_LIFTED = pa.schema([("piece", pa.int64()), ("at", pa.int64()), ("known", pa.int64()), ("more", pa.float64()), ("model", pa.float64())])


def _own(shared, vocab: int):
    """Rows (word, piece, uses) sorted by word to sums for each text, and to piece -1 with the parts of Z by class."""

    def run(batches):
        own: Own = shared.value
        z = np.zeros(vocab)

        def words(key, piece, uses, first):
            new = np.append(True, key[1:] != key[:-1])
            w = np.repeat(np.cumsum(new) - 1, np.diff(first))  # the word of each use
            of = np.repeat(piece, np.diff(first))
            code, rest = uses % (2 * vocab), uses // (2 * vocab)
            row, train = (rest // 2).astype(np.int64), rest % 2 == 1
            target, cls, m = code >= vocab, (code % vocab).astype(np.int64), int(new.sum())
            learn = [np.flatnonzero(train & ~target), np.flatnonzero(train & target)]
            n = [np.bincount(w[i], minlength=m) for i in learn]
            more, model = np.zeros(len(w)), np.zeros(len(w))
            for k in range(0, m, 1000):  # bounds the tables of words by classes
                lo, hi = np.searchsorted(w, [k, k + 1000])
                part = [i[np.searchsorted(i, lo) : np.searchsorted(i, hi)] for i in learn]
                lp, lift = (f(w[i] - k, cls[i], c[k : k + 1000]) for f, i, c in zip((own.contexts, own.lifts), part, n, strict=True))
                count = n[1][k : k + 1000]
                z[:] += np.where(count > 0, count + SMOOTH, 0.0) @ np.exp(lift)
                at = np.arange(lo, hi)
                a, t = at[~target[lo:hi]], at[target[lo:hi]]
                model[a] = lp[w[a] - k, cls[a]] / np.log(10)
                more[t] = np.log10(count[w[t] - k] + SMOOTH)
                model[t] = more[t] + lift[w[t] - k, cls[t]] / np.log(10)
            known = (target & (n[1][w] > 0)).astype(np.int64)
            order = np.lexsort((row, of))
            of, row = of[order], row[order]
            start = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (row[1:] != row[:-1])))
            for i in range(0, len(start), 20_000):
                s = start[i : i + 20_000]
                end = start[i + 20_000] if i + 20_000 < len(start) else len(of)
                add = lambda x: np.add.reduceat(x[order[s[0] : end]], s - s[0])  # noqa: B023, E731
                yield batch(_LIFTED, piece=of[s], at=row[s], known=add(known), more=add(more), model=add(model))

        held = None
        for b in batches:
            raw = b.column(2)
            size = np.diff(np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4)) if pa.types.is_binary(raw.type) else np.array([len(x.as_buffer()) for x in raw])
            now = [b.column(0).to_numpy(), b.column(1).to_numpy(), np.frombuffer(b"".join(raw.to_pylist()), np.uint32), size // 4]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last word may go on
            if cut:
                first = np.append(0, np.cumsum(held[3]))
                yield from words(held[0][:cut], held[1][:cut], held[2][: first[cut]], first[: cut + 1])
                held = [held[0][cut:], held[1][cut:], held[2][first[cut] :], held[3][cut:]]
        if held is not None:
            yield from words(held[0], held[1], held[2], np.append(0, np.cumsum(held[3])))
            yield batch(_LIFTED, piece=np.full(vocab, -1), at=np.arange(vocab), known=np.zeros(vocab, np.int64), more=np.zeros(vocab), model=z)

    return run


def score_texts(docs: DataFrame, vocab: int = VOCAB) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    A null or empty text is one end token; a null doc_id counts as an empty id (held out); repeated rows are each
    learned from and each scored; very long texts are scored whole; of words counted alike the least hashes are in the
    core.  Without training texts the counts are 0.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    counts = staged(base.mapInArrow(count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.col("word") != int(END), F.desc("n"), "word").limit(vocab - 1).toArrow()
    head = Head(*(top[c].to_numpy().astype(np.int64) for c in ("word", "n")), vocab)
    drop(counts)
    # At most 2 vocab**2 rows, as Arrow columns.
    pairs = base.mapInArrow(_pairs(spark.sparkContext.broadcast(head), vocab), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(2 * vocab * vocab, np.int64)
    seen[pairs["word"].to_numpy()] = pairs["n"].to_numpy()
    del pairs
    seen, skips = seen.reshape(2, vocab, vocab)
    # Neighbours are the contexts of a word, but for a text's end; two ends are those of a text's first word.
    both, end = seen.copy(), int(head.ids(*head.find(np.array([END])))[0])
    both[:, end] = 0
    both[end, end] = seen[:, end].sum()
    net = LogBilinear.train(seen)
    net.fit_before(skips, both)
    rows = staged(base.mapInArrow(_score(spark.sparkContext.broadcast((head, tuple(x.astype(np.float32) for x in net.tables()))), vocab), SCORED), "scored", "zstd")
    dealt = rows.where("word is not null").select("word", "piece", "uses").repartition("word").sortWithinPartitions("word")
    met = dealt.mapInArrow(_own(spark.sparkContext.broadcast(Own(net, seen)), vocab), LIFTED)
    met = staged(met.groupBy("piece", "at").agg(F.sum("known").alias("known"), F.sum("more").alias("more"), F.sum("model").alias("lift")), "lifted")
    z = np.full(vocab, SMOOTH)
    for r in met.where("piece = -1").collect():
        z[r["at"]] += r["lift"]
    logz = F.array(*[F.lit(float(x)) for x in np.log10(z)])
    norm = F.aggregate("before", F.lit(0.0), lambda x, k: x + F.get(logz, k))
    out = rows.where("word is null").select("piece", "at", "doc_id", "held_out", "n_tokens", "n_known", "logs", (F.col("model") - norm).alias("model"))
    out = out.join(met, ["piece", "at"], "left").na.fill(0, ["known", "more", "lift"])
    unit = float(np.log10(int(total["n"]) + SMOOTH * (int(total["v"]) + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), F.lit(int(total["n"])).cast("long").alias("train_tokens"), (F.col("logs") + F.col("more") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), (F.col("model") + F.col("lift")).alias("score"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
