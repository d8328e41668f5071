"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's words form one stream (its documents in a hashed order), cut into blocks of equal length.  A source's
target gives it an exact quota of blocks, of which the last may be cut.  A binary tree over the output shards splits the quotas: a node draws how
many blocks of each source go left from the multivariate hypergeometric distribution, with a generator seeded by the
node, until every shard has its exact counts.  A shard then owns a range of each source's keyed permutation
of blocks (once through all blocks before any comes again), disjoint from the other shards', and a hash orders the blocks within a shard.
What no shard owns is not taken: the mix is the rows of ``places``, a row for each piece of a document in a shard.

The tree's draws over the sources are made in two levels, which gives the same distribution: the driver splits the quotas of
at most CHUNKS hashed groups of sources, and a task for each group splits its groups' counts among the sources, keeping only those with blocks left.
So no table of shards by sources exists; counts that aren't 0 are rows, at most one for each block.  Sources are
ranked, sized and given targets by joins and sums, and documents are never gathered by
source: positions in the streams are prefix sums over range partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import GOLDEN, U, batch, drop, mix, pieces, ship, small, staged, table

BLOCK_WORDS = 128
MOST_BLOCKS = 1 << 29  # the generator takes fewer than 10**9
SHARD_BLOCKS, MOST_SHARDS = 2048, 1 << 14
CHUNKS, CHUNK_SOURCES = 256, 1024
RUN = 4096  # ranks of a permutation that a join key covers
WEIGHTS = (3, 1, 2)
SHARE, REPEATS = 1.5, 2
SEED = 20240229


def targets(sizes: list[int], weights: list[float], share: float = SHARE, repeats: float = REPEATS) -> list[float]:
    """Words for each source: share of all, by weight; none above repeats times its size, the excess reshared by weight."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split(quota: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources): how many blocks of each source each shard takes; rows differ by one block in total at most."""
    total = int(quota.sum())
    edge = [total * j // shards for j in range(shards + 1)]
    out, todo = np.zeros((shards, len(quota)), np.int64), [(0, shards, quota.astype(np.int64))]
    while todo:
        lo, hi, q = todo.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(q, edge[mid] - edge[lo], method="marginals")
        todo += [(lo, mid, left), (mid, hi, q - left)]
    return out


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 applied to x: a four-round Feistel network, walked until it falls below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(U)
    mask = (U(1) << half) - U(1)
    out, todo = x.astype(U), np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], mask[todo], key[todo]
            a, b = out[todo] >> h, out[todo] & m
            for i in range(4):
                a, b = b, a ^ (mix(b + k * U(2 * i + 1)) & m)
            out[todo] = (a << h) | b
            todo = todo[out[todo] >= n[todo].astype(U)]
    return out.astype(np.int64)


_SIZED = "doc_id long, source string, k1 long, k2 long, size long"
_STREAM = f"{_SIZED}, part long, pos long, at long"


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, pa.string() if kind == "string" else pa.int64()) for n, kind in (x.split() for x in schema.split(", "))])


def _sized(batches):
    """Rows (doc_id, source, k1, k2, text) to _SIZED."""
    for b in batches:
        size = []
        for p in pieces(b.column(4)):
            p.words()
            size.append(np.diff(p.first))
        yield batch(_arrow(_SIZED), **{n: b.column(i) for i, n in enumerate(("doc_id", "source", "k1", "k2"))}, size=np.concatenate(size) if size else np.zeros(0, np.int64))


def _running(batches):
    """Rows sorted by source: words before each row within the partition's rows of its source."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    now, total, pos = object(), 0, 0
    for b in batches:
        at = []
        for s, n in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True):
            if s != now:
                now, total = s, 0
            at.append(total)
            total += n
        m = b.num_rows
        yield batch(_arrow(_STREAM), **{n: b.column(i) for i, n in enumerate(("doc_id", "source", "k1", "k2", "size"))}, part=np.full(m, part), pos=pos + np.arange(m), at=at)
        pos += m


def _keys() -> list[Column]:
    """Two hashes of a row's id, source and text; the first, seeded, is its place in the stream's order."""
    return [F.xxhash64("doc_id", "source", "text", F.lit(SEED)).alias("k1"), F.xxhash64("text", F.lit(1), "source", F.lit(1), "doc_id").alias("k2")]


def _name(source: Column | str) -> Column:
    """A source as a join key: null is a value of its own."""
    return F.struct(F.col(source).isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"))


def streams(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, sources): every row with its place in its source's stream, and a row for each source with its size."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *_keys(), F.col("text").alias("text"))
    sized = staged(base.mapInArrow(_sized, _SIZED), "sized")
    dealt = sized.repartitionByRange("source", "k1").sortWithinPartitions("source", "k1", "k2")
    run = staged(dealt.mapInArrow(_running, _STREAM), "streams")
    drop(sized)
    parts = run.groupBy("part", "source").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = staged(parts.select("part", _name("source").alias("k"), F.coalesce(F.sum("words").over(w), F.lit(0)).alias("before")), "before")
    placed = run.withColumn("k", _name("source")).join(small(before), ["part", "k"])
    placed = staged(placed.select("part", "pos", "doc_id", "source", "k1", "k2", "size", (F.col("at") + F.col("before")).alias("start")), "placed")
    sources = staged(run.groupBy("source").agg(F.sum("size").alias("size")), "sources")
    drop(run, before)
    return placed, sources


def ranked(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Adds rank, by code points with null last, and weight, the weights in turn."""
    dealt = sources.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id())
    dealt = staged(dealt, "ranged")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    first = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    w = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    rank = dealt.withColumn("i", F.row_number().over(w) - 1).join(F.broadcast(first), "part").withColumn("rank", F.col("first") + F.col("i"))
    out = rank.select("source", "size", "rank", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"))
    out = staged(out, "ranked")
    drop(dealt)
    return out


def with_targets(sources: DataFrame, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """Adds target, as ``targets`` does. A round is one sum over the sources; each but the last finds more that are full."""
    full = F.lit(False)
    before = None
    while True:
        got = sources.agg(F.sum("size").alias("all"), F.sum(F.when(full, F.col("size"))).alias("full"), F.sum(F.when(~full & (F.col("size") > 0), F.col("weight"))).alias("open"), F.count_if(full).alias("n")).first()
        unit = (share * (got["all"] or 0) - repeats * (got["full"] or 0)) / got["open"] if got["open"] else 0.0
        if got["n"] == before or not got["open"]:
            break
        before = got["n"]
        full = full | (F.lit(unit) * F.col("weight") >= repeats * F.col("size"))
    return sources.withColumn("target", F.when(full, repeats * F.col("size").cast("double")).otherwise(F.lit(unit) * F.col("weight")))


CELLS = "rank long, shard long, t_from long, t_to long"


def _share_out(tops: np.ndarray):
    """Rows (chunk, rank, quota) sorted by both to CELLS: each group's counts, tops[shard, chunk], among its sources."""

    def cells(chunk: int, rank: np.ndarray, quota: np.ndarray):
        schema = pa.schema([(x.split()[0], pa.int64()) for x in CELLS.split(", ")])
        total = np.concatenate([[0], np.cumsum(tops[:, chunk])])
        todo, out, held = [(0, len(tops), rank, quota, np.zeros_like(quota))], [], 0
        while todo:
            lo, hi, r, q, t = todo.pop()
            if hi - lo == 1:
                out.append((r, np.full(len(r), lo), t, t + q))
                held += len(r)
                if held > 100_000:
                    yield batch(schema, **dict(zip(schema.names, map(np.concatenate, zip(*out, strict=True)), strict=True)))
                    out, held = [], 0
                continue
            mid = (lo + hi) // 2
            left = np.random.default_rng([SEED, 1 + chunk, lo, hi]).multivariate_hypergeometric(q, int(total[mid] - total[lo]), method="marginals")
            for a, z, n, at in ((lo, mid, left, t), (mid, hi, q - left, t + left)):
                some = n > 0
                if some.any():
                    todo.append((a, z, r[some], n[some], at[some]))
        if out:
            yield batch(schema, **dict(zip(schema.names, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    def run(batches):
        held, now = [], None
        for b in batches:
            chunk, rank, quota = (b.column(i).to_numpy() for i in range(3))
            for c in np.unique(chunk).tolist():
                if c != now and held:
                    yield from cells(now, *map(np.concatenate, zip(*held, strict=True)))
                    held = []
                now = c
                held.append((rank[chunk == c], quota[chunk == c]))
        if held:
            yield from cells(now, *map(np.concatenate, zip(*held, strict=True)))

    return run


def shard_cells(sources: DataFrame, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """CELLS, staged: the ranks of each source's permutation that each shard owns. sources: rank, quota."""
    n = sources.count()
    chunks = max(1, min(CHUNKS, -(-n // CHUNK_SOURCES)))
    dealt = sources.where("quota > 0").select(F.pmod(F.xxhash64("rank"), F.lit(chunks)).alias("chunk"), "rank", "quota")
    quota = np.zeros(chunks, np.int64)
    for r in dealt.groupBy("chunk").agg(F.sum("quota").alias("quota")).collect():  # CHUNKS rows at most
        quota[r["chunk"]] = r["quota"]
    shards = int(max(1, min(MOST_SHARDS, -(-int(quota.sum()) // shard_blocks))))
    tops = split(quota, shards)
    return staged(dealt.repartition("chunk").sortWithinPartitions("chunk", "rank").mapInArrow(_share_out(tops), CELLS), "cells")


PIECES = "part long, pos long, rank long, t long, word_from long, word_to long"


def _pieces(whole: bool):
    """Rows (part, pos, rank, size, start, n, quota, cut, length) to PIECES: the blocks that a row is part of, in each
    epoch of its source's permutation, below the quota; whole: a row belongs to the block of its first word alone."""

    def run(batches):
        schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])
        for b in batches:
            part, pos, rank, size, start, n, quota, cut, length = (b.column(i).to_numpy() for i in range(9))
            for lo in range(0, len(rank), 2000):
                at = slice(lo, lo + 2000)
                first = start[at] // length[at]
                last = first if whole else (start[at] + size[at] - 1) // length[at]
                many = np.where(size[at] > 0, last - first + 1, 0)
                r = np.repeat(np.arange(len(many)), many) + lo
                block = np.repeat(first, many) + np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
                for e in range(REPEATS):
                    with np.errstate(over="ignore"):
                        key = mix((rank[r] * REPEATS + e + 1).astype(U) * U(GOLDEN) + U(SEED))
                    t = e * n[r] + permuted(block, n[r], key)
                    ok = t < quota[r]
                    rr, bb, tt = r[ok], block[ok], t[ok]
                    a, step = start[rr], length[rr]
                    z = a + size[rr]
                    if whole:
                        f, to = np.zeros_like(a), size[rr]
                    else:
                        end = np.where(tt == quota[rr] - 1, bb * step + cut[rr], (bb + 1) * step)
                        f, to = np.maximum(bb * step, a) - a, np.minimum(end, z) - a
                    some = to > f
                    yield batch(schema, part=part[rr][some], pos=pos[rr][some], rank=rank[rr][some], t=tt[some], word_from=f[some], word_to=to[some])

    return run


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, whole: bool = False):
    """(rows, places): rows (part, pos, doc_id, source, k1, k2, size, source_size, target), one for each row of docs, and
    places (part, pos, shard, place, word_from, word_to), one for each block piece that the mix takes from a row.

    place orders a shard's pieces.  The last block of a source's quota is cut to what is left of the target, so a
    source's words are its target's but for its stream's last block, which is shorter than the others.
    whole: rows are not cut; a row goes where its first word goes, all of it, and sources meet their targets on average.
    A null or empty text has size 0 and is never taken; a null source is the last source; repeated rows are separate
    documents; a null doc_id is kept.  An empty table gives two empty tables.
    """
    placed, sizes = streams(docs)
    known = with_targets(ranked(sizes, weights), share)
    total = sizes.agg(F.sum("size")).first()[0] or 0
    length = max(block_words, -(-int(share * total) // MOST_BLOCKS))
    # Blocks are length words but for a source's last: a whole repeat holds size words, and the rest whole blocks and a cut one.
    n = F.ceil(F.col("size") / length).cast("long")
    times = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    rest = F.when(F.col("size") > 0, F.round(F.col("target") - F.col("times") * F.col("size"))).otherwise(0).cast("long")
    known = known.withColumn("n", n).withColumn("times", times).withColumn("rest", rest)
    quota = F.least(F.col("times") * F.col("n") + F.ceil(F.col("rest") / length), REPEATS * F.col("n")).cast("long")
    cut = F.when(F.col("rest") % length == 0, length).otherwise(F.col("rest") % length).cast("long")
    known = staged(known.select("source", _name("source").alias("k"), "rank", F.col("size").alias("source_size"), "target", "n", quota.alias("quota"), cut.alias("cut")), "known")
    drop(sizes)
    cells = shard_cells(known, shard_blocks)
    cells = cells.select("rank", F.explode(F.expr(f"sequence(t_from div {RUN}, (t_to - 1) div {RUN})")).alias("run"), "shard", "t_from", "t_to")
    met = placed.withColumn("k", _name("source")).join(small(known.drop("source"), 128), "k")
    bits = met.select("part", "pos", "rank", "size", "start", "n", "quota", "cut", F.lit(length).cast("long").alias("length")).mapInArrow(_pieces(whole), PIECES)
    dealt = bits.withColumn("run", F.expr(f"t div {RUN}")).join(small(staged(cells, "runs"), 40), ["rank", "run"]).where("t >= t_from and t < t_to")
    places = dealt.select("part", "pos", "shard", F.xxhash64("shard", "rank", "t", F.lit(SEED)).alias("place"), "word_from", "word_to")
    return met.select("part", "pos", "doc_id", "source", "k1", "k2", "size", "source_size", "target"), places


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix: shard, place, doc_id, source, word_from, word_to of every piece, shard by shard and shuffled within them.

    Options, odd rows and odd tables as for mix_sources.
    """
    rows, places = mix_sources(docs, **options)
    met = rows.select("part", "pos", "doc_id", "source").join(places, ["part", "pos"]).select("shard", "place", "doc_id", "source", "word_from", "word_to")
    return met.repartition("shard").sortWithinPartitions("shard", "place", "word_from", "doc_id")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """rows of mix_sources with taken, the words that the shards take from each row, repeats counted, and pieces,
    first_shard and last_shard, of those pieces (null where nothing is taken). Odd rows and tables are treated as there."""
    rows, places = mix_sources(docs, **options)
    taken = places.groupBy("part", "pos").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"), F.count("*").alias("pieces"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    return rows.join(taken, ["part", "pos"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("pieces", F.lit(0).cast("long")).alias("pieces"), "first_shard", "last_shard")


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


def draw_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of docs, shard by shard and shuffled within them: whole rows, as often as shards take them.

    Null and empty texts go, as they have no words to take.  Rows that are alike in id, source and text are taken alike,
    as the first of them is.  Rows without id or source stay in the mix; other columns stay, whatever their names.
    """
    ship(spark)
    rows, places = mix_sources(docs, whole=True)
    spots = F.sort_array(F.collect_list(F.struct("shard", "place"))).alias("spots")  # REPEATS at most
    drawn = rows.where("size > 0").join(places, ["part", "pos"]).groupBy("k1", "k2", "part", "pos").agg(spots)
    drawn = drawn.groupBy("k1", "k2").agg(F.min(F.struct("part", "pos", "spots")).alias("x")).select("k1", "k2", F.explode("x.spots").alias("spot"))
    drawn = staged(drawn.select("k1", "k2", "spot.*"), "drawn")
    typed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").alias("text"))
    met = typed.select("doc", *_keys()).join(small(drawn, 96), ["k1", "k2"])
    return met.select("doc", "shard", "place").repartition("shard").sortWithinPartitions("shard", "place").select("doc.*")
