"""N-gram Jaccard join: which texts share at least 85% of their word shingles, as components.

The document by shingle incidence matrix is never multiplied as a whole.  Its columns are cut into P blocks by the
shingles' hashes.  Two sets of sizes up to s that link differ in at most K = 30*s/185 shingles, so at least P-K of
the P blocks hold the same shingles in both: a pair without one equal block is below the bound and never meets.
Each document sends a key for each block it may not leave out (all but its P-K-1 lightest, ties included; the heaviest
block that two linked documents have in common is then sent by both).  The most frequent shingles, up
to 262144 of those that three texts have, count last in a block's weight, so what unrelated texts share brings few of them
together, however many texts there are.  Equal keys give candidate groups, as stars, in
rows linear in the input.  Inside a group the block rows are multiplied exactly: dense blocks of 4096 columns
accumulate overlap counts, and pairs below the bound 185*I >= 85*(a+b) are dropped.

Exact copies share one node (a hash of the whole set) from the start.  A group beyond ROWS documents is cut into row
blocks; the representatives of what each block has joined meet again.  Documents that are still apart are then compared
with those that share a key with them, as linked ones do, so a chain of chance meetings costs its keys and not the square
of its documents; where keys are so common that this ships more, every row block meets every other.  Nothing is dropped.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import GOLDEN, LOWER_BYTE, WINDOW, U, batch, cache, drop, mix, pieces, ship, small, spans_hash, staged, table, windows_hash
from .graph import components

SHINGLE = 4
NUM, DEN = 85, 100
ROWS = 256  # rows of a block of the product
ELEMENTS = 1_500_000  # and shingles, at most, that it is meant to hold
COLUMNS = 4096
HOT_MOST = 1 << 18
LEAST_SHIPPED = 1 << 28  # bytes of sets that may be on disk for a product's sake, however small the input


def sizes_to(n: int) -> int:
    """The upper end of the size class of n."""
    hi = 1
    while hi < n:
        hi = max(hi + 1, hi * 8 // 5)
    return hi


def classes(n: int) -> list[int]:
    """The size classes in which a set of n may be the smaller or the larger of a linked pair."""
    out, hi, most = [], sizes_to(n), n * DEN // NUM
    while True:
        out.append(hi)
        if hi >= most:
            return out
        hi = sizes_to(hi + 1)


def block_edges(p: int) -> np.ndarray:
    edges = cache("jaccard")
    if p not in edges:
        if len(edges) > 200:
            edges.clear()
        edges[p] = np.array([-(-(j << 64) // p) for j in range(1, p)], dtype=U)
    return edges[p]


def block_keys(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The keys of a sorted set of hashes. A block weighs by its shingles that aren't hot, then by all of them."""
    n, out = len(h), []
    rare = np.zeros(n + 1, np.int64)
    at = np.searchsorted(hot, h)
    np.cumsum(hot[np.minimum(at, len(hot) - 1)] != h if len(hot) else np.ones(n, bool), out=rare[1:])
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U)
        np.cumsum(mix(h ^ U(GOLDEN)), out=sums[1:])
        for hi in classes(n):
            k = (2 * hi * (DEN - NUM)) // (DEN + NUM)
            slack = k // 3
            p = k + 1 + slack
            cut = np.concatenate([[0], np.searchsorted(h, block_edges(p)), [n]])
            weight = (np.diff(rare[cut]) << 32) + np.diff(cut)
            pick = np.flatnonzero(weight >= np.partition(weight, slack)[slack])
            sig = sums[cut[pick + 1]] - sums[cut[pick]]
            out.append(mix(mix(sig + U(hi) * WINDOW[0]) + pick.astype(U) * WINDOW[1]))
    return np.concatenate(out)


def shingle_sets(column: pa.Array):
    """For each text the sorted distinct hashes of its shingles: windows of four lower-cased words, or all its words."""
    for p in pieces(column, owner="jaccard"):
        p.words()
        w = spans_hash(p.data, p.start, p.end, LOWER_BYTE)
        at, h = windows_hash(w, p.row, SHINGLE)
        first = np.searchsorted(at, p.first)
        with np.errstate(over="ignore"):
            for i in range(p.hi - p.lo):
                n = p.first[i + 1] - p.first[i]
                if n >= SHINGLE:
                    yield np.unique(h[first[i] : first[i + 1]])
                elif n:
                    yield mix((w[p.first[i] : p.first[i + 1]] * WINDOW[8 : 8 + n]).sum(keepdims=True) + U(n))
                else:
                    yield np.zeros(0, U)


def node_of(h: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix((mix(h) * WINDOW[5]).sum(keepdims=True) + U(len(h)))[0].astype(np.int64))


SET_ROWS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))])


def _lists(flat: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Lists of the elements of n owners, which come in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(flat))


def _heads(node: np.ndarray, keys: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Of the nodes of a batch with one key the first keeps it, and the others link to that one."""
    n = len(node)
    owner, flat = np.repeat(np.arange(n), [len(k) for k in keys]), np.concatenate(keys) if keys else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    new = np.append(True, flat[order][1:] != flat[order][:-1]) if len(flat) else np.zeros(0, bool)
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))]
    keeps = np.zeros(len(flat), bool)
    keeps[order] = new
    links = np.unique(np.stack([owner[order[~new]], owner[first[~new]]], 1), axis=0)
    return _lists(flat[keeps], owner[keeps], n), _lists(node[links[:, 1]], links[:, 0], n)


def _signed(shared):
    """Rows (doc_id, text) to SET_ROWS. A key that very many texts have leaves each batch once."""

    def run(batches):
        hot = shared.value
        seen: set[int] = set()  # copies within a partition send their keys once
        for b in batches:
            n, node, keys = [], [], []
            for h in shingle_sets(b.column(1)):
                n.append(len(h))
                node.append(node_of(h) if len(h) else None)
                if len(h) and node[-1] not in seen:
                    seen.add(node[-1])
                    keys.append(block_keys(h, hot).view(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
            own, links = _heads(np.array([x or 0 for x in node], np.int64), keys)
            yield batch(SET_ROWS, doc_id=b.column(0).cast(pa.int64()), n_shingles=n, node=node, keys=own, links=links)

    return run


OFTEN = pa.schema([("h", pa.int64()), ("docs", pa.int64())])


def _often(batches):
    """Rows (text): the most frequent shingles of every run of texts, with the numbers of different texts that have them, two at least."""

    def close():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        h, n = h[n > 1], n[n > 1]
        if len(h) > HOT_MOST:
            top = np.lexsort((h, -n))[:HOT_MOST]
            h, n = h[top], n[top]
        return batch(OFTEN, h=h.view(np.int64), docs=n)

    held, size, seen = [], 0, set()
    for b in batches:
        for h in shingle_sets(b.column(0)):
            if not len(h) or (node := node_of(h)) in seen:
                continue
            seen.add(node)
            held.append(h)
            size += len(h)
            if size > 2_000_000:
                yield close()
                held, size, seen = [], 0, set()
    if held:
        yield close()


def hot_shingles(texts: DataFrame) -> np.ndarray:
    """The most frequent shingles, at most HOT_MOST of them, sorted; their texts are counted where a run has two or more.

    Which shingles are hot decides how well blocks tell texts apart, never which texts link.  A limit in parts of all
    texts would leave out shingles that ever more texts have as the table grows.
    """
    often = staged(texts.mapInArrow(_often, "h long, docs long").groupBy("h").agg(F.sum("docs").alias("docs")).where("docs > 2"), "often")
    room, least = HOT_MOST, None
    for r in often.groupBy("docs").agg(F.count("*").alias("n")).orderBy(F.desc("docs")).limit(HOT_MOST).collect():
        room -= r["n"]
        if room < 0:
            break
        least = r["docs"]
    found = np.zeros(0, np.int64) if least is None else often.where(F.col("docs") >= least).select("h").toArrow().column(0).to_numpy()
    drop(often)
    return np.unique(found.view(U))


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(batches):
    """Rows (key, node) sorted by both: links each node of a key with the key's first."""
    key = head = None
    for b in batches:
        if not b.num_rows:
            continue
        k, node = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.concatenate([[k[0] != key], k[1:] != k[:-1]]) if key is not None else np.concatenate([[True], k[1:] != k[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        heads = np.where(at >= 0, node[np.maximum(at, 0)], head if head is not None else 0)
        key, head = k[-1], heads[-1]
        keep = heads != node
        if keep.any():
            pairs = np.unique(np.stack([heads[keep], node[keep]], 1), axis=0)
            yield batch(EDGE, a=pairs[:, 0], b=pairs[:, 1])


def linked(sets: list[np.ndarray], other: list[int] | None = None) -> np.ndarray:
    """Labels of the components of the sets: rows of the blocked product, then its pairs within the bound.

    other: rows with the same value there need no comparison (they are known to be joined).
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        overlap = np.zeros((2, 2), np.int64)
        overlap[0, 1] = overlap[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        row = np.repeat(np.arange(m), size)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        new = np.append(True, flat[1:] != flat[:-1])
        col = np.cumsum(new) - 1
        shared = np.bincount(col)[col] > 1
        row, col = row[shared], col[shared]
        col = np.cumsum(np.append(True, col[1:] != col[:-1])) - 1 if len(col) else col
        overlap = np.zeros((m, m), np.float64)
        for c in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
            lo, hi = np.searchsorted(col, [c, c + COLUMNS])
            block = np.zeros((m, int(col[hi - 1]) - c + 1), np.float32)
            block[row[lo:hi], col[lo:hi] - c] = 1
            overlap += block @ block.T
    ok = (DEN + NUM) * overlap >= NUM * (size[:, None] + size[None, :])
    ok &= overlap > 0
    if other is not None:
        other = np.asarray(other)
        ok |= other[:, None] == other[None, :]
    label = np.full(m, -1)
    for i in range(m):
        if label[i] < 0:
            label[i], todo = i, [i]
            while todo:
                near = np.flatnonzero(ok[todo.pop()] & (label < 0))
                label[near] = i
                todo.extend(near.tolist())
    return label


JOINED = pa.schema([("node", pa.int64()), ("label", pa.int64())])


def _multiply(batches):
    """Rows (comp, block, known, node, set) sorted by comp and block: (node, label) of each row within its block."""

    def close():
        if len(nodes) == 1:
            return batch(JOINED, node=nodes, label=nodes)
        got = linked(sets, known)
        return batch(JOINED, node=nodes, label=[nodes[i] for i in got])

    now, nodes, known, sets = None, [], [], []
    for b in batches:
        comp, block, have, node, data = (b.column(i) for i in range(5))
        for at, h, x, s in zip(zip(comp.to_pylist(), block.to_pylist(), strict=True), have.to_pylist(), node.to_pylist(), data, strict=True):
            if at != now and nodes:
                yield close()
                nodes, known, sets = [], [], []
            now = at
            if not nodes or x not in nodes:
                nodes.append(x)
                known.append(h)
                sets.append(np.frombuffer(s.as_buffer(), U))
    if nodes:
        yield close()


FULL = pa.schema([("node", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("set", pa.binary())])


def _sets(batches):
    """Rows (text, node, comp): the set of each text that is the node's own, once for each partition."""
    seen: set[int] = set()
    for b in batches:
        out = []
        for h, x, c in zip(shingle_sets(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if len(h) and x not in seen and node_of(h) == x:
                seen.add(x)
                out.append((x, c, len(h), h.tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield batch(FULL, node=list(cols[0]), comp=list(cols[1]), n=list(cols[2]), set=list(cols[3]))


def _product(rows: DataFrame) -> DataFrame:
    """rows (comp, block, known, node, set) to (node, label)."""
    return rows.select("comp", "block", "known", "node", "set").repartition("comp", "block").sortWithinPartitions("comp", "block", "node").mapInArrow(_multiply, "node long, label long")


def _row_blocks():
    """Aggregate: the number of row blocks that documents of sizes n take."""
    return F.ceil(F.greatest(F.count("*") / ROWS, F.sum("n") / ELEMENTS)).cast("long")


def _blocks(rows: DataFrame) -> DataFrame:
    """Adds blocks, the number of row blocks of each comp, and block."""
    size = staged(rows.groupBy("comp").agg(_row_blocks().alias("blocks")), "sizes")
    return rows.join(small(size), "comp").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")))


KEYED = pa.schema([("node", pa.int64()), ("whole", pa.int64()), ("n", pa.int64()), ("key", pa.int64())])


def _keyed(shared):
    """Rows (node, comp, n, set) to KEYED, the keys that each node has sent."""

    def run(batches):
        hot = shared.value
        for b in batches:
            keys = [block_keys(np.frombuffer(s.as_buffer(), U), hot).view(np.int64) for s in b.column(3)]
            own = np.repeat(np.arange(b.num_rows), [len(k) for k in keys])
            yield batch(KEYED, **{name: b.column(i).take(pa.array(own)) for i, name in enumerate(("node", "whole", "n"))}, key=np.concatenate(keys) if keys else [])

    return run


def _joined_nodes(sets: DataFrame, hot) -> DataFrame:
    """sets (node, comp, n, set), each node once or a few times: (node, label), label common to the linked nodes.

    hot: the broadcast shingles that the keys were made with.
    """
    cut = _blocks(sets)
    got = _product(cut.where("blocks = 1").withColumn("known", F.col("node")))
    if cut.where("blocks > 1").isEmpty():
        return got
    # A large group is taken apart by size: linked sets are of one band of ratio 100:85 or of neighbouring ones.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(DEN / NUM))).cast("long")
    both = F.explode(F.array(band, band + 1))
    large = cut.where("blocks > 1").drop("block", "blocks")
    big = large.withColumn("band", both).withColumn("whole", F.col("comp")).withColumn("comp", F.xxhash64("comp", "band")).drop("band")
    big = staged(big, "big")
    first = staged(_product(_blocks(big).withColumn("known", F.col("node"))), "first")
    edges = first.select("node", "label")
    known = _known(big, edges)
    while True:  # one of each group's joined documents meets the others' again, in far fewer blocks
        ones = known.groupBy("comp", "label").agg(F.min("node").alias("node"))
        n = ones.count()
        heads = _blocks(big.join(small(staged(ones, "ones")), ["comp", "node"], "left_semi"))
        more = staged(_product(heads.withColumn("known", F.col("node"))), "more")
        edges = edges.union(more)
        known = _known(big, edges)
        if heads.where("blocks > 1").isEmpty() or known.select("comp", "label").distinct().count() > 0.5 * n:
            break
    rest, shipped = _apart(large, big, known, hot)
    room = max(LEAST_SHIPPED, 8 * sets.agg(F.sum("n")).first()[0])
    slices = -(-int(shipped) // room)
    for i in range(slices):  # on disk one after another, as they may take a multiple of the sets
        edges = edges.union(staged(_product(rest.where(F.pmod(F.xxhash64("block", "comp"), F.lit(slices)) == i)), "last"))
    return got.union(components(edges, "node", "label"))


def _apart(large: DataFrame, big: DataFrame, known: DataFrame, hot) -> tuple[DataFrame, float]:
    """Rows (comp, block, known, node, set) in which all documents meet that may be linked but have other labels so far, and their bytes.

    They share a key; of keys with the same documents one is enough.  A group whose keys are so common that they ship
    more shingles than its bands do, every row block with every other, is compared by bands.
    """
    labels = known.select("node", F.col("label").alias("known")).distinct()
    keyed = staged(large.select("node", "comp", "n", "set").mapInArrow(_keyed(hot), "node long, whole long, n long, key long").distinct(), "keyed")
    labels = small(staged(labels, "labelled"))
    met = keyed.join(labels, "node").groupBy("whole", "key")
    met = met.agg(_row_blocks().alias("blocks"), F.sum("n").alias("n"), F.count("*").alias("docs"), F.bit_xor(F.xxhash64("node")).alias("who"), F.min("known").alias("x"), F.max("known").alias("y"))
    met = staged(met.where("x <> y").groupBy("whole", "docs", "n", "blocks", "who").agg(F.min("key").alias("key")), "met")
    apart = known.groupBy("comp").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("comp")
    bands = big.join(apart, "comp", "left_semi").groupBy("whole", "comp").agg(_row_blocks().alias("blocks"), F.sum("n").alias("n"))
    cost = lambda of, name: of.groupBy("whole").agg(F.sum(F.col("n").cast("double") * F.col("blocks")).alias(name))
    costs = cost(met, "keys").join(cost(bands.where("blocks > 1"), "bands"), "whole").withColumn("by_band", F.col("bands") <= F.col("keys"))
    costs = staged(costs, "costs")
    shipped = 8 * (costs.agg(F.sum(F.when(F.col("by_band"), F.col("bands")).otherwise(F.col("keys")))).first()[0] or 0)
    by_key = met.join(small(costs.where("not by_band")), "whole", "left_semi").select("whole", "key", "blocks")
    by_key = keyed.drop("n").join(by_key, ["whole", "key"]).join(large.select("node", "set").dropDuplicates(["node"]), "node")
    by_key = by_key.withColumn("comp", F.xxhash64("whole", "key")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")))
    by_band = _blocks(big.join(small(costs.where("by_band")), "whole", "left_semi").join(apart, "comp", "left_semi")).where("blocks > 1")
    cols = ["comp", "blocks", "block", "node", "set"]
    rest = by_key.select(cols).union(by_band.select(cols)).join(labels, "node")
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rest.withColumn("block", F.greatest("block", "other") * F.col("blocks") + F.least("block", "other")), shipped


def _known(big: DataFrame, edges: DataFrame) -> DataFrame:
    labels = components(edges, "node", "label").withColumnRenamed("label", "found")
    mine = big.select("node", "comp").distinct().join(labels, "node", "left")
    return staged(mine.select("node", "comp", F.coalesce("found", "node").alias("label")), "known")


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    A set has the distinct windows of four words (ASCII lower-cased), or all the words of a shorter text as one.  Two
    documents link when 100*|A&B| >= 85*|A|B|; component_id is the smallest id reachable by links.  A text that is
    null or has no words has an empty set and is linked with nothing; a row without id gets a null component_id and
    links nothing; repeated rows are copies of each other and each give a row.  Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hot = docs.sparkSession.sparkContext.broadcast(hot_shingles(base.select("text")))
    signed = staged(base.mapInArrow(_signed(hot), "doc_id long, n_shingles long, node long, keys array<long>, links array<long>"), "signed")
    slim = staged(signed.drop("keys", "links"), "slim")
    pairs = signed.where("node is not null").select(F.explode("keys").alias("key"), "node")
    stars = pairs.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars, "a long, b long")
    group = components(stars.union(signed.select(F.explode("links").alias("a"), F.col("node").alias("b"))))
    drop(signed)
    nodes = slim.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(group, "node").select("doc_id", "node", F.col("label").alias("comp"))
    texts = base.join(small(staged(nodes, "wanted")), "doc_id").select("text", "node", "comp")
    sets = staged(texts.mapInArrow(_sets, "node long, comp long, n long, set binary"), "sets")
    labels = staged(_joined_nodes(sets, hot).distinct(), "labels")
    tagged = staged(slim.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node")), "tagged")
    least = tagged.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = tagged.join(least, "label", "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", mine.alias("component_id"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


OP8_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {DEN} * common >= {NUM} * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose id is the smallest of its component, one row for each; rows without id stay.

    Null and empty texts are linked with nothing and stay; of rows with one id that is a component's smallest, one stays
    (any); an empty table stays empty; other columns stay, whatever their names.
    """
    ship(spark)
    got = ngram_jaccard_components(docs)
    gone = staged(got.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    kept = docs.join(small(gone), "doc_id", "left_anti")
    twice = staged(got.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    one = kept.join(small(twice), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(small(twice), "doc_id", "left_anti").unionByName(one)
