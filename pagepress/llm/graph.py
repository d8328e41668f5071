"""Connected components of an edge table.

First each run of LOCAL edges is contracted to stars where it lies, in as many tasks as there are runs; a table of one run
is then done.  Else large-star and small-star steps alternate on DataFrames.  Every step is a grouped minimum (combined
before the shuffle) and an equi-join that adaptive execution can split, so a node with very many neighbours meets no
single task.  Rounds are cut by written tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import batch, drop, staged

LOCAL = 1_000_000
EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(u):
        x, y = label[u], label[v]
        apart = x != y
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _contract(batches):
    def close():
        u, v = stars(*map(np.concatenate, zip(*held, strict=True)))
        for k in range(0, len(u), 100_000):
            yield batch(EDGE, u=u[k : k + 100_000], v=v[k : k + 100_000])

    held, size = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size > 2 * LOCAL:  # bounds what a task holds, however its share came out
            yield from close()
            held, size = [], 0
    if size:
        yield from close()


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v): points the neighbours of u at the smallest of them and u; large: those above u, else those below."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge; label is the smallest node of its component. Null ends are left out."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    raw = staged(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges")
    runs = -(-raw.count() // LOCAL)
    e = staged(raw.coalesce(max(1, runs)).mapInArrow(_contract, "u long, v long"), "contracted")
    drop(raw)
    before = None
    while runs > 1:
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before == state:
            break
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = staged(_star(both, True), "large")
        drop(e)
        e = staged(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), False), "small")
        drop(large)
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v"), F.col("v")).distinct())
