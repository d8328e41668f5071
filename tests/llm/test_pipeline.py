import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import W, components_by_hand, rules_by_hand
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs_of_stages(spark):
    """Rows of documents and of each stage's result."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF))
    return [x.collect() for x in out]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, ids = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        now = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert ids is None or now <= ids
        if name == "n-gram Jaccard join":
            assert after.count() == len(now)
        before, ids = after, now
    assert ids


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).toPandas().sort_values("start")
    assert (got.start.diff().dropna().to_numpy() == got.n_tokens.to_numpy()[:-1]).all()
    assert got.doc_id.is_monotonic_increasing


def test_run_by_hand(spark, docs_of_stages):
    """Each stage against a plain version of it, on what the stage before kept."""
    start, rules, joined, clean, mixed, tokens = docs_of_stages
    assert {r["doc_id"]: r["text"] for r in rules} == rules_by_hand([(r["doc_id"], r["text"], r["source"]) for r in start])
    assert all(r["n_chars"] == len(r["text"]) for r in rules)
    groups = components_by_hand({r["doc_id"]: r["text"] for r in rules})
    assert sorted(r["doc_id"] for r in joined) == sorted(i for i, (_, c) in groups.items() if i == c)
    items = [W.findall(r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    leaks = lambda t: any(len(windows(x) & windows(W.findall(t.lower()))) >= 0.6 * len(windows(x)) for x in items)
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in joined if not leaks(r["text"]))
    times, texts = collections.Counter(r["doc_id"] for r in mixed), {r["doc_id"]: r["text"] for r in clean}
    assert set(times) <= set(texts) and max(times.values()) <= 2 and all(r["text"] == texts[r["doc_id"]] for r in mixed)
    tok, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = sorted((tuple(r[c] for c in ("start", "doc_id", "n_tokens", "ids_crc32")) for r in tokens))
    for (start, i, n, crc), r in zip(got, sorted(mixed, key=lambda r: r["doc_id"]), strict=True):
        ids = tok.encode(r["text"], add_special_tokens=False).ids + [2]
        assert (start, i, n, crc) == (at, r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_stages_on_odd_tables(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, empty, odd.withColumn("times", F.lit(1)).withColumn("_at", F.lit("x"))):
            after = stage(spark, docs, SF)
            assert name == "token-ID output" or after.columns == docs.columns, name
            assert len(after.collect()) <= 2 * docs.count(), name


def test_all_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
