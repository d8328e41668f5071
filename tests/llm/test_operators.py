"""Each operator against a brute-force version on small data, and on odd and empty tables."""

import collections
import math
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagepress.llm import core, decontamination, graph, jaccard_join, license_scan, line_crf, line_spread, lm_scoring, mixing, quality_rules, token_blocks, url_filter
from pagepress.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
W = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_words_and_lines():
    texts = ["a b  c", "", None, "Éa\tx\n\n y", " lead trail ", "a\nb\n", "x" * 10]
    for limit in (1, 5, 1000):
        words, lines, seen = [], [], {}
        for p in core.pieces(pa.array(texts), limit):
            p.words()
            p.lines()
            for s, e, r, h in zip(p.start, p.end, p.row, core.spans_hash(p.data, p.start, p.end, core.WORD_BYTE), strict=True):
                w = bytes(p.data[s:e]).decode()
                words.append((p.lo + r, w))
                assert seen.setdefault(w, h) == h
            lines += [(p.lo + r, bytes(p.data[s:e]).decode()) for s, e, r in zip(p.line_start, p.line_end, p.line_row, strict=True)]
        assert words == [(i, w) for i, t in enumerate(texts) for w in W.findall(t or "")]
        assert lines == [(i, x) for i, t in enumerate(texts) for x in (t or "").split("\n")]
        assert len(set(seen.values())) == len(seen)


def test_staged_tables_go(spark):
    """Tables staged in a scratch block, or dropped, are gone from the shared folder."""
    there = lambda: {f.name for f in Path(core.shared_dir(spark).removeprefix("file://")).iterdir()}
    before = there()
    with core.scratch():
        kept = core.staged(spark.range(3), "a")
        core.drop(core.staged(spark.range(3), "b"))
        assert kept.count() == 3 and len(there() - before) == 1
    assert there() == before


def test_remembered_words_grow():
    """The tokenizer's tables grow with the words, and a full table changes no ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, spec = Tokenizer.from_file(path), Path(path).read_text()
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 6))) for _ in range(3000)) for _ in range(30)]
    want = [i for t in texts for i in tok.encode(t, add_special_tokens=False).ids + [2]]
    for most in (token_blocks.CACHED_WORDS, 1000):
        token_blocks.CACHED_WORDS, was = most, token_blocks.CACHED_WORDS
        try:
            mine = token_blocks.WordTokenizer(spec)
            for _ in range(2):
                got = np.concatenate([mine.encode(p, 2)[0] for p in core.pieces(pa.array(texts), owner="tokens")])
                assert got.tolist() == want
            assert mine.used <= most and (most < 2000 or mine.bits > token_blocks.LEAST_BITS + 1)
        finally:
            token_blocks.CACHED_WORDS = was


@pytest.mark.parametrize("local", [10**6, 50])
def test_components(spark, monkeypatch, local):
    """In one run of edges and in many: a long chain, a star, random edges."""
    monkeypatch.setattr(graph, "LOCAL", local)
    rng = np.random.default_rng(local)
    edges = [(i, i + 1) for i in range(1000, 1200)] + [(5, x) for x in range(2000, 2300)] + [(int(a), int(b)) for a, b in rng.integers(-300, 300, (250, 2))] + [(7, None), (8, 8), (None, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert {r["node"]: r["label"] for r in got} == {x: find(x) for x in list(root)} and len(got) == len(root)
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def components_by_hand(texts):
    sets = {}
    for i, t in texts.items():
        w = W.findall((t or "").translate(AZ))
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("rows", [256, 4])
def test_jaccard(spark, docs, tables, monkeypatch, rows):
    monkeypatch.setattr(jaccard_join, "ROWS", rows)
    texts = {i: r["text"] for i, r in docs.items()}
    base = " ".join(f"w{i}" for i in range(200)).split()
    for i in range(30):  # a chain and a cluster of near copies
        near = list(base)
        for j in range(i % 6):
            near[(i * 37 + j * 11) % 200] = f"n{i}"
        texts[10_000 + i] = " ".join(near)
    got = jaccard_join.ngram_jaccard_components(tables([(i, t) for i, t in texts.items()])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components_by_hand(texts)


def test_jaccard_chain_of_meetings(spark, tables, monkeypatch):
    """Texts that only meet their neighbours don't ship the square of their group, and links within the group are found."""
    monkeypatch.setattr(jaccard_join, "ROWS", 4)
    monkeypatch.setattr(jaccard_join, "LEAST_SHIPPED", 1, raising=False)
    shipped, product = [], jaccard_join._product
    monkeypatch.setattr(jaccard_join, "_product", lambda rows: shipped.append(rows.count()) or product(rows))
    words = [f"w{i}" for i in range(3000)]
    texts = {i: " ".join(words[30 * i : 30 * i + 200]) for i in range(80)}
    texts |= {100 + i: f"n{i} {texts[i]}" for i in range(0, 80, 8)}
    got = jaccard_join.ngram_jaccard_components(tables(list(texts.items()))).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components_by_hand(texts)
    assert max(shipped) <= 5 * len(texts), shipped


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.randoms(use_true_random=False))
def test_block_keys_meet(n, rnd):
    """Linked sets have a key in common, whatever is hot."""
    a = {rnd.getrandbits(64) for _ in range(n)}
    b = set(a)
    while True:
        x = rnd.choice(sorted(b))
        c = b - {x} if rnd.random() < 0.5 else b | {rnd.getrandbits(64)}
        if not c or 100 * len(a & c) < 85 * len(a | c):
            break
        b = c
    hot = np.array(sorted(rnd.sample(sorted(a), len(a) // 3)), np.uint64)
    keys = [set(jaccard_join.block_keys(np.array(sorted(s), np.uint64), hot).tolist()) for s in (a, b)]
    assert keys[0] & keys[1]


def test_keys_leave_a_batch_once():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 50):
        node, keys = rng.integers(1, 1 << 40, n), [np.unique(rng.integers(0, 20, rng.integers(0, 6))) for _ in range(n)]
        own, links = (x.to_pylist() for x in jaccard_join._heads(node, keys))
        first: dict = {}
        for i in range(n):
            heads = [first.setdefault(k, i) for k in keys[i].tolist()]
            assert own[i] == [k for k, h in zip(keys[i].tolist(), heads, strict=True) if h == i]
            assert set(links[i]) == {int(node[h]) for h in heads if h != i}


def test_quality_rules(spark, docs):
    for r in quality_rules.quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        t = docs[r["doc_id"]]["text"] or ""
        w = W.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += bool(W.search(line)) and line in seen
            seen.add(line)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        at = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(at))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(at) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_line_frequency(tables):
    common = "Buy Now   at shop 123"
    rows = [(i, f"{common}\n" + " ".join(f"u{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(20)), "en", "h") for i in range(40)]
    rows += [(100 + i, f"buy now at shop 456\nshort{chr(97 + i)}", "en", "h") for i in range(5)]  # depleted
    rows += [(200 + i, "one copied line of words that is long enough to stay\nand another line", "en", "h") for i in range(60)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(tables(rows), min_docs=20, share=0.1).collect()}
    assert all(got[i]["n_removed_lines"] == 1 and got[i]["kept"] for i in range(40))
    assert not any(got[100 + i]["kept"] for i in range(5))
    assert all(got[200 + i]["n_removed_lines"] == 0 and got[200 + i]["kept"] for i in range(60))
    texts = {r["doc_id"]: r["text"] for r in quality_rules.clean_texts(tables(rows), min_docs=20, share=0.1).collect()}
    assert texts == {i: t.removeprefix(f"{common}\n") if i < 40 else t for i, t, *_ in rows if not 100 <= i < 200}


def rules_by_hand(rows, min_docs=20, share=0.1):
    """(doc_id, text, host) to {doc_id: text without its removed lines} of the documents kept; ids are distinct."""

    def lines(t):
        return [(i, " ".join(re.sub("[0-9]", "0", x) for x in W.findall(line.translate(AZ)))) for i, line in enumerate(t.split("\n")) if W.search(line)]

    hosts, seen, out = collections.Counter(h for _, _, h in rows), collections.defaultdict(set), {}
    for _, t, h in rows:
        names = {x for _, x in lines(t or "")}
        for x in names:
            least = sorted(core.spans_hash(np.frombuffer(y.encode(), np.uint8), np.array([0]), np.array([len(y.encode())]), core.LINE_BYTE)[0] for y in names - {x})
            seen[h, x].add(tuple(least))
    for i, t, h in rows:
        w = W.findall(t or "")
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        at = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        if len(w) < 10 or 100 * len(at) > 20 * len(w):
            continue
        gone = {k for k, x in lines(t) if len(seen[h, x]) > max(min_docs, share * hosts[h])}
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        left = len(W.findall(kept))
        if not gone or (left >= 10 and left >= 0.2 * len(w)):
            out[i] = kept
    return out


def test_clean_texts_by_hand(spark):
    """Lower limits, so that lines go in a small table; whole sets of other lines tell documents apart here."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = rules_by_hand([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], 2, 0.01)
    got = {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in quality_rules.clean_texts(docs, min_docs=2, share=0.01).collect()}
    assert sum(n > 0 for _, n in got.values()) > 5
    differ = {i for i in want.keys() | got.keys() if want.get(i) != got.get(i, (None,))[0]}
    assert not differ, differ


def test_template_lines_of_different_documents(spark, tables):
    """Every line that all documents carry goes, however many such lines there are."""
    letters = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04}")
    shared = [f"ta{letters(i)} tb{letters(i)} tc{letters(i)}" for i in range(40)]
    rows = [(i, "\n".join([*shared, *(f"own {letters(i)} text {letters(j)} " + " ".join(f"w{letters(1000 + 100 * j + 10 * (i % 10) + k)}{letters(i)}" for k in range(30)) for j in range(2))]), "en", "h") for i in range(60)]
    got = quality_rules.quality_rules(tables(rows)).collect()
    assert len(got) == 60 and all(r["n_removed_lines"] == 40 and r["kept"] for r in got)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = rules_by_hand([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], 2, 0.01)
    assert {r["doc_id"]: r["text"] for r in quality_rules.clean_texts(docs, min_docs=2, share=0.01).collect()} == want


def test_lm(spark, docs):
    got = QUERIES["op2_lm_scoring"](spark, SF).toPandas()
    words = {i: W.findall((r["text"] or "").translate(AZ)) + ["\n"] for i, r in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    c = collections.Counter(w for i, x in words.items() if not held[i] for w in x)
    n, v = sum(c.values()), len(c)
    for r in got.itertuples():
        x = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(x), sum(w in c for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), rel_tol=1e-9)
    h = got[got.held_out]
    assert h.score.sum() > h.base_score.sum()


def test_lm_is_normalised():
    rng = np.random.default_rng(0)
    net = lm_scoring.LogBilinear.train(rng.poisson(3, (20, 20)) * (rng.random((20, 20)) < 0.3), steps=50)
    assert np.allclose(np.exp(net.log_probs(np.arange(20))).sum(1), 1)


def test_lm_learns_words_of_class_0(tables):
    """Words that the core has no id for are told apart by the words before and after them."""
    held = [i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = {i: f"ga x{i % 40} gb y{i % 40} " * 5 for i in range(400)}
    texts |= dict(zip(held, ("ga x7 gb", "ga y7 gb", "gb y7 ga", "gb x7 ga", "ga never gb"), strict=False))
    got = {r["doc_id"]: r for r in lm_scoring.score_texts(tables(list(texts.items())), vocab=4).collect()}
    right, wrong, also, mixed, new = (got[i] for i in held[:5])
    assert right["held_out"] and math.isclose(right["base_score"], wrong["base_score"])
    assert right["score"] > wrong["score"] + 1 and also["score"] > mixed["score"] + 1
    assert new["n_known"] == 3 and new["score"] < right["score"]
    rng = np.random.default_rng(3)
    seen = rng.poisson(20, (6, 6))
    own = lm_scoring.Own(lm_scoring.LogBilinear.train(seen, steps=50), seen)
    assert np.allclose(np.exp(own.contexts(np.array([0, 0, 2]), np.array([1, 1, 5]), np.array([2, 0, 1]))).sum(1), 1, atol=1e-5)


def test_lm_by_hand(tables):
    """Where the core knows all words, a text's score is the sum of its tokens' log-probabilities after two words."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(20)]
    texts = {i: " ".join(rng.choice(words, rng.integers(0, 30), p=np.arange(1, 21) / 210)) for i in range(200)}
    v = 32
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(tables(list(texts.items())), vocab=v).collect()}
    train = {i: t.split() + ["\n"] for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10}
    counts = collections.Counter(w for t in train.values() for w in t)
    keys = {w: lm_scoring._tokens(next(core.pieces(pa.array([w]))))[0][0] for w in words} | {"\n": lm_scoring.END}
    ids = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (w != "\n", -counts[w], keys[w])), 1)}
    seen, skips, both = np.zeros((3, v, v), np.int64)
    walk = lambda t: zip(["\n", "\n", *t], ["\n", *t], t, strict=False)
    for t in train.values():
        for c, b, w in walk(t):
            seen[ids[b], ids[w]] += 1
            skips[ids[c], ids[w]] += 1
            both[ids[c], ids[b]] += 1
    net = lm_scoring.LogBilinear.train(seen)
    net.fit_before(skips, both)
    one, add, norm = net.tables()
    p = np.exp(one[None] + add[:, None, :] - norm[:, :, None])  # (before, last, word)
    assert np.allclose(p.sum(2), 1, atol=1e-4) and np.abs(add).max() > 0
    for i, t in texts.items():
        want = sum(math.log10(p[ids[c], ids[b], ids[w]]) for c, b, w in walk(t.split() + ["\n"]))
        assert math.isclose(got[i], want, rel_tol=1e-4, abs_tol=1e-4)


def test_lm_uses_the_word_before_the_last(tables):
    """x stands after each of a and b; what follows x is told by the word before it."""
    texts = {i: "a x p q " * 4 if i % 2 else "b x r s " * 4 for i in range(600)}
    held = [i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    texts |= {held[0]: "a x p q a x p q", held[1]: "a x r s a x r s"}
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(tables(list(texts.items())), vocab=16).collect()}
    assert got[held[0]] > got[held[1]] + 2


def test_line_features():
    """Against plain counts of each line."""
    text = "One TWO two two, three!\n\nabc def abc | 12 #x\nOne TWO two two, three!\n a b c d e f a b c d e\n\tÉé ü."
    p = next(core.pieces(pa.array([text])))
    x, size, offs = line_crf.line_features(p)
    lines = [t for t in text.split("\n") if W.search(t)]
    assert offs.tolist() == [0, len(lines)] and size.tolist() == [len(t.encode()) for t in lines]
    words = [W.findall(t) for t in lines]
    flat = [w for t in words for w in t]
    grams = collections.Counter(tuple(flat[i : i + 5]) for i in range(len(flat) - 4))
    covered = {j for i in range(len(flat) - 4) if grams[tuple(flat[i : i + 5])] > 1 for j in range(i, i + 5)}
    at = 0
    for k, (t, w) in enumerate(zip(lines, words, strict=True)):
        b, n = t.encode(), len(w)
        letters = sum(65 <= c <= 90 or 97 <= c <= 122 for c in b)
        want = [
            1, min(5 * sum(c in b"#*$%&<>=_~^" for c in b) / len(b), 1), min(2 * t.count("|") / n, 1), min(sum(65 <= c <= 90 for c in b) / max(letters, 1), 1), min(t.count("!") / n, 1), min(3 * sum(48 <= c <= 57 for c in b) / len(b), 1),
            sum(i > 0 and flat[i] == flat[i - 1] for i in range(at, at + n)) / n, sum(i > 1 and flat[i] == flat[i - 2] for i in range(at, at + n)) / n, min(math.log1p(n) / 6, 1), min(len(b) / n / 16, 1), float(w[-1][-1] in ".!?"),
            min(3 * sum(c in ",;:" for c in t) / n, 1), float(t in lines[:k]), min(sum(c > 127 for c in b) / len(b), 1), sum(i in covered for i in range(at, at + n)) / n,
        ]
        assert np.allclose(x[k], want), (t, x[k], want)
        at += n


def test_quality_is_fitted_on_bounded_lines(spark, tables):
    """An id that is repeated counts once, and the lines have a bound; neither keeps rows from being scored."""
    rows = [(i % 40, ("good words of a line, here.\n" if i % 2 else "### $$ ## ||\n") * 5, "en") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = line_crf.score_quality(tables(rows), labels, lines=60).collect()
    assert len(got) == 400 and all(r["predicted"] == r["doc_id"] % 2 for r in got)
    a, b = (line_crf.fit(tables(rows if k else rows[:40]), labels) for k in (0, 1))
    assert np.allclose(a.weight, b.weight)


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op5_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    field = line_crf.Field(np.zeros(3), np.array([[0.7, -0.2], [0.1, 0.4]]))
    emit, offs = np.array([0.3, -1.0, 0.5, 2.0]), np.array([0, 3, 3, 4])
    paths = collections.Counter()
    for s in np.ndindex(2, 2, 2):
        paths[s] = math.exp(sum(emit[i] for i in range(3) if s[i]) + field.step[s[0], s[1]] + field.step[s[1], s[2]])
    exact = [sum(v for s, v in paths.items() if s[i]) / sum(paths.values()) for i in range(3)] + [1 / (1 + math.exp(-2))]
    assert np.allclose(field.marginals(emit, offs), exact)


def test_license(spark, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in QUERIES["op6_license_scans"](spark, SF).collect():
        w = word.findall((docs[r["doc_id"]]["text"] or "").translate(AZ))
        hits = [(i, x) for i in range(len(w)) for p, x in license_scan.BASE.items() if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))


def test_license_expressions():
    assert license_scan.to_postfix("MIT OR (Apache-2.0 AND GPL-2.0 WITH Classpath-exception-2.0)") == ["MIT", "Apache-2.0", "GPL-2.0", "Classpath-exception-2.0", "with", "and", "or"]
    assert all(license_scan.to_postfix(x) is None for x in ("", "OR MIT", "MIT OR", "(MIT", "MIT)", "MIT MIT", "()"))
    assert license_scan.evaluate(license_scan.to_postfix("MIT AND GPL-3.0-only")) == ({"mit", "gpl"}, 0.5)
    auto = license_scan.scanner()
    got = license_scan.scan_text(auto, b"// SPDX-License-Identifier: GPL-2.0+ OR MIT\nMIT license, MIT License")
    assert got == (12, 2, 8, 10, "mit", "gpl,mit", 1.0)


def licences_by_hand(text):
    """(labels, score) of a text: phrases word by word, expressions by recursive descent on the longest prefix that parses."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(AZ))
    phrases = license_scan.BASE | license_scan.NOTICES
    labels = {x for p, x in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()}
    free = [license_scan.FREEDOM[x] for x in labels]

    def parse(tokens):
        at = 0

        def either():
            nonlocal at
            a = both()
            while at < len(tokens) and tokens[at].lower() == "or":
                at += 1
                b = both()
                a = (a[0] | b[0], max(a[1], b[1]))
            return a

        def both():
            nonlocal at
            a = one()
            while at < len(tokens) and tokens[at].lower() == "and":
                at += 1
                b = one()
                a = (a[0] | b[0], min(a[1], b[1]))
            return a

        def one():
            nonlocal at
            if at >= len(tokens) or tokens[at].lower() in ("or", "and", "with", ")"):
                raise ValueError
            if tokens[at] == "(":
                at += 1
                a = either()
                if at >= len(tokens) or tokens[at] != ")":
                    raise ValueError
                at += 1
            else:
                x = license_scan.label_of(tokens[at])
                a = ({x}, license_scan.FREEDOM.get(x, license_scan.UNKNOWN))
                at += 1
            if at < len(tokens) and tokens[at].lower() == "with":
                at += 1
                one()
            return a

        got = either()
        if at < len(tokens):
            raise ValueError
        return got

    for line in re.split("[\n\r]", text):
        for part in re.split("(?i)spdx-license-identifier:", line)[1:]:
            words = part.replace("*/", " ").replace("-->", " ").split()
            for n in range(len(words), 0, -1):
                pieces = [re.findall(r"[()]|[A-Za-z0-9.\-+:]+", x) for x in words[:n]]
                if "".join(map("".join, pieces)) != "".join(words[:n]):
                    continue
                try:
                    more, f = parse([x for p in pieces for x in p])
                except ValueError:
                    continue
                labels |= more
                free.append(f)
                break
    return ",".join(sorted(labels)), min(free, default=0.0)


def test_licences_by_hand(spark, docs, tables):
    names = ["MIT", "GPL-2.0-only", "Apache-2.0", "ISC", "Some-1.0", "CC-BY-NC-4.0"]
    rng = np.random.default_rng(4)

    def expression(depth):
        if depth == 0 or rng.random() < 0.3:
            return str(rng.choice(names))
        inner = f" {rng.choice(['AND', 'or', 'And'])} ".join(expression(depth - 1) for _ in range(rng.integers(1, 4)))
        return f"({inner})" if rng.random() < 0.5 else inner

    texts = {i: r["text"] or "" for i, r in docs.items()}
    for i in range(300):
        tail = str(rng.choice(["", " */", " see the file", " -->\nMIT License", ") or", " and", "\nall rights reserved", " ZZ ZZ"]))
        texts[50_000 + i] = f"x\n// SPDX-License-Identifier: {expression(3)}{tail}\nmore"
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(tables(list(texts.items()))).collect()}
    want = {i: licences_by_hand(t) for i, t in texts.items()}
    assert got == want


def test_long_license_expressions():
    auto = license_scan.scanner()
    names = [f"Some-{i}" for i in range(3000)]
    for text in (" AND ".join(["MIT", *names, "CC-BY-NC-4.0"]), "(" + " OR ".join(names) + ") AND CC-BY-NC-4.0", "MIT AND (" * 50 + "CC-BY-NC-4.0" + ")" * 50):
        got = license_scan.scan_text(auto, f"// SPDX-License-Identifier: {text} */ see below\nmore".encode())
        assert got[-1] == 0.2 and set(got[-2].split(",")) - {"cc-by"} == {license_scan.label_of(x) for x in re.findall(r"[A-Za-z0-9.\-]+", text) if x not in ("AND", "OR")}
    assert license_scan._expression(b"mit or (gpl-2.0 and isc, see below") == ["mit"] and license_scan._expression(b"(mit") is None


def test_url_rules_and_segmentation():
    assert url_filter.parts("HTTP://A.b/C?d") == ("a.b", "/C") and url_filter.parts("a.b/c") == ("", "") and url_filter.parts(None) == ("", "")
    rule = lambda u: url_filter.rule_for(*url_filter.parts(u))
    assert rule("http://x.example.com/en/7") == ("example.com/en/7", "allow") and rule("http://x.example.com/en/8") == ("com/en/", "block")
    assert rule("http://notcom/en/8") is None and rule("http://a.example.net/de/81") == ("example.net/de/8", "block") and rule("http://b.net/de/1") == ("net/de/", "allow")
    model = url_filter.HostModel({"green": 50, "garden": 40, "tools": 30, "the": 500}, seeds=("cheap pills",))
    assert model.split("greengardentools") == ("green", "garden", "tools") and model.split("cheappills") == ("cheap", "pills")
    assert url_filter.runs("x.example.com", "/en/seven", ("com", "/en/")) == [("x", True), ("example", True), ("com", False), ("en", False), ("seven", True)]


def urls_by_hand(rows, rules, seeds, rounds=url_filter.ROUNDS, prior=url_filter.PRIOR, smooth=1.0, unruled=0.25):
    """(page_id, url, html) to {(page_id, url): (host, path, rule, verdict, tokens)}, in plain loops."""
    counts = collections.Counter()
    for _, _, html in rows:
        counts.update(re.findall("[a-z]{2,24}", re.sub("<[^>]*>", " ", html or "").lower().encode().decode()))
    usual = sorted(counts.values())[len(counts) // 2]
    model = url_filter.HostModel({}, seeds, sum(counts.values()), usual)
    known = {w: counts[w] for name in seeds for w in name.split() if w in counts}
    model = url_filter.HostModel(known, seeds, sum(counts.values()), usual)
    urls = {}
    for url in {u or "" for _, u, _ in rows}:
        rest = url.partition("://")[2] if "://" in url else ""
        host = re.split("[/?#]", rest)[0].translate(AZ)
        path = re.split("[?#]", rest[len(re.split("[/?#]", rest)[0]) :])[0]
        fits = sorted(((h + p, v, h, p) for v, h, p in rules if (("." + host).endswith("." + h)) and path.startswith(p)), key=lambda x: len(x[0]))
        rule = fits[-1] if fits else (None, None, "", "")
        host_edge, words, own = len(host) - len(rule[2]), [], []
        for text, mine in ((host, lambda at, e=host_edge: at < e), (path.translate(AZ), lambda at, e=len(rule[3]): at >= e)):
            for m in re.finditer("[a-z]+", text):
                split = model.split(m[0], counts)
                words += split
                own += split if mine(m.start()) else []
        urls[url] = (host, path, rule[0], rule[1], words, own)
    odds = {}
    for r in range(rounds + 1):
        n = {"block": collections.Counter(w for x in seeds for w in x.split()), "allow": collections.Counter()}
        for url, (_, _, _, ruled, _, own) in urls.items():
            p = 1 / (1 + math.exp(-odds[url])) if r else 0
            for v, share in (("block", p), ("allow", 1 - p)):
                if ruled == v or (not ruled and r):
                    for w in own:
                        n[v][w] += 1 if ruled else unruled * share
        total = {v: sum(c.values()) for v, c in n.items()}
        least = min(total.values())
        part = lambda v, w: math.log(n[v][w] * (least / total[v] if total[v] else 0) + smooth)  # noqa: B023, E731
        odds = {u: math.log(prior / (1 - prior)) + sum(part("block", w) - part("allow", w) for w in x[4]) for u, x in urls.items()}
    return {(i, u): (*urls[u or ""][:3], urls[u or ""][3] or ("block" if odds[u or ""] > 0 else "allow"), " ".join(urls[u or ""][4]), odds[u or ""]) for i, u, _ in rows}


@pytest.mark.parametrize("seeds", [url_filter.SEEDS, ("tion", "th re"), ()])
def test_urls_by_hand(spark, seeds):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", F.col("html").cast("string").alias("html"))
    want = urls_by_hand([tuple(r) for r in pages.collect()], url_filter.RULES, seeds)
    got = url_filter.judge_urls(pages, url_filter.word_counts(pages.select("html")), seeds=seeds).join(pages.select("page_id", "url"), "page_id").collect()
    assert len(got) == len(want)
    for r in got:
        host, path, rule, verdict, tokens, odds = want[r["page_id"], r["url"]]
        assert (r["host"], r["path"], r["rule"], r["tokens"]) == (host, path, rule, tokens)
        assert math.isclose(r["block_probability"], 1 / (1 + math.exp(-odds)), abs_tol=1e-4)
        assert r["verdict"] == verdict or abs(odds) < 1e-3
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}


def test_url_classes_follow_the_rules(spark):
    """Hosts of which a rule blocks pages are blocked elsewhere too, by their names alone; clean hosts aren't."""
    rows = [f"http://casinoclub{i % 9}.example.com/en/{i}" for i in range(60)] + [f"http://gardenclub{i % 9}.example.net/de/{i}" for i in range(60)]
    rows += ["http://casinohall.example.com/fr/1", "http://gardenhall.example.net/fr/1", "http://nothing.of.that/"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    lexicon = {w: 50 for w in ("casino", "garden", "club", "hall", "example", "com", "net", "en", "de", "fr", "http", "nothing", "of", "that")}
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, lexicon).collect()}
    assert [got[120], got[121], got[122]] == ["block", "allow", "allow"]


def test_long_runs_of_letters():
    """A word that lies across the 200th or 1000th letter is one word."""
    model = url_filter.HostModel({"green": 50, "garden": 40, "tools": 30, "the": 500})
    words = ("green", "garden", "tools") * 80
    assert model.split("".join(words)) == words
    name = "".join(words)
    subs = {w for b in url_filter._substrings([pa.record_batch({"id": [1], "name": [name]})]) for w in b.column(1).to_pylist()}
    assert subs == {name[a:z] for a in range(len(name)) for z in range(a + 2, min(a + 24, len(name)) + 1)}


def test_url_words_are_all_known(spark, tables):
    """A word seen once among very many others is known, and total and median are of all words."""
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(5))
    texts = [(0, " ".join(f"qq{letters(i)} " * 2 for i in range(60_000))), (1, "green garden tools")]
    counts = url_filter.word_counts(tables(texts).select("text"))
    assert counts.count() == 60_003
    pages = spark.createDataFrame([(1, "http://greengardentools.x/"), (2, None), (1, "http://greengardentools.x/")], "page_id long, url string")
    got = [(r["page_id"], r["tokens"]) for r in url_filter.judge_urls(pages, counts).collect()]
    assert sorted(got) == [(1, "green garden tools x"), (1, "green garden tools x"), (2, "")]


def test_mixing(spark, docs):
    got = QUERIES["op7_mixing_sources"](spark, SF).toPandas()
    again = QUERIES["op7_mixing_sources"](spark, SF).toPandas()
    key = ["doc_id", "taken"]
    assert (got.sort_values("doc_id")[key].to_numpy() == again.sort_values("doc_id")[key].to_numpy()).all()
    assert (got.taken <= 2 * got["size"]).all()
    got["source"] = got.doc_id.map(lambda i: docs[i]["source"])
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert ((by.taken - by.target).abs() <= 2 * mixing.BLOCK_WORDS).all() and (by.target <= 2 * by["size"] + 1e-6).all()
    assert math.isclose(by.target.sum(), 1.5 * by["size"].sum())


def test_mixing_shards(tables):
    rows, places = mixing.mix_sources(tables([(i, "w " * (50 + i % 7 * 100), "en", f"s{i % 3}") for i in range(90)]), block_words=8)
    p = places.toPandas()
    assert (p.groupby(["part", "pos", "word_from"]).size() <= 2).all()
    q = np.array([500, 300, 700])
    counts = mixing.split(q, 7)
    assert (counts.sum(0) == q).all() and np.ptp(counts.sum(1)) <= 1
    for n in (1, 2, 3, 17, 100, 1000):
        x = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(x.tolist()) == list(range(n))


def test_mixing_tree(spark, tables, monkeypatch):
    """Quotas by shard, against plain sums; what the tree decides decides the result."""
    texts = [(i, "w " * (3 + i * 37 % 300), "en", [None, "a", "b", "tiny", "é"][0 if i % 9 == 0 else 3 if i == 50 else (1, 1, 2, 4)[i % 4]]) for i in range(150)] + [(900, None, "en", "a"), (901, "", "en", "none")]
    docs, options = tables(texts), dict(block_words=8, shard_blocks=64)
    size = collections.Counter()
    for _, t, _, s in texts:
        size[s] += len(W.findall(t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    goal = dict(zip(order, mixing.targets([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]), strict=True))
    rows, places = mixing.mix_sources(docs, **options)
    info = {(r["part"], r["pos"]): r for r in rows.collect()}
    assert len(info) == len(texts) and all(math.isclose(r["target"], goal[r["source"]], abs_tol=1e-6) and r["source_size"] == size[r["source"]] for r in info.values())
    got = places.collect()
    taken, pieces = collections.Counter(), collections.Counter()
    for r in got:
        x = info[r["part"], r["pos"]]
        taken[x["source"]] += r["word_to"] - r["word_from"]
        pieces[r["part"], r["pos"]] += r["word_to"] - r["word_from"]
        assert 0 <= r["word_from"] < r["word_to"] <= x["size"]
    assert all(abs(taken[s] - goal[s]) < 8.5 for s in order) and all(n <= 2 * info[k]["size"] for k, n in pieces.items())
    blocks = collections.defaultdict(set)
    for r in got:
        blocks[r["shard"]].add(r["place"])
    many = [len(blocks[k]) for k in range(len(blocks))]
    assert len(many) == -(-sum(many) // 64) > 4 and max(many) - min(many) <= 1  # blocks of equal number, each in one shard
    assert len(set().union(*blocks.values())) == sum(many)
    mix = [tuple(r) for r in mixing.mixed(docs, **options).collect()]
    assert sorted(mix, key=str) == sorted(((r["shard"], r["place"], info[r["part"], r["pos"]]["doc_id"], info[r["part"], r["pos"]]["source"], r["word_from"], r["word_to"]) for r in got), key=str)
    starts = [i for i, r in enumerate(mix) if i == 0 or r[0] != mix[i - 1][0]]
    assert len(starts) == len(blocks) and all(mix[a][1] <= mix[b][1] for a, b in zip(range(len(mix)), range(1, len(mix)), strict=False) if mix[a][0] == mix[b][0])
    assert sum(a[2] > b[2] for a, b in zip(mix, mix[1:], strict=False)) > len(mix) / 4  # shuffled
    flat = lambda: sorted(map(tuple, mixing.taken_words(docs, **options).collect()), key=str)
    before = flat()
    assert {r[0]: r[4] for r in before} == {x["doc_id"]: pieces[k] for k, x in info.items()}

    def one_sided(quota, shards):
        out = np.zeros((shards, len(quota)), np.int64)
        out[0] = quota
        return out

    monkeypatch.setattr(mixing, "split", one_sided)
    after = flat()
    assert after != before and {r[6] for r in after} <= {0, None}


def test_mixing_shares_quotas_out():
    """Each source's quota is whole over the shards, in ranges one after the other, as the shards' sums are."""
    tops = mixing.split(np.array([5000, 700]), 13)
    for chunk, quota in ((0, [4000, 0, 999, 1]), (1, [1] * 700)):
        rank, q = np.arange(len(quota)) * 7, np.array(quota, np.int64)
        some = q > 0
        rows = pa.record_batch({"chunk": np.full(int(some.sum()), chunk), "rank": rank[some], "quota": q[some]})
        sent = [rows.slice(i, 2) for i in range(0, len(rows), 2)]
        cells = pa.Table.from_batches(mixing._share_out(tops)(sent)).to_pandas()
        by = cells.assign(n=cells.t_to - cells.t_from)
        assert (by.n > 0).all() and by.groupby("rank").n.sum().to_dict() == {int(r): int(n) for r, n in zip(rank[some], q[some], strict=True)}
        assert by.groupby("shard").n.sum().reindex(range(13), fill_value=0).tolist() == tops[:, chunk].tolist()
        for _, x in by.sort_values(["rank", "shard"]).groupby("rank"):
            assert x.t_from.iloc[0] == 0 and (x.t_from.to_numpy()[1:] == x.t_to.to_numpy()[:-1]).all()


def test_drawn_mix(spark, tables):
    """Whole rows, of the sources in their shares; odd columns stay."""
    rows = [(i, f"{i} " + "w " * (20 + i % 50), "en", f"s{i % 4}", i) for i in range(400)] + [(7, "7 " + "w " * 27, "en", "s3", 7)]
    docs = tables(rows).withColumn("shard", F.lit("x")).withColumn("doc", F.lit(1))
    got = mixing.draw_mix(spark, docs, SF).collect()
    text = {r[0]: r[1] for r in rows}
    times = collections.Counter(r["doc_id"] for r in got)
    assert all(r["text"] == text[r["doc_id"]] and r["shard"] == "x" and r["n_chars"] == r["doc_id"] for r in got) and max(n for i, n in times.items() if i != 7) <= 2
    size = collections.Counter()
    words = collections.Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    for r in got:
        words[r["source"]] += len(r["text"].split())
    goal = dict(zip("s0 s1 s2 s3".split(), mixing.targets([size[f"s{i}"] for i in range(4)], [3, 1, 2, 3]), strict=True))
    assert all(abs(words[s] - goal[s]) < 0.2 * goal[s] for s in goal), (words, goal)


def test_hot_shingles_of_few_texts(spark):
    """What five of 20,000 texts share is hot; copies of one text don't make it so."""
    rows = [(f"w{i} x{i} y{i} z{i}" + (" as five texts say" if i % 4000 == 0 else ""),) for i in range(20_000)] + [("copies of one text",)] * 5
    hot = set(jaccard_join.hot_shingles(spark.createDataFrame(rows, "text string").coalesce(1)).tolist())
    five, once, copy = (next(jaccard_join.shingle_sets(pa.array([t]))).tolist() for t in ("as five texts say", "w1 x1 y1 z1", "copies of one text"))
    assert set(five) <= hot and not hot & set(once + copy)


def test_jaccard_of_tokens_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        for top in (1, 2, 300, 49408, 2**32):
            ids = rng.integers(0, top, n).astype(np.uint32)
            ids[rng.random(n) < 0.05] = rng.integers(0, 2**32)
            assert (token_blocks.decode(*token_blocks.encode(ids), n) == ids).all()


def test_tokens(spark, docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def want(rows):
        out, at = [], 0
        for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
            ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
            out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        return out

    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: r[1])
    got = order(QUERIES["op10_token_blocks"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want([(i, r["text"]) for i, r in docs.items()])
    got = order(token_blocks.token_output(spark, odd).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_decontamination(spark, tables):
    item = "If a train leaves Boston at 40 km per hour and another leaves Denver at 60 km per hour when do they meet again exactly"
    same = item.replace("Boston", "Paris").replace("Denver", "Rome").replace("40", "35").replace("60", "80")
    wrong = item.replace("Denver", "Boston")
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (1, item)], "item_id long, text string")
    filler = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100))
    rows = tables([(1, f"{filler}. {item} {filler}"), (2, f"{filler}. {same} {filler}"), (3, filler), (4, None), (None, item), (1, f"{filler}. {item} {filler}"), (6, "too short")])
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(rows, bench).collect()) == [(1, 1), (2, 1)]
    got = {r["doc_id"]: r["coverage"] for r in decontamination.contaminated(rows, bench).collect()}
    assert set(got) >= {1, 2} and not {3, 4, 6} & set(got)
    clash = {r["doc_id"]: r["matched"] for r in decontamination.contaminated(tables([(1, item), (2, wrong)]), bench, cover=0.0).collect()}
    assert clash.get(2, 0) < clash[1]


def test_decontamination_of_dense_items(spark, tables):
    """Items whose windows are mostly numbers or names."""
    sort, series = "Sort 12 5 33 8 21 9 ascending", "What comes next: 2, 4, 8, 16, 32"
    bench = spark.createDataFrame([(1, sort), (2, series)], "item_id long, text string")
    texts = [sort, f"see this: {sort}. and more of it", "Sort 1 2 3 4 5 6 ascending", "12 5 7 8 9 1 2 3", series, "What comes next: 3, 9, 27, 81, 243", "What comes next: 3, 9 people and others came after"]
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["item_windows"]) for r in decontamination.contaminated(tables(list(enumerate(texts))), bench).collect()}
    assert got == {(0, 1): (4, 4), (1, 1): (4, 4), (4, 2): (4, 4), (5, 2): (4, 4)}


def test_decontamination_of_equal_parameters(spark, tables):
    """Different numbers of an item may become equal; one number that becomes two is another question."""
    item = "A bag has 3 apples and 5 pears, take 2 apples and 4 pears away"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [item, "A bag has 4 apples and 4 pears, take 1 apples and 1 pears away", "A bag has 4 apples and 4 pears, take 4 apples and 4 pears away"]
    got = {r["doc_id"]: r["coverage"] for r in decontamination.contaminated(tables(list(enumerate(texts))), bench).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 1.0}
    twice = "A bag has 3 apples and 3 pears, take 3 apples and 3 pears away"
    bench = spark.createDataFrame([(1, twice)], "item_id long, text string")
    assert not {r["doc_id"] for r in decontamination.contaminated(tables(list(enumerate(texts))), bench).collect()} & {0, 1}


def test_planted_benchmark_passages(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_benchmark_decontamination"](spark, sf).collect()}
    want = set()
    items = {r["item_id"]: W.findall(r["text"].lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = W.findall(d["text"].lower())
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        want |= {(d["doc_id"], i) for i, x in items.items() if sum(tuple(x[j : j + 5]) in grams for j in range(len(x) - 4)) >= 0.6 * (len(x) - 4)}
    assert got == want


def test_decontamination_recall(spark, tables):
    """Re-parameterised questions: other names, numbers (in digits or words) and units; and no clean text is found."""
    rng = np.random.default_rng(6)
    pick = lambda xs: str(rng.choice(xs))
    names, things = "Anna Boris Carla Dmitri Elena Farid Greta Hugo Irene Jonas".split(), "apples pears books tickets pencils marbles".split()
    units, words = "kilometers miles meters kilograms tons hours minutes dollars".split(), "two three five eight eleven twelve twenty forty".split()
    shapes = [
        "When {n} drives {d} {u} north and then {d} {u} east how far away from home is the car now",
        "If {n} has {d} red {t} and {m} buys {d} more of them on the way how many are there in the basket",
        "A worker named {n} carries {w} heavy boxes of {d} {u} each up the stairs so what is the total load of that day",
        "The ages of {n} and {m} add up to {d} and in {w} years one will be twice as old as the other so how old are they",
        "Every morning {n} walks {w} {u} to school and takes {d} minutes for it which speed is that on average",
    ]
    thing = {k: things[k] for k in range(len(shapes))}

    def filled(k):
        out = shapes[k].replace("{t}", thing[k])
        for slot, make in (("{n}", lambda: pick(names[:5])), ("{m}", lambda: pick(names[5:])), ("{w}", lambda: pick(words)), ("{d}", lambda: str(rng.integers(2, 900)))):
            while slot in out:
                out = out.replace(slot, make(), 1)
        return out.replace("{u}", pick(units))

    bench = spark.createDataFrame([(k, filled(k)) for k in range(len(shapes))], "item_id long, text string")
    filler = lambda: " ".join(f"{pick(['the', 'a', 'of', 'to'])} w{rng.integers(0, 500)}" for _ in range(40))
    planted = [(i, f"{filler()}. {filled(i % 5)}. {filler()}") for i in range(100)]
    clean = [(1000 + i, f"{filler()}. {pick(names)} drives {rng.integers(2, 90)} {pick(units)} and buys {pick(words)} {pick(things)} {filler()}") for i in range(100)]
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(tables(planted + clean), bench).collect()}
    assert found <= {(i, i % 5) for i in range(100)} and len(found) >= 95


def test_decontamination_probes(spark, tables):
    """Items that are dense in numbers, other units, number words, and items of three and four words."""
    items = ["the ages 12 15 19 23 31 44 58 60 72 and 81", "how long does it take to go 30 miles north", "she had twelve sheep and sold four of her sheep", "name the capital", "seven plus eight is", "too short"]
    texts = [f"before it {items[0]} and after", "so how long does it take to go 40 kilometers north or not", "then she had 9 sheep and sold 2 of her sheep", "please name the capital of it", "what seven plus eight is then", "this is too short", "name a capital the", "seven minus eight is"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(tables(list(enumerate(texts))), bench).collect()}
    assert got == {(i, i) for i in range(5)}


def test_line_spread_keeps_other_columns(tables):
    rows = [(i, "Shared line\nown", "en", f"s{i}") for i in range(9)]
    docs = tables(rows).withColumns({c: F.lit(c) for c in ("_gone", "_k1", "_k2", "k1", "doc", "mask", "n")})
    got = line_spread.remove_spread_lines(docs)
    assert set(docs.columns) < set(got.columns)
    for r in got.collect():
        assert r["text"] == "" and r["n_removed_lines"] == 2 and all(r[c] == c for c in ("_gone", "_k1", "_k2", "k1", "doc", "mask", "n"))


def test_line_spread(tables):
    rows = [(i, f"Shared  line\nown {i}\n\nTwo\tsites", "en", f"s{i % 9}") for i in range(18)] + [(50, "only here", "en", None), (51, None, "en", "s1")]
    rows = [(i, t if i % 9 < 2 or t is None or "\t" not in t else t.replace("\nTwo\tsites", ""), g, s) for i, t, g, s in rows]
    got = {r["doc_id"]: r for r in line_spread.remove_spread_lines(tables(rows).select("doc_id", "text", "source")).collect()}
    assert got[0]["text"] == "own 0\n\nTwo\tsites" and got[0]["n_removed_lines"] == 1 and got[5]["text"] == "own 5\n"
    assert got[50]["text"] == "only here" and got[51]["text"] is None


OPERATORS = {
    "jaccard": lambda s, d: jaccard_join.ngram_jaccard_components(d),
    "rules": lambda s, d: quality_rules.quality_rules(d),
    "lm": lambda s, d: lm_scoring.score_texts(d),
    "leaks": lambda s, d: decontamination.contaminated(d, s.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")),
    "crf": lambda s, d: line_crf.score_quality(d, s.createDataFrame([(6, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")),
    "license": lambda s, d: license_scan.scan_licenses(d),
    "mix": lambda s, d: mixing.taken_words(d),
    "spread": lambda s, d: line_spread.remove_spread_lines(d),
    "tokens": lambda s, d: token_blocks.token_output(s, d),
    "urls": lambda s, d: url_filter.judge_urls(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), {}),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_and_empty(spark, odd, empty, name):
    core.ship(spark)
    got = OPERATORS[name](spark, odd).collect()
    assert len(got) == (odd.count() if name != "leaks" else 0)
    assert OPERATORS[name](spark, empty).collect() == []


VALUES = {
    "jaccard": {1: (0, 1), 2: (0, 2), 3: (0, 3), None: (9, None), 4: (1, 4), 5: (1, 5), 6: (9, 6)},
    "rules": {1: (0, True, False), 2: (0, True, False), 3: (0, True, False), None: (12, False, True), 4: (30000, True, False), 5: (1, True, False), 6: (12, False, True)},
    "lm": {1: (1,), 2: (1,), 3: (1,), None: (13,), 4: (30001,), 5: (2,), 6: (13,)},
    "license": {1: (0, "", 0.0), 2: (0, "", 0.0), 3: (0, "", 0.0), None: (12, "", 0.0), 4: (30000, "", 0.0), 5: (1, "", 0.0), 6: (12, "", 0.0)},
    "mix": {1: (0, 0), 2: (0, 0), 3: (0, 0), None: (12, None), 4: (30000, None), 5: (1, None), 6: (12, None)},
    "spread": {1: (None, 1, 0), 2: ("", 1, 0), 3: (" \t\n ", 2, 0), 6: ("same text of a few more words than ten in one line", 1, 0)},
    "tokens": {1: (1,), 2: (1,), 3: (1,)},
    "urls": {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 4: ("", "", None, "allow")},
    "crf": {1: (0.5, 1), 2: (0.5, 1), 3: (0.5, 1)},
}
FIELDS = {
    "jaccard": ("n_shingles", "component_id"), "rules": ("n_words", "base_failed", "kept"), "lm": ("n_tokens",), "license": ("n_words", "labels", "score"), "mix": ("size", "taken"),
    "spread": ("text", "n_lines", "n_removed_lines"), "tokens": ("n_tokens",), "urls": ("host", "path", "rule", "verdict"), "crf": ("score", "predicted"),
}


@pytest.mark.parametrize("name", sorted(VALUES))
def test_odd_values(spark, odd, name):
    """What each operator gives for null, empty, very long and repeated texts; None: any value."""
    core.ship(spark)
    rows = collections.defaultdict(list)
    for r in OPERATORS[name](spark, odd).collect():
        rows[r["page_id" if name == "urls" else "doc_id"]].append(r)
    for i, want in VALUES[name].items():
        assert len(rows[i]) == (2 if i == 6 else 1)
        for r in rows[i]:
            got = tuple(r[f] for f in FIELDS[name])
            loose = name in ("mix",)
            assert all((loose and w is None) or g == w for g, w in zip(got, want, strict=True)), (i, got, want)


@pytest.mark.parametrize(("name", "low"), [("op3_quality_rules", True), ("op3_quality_rules", False), ("op8_ngram_jaccard_join", False), ("op9_line_spread", False)])
def test_sql(spark, name, low):
    """The queries against their SQL; op3 also with limits so low that lines go in a small table."""
    import duckdb

    from pagepress.llm.queries import SQL

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    df = quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), min_docs=2, share=0.01) if low else QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(cols).collect())))
    assert got == sorted(map(str, con.execute(f"SELECT {', '.join(cols)} FROM ({quality_rules.rules_sql(2, 0.01) if low else SQL[name]})").fetchall()))
    assert not low or df.where("n_removed_lines > 0").count() > 5
