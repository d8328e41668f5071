"""URL filters: allow and block rules on host suffixes and path prefixes, else host word segmentation.

A unigram model of the pages' own words splits concatenated names by Viterbi; multinomial naive Bayes then scores the
words of host and path.  Its classes are learned from the urls themselves: a url that a rule fits is an example of the
rule's verdict, by the words that the rule doesn't name.  ROUNDS of expectation-maximisation then add the urls that no
rule fits, at UNRULED of a url each, shared out as the round before judged them.  SEEDS are further examples of block.

The counts of all words stay in tables; each distinct name meets those of its substrings in a join, and each url those
of its words.  Shares and log-odds are whole numbers of 1/SCALE, so sums don't depend on their order.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import batch, drop, small, staged, table

LONGEST = 24  # letters of a counted word, as _WORD has it
PRIOR, SMOOTH, UNRULED, ROUNDS = 0.3, 1.0, 0.25, 2
SCALE = 1 << 20
# The rules (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
# Words of kinds of pages that block lists usually name, as examples where no rule speaks of them.
SEEDS = ("porn", "xxx", "viagra", "poker", "roulette", "lottery", "payday loans", "warez", "torrents", "phishing", "malware")
_URL = re.compile(r"\A.*?://([^/?#]*)([^?#]*)", re.S)
_TAG, _WORD = re.compile(rb"<[^>]*>"), re.compile(rb"[a-z]{2,24}")
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    m = _URL.match(url) if url else None
    return (m[1].translate(_AZ), m[2]) if m else ("", "")


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    fits = [(host_ + path_, verdict) for verdict, host_, path_ in rules if (host == host_ or host.endswith("." + host_)) and path.startswith(path_)]
    return max(fits, key=lambda x: len(x[0])) if fits else None


def _count(batches):
    total: Counter[bytes] = Counter()
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    for b in batches:
        for text in b.column(0):
            raw = text.as_buffer()
            if raw is not None:
                total.update(_WORD.findall(_TAG.sub(b" ", raw.to_pybytes()).lower()))
        if len(total) > 500_000:
            yield batch(schema, word=[w.decode() for w in total], n=list(total.values()))
            total.clear()
    if total:
        yield batch(schema, word=[w.decode() for w in total], n=list(total.values()))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): counts of all words of a column of texts, as a staged table."""
    return staged(texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


class HostModel:
    """counts: of the words that names can hold; total and usual (the median) are of all words, by default of counts."""

    def __init__(self, counts: dict[str, int], seeds=SEEDS, total: int | None = None, usual: int | None = None):
        self.counts = counts
        # A seed's word is taken for as usual as the lexicon's median, so that concatenations of them come apart.
        if usual is None:
            usual = sorted(counts.values())[len(counts) // 2] if counts else 1
        self.raised = {w: max(usual, counts.get(w, 0)) for name in seeds for w in name.split() if len(w) > 1}
        self.total = ((sum(counts.values()) if total is None else total) + sum(n - counts.get(w, 0) for w, n in self.raised.items())) or 1

    def unknown(self, n: int) -> float:
        return log(10 / self.total) - n * log(10)

    def split(self, name: str, found: dict[str, int] | None = None) -> tuple[str, ...]:
        """The most likely words of a run of letters, by Viterbi over its prefixes; found: counts besides the model's."""
        words = {**(self.counts if found is None else found), **self.raised}
        best, back = [0.0] + [float("-inf")] * len(name), [0] * (len(name) + 1)
        for j in range(1, len(name) + 1):
            for i in range(max(0, j - LONGEST), j):
                n = words.get(name[i:j])
                s = best[i] + (log(n / self.total) if n else self.unknown(j - i))
                if s > best[j]:
                    best[j], back[j] = s, i
        out, j = [], len(name)
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        return tuple(out[::-1])


def word_odds(block: Column, allow: Column, blocks: int, allows: int) -> Column:
    """Log-odds of a word, in 1/SCALE, from its counts and its classes' totals; the larger class is brought to the other's
    total, so a word that neither class knows tells nothing."""
    least = min(blocks, allows)
    part = lambda n, total: F.log(n * F.lit(least / total if total else 0.0) / SCALE + F.lit(SMOOTH))
    return F.round((part(block, blocks) - part(allow, allows)) * SCALE).cast("long")


def runs(host: str, path: str, rule: tuple[str, str] | None = None) -> list[tuple[str, bool]]:
    """The runs of letters of host and path, and whether the rule (host, path) that fits doesn't name them."""
    suffix, prefix = rule or ("", "")
    edge = len(host) - len(suffix)
    return [(m[0], m.start() < edge) for m in re.finditer("[a-z]+", host)] + [(m[0], m.start() >= len(prefix)) for m in re.finditer("[a-z]+", path.translate(_AZ))]


_RUN = pa.struct([("name", pa.string()), ("own", pa.bool_())])
_URLS = pa.schema([("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("ruled", pa.string()), ("names", pa.list_(_RUN))])
_SUBS = pa.schema([("id", pa.int64()), ("word", pa.string())])
_SPLIT = pa.schema([("name", pa.string()), ("words", pa.list_(pa.string()))])


def _parse(rules):
    sides = {host + path: (host, path) for _, host, path in rules}

    def run(batches):
        for b in batches:
            got = []
            for u in b.column(0).to_pylist():
                host, path = parts(u)
                rule, verdict = rule_for(host, path, rules) or (None, None)
                got.append((u, host, path, rule, verdict, [{"name": n, "own": own} for n, own in runs(host, path, sides.get(rule))]))
            yield batch(_URLS, **{f.name: [r[k] for r in got] for k, f in enumerate(_URLS)})

    return run


def _substrings(batches):
    for b in batches:
        for i, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for k in range(0, len(name), 1000):  # bounds the set, for very long runs
                subs = sorted({name[a:z] for a in range(k, min(k + 1000, len(name))) for z in range(a + 2, min(a + LONGEST, len(name)) + 1)})
                yield batch(_SUBS, id=[i] * len(subs), word=subs)


def _segment(model: HostModel):
    def run(batches):
        for b in batches:
            got = [(name, model.split(name, {x["word"]: x["n"] for x in found or ()})) for name, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield batch(_SPLIT, name=[n for n, _ in got], words=[list(w) for _, w in got])

    return run


def segmented(urls: DataFrame, counts: DataFrame, seeds=SEEDS) -> DataFrame:
    """Adds words, those of host and path in order, and own, those that the url's rule doesn't name."""
    by = counts.groupBy("n").agg(F.count("*").alias("words"))  # a row for each count that occurs
    total = by.agg(F.sum(F.col("n") * F.col("words")).alias("n"), F.sum("words").alias("words")).first()
    below = F.sum("words").over(Window.orderBy("n"))
    usual = by.withColumn("below", below).where(F.col("below") > (total["words"] or 0) // 2).agg(F.min("n")).first()[0] or 1
    bad = sorted({w for name in seeds for w in name.split()})
    model = HostModel({r["word"]: r["n"] for r in counts.where(F.col("word").isin(bad)).collect()}, seeds, int(total["n"] or 0), usual)
    names = staged(urls.select(F.explode("names.name").alias("name")).distinct().select(F.xxhash64("name").alias("id"), "name"), "names")
    subs = names.mapInArrow(_substrings, "id long, word string")
    found = subs.join(counts, "word").groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    cut = staged(names.join(found, "id", "left").select("name", "found").mapInArrow(_segment(model), "name string, words array<string>"), "split")
    drop(names)
    met = urls.select("url", F.posexplode("names").alias("at", "x")).select("url", "at", "x.*").join(small(cut, 128), "name")
    met = met.groupBy("url").agg(F.sort_array(F.collect_list(F.struct("at", "words", "own"))).alias("parts"))
    none = F.expr("cast(array() as array<string>)")
    words = lambda own: F.flatten(F.transform(F.filter("parts", lambda x: x["own"]) if own else "parts", lambda x: x["words"]))
    return staged(urls.join(met, "url", "left").select("url", "host", "path", "rule", "ruled", F.coalesce(words(False), none).alias("words"), F.coalesce(words(True), none).alias("own")), "segmented")


def learned(shared: DataFrame, seeds=SEEDS) -> tuple[DataFrame, int, int]:
    """(word, block, allow) and the classes' totals; shared: own, and the shares block and allow of each url."""
    spark = shared.sparkSession
    rows = shared.where("block + allow > 0").select(F.explode("own").alias("word"), "block", "allow")
    first = spark.createDataFrame([(w, SCALE, 0) for name in seeds for w in name.split()], "word string, block long, allow long")
    counts = staged(rows.union(first).groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "classes")
    total = counts.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    return counts, int(total["block"] or 0), int(total["allow"] or 0)


def scored(urls: DataFrame, classes: tuple[DataFrame, int, int]) -> DataFrame:
    """Adds odds, in 1/SCALE, to urls with words."""
    counts, blocks, allows = classes
    words = counts.select("word", word_odds(F.col("block"), F.col("allow"), blocks, allows).alias("odds"))
    sums = urls.select("url", F.explode("words").alias("word")).join(small(staged(words, "odds")), "word").groupBy("url").agg(F.sum("odds").alias("odds"))
    drop(counts)
    prior = round(log(PRIOR / (1 - PRIOR)) * SCALE)
    return staged(urls.drop("odds").join(sums, "url", "left").withColumn("odds", F.coalesce("odds", F.lit(0)) + prior), "scored")


def chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds / SCALE))))


def judge_urls(pages: DataFrame, counts: DataFrame | dict[str, int], rules=RULES, seeds=SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, tokens, block_probability for every row of pages.

    A null url, or one without ://, has an empty host and path, fits no rule and is judged by the prior (allow); a null
    page_id stays; repeated rows are judged alike and learned from once; very long hosts and paths are split whole; an
    empty lexicon leaves names whole; without urls that a rule fits the seeds alone are known.  An empty table gives no
    rows.  Other columns are ignored.
    """
    if isinstance(counts, dict):
        counts = pages.sparkSession.createDataFrame(list(counts.items()), "word string, n long")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"))
    parsed = base.select("url").distinct().mapInArrow(_parse(rules), "url string, host string, path string, rule string, ruled string, names array<struct<name:string,own:boolean>>")
    urls = segmented(staged(parsed, "urls"), counts, seeds)
    ruled = {v: F.when(F.col("ruled") == v, F.lit(SCALE)).otherwise(0).cast("long") for v in ("block", "allow")}
    now = scored(urls, learned(urls.withColumns(ruled), seeds))
    for _ in range(rounds):
        guess = F.round(chance(F.col("odds")) * (UNRULED * SCALE)).cast("long")
        open_ = {"block": guess, "allow": F.lit(round(UNRULED * SCALE)) - guess}
        last, now = now, scored(now, learned(now.withColumns({v: F.when(F.col("ruled").isNull(), open_[v]).otherwise(ruled[v]) for v in open_}), seeds))
        drop(last)
    verdict = F.coalesce("ruled", F.when(F.col("odds") > 0, "block").otherwise("allow"))
    judged = now.select("url", "host", "path", "rule", verdict.alias("verdict"), F.array_join("words", " ").alias("tokens"), chance(F.col("odds")).alias("block_probability"))
    return base.join(judged, "url").select("page_id", "host", "path", "rule", "verdict", "tokens", "block_probability")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, word_counts(pages.select(F.col("html").cast("string").alias("html"))))
