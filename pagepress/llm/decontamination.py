"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, units after numbers and names (capitalised words inside a sentence, not all in capitals) become typed placeholders, so a question
with other parameters has the same template.  Windows of five template words of every text are hash-joined with the
benchmark's; a window of mostly placeholders, whose template says little, is looked for by its plain words, and by its
template where another window of the item matched on the same alignment.  Where matched windows hold placeholders, the values are compared: along one alignment each of an item's
values must stand for one value of the text.  Different numbers of an item may well become equal; windows in which
different names have become one do not count.  A text holds an item if the consistent windows
cover at least half of the item's.  An item of three or four words is one window of its own length, which says more
than three literal words only if it is found whole; one or two words are no question and are never looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import ship, small, staged, table

WINDOW = 5
LITERALS = 3  # words of a window that aren't placeholders, at least
COVER = 0.5
BROADCAST_BYTES = 64 << 20
NUM, UNIT, NAME = "\x01d", "\x01u", "\x01n"
SHORT = (3, 4)  # words of items that are one window
# Units of measurement that make a slot after a number, and number words.
UNITS = (
    "km|kilometers?|kilometres?|m|meters?|metres?|cm|centimeters?|centimetres?|mm|millimeters?|millimetres?|miles?|yards?|feet|foot|ft|inch(?:es)?|"
    "kg|kilos?|kilograms?|kilogrammes?|g|grams?|grammes?|mg|milligrams?|milligrammes?|tons?|tonnes?|pounds?|lbs?|ounces?|oz|"
    "l|liters?|litres?|ml|milliliters?|millilitres?|gallons?|pints?|quarts?|tablespoons?|teaspoons?|"
    "ms|milliseconds?|s|secs?|seconds?|mins?|minutes?|h|hrs?|hours?|days?|weeks?|months?|years?|decades?|centuries|century|"
    "dollars?|euros?|cents?|yen|rupees?|francs?|usd|eur|gbp|percent|degrees?|celsius|fahrenheit|kelvins?|radians?|"
    "hz|khz|mhz|ghz|hertz|bytes?|bits?|kb|mb|gb|tb|kilobytes?|megabytes?|gigabytes?|terabytes?|"
    "w|watts?|kw|kilowatts?|kwh|volts?|amps?|amperes?|ohms?|joules?|kj|calories|kcal|newtons?|pascals?|moles?|"
    "mph|kph|kmh|km/h|m/s|knots?|rpm|acres?|hectares?"
)
ONES = "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
NUMBERS = rf"(?:(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:-(?:{ONES}))?|{ONES}|hundred|thousand|million|billion|dozen)"
PUNCTUATION = ",.;:!?\"'()[]{}"


def template(text: Column) -> Column:
    """The template words of a text with single spaces; placeholders stand in place of single words."""
    counted = F.regexp_replace(text, rf"(?i)(?<![^ (\"']){NUMBERS}(?=[ ,.;:!?)\"']|$)", NUM)
    named = F.regexp_replace(counted, r"(?<=[^.!?: ] )\p{Lu}\p{Ll}[\p{L}'-]*", NAME)
    digits = F.regexp_replace(named, r"[+\-$€£]?\d[\d.,:/%]*", NUM)
    units = F.regexp_replace(digits, rf"(?i)(?<={NUM} )(?:{UNITS})(?![\p{{L}}\p{{N}}])", UNIT)
    return F.translate(F.lower(F.when(named.contains(NUM) | text.rlike(r"\d"), units).otherwise(named)), PUNCTUATION, "")


def templated(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, raw words (lower case), template words; both arrays have the same length."""
    one = rows.select(*key, F.regexp_replace(F.trim(F.regexp_replace("text", r"[ \t\n\r\x0B\f]+", " ")), "\x01", "").alias("one"))
    return one.select(*key, F.split(F.lower("one"), " ").alias("raw"), F.split(template(F.col("one")), " ").alias("words"))


def windows(rows: DataFrame, key: list[str], k: int = WINDOW, dense: bool = True) -> DataFrame:
    """key, at (from 0), hash of each window of template words; with dense, of plain words where less than LITERALS aren't placeholders."""
    word = lambda i, j: F.get("words", i + j)
    of_template = lambda i: F.xxhash64(*[word(i, j) for j in range(k)])
    of_plain = lambda i: F.xxhash64(F.lit("\x01"), *[F.translate(F.get("raw", i + j), PUNCTUATION, "") for j in range(k)])
    many = lambda i: sum((_is_slot(word(i, j)).cast("int") for j in range(k)), F.lit(0)) > k - LITERALS
    one = (lambda i: F.when(many(i), of_plain(i)).otherwise(of_template(i))) if dense else of_template
    enough = F.when(F.size("words") >= k, F.transform(F.sequence(F.lit(0), F.size("words") - k), one))
    # The outer form: for the other one Catalyst infers a filter on the array, and works it out again in each element.
    return rows.select(*key, enough.alias("hashes")).select(*key, F.posexplode_outer("hashes").alias("at", "hash"))


def _is_slot(x: Column) -> Column:
    return x.startswith("\x01")


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, matched, item_windows, coverage): every document and item that it holds, a row for each.

    A null text or item holds nothing; items of one or two words are too short to tell and are never found; rows
    without doc_id give no row; repeated rows and repeated items count once.  Very long texts are taken whole.  Empty
    tables give no rows; other columns are ignored.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).distinct()
    bench = templated(items, ["item_id"])
    slots = lambda: F.size(F.filter(F.slice("words", F.col("at") + 1, WINDOW), _is_slot))
    sized = bench.withColumn("item_key", F.xxhash64("item_id", F.concat_ws(" ", "raw")))
    short = [k for k in SHORT if not sized.where(F.size("words") == k).isEmpty()]
    windowed = windows(sized, ["item_key"]).withColumn("k", F.lit(WINDOW))
    for k in short:
        windowed = windowed.union(windows(sized.where(F.size("words") == k), ["item_key"], k).withColumn("k", F.lit(k)))
    windowed = windowed.join(sized, "item_key")
    keyed = windowed.select("item_key", "item_id", "k", F.col("at").alias("item_at"), "hash", slots().alias("slots"), F.slice("raw", F.col("at") + 1, WINDOW).alias("item_raw"), F.slice("words", F.col("at") + 1, WINDOW).alias("item_words"))
    keyed = staged(keyed, "bench")
    dense = staged(keyed.where((F.col("k") == WINDOW) & (F.col("slots") > WINDOW - LITERALS)), "dense")
    any_dense = not dense.isEmpty()
    sizes = keyed.groupBy("item_key").agg(F.count("*").alias("item_windows"))
    few = keyed.select("item_key", "item_id", "item_at", "hash", "slots")
    few = small(few, 64, BROADCAST_BYTES)
    base = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    key = ["doc_id", "row"]
    rowed = base.withColumn("row", F.xxhash64("text"))
    ours = windows(templated(rowed, key), key, dense=any_dense)
    for k in short:
        ours = ours.union(windows(templated(rowed, key), key, k))
    # The benchmark's side is broadcast up to BROADCAST_BYTES; beyond that adaptive execution splits a hash that many texts have.
    hits = staged(ours.join(few, "hash").withColumn("shift", F.col("at") - F.col("item_at")).drop("hash").distinct(), "hits")
    group = ["doc_id", "row", "item_key", "shift"]
    if any_dense:
        # Windows of mostly placeholders where an alignment is known from others.
        lines = hits.select(*group, "item_id").distinct().join(dense.select("item_key", "item_at", "slots", "item_words"), "item_key").withColumn("at", F.col("item_at") + F.col("shift")).where("at >= 0")
        held = templated(rowed.join(small(staged(hits.select(*key).distinct(), "aligned")), key, "left_semi"), key).dropDuplicates(key)
        also = lines.join(held, key).where(F.slice("words", F.col("at") + 1, WINDOW) == F.col("item_words"))
        hits = staged(hits.unionByName(also.select(hits.columns)).distinct(), "hits")
    with_slots = hits.where("slots > 0")
    wanted = staged(with_slots.select(*key).distinct(), "slotted")
    if wanted.isEmpty():
        good = hits
    else:
        words = templated(rowed.join(small(wanted), key, "left_semi"), key).dropDuplicates(key)
        both = with_slots.join(words, key).join(keyed.select("item_key", "item_at", "item_raw", "item_words"), ["item_key", "item_at"])
        cut = F.slice("raw", F.col("at") + 1, WINDOW)
        pairs = both.select(*group, "item_at", F.explode(F.arrays_zip(F.col("item_raw").alias("theirs"), cut.alias("ours"), F.col("item_words").alias("kind"))).alias("x"))
        pairs = pairs.where(_is_slot(F.col("x.kind"))).select(*group, "item_at", F.translate("x.theirs", PUNCTUATION, "").alias("theirs"), F.translate("x.ours", PUNCTUATION, "").alias("ours"), F.col("x.kind").startswith(NAME).alias("name")).distinct()
        clash = pairs.groupBy(*group, "theirs").agg(F.count_distinct("ours").alias("n")).where("n > 1").select(*group).distinct()
        names = pairs.where("name")
        merged = names.groupBy(*group, "ours").agg(F.count_distinct("theirs").alias("n")).where("n > 1").drop("n")
        merged = names.join(merged, [*group, "ours"], "left_semi").select(*group, "item_at").distinct()
        good = hits.where("slots = 0").unionByName(with_slots.join(clash, group, "left_anti").join(merged, [*group, "item_at"], "left_anti"))
    found = good.groupBy("doc_id", "row", "item_key", "item_id").agg(F.count_distinct("item_at").alias("matched")).join(sizes, "item_key")
    found = found.withColumn("coverage", F.col("matched") / F.col("item_windows")).where(F.col("coverage") >= cover)
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("item_windows").alias("item_windows"), F.max("coverage").alias("coverage"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark item; rows without id stay.

    Null and empty texts hold nothing; all rows of an id go if one of them holds an item; an empty table stays empty; other
    columns stay, whatever their names.
    """
    ship(spark)
    bad = staged(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(small(bad), "doc_id", "left_anti").select(docs.columns)
