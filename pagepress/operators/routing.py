"""Which codec a resource goes to, from its name, its MIME type and its first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, extension_with_dot
from ..plans import dims


def _by_extension(ext: Column, unknown: bool) -> Column:
    out = None
    for s, xs in dims.EXTENSIONS.items():
        hit = ext.isin(*xs)
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return out.when(ext == ".unknown", 5) if unknown else out


def mapped_strategy(name: Column) -> Column:
    """The strategy that the extension is listed under; null where it is not."""
    return _by_extension(extension_with_dot(name), True)


def strategy_by_extension(name: Column) -> Column:
    return F.coalesce(mapped_strategy(name), F.lit(5))


def strategy_by_mime(mime: Column) -> Column:
    m = F.lower(mime)
    any_of = lambda *xs: m.rlike("|".join(xs))
    return F.when(mime.isNull(), 0).when(any_of("html", "css", "javascript", "text", "xml", "json"), 5).when(any_of("image"), 4).when(any_of("font", "octet-stream"), 2).otherwise(0)


def factory_type(ext: Column) -> Column:
    e = F.lower(ext)
    return F.when(e.isin(*dims.FACTORY_IMAGE), "POOLING_IMAGE").otherwise("BROTLI")


def sniff(content: Column) -> Column:
    """JPEG, PNG, GIF, WEBP or UNKNOWN, from at most the first twelve bytes."""
    h = F.hex(F.substring(content, 1, 12))
    return sniff_hex(h)


def sniff_hex(h: Column) -> Column:
    return (
        F.when(h.isNull() | (F.length(h) < 8), "UNKNOWN")
        .when(h.startswith("FFD8FF"), "JPEG")
        .when(h.startswith("89504E470D0A1A0A"), "PNG")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "GIF")
        .when(h.startswith("52494646") & (F.length(h) >= 24) & (F.substring(h, 17, 8) == "57454250"), "WEBP")
        .otherwise("UNKNOWN")
    )


def suspicious_extension(ext: Column) -> Column:
    return ext.isNull() | ~F.lower(ext).isin(*dims.SAFE_EXTENSIONS)


def dual_check(name: Column, kind: Column) -> Column:
    """The extension's strategy; but text or unknown names whose content sniffs as an image go to pooling."""
    by_name = strategy_by_extension(name)
    return F.when((by_name == 5) & suspicious_extension(extension(name)) & (kind != "UNKNOWN"), 4).otherwise(by_name)


def resource_type(name: Column, kind: Column) -> Column:
    found = _by_extension(extension_with_dot(name), False)
    return F.when(found == 5, "WEB_TEXT").when((found == 4) | (found.isNull() & (kind != "UNKNOWN")), "IMAGE").when(found == 2, "BINARY_FONT").otherwise("OTHER")


def strategy_name(strategy: Column) -> Column:
    out = F
    for i, label in dims.STRATEGIES:
        out = out.when(strategy == i, label)
    return out.otherwise("Unknown")


def codec_of_strategy(strategy: Column) -> Column:
    """The display name of a strategy's codec; null for none."""
    out = None
    for _, display, i, _ in dims.CODECS:
        out = F.when(strategy == i, display) if out is None else out.when(strategy == i, display)
    return out


def codec_by_extension(name: Column) -> Column:
    return codec_of_strategy(strategy_by_extension(name))


def codec_by_mime(mime: Column) -> Column:
    return codec_of_strategy(strategy_by_mime(mime))


def archive_strategy(codec_name: Column) -> Column:
    """The id that an archive entry carries for a codec's name; 0 for none, LZ77's for unknown ones."""
    out = F.when(codec_name.isNull(), 0)
    for _, display, i, _ in dims.CODECS:
        out = out.when(codec_name == display, i)
    return out.otherwise(dims.ARCHIVE_FALLBACK)


def route(resources: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Adds kind (sniffed), strategy_id, strategy_name and resource_type. Narrow: no shuffle, no second read of content."""
    kind = resources.withColumn("kind", sniff(F.col(content)))
    ided = kind.withColumn("strategy_id", dual_check(F.col(name), F.col("kind")))
    return ided.withColumns({"strategy_name": strategy_name(F.col("strategy_id")), "resource_type": resource_type(F.col(name), F.col("kind"))})


def size_by_type(resources: DataFrame, size: Column) -> DataFrame:
    """resource_type, files, bytes, share in percent; types without bytes are left out; in the types' order."""
    sums = resources.groupBy("resource_type").agg(F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes")).where("bytes > 0")
    total = sums.agg(F.sum("bytes").alias("total"))
    order = F.array_position(F.array(*[F.lit(x) for x in dims.RESOURCE_TYPES]), F.col("resource_type"))
    return sums.crossJoin(F.broadcast(total)).select("resource_type", "files", "bytes", F.round(F.col("bytes") * 100.0 / F.col("total"), 4).alias("share"), order.cast("long").alias("ordinal")).orderBy("ordinal")
