"""Scalar functions over columns: sizes, durations, labels, names, hashes. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """A double as SQL engines round it: times the power of ten, halves away from zero; F.round takes the shortest decimal instead."""
    return F.round(x * 10.0**digits) / 10.0**digits


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", rounded(x, digits))


def _two(x: Column) -> Column:
    return _fixed(x, 2)


def format_file_size(b: Column) -> Column:
    """n B below 1024, else KB, MB or GB with two decimals."""
    return F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1 << 20, F.concat(_two(b / 1024.0), F.lit(" KB"))).when(b < 1 << 30, F.concat(_two(b / 1048576.0), F.lit(" MB"))).otherwise(F.concat(_two(b / 1073741824.0), F.lit(" GB")))


def format_size_short(b: Column) -> Column:
    """The same, with MB as the largest unit."""
    return F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1 << 20, F.concat(_two(b / 1024.0), F.lit(" KB"))).otherwise(F.concat(_two(b / 1048576.0), F.lit(" MB")))


def format_duration(ms: Column) -> Column:
    part = lambda n, of, unit: F.concat(F.call_function("div", n.cast("long"), F.lit(of)).cast("string"), F.lit(unit))
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms")))
        .when(ms < 60_000, F.concat(_two(ms / 1000.0), F.lit(" s")))
        .when(ms < 3_600_000, F.concat(part(ms, 60_000, " min "), part(ms % 60_000, 1000, " s")))
        .otherwise(F.concat(part(ms, 3_600_000, " h "), part(ms % 3_600_000, 60_000, " min")))
    )


def format_duration_short(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).when(ms < 60_000, F.concat(_two(ms / 1000.0), F.lit(" s"))).otherwise(F.concat(_fixed(ms / 60_000.0, 1), F.lit(" min")))


def axis_label(v: Column) -> Column:
    v = v.cast("double")
    return F.when(v >= 1e6, F.concat(_fixed(v / 1e6, 1), F.lit("M"))).when(v >= 1e3, F.concat(_fixed(v / 1e3, 1), F.lit("K"))).otherwise(F.format_string("%.0f", v))


def axis_bytes_label(v: Column) -> Column:
    v = v.cast("double")
    return F.when(v >= 1e6, F.concat(_fixed(v / 1e6, 1), F.lit(" MB"))).when(v >= 1e3, F.concat(_fixed(v / 1e3, 1), F.lit(" KB"))).otherwise(F.format_string("%.0f B", v))


def tick_unit(v: Column) -> Column:
    """A fifth of the power of ten (1024 at first) that v reaches; beyond 1e8 a fifth of v."""
    out = F.when(v <= 1024, F.lit(200.0))
    for power in range(4, 9):
        out = out.when(v <= 10**power, F.lit(2.0 * 10 ** (power - 1)))
    return out.otherwise(v / 5.0)


def axis_maximum(original: Column, compressed: Column) -> Column:
    """Aggregate: 1.2 times the largest value, 1024 at least."""
    return F.greatest(F.coalesce(F.max(F.greatest(original, compressed)), F.lit(0)) * 1.2, F.lit(1024.0))


def shorten_file_name(name: Column) -> Column:
    dot = F.length(name) - F.instr(F.reverse(name), ".")
    has = F.contains(name, F.lit("."))
    base, ext = F.substring(name, F.lit(1), dot), F.substring(name, dot + 1, F.length(name))
    return F.when(name.isNull(), "").when(F.length(name) <= 15, name).when(has & (dot > 10), F.concat(F.substring(base, 1, 7), F.lit("..."), ext)).otherwise(F.concat(F.substring(name, 1, 12), F.lit("...")))


def extension_with_dot(name: Column) -> Column:
    """From the last dot on, lower case; empty without a dot."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def extension(name: Column) -> Column:
    """Without the dot, case kept; empty if the dot is the first or the last character."""
    return F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1)


def file_extension(name: Column) -> Column:
    return F.lower(extension(F.regexp_extract(name, r"([^/\\]*)$", 1)))


def extension_kept_dot(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)


def relative_path(path: Column, base: str) -> Column:
    """path below base, with forward slashes."""
    p = F.translate(path, "\\", "/")
    b = base.replace("\\", "/").rstrip("/") + "/"
    return F.when(p.startswith(b), F.substring(p, F.lit(len(b) + 1), F.length(p))).otherwise(p)


def archive_name(explicit: Column, directory: Column, file: Column, many: Column, stamp: Column) -> Column:
    base = F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")
    chosen = F.when(explicit.isNotNull() & (explicit != ""), explicit).when(directory.isNotNull(), directory).when(many, F.concat(F.lit("archive_"), stamp)).otherwise(base)
    return F.when(chosen.endswith(".wzip"), chosen).otherwise(F.concat(chosen, F.lit(".wzip")))


def md5_text(s: Column) -> Column:
    return F.md5(s.cast("binary"))


def bytes_to_hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def verify_md5(content: Column, wanted: Column) -> Column:
    return F.md5(content) == F.lower(wanted)


def ratio(original: Column, compressed: Column, of_empty: float = 0.0) -> Column:
    return F.when(original > 0, compressed / original).otherwise(F.lit(of_empty))


def savings_percent(original: Column, compressed: Column) -> Column:
    return F.when(original > 0, (1 - compressed / original) * 100).otherwise(F.lit(0.0))
