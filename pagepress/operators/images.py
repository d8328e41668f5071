"""Mean pooling and nearest-neighbour upscaling of pixel rows (image, x, y, one column for each channel)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_pool(pixels: DataFrame, sizes: DataFrame, window: int, channels: Sequence[str] = ("r", "g", "b"), key: str = "image") -> DataFrame:
    """Means (truncated) of window x window squares; what is left at the right and below is dropped.

    sizes has key, w, h. The output is floor(w/window) x floor(h/window), one at least; a window of 1 changes nothing.
    """
    if window <= 1:
        return pixels.select(key, "x", "y", *channels)
    p = F.lit(window)
    on = pixels.join(sizes.select(key, "w", "h"), key)
    ow, oh = F.greatest(F.floor(F.col("w") / p), F.lit(1)), F.greatest(F.floor(F.col("h") / p), F.lit(1))
    inside = on.where((F.col("x") < ow * p) & (F.col("y") < oh * p))
    groups = inside.groupBy(key, F.floor(F.col("x") / p).cast("int").alias("x"), F.floor(F.col("y") / p).cast("int").alias("y"))
    return groups.agg(*[F.floor(F.sum(c) / F.count("*")).cast("int").alias(c) for c in channels])


def upscale(pixels: DataFrame, sizes: DataFrame, channels: Sequence[str] = ("r", "g", "b"), key: str = "image") -> DataFrame:
    """Every pixel of the target size from the nearest source pixel. sizes has key, w, h (source), tw, th (target)."""
    rows = sizes.select("*", F.explode(F.sequence(F.lit(0), F.col("th") - 1)).alias("ty")).select("*", F.explode(F.sequence(F.lit(0), F.col("tw") - 1)).alias("tx"))
    nearest = lambda t, n, tn: F.least(F.floor(F.col(t) * F.col(n) / F.col(tn)), F.col(n) - 1).cast("int")
    at = rows.select(key, "tx", "ty", nearest("tx", "w", "tw").alias("x"), nearest("ty", "h", "th").alias("y"))
    return at.join(pixels, [key, "x", "y"]).select(key, F.col("tx").cast("int").alias("x"), F.col("ty").cast("int").alias("y"), *channels)
