"""Perceptual hashes of images that are given as arrays of grey values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def average_hash(grey: Column) -> Column:
    """A string with 1 for each value above the mean, 0 for the others; empty for an image without values."""
    mean = F.try_divide(F.aggregate(grey, F.lit(0.0), lambda a, x: a + x.cast("double")), F.size(grey).cast("double"))
    return F.coalesce(F.array_join(F.transform(grey, lambda x: F.when(x.cast("double") > mean, "1").otherwise("0")), ""), F.lit(""))


def channels(size: Column, width: Column, height: Column) -> Column:
    """Channels of raw pixels; null where they don't come out even, which no decoder takes."""
    return F.when((width > 0) & (height > 0) & (size % (width * height) == 0) & (size > 0), (size / (width * height)).cast("int"))


def hash_or_empty(grey: Column, n_channels: Column) -> Column:
    """The hash, and an empty one for an image that can't be decoded."""
    return F.when(n_channels.isNull() | grey.isNull(), "").otherwise(average_hash(grey))


def hash_similarity(a: Column, b: Column) -> Column:
    """Equal places over the longer length; null for two empty hashes, so that no threshold lets them pass."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda p, q: F.when((p != "") & (p == q), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.try_divide(same.cast("double"), F.greatest(F.length(a), F.length(b)).cast("double"))


def differing(bits: int, threshold: float) -> int:
    """How many places may differ, at most, for a similarity strictly above the threshold."""
    d = 0
    while d < bits and (bits - d - 1) / bits > threshold:
        d += 1
    return d


def bands(hash_: Column, bits: int, n: int) -> Column:
    """The hash in n pieces: with at most n - 1 differing places, one piece is equal."""
    at = [k * bits // n for k in range(n + 1)]
    return F.array(*[F.struct(F.lit(k).alias("band"), F.substring(hash_, 1 + at[k], at[k + 1] - at[k]).alias("piece")) for k in range(n)])
