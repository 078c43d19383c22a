"""Arrays of arrays and batches of waveforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.lists import unflatten


def padded(values: Column, length: Column, fill: float = 0.0) -> Column:
    """``values`` filled up to ``length``."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest((length - F.size(values)).cast("int"), F.lit(0))))


def mono(channels: Column) -> Column:
    """The mean of channels (an array of equally long arrays)."""
    first = F.get(channels, F.lit(0))
    return F.transform(first, lambda _, i: F.aggregate(channels, F.lit(0.0), lambda a, c: a + F.get(c, i)) / F.size(channels))


def truncated(values: Column, seconds: float, rate: int) -> Column:
    """At most so many seconds of samples."""
    return F.slice(values, 1, int(seconds * rate))


__all__ = ["mono", "padded", "truncated", "unflatten"]
