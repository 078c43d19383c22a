"""Filters, reports and checks of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import MAX_AUDIO_S, ROW, SAMPLE_RATE
from corpusloom.functions.text import is_garbage
from corpusloom.operators.ranking import with_position


def head(df: DataFrame, n: int, order: str = ROW) -> DataFrame:
    """The first ``n`` rows in manifest order; all rows for 0 or less."""
    return with_position(df, order=order).filter(F.col("_position") < n).drop("_position") if n > 0 else df


def existing(df: DataFrame, files: DataFrame, path: str = "path", n: int | None = None) -> DataFrame:
    """Rows whose ``path`` is in ``files``; optionally the first ``n`` of them in manifest order."""
    kept = df.join(files.select(F.col(path)), path, "left_semi").select(*df.columns)
    return kept if n is None else head(kept, n) if n > 0 else kept.limit(0)


def missing(df: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose ``path`` is not in ``files``; a null path is missing."""
    return df.join(files.select(F.col(path)), path, "left_anti").select(*df.columns)


def duration_mismatch(measured: Column, begin: Column, end: Column, tolerance: float = 0.01) -> Column:
    """Whether audio is longer than its segment says by more than the tolerance."""
    return F.coalesce((measured - (end - begin)) > tolerance, F.lit(False))


def without_garbage(df: DataFrame, text: str, n: int = -1) -> DataFrame:
    """Rows without a garbage tag in ``text``, null texts among them; ``n`` > 0 keeps the first of the kept rows."""
    kept = df.filter(~F.coalesce(is_garbage(F.col(text)), F.lit(False)))
    return head(kept, n)


def repeats(labels: Column) -> Column:
    """The number of labels that equal their predecessor."""
    return F.size(F.filter(F.transform(labels, lambda x, i: (i > 0) & x.eqNullSafe(F.get(labels, i - 1))), lambda same: same))


def ctc_feasible(labels: Column, frames: Column) -> Column:
    """Whether the labels, with a blank between equal neighbours, fit the frames."""
    return F.size(labels) + repeats(labels) <= frames


def alignment_error(letters: Column, frames: Column, samples: Column) -> Column:
    """Why a row cannot be aligned or encoded; null where it can."""
    return (
        F.when(letters.isNull() | (F.size(letters) == 0), "no tokens")
        .when(F.coalesce(samples, F.lit(0)) > MAX_AUDIO_S * SAMPLE_RATE, "audio too long")
        .when(~ctc_feasible(letters, frames), "more targets than frames")
    )


def quarantine(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without and with an ``error``."""
    told = df.withColumn("error", error)
    return told.filter("error is null").drop("error"), told.filter("error is not null")


def parallel(*arrays: str) -> Column:
    """Whether arrays have the same length; null arrays differ from others."""
    first = F.size(arrays[0])
    same = F.lit(True)
    for a in arrays[1:]:
        same = same & first.eqNullSafe(F.size(a))
    return same


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``, whose evaluation raises where the condition fails."""
    columns = df.columns
    return df.withColumn("_checked", F.assert_true(condition, message)).filter("_checked is null").select(*columns)


def id_sequence_differences(one: DataFrame, two: DataFrame, identifier: str = "ID") -> DataFrame:
    """(_row_idx, one, two) of the positions where the ids differ or one side ends."""
    a, b = one.select(ROW, F.col(identifier).alias("one")), two.select(ROW, F.col(identifier).alias("two"))
    return a.join(b, ROW, "full_outer").filter(~F.col("one").eqNullSafe(F.col("two"))).select(ROW, "one", "two")
