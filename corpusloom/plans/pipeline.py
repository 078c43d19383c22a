"""The canonical pipeline: romanize, align and encode, interleave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import ENDS, FRAME_MS, NORMALIZED, ROW, SPEECH_TOKENS, STARTS, TOKENIZED, UROMAN
from corpusloom.functions.normalize import normalize_tokens
from corpusloom.functions.romanize import romanize_tokens
from corpusloom.functions.text import letter_tokens, tokenize
from corpusloom.operators.align import align, merge_repeats, span_times, with_token_spans
from corpusloom.operators.cluster import assign
from corpusloom.operators.filters import alignment_error
from corpusloom.operators.joins import label_ids


def uromanize(df: DataFrame, text: str, language: str = "eng", delimiter: str | None = None, rules: list[str] | None = None) -> DataFrame:
    """``df`` with ``tokenized``, ``normalized`` and ``uroman``; a column of one of these names raises."""
    if clash := {TOKENIZED, NORMALIZED, UROMAN} & set(df.columns):
        raise ValueError(f"columns exist: {sorted(clash)}")
    out = df.withColumn(TOKENIZED, tokenize(F.col(text), delimiter))
    out = out.withColumn(NORMALIZED, normalize_tokens(F.col(TOKENIZED), language))
    return out.withColumn(UROMAN, letter_tokens(romanize_tokens(F.col(NORMALIZED), language, rules)))


def align_and_encode(df: DataFrame, emissions: DataFrame, features: DataFrame, centroids: DataFrame, dictionary: dict[str, int], stride_ms: float = FRAME_MS) -> tuple[DataFrame, DataFrame]:
    """(aligned rows, quarantined rows with their ``error``).

    ``emissions`` holds (_row_idx, emissions) log-probabilities by frame and label, ``features``
    (_row_idx, frame_idx, vec). The path of labels is found, merged and spread over the tokens; the
    frames are replaced by their nearest centroids.
    """
    names = F.create_map(*[F.lit(x) for k, v in dictionary.items() for x in (v, k)])
    letters = F.flatten(F.transform(UROMAN, lambda t: F.filter(F.split(t, " "), lambda c: c != "")))
    rows = df.join(emissions, ROW, "left").withColumn("_targets", label_ids(letters, dictionary))
    paths = align(rows.select(ROW, "emissions", "_targets"), ROW, "emissions", "_targets", dictionary["<blank>"])
    labelled = F.transform("path", lambda x: F.element_at(names, x))
    told = df.join(paths, ROW).withColumn("_segments", merge_repeats(labelled)).withColumnRenamed("error", "_path_error")
    spans = with_token_spans(told, UROMAN, "_segments")
    times = span_times(F.col("spans"), F.lit(stride_ms))
    units = assign(features.select(F.struct(ROW, "frame_idx").alias("_k"), "vec"), "_k", "vec", centroids)
    by_row = (
        units.select(F.col(f"_k.{ROW}").alias(ROW), F.struct(F.col("_k.frame_idx").alias("f"), F.col("cluster").alias("c")).alias("u"))
        .groupBy(ROW)
        .agg(F.transform(F.sort_array(F.collect_list("u")), lambda u: u["c"]).alias(SPEECH_TOKENS))
    )
    whole = spans.withColumn("_times", times).join(by_row, ROW, "left").withColumn("error", F.coalesce("_path_error", "error"))
    done = whole.withColumn(STARTS, F.transform("_times", lambda t: t["start_s"])).withColumn(ENDS, F.transform("_times", lambda t: t["end_s"]))
    keep = [*df.columns, SPEECH_TOKENS, STARTS, ENDS]
    return done.filter("error is null").select(*keep), done.filter("error is not null").select(*df.columns, "error")


class MissingModel(RuntimeError):
    """A model is needed that this installation doesn't have."""


def acoustic(df: DataFrame, provider: Callable | None, schema: str) -> DataFrame:
    """Emissions or features of audio rows by a model.

    ``provider`` maps an iterator of pandas frames like ``mapInPandas``'s functions and loads its
    model once in a worker; none is built in.
    """
    if provider is None:
        raise MissingModel("give a provider that computes emissions or features")
    return df.mapInPandas(provider, schema)


__all__ = ["MissingModel", "acoustic", "align_and_encode", "alignment_error", "uromanize"]
