"""Text interleaved with speech units.

Catalyst expressions on one row, without a shuffle; only the spans' boundaries, which depend on nothing
but a row's number of tokens, are drawn in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import ENDS, ROW, SEED, SPEECH_MARK, SPEECH_TOKENS, STARTS, TEXT_KEY, TEXT_MARK, TOKENIZED
from corpusloom.functions.lists import boundaries, span_boundaries
from corpusloom.functions.units import units_to_pua, without_repeats
from corpusloom.operators.joins import units_of_span
from corpusloom.operators.ranking import with_position


def interleave(aligned: DataFrame, marks: bool = True, dedup: bool = True, seed: int = SEED) -> DataFrame:
    """(_row_idx, text, error): spans of text and of speech in turn.

    Rows at an even place of the manifest begin with text, others with speech; where filters have left
    gaps in the numbers, the places are counted anew. ``marks`` puts the modality mark
    before each span, ``dedup`` leaves out units equal to the one before. Rows without tokens (where
    their number is odd), without speech tokens or with arrays of different lengths have an error and
    no text. Other columns are ignored.
    """
    tokens, units = F.col(TOKENIZED), F.col(SPEECH_TOKENS)
    bounds = span_boundaries(F.size(tokens), seed)
    rows = with_position(aligned.select(ROW, tokens, units, STARTS, ENDS)).withColumn("_bounds", bounds)
    even = F.pmod(F.col("_position"), F.lit(2)) == 0

    is_text = lambda i: (F.pmod(i, F.lit(2)) == 0) == even

    def part(i: Column) -> Column:
        cut = units_of_span(units, F.get(STARTS, F.get("_bounds", i)), F.get(ENDS, F.get("_bounds", i + 1) - 1))
        return F.when(is_text(i), F.array().cast("array<int>")).otherwise(cut)

    def span(p: Column, i: Column) -> Column:
        first, until = F.get("_bounds", i), F.get("_bounds", i + 1)
        words, speech = F.array_join(F.slice(tokens, first + 1, until - first), " "), units_to_pua(without_repeats(p) if dedup else p)
        if marks:
            words, speech = F.concat(F.lit(TEXT_MARK + " "), words), F.concat(F.lit(SPEECH_MARK + " "), speech)
        return F.when(is_text(i), words).otherwise(speech)

    error = (
        F.when(tokens.isNull(), "no tokens")
        .when(units.isNull(), "no speech tokens")
        .when(~((F.size(tokens) == F.size(STARTS)) & (F.size(tokens) == F.size(ENDS))) | F.col(STARTS).isNull() | F.col(ENDS).isNull(), "times differ from tokens")
        .when((F.size(tokens) == 0) & ~even, "no tokens")
    )
    # the units are cut first, so that the lambda over them sees a value and not the cutting
    spans = F.transform(F.transform(F.sequence(F.lit(0), F.size("_bounds") - 2), part), span)
    return rows.withColumn("error", error).select(ROW, F.when(F.col("error").isNull(), F.array_join(spans, " ")).alias(TEXT_KEY), "error")


__all__ = ["boundaries", "interleave", "span_boundaries"]
