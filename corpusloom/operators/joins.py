"""Joins of manifests, units and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import ENDS, ROW, SPEECH_TOKENS, STARTS
from corpusloom.functions.units import frame_slice
from corpusloom.operators.projections import select_codec_layer

#: Rows of one key that a task joins; keys with more are spread over copies.
KEY_ROWS = 500_000


def split_join(many: DataFrame, few: DataFrame, on: list[str], by: list[str], how: str = "inner", key_rows: int = KEY_ROWS, most: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``many`` joined with ``few`` on ``on``, with keys that hold very many rows of ``many`` spread over tasks.

    One pass counts the rows of each key. A key with more than ``key_rows`` of them gets that many
    times as many copies of its rows in ``few``, and the rows of ``many`` are dealt to them by a hash of
    ``by``. There are at most rows / ``key_rows`` such keys, so their list may be broadcast. Without one
    it is a plain join. ``how`` is 'inner' or 'left'; null keys meet nothing. Where no key can have more
    than ``most`` rows, the count is saved if that is little enough; where the rows of each key are
    known, ``sizes`` (``on``, ``_n``) takes its place.
    """
    if most is not None and most <= key_rows:
        return many.join(few, on, how)
    counted = (sizes or many.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))).filter(F.col("_n") > key_rows)
    counted = counted.select(*on, F.ceil(F.col("_n") / key_rows).cast("int").alias("_copies")).filter(" and ".join(f"`{c}` is not null" for c in on))
    if not (hot := counted.collect()):
        return many.join(few, on, how)
    copies = F.broadcast(many.sparkSession.createDataFrame(hot, counted.schema))
    dealt = many.join(copies, on, "left").withColumn("_copy", F.pmod(F.xxhash64(*by), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    copied = few.join(copies, on, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return dealt.join(copied, [*on, "_copy"], how).drop("_copy")


def join_codec(aligned: DataFrame, codec: DataFrame, prefix: str, layer: int) -> DataFrame:
    """The aligned rows with the speech tokens of one layer of another codec, by ID (inner).

    The layer is picked before the join, so that the others are never read; a column both sides
    have comes from the aligned side.
    """
    other = select_codec_layer(codec, prefix, layer).select("ID", SPEECH_TOKENS)
    return aligned.drop(SPEECH_TOKENS).join(other, "ID")


def zip_rows(one: DataFrame, two: DataFrame, columns: list[str]) -> DataFrame:
    """``one`` with ``columns`` of the row of ``two`` at the same position (inner)."""
    return one.join(two.select(ROW, *columns), ROW)


def audio_with_text(audio: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """Audio and transcript of the same id (inner)."""
    return audio.join(texts, key)


def units_of_span(units: Column, start: Column, end: Column) -> Column:
    """The units of a time span; what lies outside the array is cut off."""
    return units_between(units, *frame_slice(start, end))


def units_between(units: Column, first: Column, until: Column) -> Column:
    """The units from ``first`` to the one before ``until``; what lies outside the array is cut off."""
    first = F.greatest(first, F.lit(0))
    return F.slice(units, first + 1, F.greatest((until - first).cast("int"), F.lit(0)))


def token_units(aligned: DataFrame, tokens: str = "tokenized") -> DataFrame:
    """(_row_idx, position, token, units): each token with its units."""
    zipped = F.arrays_zip(F.col(tokens).alias("t"), F.col(STARTS).alias("s"), F.col(ENDS).alias("e"))
    each = aligned.select(ROW, SPEECH_TOKENS, F.posexplode(zipped).alias("position", "z"))
    return each.select(ROW, "position", F.col("z.t").alias("token"), units_of_span(F.col(SPEECH_TOKENS), F.col("z.s"), F.col("z.e")).alias("units"))


def frames_in_spans(frames: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """The same as a range join of a frame table (key, frame_idx, unit) with spans (key, first, until), whose columns stay.

    ``frames`` (key, units) has the frames of a key in one array, in order from 0. Frames get rows of their own only after the join,
    where a span cuts out those that lie in it. Neither side is sent to the driver: the optimizer takes
    arrays for short, so it would broadcast far more than it reckons with.
    """
    met = frames.filter(F.size("units") > 0).select(key, "units").hint("merge").join(spans, key)
    met = met.filter((F.col("first") < F.size("units")) & (F.col("until") > F.greatest("first", F.lit(0))))
    each = met.select(*spans.columns, F.posexplode(units_between(F.col("units"), F.col("first"), F.col("until"))).alias("_at", "unit"))
    return each.withColumn("frame_idx", F.greatest("first", F.lit(0)) + F.col("_at")).drop("_at")


def label_ids(letters: Column, dictionary: dict[str, int]) -> Column:
    """Ids of the letters, in order; letters the dictionary lacks are dropped."""
    known = F.create_map(*[F.lit(x) for kv in dictionary.items() for x in kv])
    return F.filter(F.transform(letters, lambda c: F.try_element_at(known, c)), lambda x: x.isNotNull())
