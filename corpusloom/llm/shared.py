"""Pieces that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal digits of other scripts that speaker ids are written with, and the ASCII digits they stand for (fixed values).
OTHER_DIGITS = "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९"
ASCII_DIGITS = "0123456789" * 4


def unit_hash(*parts: Column | str, seed: int = 0) -> Column:
    """A double in [0, 1) that depends only on ``parts`` and ``seed``."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


def first_number(text: Column) -> Column:
    """The first run of decimal digits in ``text`` as bigint; null without one or beyond 18 digits."""
    digits = F.regexp_extract(F.translate(text, OTHER_DIGITS, ASCII_DIGITS), "([0-9]+)", 1)
    return F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 18, digits.try_cast("bigint"))


def id_speaker(identifier: Column) -> Column:
    """The number before the first underscore of an utterance id; null where there is none."""
    return F.when(identifier.contains("_"), first_number(F.substring_index(identifier, "_", 1)))


def id_book(identifier: Column) -> Column:
    """The middle part of an utterance id; null where there is none."""
    parts = F.split(identifier, "_")
    return F.when(F.size(parts) >= 3, F.nullif(F.get(parts, F.lit(1)), F.lit("")))
