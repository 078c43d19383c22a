"""Speech units, frames and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.constants import DOWNSAMPLING, FRAMES_PER_SECOND, PUA_FIRST, PUA_LAST, SAMPLE_RATE, VOCABULARY_MULTIPLE


def _characters() -> Column:
    """All private-use characters in order: one literal, which the optimizer splits once for the plan."""
    return F.split(F.lit("".join(map(chr, range(PUA_FIRST, PUA_LAST + 1)))), "")


def unit_to_pua(unit: Column) -> Column:
    """One unit as a private-use character, looked up by position; units outside 0..65,533 raise, null stays null."""
    wrong = F.raise_error(F.concat(F.lit("no private-use character for unit "), unit.cast("string"))).cast("string")
    return F.coalesce(F.get(_characters(), unit), F.when(unit.isNotNull(), wrong))


def units_to_pua(units: Column) -> Column:
    """An array of units as one string of private-use characters; units outside 0..65,533 raise, null ones are left out."""
    return F.array_join(F.transform(units, unit_to_pua), "")


def pua_to_unit(text: Column) -> Column:
    """The unit of one private-use character; anything else raises."""
    good = (F.char_length(text) == 1) & F.ascii(text).between(PUA_FIRST, PUA_LAST)
    return F.when(text.isNull() | good, F.ascii(text) - PUA_FIRST).otherwise(F.raise_error(F.concat(F.lit("not one unit character: "), text)).cast("int"))


def extra_id(number: Column) -> Column:
    """The placeholder token of a number."""
    return F.format_string("<extra_id_%d>", number)


def time_to_frame(seconds: Column) -> Column:
    return (seconds * FRAMES_PER_SECOND).cast("int")


def frame_slice(start: Column, end: Column, rate: int = SAMPLE_RATE, ratio: int = DOWNSAMPLING) -> tuple[Column, Column]:
    """First frame and the frame after the last of a time span."""
    return ((start * rate) / ratio).cast("int"), F.ceil((end * rate) / ratio).cast("int")


def frame_stride_ms(samples: Column, frames: Column, rate: int = SAMPLE_RATE) -> Column:
    return samples * 1000 / frames / rate


def without_repeats(values: Column) -> Column:
    """Equal neighbours once."""
    return F.filter(values, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(values, i - 1)))


def padded_vocabulary(size: Column, multiple: int = VOCABULARY_MULTIPLE) -> Column:
    """``size`` raised to a multiple; a multiple stays."""
    return size + F.pmod(multiple - F.pmod(size, F.lit(multiple)), F.lit(multiple))
