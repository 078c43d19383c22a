"""Text functions that Spark's own expressions cover."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.constants import GARBAGE_TAGS, PUNCTUATION_TAGS


def trimmed(text: Column) -> Column:
    """Without white space at the ends, in Unicode's sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokenize(text: Column, delimiter: str | None = None) -> Column:
    """Tokens of the trimmed text; without a delimiter any white space divides and no token is empty."""
    if delimiter is None:
        return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    return F.split(trimmed(text), r"\Q" + delimiter.replace(r"\E", r"\E\\E\Q") + r"\E")


def normalize_uroman(text: Column) -> Column:
    """Lower-case letters, apostrophes and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z' ]", " "), " +", " "))


def letters(token: Column) -> Column:
    """A token with a space between all of its characters."""
    return F.array_join(F.filter(F.split(trimmed(token), ""), lambda c: ~c.rlike(r"(?U)^\s*$")), " ")


def letter_tokens(tokens: Column, normalize: bool = True) -> Column:
    """Spelled-out tokens, optionally reduced to a-z and apostrophes."""
    # of a reduced token only its a-z and apostrophes are left, so nothing needs to be split
    reduced = lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z']", ""), "(?<=.)(?=.)", " ")
    return F.transform(tokens, reduced if normalize else letters)


def substitute_punctuation_tags(text: Column) -> Column:
    """Punctuation tags, with the white space before them, as their characters."""
    for tag, mark in PUNCTUATION_TAGS.items():
        text = F.regexp_replace(text, r"\s*" + tag, mark)
    return text


def is_garbage(text: Column) -> Column:
    """Whether any garbage tag occurs."""
    found = F.lit(False)
    for tag in GARBAGE_TAGS:
        found = found | text.contains(tag)
    return found


def strip_punctuation(text: Column) -> Column:
    """Lower case without ASCII punctuation."""
    return F.translate(F.lower(text), string.punctuation, "")
