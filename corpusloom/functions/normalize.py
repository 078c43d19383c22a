"""Multilingual text normalization.

The steps are one table of patterns for each language, run in Arrow batches, as Unicode
compatibility normalization has no Spark expression.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.lists import each_distinct

# --- fixed values: character sets, as regular-expression ranges ---
BASIC = r".?,:!{}\"<>;"
QUOTES = "‘-‟«»‹›"
SPANISH, ARMENIAN, ARABIC, HINDI = "¡¿", "՚-՟։", "،؛؟", "।"
CHINESE = "、。〈-』（），！？：；／＿ａ-ｄ～﹏⋯‧─"
#: The punctuation list of the released corpora, one character after the other in its own order (fixed values).
LISTED = (
    "\x81\x90\x08\x8d\x94\x8f\x1a\x9d\x93\x92\ue295\uf21d\uf62d\uf173\ue514\ue293\uf523\ue233\uf50f\ue232"
    "\uea7b\uf172\ue290\uf519\ue292\ue328\ue2fa\ue234\ue043\ue040\ue2fb\ue32b\ue236\uf511\ue517\ue2fe"
    "\ue492\uf52d\ue2fc\uf521\ue516\ue041\uf529\ue2f9\ue2d9\ue32a\ue291\ue296\ue518\ue32c\ue2db\ue231"
    "\uf522\uf518\uf513\ue32d\ue32e\ue06b\uea01\ue294\ue203\uf218\ue070\ue013\ue2de\ue493\uf7e8\uf7d0"
    "\ue313\ue329\ue06d\ue003\uf50e\uf171\ue01d\u206f\u2060―־)]⌋〕】﴾&།።፥༌။/၊·‸*۔፤၏។꓾᙮꤯⵰꓿॥؞၍·†၌፣៖꤮※፦•¶၎﹖;…%"
    "・༎‡#@፡៚៕﹐༅༄．﹗﹕‰･([⌊〔【﴿_$€£~=|−≫≪+＜＞¬×→᙭°႟�⌟⌞©\u202f\u2006˜^¯ˇⁿـๆៗ々ໆーⁱ৷⅓½¼⅟⁄"
)
PUNCTUATION = BASIC + QUOTES + SPANISH + ARMENIAN + ARABIC + HINDI + CHINESE + re.escape(LISTED)
DELETED = "\u200b\u200c\u200e\u200f\u202a\u202c\u064b-\u0652\u0656\u0657"
DIGITS = "0-9০-৯០-៩०-९୦-୯۰-۹꤀-꤉０-９൦-൯၀-၉ⅰ-ⅹ\u206f"
#: Replacements for all languages, in this order; the last one also for other languages than Arabic.
MAPPING = (("&lt;", ""), ("&gt;", ""), ("&nbsp", ""), ("(\\S+)[‛’‘](\\S+)", r"\1'\2"), ("ٱ", "ا"))
#: Of each replacement the characters one of which its matches hold.
NEEDED = ("&", "&", "&", "‛’‘", "ٱ")
EXTRA_DELETED = {"mon": "\u00ad", "khk": "\u00ad", "heb": "\u05b0-\u05cf"}
EXTRA_PUNCTUATION = {"tha": "\u200d"}
WITHOUT_DIACRITICS = frozenset({"jav"})


@cache
def _steps(language: str) -> tuple:
    punctuation = re.compile(f"[{PUNCTUATION}{EXTRA_PUNCTUATION.get(language, '')}]")
    deleted = re.compile(f"[{DELETED}{EXTRA_DELETED.get(language, '')}]")
    return punctuation, deleted, tuple((re.compile(a), b) for a, b in MAPPING), re.compile(f"[{DIGITS}]+")


class _Replacements(dict):
    """For ``str.translate``: what becomes of each character, found by the patterns when it is first met."""

    def __init__(self, language: str) -> None:
        self.punctuation, self.deleted, _, _ = _steps(language)

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = 32 if self.punctuation.match(c) else None if self.deleted.match(c) else code
        return self[code]


_replacements = cache(_Replacements)


_NUMBERED, _BRACKETED = re.compile(r"\([^)]*\d[^)]*\)"), re.compile(r"\([^)]*\)")


def normalized(text: str | None, language: str = "eng", lower: bool = True, numbers: bool = True, brackets: bool = False) -> str | None:
    """``text`` normalized: see ``text_normalize``; null stays null."""
    if text is None:
        return None
    _, _, mapping, digits = _steps(language)
    text = unicodedata.normalize("NFKC", text)
    text = text.lower() if lower else text
    if "(" in text:
        text = _NUMBERED.sub(" ", text)
        if brackets:
            text = _BRACKETED.sub(" ", text)
    for (pattern, new), needed in zip(mapping, NEEDED):
        # most texts have none of the characters that a pattern needs
        if any(c in text for c in needed):
            text = pattern.sub(new, text)
    text = text.translate(_replacements(language))
    if numbers:
        # a number goes where white space is on one side at least: all of them, but for a text that is nothing else
        parts = re.split(r"(\s+)", text)
        if len(parts) > 1:
            text = "".join(" " if p and digits.fullmatch(p) else p for p in parts)
    if language in WITHOUT_DIACRITICS:
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return " ".join(text.split())


def _escaped(characters: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in characters)


def _ascii_text(text: Column, language: str, lower: bool, numbers: bool, brackets: bool) -> Column:
    """The same steps on ASCII text as Spark's own expressions: composition and the other scripts' characters play no part."""
    punctuation, deleted, mapping, digits = _steps(language)
    plain = [chr(c) for c in range(128)]
    space = r"[\t-\r\x{1c}-\x{1f} ]"
    text = F.regexp_replace(F.lower(text) if lower else text, r"\([^)]*[0-9][^)]*\)", " ")
    if brackets:
        text = F.regexp_replace(text, r"\([^)]*\)", " ")
    for pattern, new in mapping:
        if pattern.pattern.isascii():
            text = F.regexp_replace(text, pattern.pattern, new)
    text = F.regexp_replace(text, "[" + _escaped("".join(filter(punctuation.match, plain))) + "]", " ")
    if gone := "".join(filter(deleted.match, plain)):
        text = F.regexp_replace(text, f"[{_escaped(gone)}]", "")
    words = F.split(text, space + "+")
    number = "^[" + _escaped("".join(filter(digits.fullmatch, plain))) + "]+$"
    kept = F.filter(words, lambda w: (w != "") & ~w.rlike(number)) if numbers else F.filter(words, lambda w: w != "")
    # a text without white space is kept even if it is a number
    return F.when(F.size(words) > 1, F.array_join(kept, " ")).otherwise(F.array_join(words, " "))


def text_normalize(text: Column, language: str = "eng", lower: bool = True, numbers: bool = True, brackets: bool = False) -> Column:
    """Normalized text.

    Compatibility forms, lower case, brackets with digits out, mappings, punctuation to spaces,
    deletions, words of digits out (``numbers``; a text that is only a number stays), single spaces.
    ASCII texts never leave the JVM; only the others are sent to Python, which has the Unicode forms.
    """

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([normalized(t, language, lower, numbers, brackets) for t in values.to_pylist()], pa.string())

    plain = F.octet_length(text) == F.char_length(text)
    return F.coalesce(F.when(plain, _ascii_text(text, language, lower, numbers, brackets)), run(F.when(~plain, text)))


@lru_cache(maxsize=500_000)
def normalized_token(token: str, language: str) -> str:
    return normalized(token, language)


def normalize_tokens(tokens: Column, language: str = "eng") -> Column:
    """Each token of an array normalized by itself; the different tokens of a batch once, and a worker keeps them."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        return each_distinct(lists, lambda t: normalized_token(t, language))

    return run(tokens)
