"""Romanization of any script.

A text is a row of positions; each rule that matches somewhere is an edge over the positions it
covers, and the reading goes from left to right along the longest edge. The built-in rules come
from the Unicode character names; rule files in ``::s source ::t target`` lines may add others or
replace them. Which rule wins where several cover the same stretch is fixed: more restrictions
first, then rules before decompositions, then the order of insertion.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.lists import each_distinct

# --- fixed values: sounds of letter names ---
CYRILLIC = {
    "A": "a", "BE": "b", "VE": "v", "GHE": "g", "GHE WITH UPTURN": "g", "DE": "d", "DJE": "dj", "GJE": "gj", "IE": "e", "IO": "yo", "UKRAINIAN IE": "ye", "ZHE": "zh", "ZE": "z", "DZE": "dz", "I": "i", "SHORT I": "y", "BYELORUSSIAN-UKRAINIAN I": "i", "YI": "yi", "JE": "j", "KA": "k", "KJE": "kj", "EL": "l", "LJE": "lj", "EM": "m", "EN": "n", "NJE": "nj", "O": "o", "PE": "p", "ER": "r", "ES": "s", "TE": "t", "TSHE": "ch", "U": "u", "SHORT U": "w", "EF": "f", "HA": "kh", "TSE": "ts", "CHE": "ch", "DZHE": "dzh", "SHA": "sh", "SHCHA": "shch", "HARD SIGN": "", "YERU": "y", "SOFT SIGN": "", "E": "e", "YU": "yu", "YA": "ya",
}
GREEK = {
    "ALPHA": "a", "BETA": "b", "GAMMA": "g", "DELTA": "d", "EPSILON": "e", "ZETA": "z", "ETA": "e", "THETA": "th", "IOTA": "i", "KAPPA": "k", "LAMDA": "l", "MU": "m", "NU": "n", "XI": "x", "OMICRON": "o", "PI": "p", "RHO": "r", "SIGMA": "s", "FINAL SIGMA": "s", "TAU": "t", "UPSILON": "y", "PHI": "ph", "CHI": "ch", "PSI": "ps", "OMEGA": "o",
}
HEBREW = {
    "ALEF": "", "BET": "b", "GIMEL": "g", "DALET": "d", "HE": "h", "VAV": "v", "ZAYIN": "z", "HET": "ch", "TET": "t", "YOD": "y", "FINAL KAF": "k", "KAF": "k", "LAMED": "l", "FINAL MEM": "m", "MEM": "m", "FINAL NUN": "n", "NUN": "n", "SAMEKH": "s", "AYIN": "", "FINAL PE": "p", "PE": "p", "FINAL TSADI": "ts", "TSADI": "ts", "QOF": "q", "RESH": "r", "SHIN": "sh", "TAV": "t",
}
ARABIC = {
    "HAMZA": "'", "ALEF": "a", "BEH": "b", "PEH": "p", "TEH": "t", "TEH MARBUTA": "h", "THEH": "th", "JEEM": "j", "TCHEH": "ch", "HAH": "h", "KHAH": "kh", "DAL": "d", "THAL": "th", "REH": "r", "ZAIN": "z", "JEH": "zh", "SEEN": "s", "SHEEN": "sh", "SAD": "s", "DAD": "d", "TAH": "t", "ZAH": "z", "AIN": "'", "GHAIN": "gh", "FEH": "f", "QAF": "q", "KAF": "k", "KEHEH": "k", "GAF": "g", "LAM": "l", "MEEM": "m", "NOON": "n", "HEH": "h", "WAW": "w", "YEH": "y", "ALEF MAKSURA": "a", "FARSI YEH": "y",
}
HANGUL_LEADS = "g kk n d tt r m b pp s ss - j jj c k t p h".split()
HANGUL_VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u weo we wi yu eu yi i".split()
HANGUL_TAILS = "- g kk gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j c k t p h".split()
LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h", "ŋ": "ng"}
GEORGIAN = {
    "AN": "a", "BAN": "b", "GAN": "g", "DON": "d", "EN": "e", "VIN": "v", "ZEN": "z", "TAN": "t", "IN": "i", "KAN": "k", "LAS": "l", "MAN": "m", "NAR": "n", "ON": "o", "PAR": "p", "ZHAR": "zh", "RAE": "r", "SAN": "s", "TAR": "t", "UN": "u", "PHAR": "p", "KHAR": "k", "GHAN": "gh", "QAR": "q", "SHIN": "sh", "CHIN": "ch", "CAN": "ts", "JIL": "dz", "CIL": "ts", "CHAR": "ch", "XAN": "kh", "JHAN": "j", "HAE": "h",
}
ARMENIAN = {
    "AYB": "a", "BEN": "b", "GIM": "g", "DA": "d", "ECH": "e", "ZA": "z", "EH": "e", "ET": "e", "TO": "t", "ZHE": "zh", "INI": "i", "LIWN": "l", "XEH": "kh", "CA": "ts", "KEN": "k", "HO": "h", "JA": "dz", "GHAD": "gh", "CHEH": "ch", "MEN": "m", "YI": "y", "NOW": "n", "SHA": "sh", "VO": "o", "CHA": "ch", "PEH": "p", "JHEH": "j", "RA": "r", "SEH": "s", "VEW": "v", "TIWN": "t", "REH": "r", "CO": "ts", "YIWN": "w", "PIWR": "p", "KEH": "k", "OH": "o", "FEH": "f",
}
COPTIC = {"ALFA": "a", "VIDA": "b", "GAMMA": "g", "DALDA": "d", "EIE": "e", "ZATA": "z", "HATE": "e", "THETHE": "th", "IAUDA": "i", "KAPA": "k", "LAULA": "l", "MI": "m", "NI": "n", "KSI": "x", "O": "o", "PI": "p", "RO": "r", "SIMA": "s", "TAU": "t", "UA": "u", "FI": "ph", "KHI": "kh", "PSI": "ps", "OOU": "o", "SHEI": "sh", "FEI": "f", "KHEI": "kh", "HORI": "h", "GANGIA": "j", "SHIMA": "ch", "DEI": "ti"}
#: The letters of Braille by their dots.
BRAILLE = {
    "1": "a", "12": "b", "14": "c", "145": "d", "15": "e", "124": "f", "1245": "g", "125": "h", "24": "i", "245": "j", "13": "k", "123": "l", "134": "m", "1345": "n", "135": "o", "1234": "p", "12345": "q", "1235": "r", "234": "s", "2345": "t", "136": "u", "1236": "v", "2456": "w", "1346": "x", "13456": "y", "1356": "z",
}
#: Kana whose sound is not that of their name.
KANA = {"SI": "shi", "TI": "chi", "TU": "tsu", "HU": "fu", "ZI": "ji", "DI": "ji", "DU": "zu"}
#: Sinhala vowel signs, and Thaana ones.
SINHALA_SIGNS = {"AELA-PILLA": "aa", "KETTI AEDA-PILLA": "ae", "DIGA AEDA-PILLA": "aae", "KETTI IS-PILLA": "i", "DIGA IS-PILLA": "ii", "KETTI PAA-PILLA": "u", "DIGA PAA-PILLA": "uu", "KOMBUVA": "e", "DIGA KOMBUVA": "ee", "KOMBU DEKA": "ai", "KOMBUVA HAA AELA-PILLA": "o", "KOMBUVA HAA DIGA AELA-PILLA": "oo", "KOMBUVA HAA GAYANUKITTA": "au"}
THAANA = {"ABAFILI": "a", "AABAAFILI": "aa", "IBIFILI": "i", "EEBEEFILI": "ee", "UBUFILI": "u", "OOBOOFILI": "oo", "EBEFILI": "e", "EYBEYFILI": "ey", "OBOFILI": "o", "OABOAFILI": "oa", "SUKUN": ""}
#: Letters that sound different in one language.
OWN = {("ukr", "и"): "y", ("ukr", "И"): "Y", ("ukr", "г"): "h", ("ukr", "Г"): "H"}
BRAILLE_CAPITAL, GRAVE = "\u2820", "\u0300"
#: Vowels that are written before the consonant they are spoken after (Thai and Lao).
WRITTEN_BEFORE = "\u0e40\u0e41\u0e42\u0e43\u0e44\u0ec0\u0ec1\u0ec2\u0ec3\u0ec4"
O_ANG = "\u0e2d"
THAI_VOWELS = {"A": "a", "AA": "aa", "AM": "am", "I": "i", "II": "ii", "UE": "ue", "UEE": "uee", "U": "u", "UU": "uu", "E": "e", "AE": "ae", "O": "o", "AI MAIMUAN": "ai", "AI MAIMALAI": "ai", "EI": "e", "Y": "ue", "YY": "uee", "AY": "ai", "MAI KAN": "a", "MAI KON": "o", "AI": "ai"}
#: Scripts whose consonants have a vowel of their own, by the first word of their characters' names.
ABUGIDAS = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "MYANMAR", "KHMER", "TIBETAN", "JAVANESE", "BALINESE", "NEWA", "SAURASHTRA", "TAGALOG", "LIMBU", "LEPCHA")
VIRAMAS = ("SIGN VIRAMA", "SIGN AL-LAKUNA", "SIGN COENG", "SIGN ASAT", "PANGKON", "ADEG ADEG", "SIGN HALANTA")
#: Rule lines beyond this number are not sent to the workers.
MAX_RULES = 2_000_000
#: Words that a task keeps with their reading.
KNOWN = 200_000
#: Decompositions that change more than the shape and are not followed.
NOT_FOLLOWED = ("<super>", "<sub>", "<noBreak>", "<compat>")
KEEP_FINAL_A = frozenset({"san"})


@dataclass
class Rule:
    """What a stretch of text sounds like, and where the rule holds."""

    target: str
    languages: frozenset = frozenset()
    at_start: bool = False
    at_end: bool = False
    not_at_start: bool = False
    not_at_end: bool = False
    whole_word: bool = False
    order: int = 0

    @property
    def restrictions(self) -> int:
        return bool(self.languages) + self.at_start + self.at_end + self.not_at_start + self.not_at_end + self.whole_word


@dataclass
class Edge:
    start: int
    end: int
    text: str
    kind: str = "rom"
    order: int = 0

    def as_list(self) -> list:
        return [self.start, self.end, self.text, self.kind]


@cache
def letter_sound(c: str) -> str | None:
    """What the name of a letter tells about its sound; null for letters the rules don't cover."""
    name = unicodedata.name(c, "")
    for script, table in (("CYRILLIC", CYRILLIC), ("GREEK", GREEK), ("HEBREW", HEBREW), ("ARABIC", ARABIC), ("GEORGIAN", GEORGIAN), ("ARMENIAN", ARMENIAN), ("COPTIC", COPTIC)):
        if name.startswith(script) and " LETTER " in name:
            base = name.split(" LETTER ", 1)[1]
            sound = table.get(base, table.get(re.sub(r" WITH .*", "", base)))
            if sound is not None:
                return sound.capitalize() if " CAPITAL " in name else sound
    if c.lower() in LATIN:
        return LATIN[c.lower()] if c.islower() else LATIN[c.lower()].capitalize()
    if name.startswith(("HIRAGANA LETTER ", "KATAKANA LETTER ")):
        base = re.sub(r"^SMALL ", "", name.split(" LETTER ", 1)[1])
        return KANA.get(base, base.lower())
    if name.startswith(("THAI CHARACTER ", "LAO LETTER ", "LAO VOWEL SIGN ")):
        return _thai_sound(re.sub(r"^(?:THAI CHARACTER|LAO LETTER) ", "", name.replace("LAO VOWEL SIGN", "SARA")))
    if name.startswith("BRAILLE PATTERN DOTS-"):
        return BRAILLE.get(name.removeprefix("BRAILLE PATTERN DOTS-"))
    # syllabaries and alphabets whose names are their sounds
    if m := re.fullmatch(r"(?:ETHIOPIC SYLLABLE(?: GLOTTAL| PHARYNGEAL)?|YI SYLLABLE|VAI SYLLABLE|LINEAR B SYLLABLE B\d+|CHEROKEE (?:SMALL )?LETTER|BOPOMOFO LETTER|CANADIAN SYLLABICS) ([A-Z]+)", name):
        return m[1].lower()
    if name.startswith("THAANA "):
        return re.match(r"[^AEIOU]*", name.split(" ")[-1])[0].lower() if " LETTER " in name else THAANA.get(name.split(" ")[-1])
    return "/" if c == "\u2044" else None


def _thai_sound(name: str) -> str:
    """A Thai or Lao letter by its name: consonants without the o of the name, tone and other marks silent."""
    if name.startswith("SARA "):
        return THAI_VOWELS.get(name.removeprefix("SARA "), name.split(" ")[1].lower())
    if name == "MAI HAN-AKAT":
        return "a"
    if name.startswith(("MAI", "NIKH", "YAM", "THANTH", "PAIYAN", "PHINTHU")):
        return ""
    first = name.split(" ")[0].lower()
    return first.removesuffix("o") or first


@cache
def abugida_part(c: str) -> tuple[str, str] | None:
    """('consonant' | 'vowel' | 'sign' | 'virama' | 'mark', sound) of a letter with inherent vowels."""
    name = unicodedata.name(c, "")
    script = name.split(" ")[0]
    if script not in ABUGIDAS:
        return None
    if name.endswith(VIRAMAS):
        return "virama", ""
    if script == "SINHALA" and " VOWEL SIGN " in name:
        return "sign", SINHALA_SIGNS.get(name.split(" VOWEL SIGN ")[1], "")
    if script == "SINHALA" and name.endswith("AYANNA"):
        sound = name.split(" ")[-1].removesuffix("AYANNA").lower()
        return "consonant", "sh" if sound == "s" and "DANTAJA" not in name else sound + "h" * ("MAHAAPRAANA" in name)
    if " CONSONANT SIGN MEDIAL " in name or " SUBJOINED LETTER " in name:
        return "medial", name.split(" ")[-1].lower().rstrip("a")
    if " VOWEL SIGN " in name:
        return "sign", _plain_vowel(name.split(" VOWEL SIGN ")[1])
    if name.endswith(("SIGN ANUSVARA", "SIGN ANUSVARAYA", "SIGN CANDRABINDU", "SIGN BINDI", "TIPPI")):
        return "mark", "m" if script in ("MALAYALAM", "TELUGU", "KANNADA", "TAMIL", "SINHALA") else "n"
    if name.endswith("SIGN VISARGA"):
        return "mark", "h"
    if name.endswith("SIGN NUKTA"):
        return "mark", ""
    if " LETTER " in name:
        sound = name.split(" LETTER ")[1].lower().split(" ")[-1]
        if re.fullmatch(r"[^aeiou]+[ao]", sound):
            return "consonant", {"lll": "zh"}.get(sound[:-1], sound[:-1])
        return "vowel", _plain_vowel(sound.upper())
    return None


def _plain_vowel(name: str) -> str:
    long = {"AA": "aa", "II": "ii", "UU": "uu", "EE": "ee", "OO": "oo", "VOCALIC R": "r", "VOCALIC L": "l"}
    return long.get(name, name.split(" ")[-1].lower())


def hangul(c: str) -> str | None:
    """A syllable by its place in the block: lead, vowel, tail."""
    at = ord(c) - 0xAC00
    if not 0 <= at < 11172:
        return None
    lead, vowel, tail = at // 588, at % 588 // 28, at % 28
    return "".join(p for p in (HANGUL_LEADS[lead], HANGUL_VOWELS[vowel], HANGUL_TAILS[tail]) if p != "-")


def number_value(c: str) -> str | None:
    """The value of a numeral as text."""
    value = unicodedata.numeric(c, None)
    if value is None or c.isascii():
        return None
    return str(int(value)) if value == int(value) else None


@dataclass
class Romanizer:
    """Rules, and the reading of texts under them."""

    rules: dict[str, list[Rule]] = field(default_factory=dict)
    prefixes: set[str] = field(default_factory=set)

    def load(self, lines: list[str]) -> Romanizer:
        """Adds rules in ``::s x ::t y [::lcode a,b] [::start] [::end] ...`` lines; a plain rule replaces a plain one."""
        flags = {"at-start-of-word": "at_start", "at-end-of-word": "at_end", "not-at-start-of-word": "not_at_start", "not-at-end-of-word": "not_at_end", "only-for-whole-word": "whole_word"}
        for line in lines:
            slots = dict(re.findall(r"::(\S+)(?:[ \t]+((?:(?!::).)*))?", line.split("#")[0] if line.startswith("#") else line))
            source, target = slots.get("s", "").strip().strip('"'), slots.get("t", "").strip().strip('"')
            if not source:
                continue
            where = {name: True for given, name in flags.items() if given in slots}
            rule = Rule(target, frozenset(x for x in re.split(r"[,; ]+", slots.get("lcode", "").strip()) if x), order=len(self.rules), **where)
            old = self.rules.setdefault(source, [])
            if not rule.restrictions:
                old[:] = [r for r in old if r.restrictions]
            old.append(rule)
            self.prefixes.update(source[:i] for i in range(1, len(source) + 1))
        return self

    def edges(self, text: str, language: str = "") -> list[Edge]:
        """All edges over ``text``: rules, letters, numerals, decompositions and the characters themselves."""
        out: list[Edge] = []
        word = lambda i: 0 <= i < len(text) and (text[i].isalpha() or unicodedata.combining(text[i]) > 0)
        for i, c in enumerate(text):
            if c.isascii():
                # plain letters stand for themselves, unless a rule file says otherwise
                if c not in self.prefixes:
                    out.append(Edge(i, i + 1, c))
                    continue
            end = i + 1
            while end <= len(text) and text[i:end] in self.prefixes:
                fitting = [r for r in self.rules.get(text[i:end], ()) if self._holds(r, language, word(i - 1), word(end))]
                if fitting:
                    out.append(Edge(i, end, max(fitting, key=lambda r: (r.restrictions, -r.order)).target))
                end += 1
            part = abugida_part(c)
            if part:
                out.append(Edge(i, i + 1, self._syllable(text, i, part, language)))
            elif (sound := OWN.get((language, c))) is not None or (sound := letter_sound(c)) is not None or (sound := hangul(c)) is not None:
                out.append(self._in_context(text, i, sound))
            elif (value := number_value(c)) is not None:
                out.append(Edge(i, i + 1, value, "num"))
            else:
                tag, _, rest = unicodedata.decomposition(c).partition(" ")
                if tag and tag not in NOT_FOLLOWED:
                    inner = unicodedata.normalize("NFKD", c)
                    if inner != c:
                        out.append(Edge(i, i + 1, self._apart(text, i, self.romanize(inner, language)), "rom decomp", 1))
            silent = unicodedata.category(c) in ("Mn", "Cf")
            out.append(Edge(i, i + 1, "" if silent else c, "fallback", 2))
        return out

    @staticmethod
    def _holds(rule: Rule, language: str, before: bool, after: bool) -> bool:
        if rule.languages and language not in rule.languages:
            return False
        if (rule.at_start or rule.whole_word) and before or rule.not_at_start and not before:
            return False
        return not ((rule.at_end or rule.whole_word) and after or rule.not_at_end and not after)

    @staticmethod
    def _syllable(text: str, i: int, part: tuple[str, str], language: str) -> str:
        """A consonant has its own 'a' unless a vowel sign or virama follows, or it ends a longer Devanagari word."""
        kind, sound = part
        if kind not in ("consonant", "medial"):
            return sound
        following = [abugida_part(text[j]) for j in range(i + 1, min(i + 3, len(text)))]
        if following and following[0] and following[0] == ("mark", "") and len(following) > 1:
            following = following[1:]
        after = following[0] if following else None
        if after and after[0] in ("sign", "virama", "medial"):
            return sound
        ends = after is None
        longer = i > 0 and abugida_part(text[i - 1]) is not None
        if ends and longer and unicodedata.name(text[i], "").startswith("DEVANAGARI") and language not in KEEP_FINAL_A:
            return sound
        return sound + "a"

    @staticmethod
    def _apart(text: str, i: int, sound: str) -> str:
        """A fraction keeps away from numerals next to it: 23½ becomes 23 1/2."""
        numeral = lambda k: 0 <= k < len(text) and unicodedata.numeric(text[k], None) is not None
        if not numeral(i):
            return sound
        return " " * numeral(i - 1) + sound + " " * numeral(i + 1)

    @staticmethod
    def _in_context(text: str, i: int, sound: str) -> Edge:
        """The reading of a letter among its neighbours; it may take in the sign before or after it."""
        c, last, following = text[i], text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
        name = unicodedata.name(c, "")
        consonant = sound[:1] not in ("", *"aeiou")
        if name.endswith("LETTER SMALL TU"):
            # doubles the next consonant; before ch it is t
            after = letter_sound(following) or "" if following else ""
            return Edge(i, i + 1, "t" if after.startswith("ch") else after[:1])
        if last == BRAILLE_CAPITAL and name.startswith("BRAILLE"):
            return Edge(i - 1, i + 1, sound.capitalize())
        if following == GRAVE and name.startswith("COPTIC") and consonant:
            return Edge(i, i + 2, "e" + sound)
        if last and last in WRITTEN_BEFORE and consonant:
            return Edge(i - 1, i + 1, sound + (letter_sound(last) or ""))
        if c == O_ANG:
            # silent as the bearer of a vowel, o between consonants
            beside = [letter_sound(x) if x and "\u0e01" <= x <= "\u0e2e" and x != O_ANG else "" for x in (last, following)]
            return Edge(i, i + 1, "o" if all(beside) else "")
        if len(sound) > 1 and sound[0].isupper():
            # all capitals stay so; a capital before a small letter has one capital
            if following.isupper() or last.isupper() and not following.islower():
                sound = sound.upper()
        return Edge(i, i + 1, sound)

    def path(self, text: str, language: str = "") -> list[Edge]:
        """From the left, always the longest edge; among equally long ones the least order."""
        at: dict[int, list[Edge]] = {}
        for e in self.edges(text, language):
            at.setdefault(e.start, []).append(e)
        out, i = [], 0
        while i < len(text):
            # an edge may begin before its letter, at a sign that is read with it
            best = min(at[i], key=lambda e: (-(e.end - e.start), e.order))
            if best.text == "ー" and out and out[-1].text:
                best = Edge(best.start, best.end, out[-1].text[-1])
            out.append(best)
            i = best.end
        return out

    def romanize(self, text: str, language: str = "") -> str:
        """The text in Latin letters; small ya, yu, yo join the syllable before ('ki' + 'ya' = 'kya')."""
        if text.isascii() and not self.prefixes:
            return text
        parts: list[str] = []
        for e in self.path(text, language):
            name = unicodedata.name(text[e.start], "")
            if re.search(r"LETTER SMALL Y[AUO]$", name) and parts and parts[-1].endswith("i"):
                parts[-1] = parts[-1][:-1]
                e = Edge(e.start, e.end, e.text[1:] if parts[-1].endswith(("sh", "ch", "j")) else e.text)
            parts.append(e.text)
        return "".join(parts)

    def output(self, text: str, language: str = "", form: str = "str") -> str:
        """'str', or 'edges' (the path) or 'lattice' (all edges) as JSON."""
        if form == "str":
            return self.romanize(text, language)
        edges = self.path(text, language) if form == "edges" else self.edges(text, language)
        return json.dumps([e.as_list() for e in edges], ensure_ascii=False)


def romanized_line(engine: Romanizer, line: str, language: str = "") -> str:
    """A line; ``::lcode xxx `` before it gives its language."""
    if m := re.match(r"::lcode\s+(\S+)\s+", line):
        return engine.romanize(line[m.end() :], m[1])
    return engine.romanize(line, language)


def _reader(rules: list[str], language: str) -> Callable[[str], str]:
    """Romanizes lines; the words of a line by themselves and each once, unless a rule covers a blank."""
    engine = _builtin() if not rules else Romanizer().load(rules)
    known: dict[str, str] = {}
    whole = any(" " in source for source in engine.rules)

    def word(text: str) -> str:
        found = known.get(text)
        if found is None:
            if len(known) >= KNOWN:
                known.clear()
            found = known[text] = engine.romanize(text, language)
        return found

    def line(text: str) -> str:
        if text.startswith("::lcode"):
            return romanized_line(engine, text, language)
        if text.isascii() and not rules:
            return text
        return word(text) if whole else " ".join(map(word, text.split(" ")))

    return line


@cache
def _builtin() -> Romanizer:
    return Romanizer()


def romanize(text: Column, language: str = "", rules: list[str] | None = None) -> Column:
    """The text in Latin letters; null stays null. The rules are read once for all batches of a task."""
    given = list(rules or ())

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = _reader(given, language)
        for values in batches:
            yield pa.array([None if t is None else read(t) for t in values.to_pylist()], pa.string())

    return run(text)


def romanize_tokens(tokens: Column, language: str = "", rules: list[str] | None = None) -> Column:
    """Each token of an array romanized; the different tokens of a batch are read once."""
    given = list(rules or ())

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = _reader(given, language)
        for lists in batches:
            yield each_distinct(lists, read)

    return run(tokens)


def read_rules(lines: DataFrame) -> list[str]:
    """Rule lines of a table with a ``value`` column, in order; more than ``MAX_RULES`` raise."""
    rows = lines.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return [r["value"] for r in rows]
