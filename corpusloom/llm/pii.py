"""Problem 7: personal information inside free text.

Regular expressions propose spans, checksum validators confirm them and the words around a span
move its score; of overlapping spans the best one stays. A number whose form has check digits counts
without any word where they are right. Card and account numbers must be right; other numbers whose
check digits are wrong count only where a word names them, as people mistype and tests invent them. Matching runs on a copy of the text in
which wide forms, other digits, spaces and dashes are replaced one for one, so that offsets are
those of the text. Each text is handled by itself, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusloom.llm.bpe import spread

#: A span counts from this score on.
THRESHOLD = 0.5
#: What a valid check digit adds to the score of an identity number, and what a form that is right as a whole adds.
CHECKED, CONFIRMED = 0.15, 0.5
#: Characters before and after a span whose words count.
BEFORE, AFTER = 48, 40
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity": "[ID]", "address": "[ADDRESS]", "name": "[NAME]", "account": "[ACCOUNT]"}
#: The kinds that ``found`` gives; redaction also takes card and bank account numbers.
KINDS = ("email", "phone", "identity", "address", "name")
#: The registry of readers is fixed (400 rows); above this it would not be sent to the workers.
MAX_READERS = 100_000


def _mapping() -> dict[int, str]:
    """One-for-one replacements: wide forms, decimal digits, spaces and dashes."""
    out = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    out |= {c: str(unicodedata.decimal(chr(c))) for c in range(0x600, 0x1E960) if unicodedata.category(chr(c)) == "Nd"}
    out |= dict.fromkeys((0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000), " ")
    out |= dict.fromkeys((*range(0x2010, 0x2016), 0x2212), "-")
    return out | dict.fromkeys((0x2018, 0x2019), "'")


_MAP = {chr(c): to for c, to in _mapping().items()}


def flattened(text: str) -> str:
    """``text`` with the replacements, character for character."""
    if not text.isascii():
        for c in _MAP.keys() & set(text):
            text = text.replace(c, _MAP[c])
    return text

# --- words in several languages that the corpus desk meets (fixed values) ---
TITLES = r"Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Frau|Herrn?|Madame|Mme|Mademoiselle|Mlle|Monsieur|Señora|Señor|Señorita|Sra|Sr|Srta|Doña|Pani|Pana|Panu|Pan|señora|señor|señorita|doña|madame|monsieur|pani|pana|panu|госпожа|господин|госпожи|господина|Госпожа|Господин|Госпожи|Господина|Г-жа|Г-н|г-жа|г-н"
#: Common given names of several languages; with one of them, two capitalized words are a name without other signs.
GIVEN = frozenset(
    "james john robert michael david william richard joseph thomas charles christopher daniel matthew anthony mark steven paul andrew george edward brian kevin peter henry "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen emma olivia laura alice anna julia sophie emily eleanor margaret helen rachel rebecca claire "
    "hans klaus jürgen wolfgang lukas felix stefan andreas martin matthias uwe heike ursula sabine monika greta ingrid katharina johanna "
    "pierre jean jacques julien antoine françois michel nicolas camille chloé amélie céline élodie margaux "
    "carlos josé juan luis miguel javier antonio pedro diego maria maría lucía carmen elena isabel sofía ana marta pilar "
    "jan piotr krzysztof andrzej tomasz paweł marek agnieszka katarzyna małgorzata magdalena ewa joanna zofia "
    "иван пётр сергей алексей дмитрий андрей николай михаил владимир анна мария елена ольга наталья татьяна екатерина ирина "
    "marco giuseppe giulia francesca joão paulo ahmed mohammed fatima ali priya raj wei".split()
)
#: Second words of places and institutions that bear a given name.
NOT_PEOPLE = frozenset(
    "street road lane avenue town city county island islands station park bridge river lake bay beach hill hills press books library archive archives museum university college school hospital church cathedral palace theatre house hall hotel square market museum institute foundation society company edition series january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday north south east west railway port wing".split()
)
NOT_FAMILIES = frozenset("president präsident präsidentin présidente président presidente presidenta commissioner kommissar kommissarin chair speaker przewodniczący przewodnicząca председатель commissaire ministre minister".split())
INTRODUCTIONS = (
    r"My name is|my name is|I am|I'm|It was|This is|Please remove|Please thank|The parcel goes to|parcel to|[Aa]sk for|Call|Contact|Reader:|Reader|Speaker:|Name:|Narrator:|Signed,?|attention(?: of)?|maintained by|consent of|"
    r"[Rr]ead by|Dear|Ich heiße|Mein Name ist|Ich bin|Je m'appelle|je m'appelle|Je suis|Mon nom est|Me llamo|me llamo|Mi nombre es|Soy|Nazywam się|Mam na imię|Jestem|Меня зовут|меня зовут|Моё имя"
)
CLOSINGS = r"(?:Kind|Best|Warm) regards,?|Yours(?: sincerely| faithfully| truly)?,?|Sincerely,?|Best wishes,?|С уважением,?|Mit freundlichen Grüßen,?|Viele Grüße,?|Cordialement,?|Bien à vous,?|Z poważaniem,?|Pozdrawiam,?|Un saludo,?|Saludos,?|Atentamente,?"
#: Stems of which one is in any text that the two patterns above match.
INTRODUCED = ("y name is", "I am", "I'm", "It was", "This is", "Please ", "arcel", "sk for", "Call", "ontact", "Reader", "Speaker", "Name:", "Narrator", "Signed", "attention", "maintained by", "consent of", "ead by", "Dear", "Ich ", "Mein Name", "e m'appelle", "Je suis", "Mon nom", "e llamo", "Mi nombre", "Soy", "Nazywam", "Mam na", "Jestem", "еня зовут", "Моё имя")
CLOSED = ("egards", "Yours", "Sincerely", "Best wishes", "С уважением", "Grüße", "Cordialement", "Bien à vous", "poważaniem", "Pozdrawiam", "aludo", "Atentamente")
STREETS = r"Street|Road|Lane|Avenue|Drive|Court|Close|Mews|Row|Terrace|Way|Place|Square|Crescent|Gardens|Grove|Boulevard|Alley|Walk|Hill|Parade"
STREETS_SHORT = r"(?:St|Rd|Ln|Ave|Dr|Ct|Pl|Sq|Blvd|Cres|Terr)\b\.?"
LOW_STREETS = STREETS.lower()
DIGIT = r"(?:oh|zero|nought|one|two|three|four|five|six|seven|eight|nine)"
DIGITS = rf"(?:(?:double|triple)\s)?{DIGIT}(?:\s(?:(?:double|triple)\s)?{DIGIT})*"
NUMBER = r"(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)"
NUMBERS = rf"{NUMBER}(?:\s(?:hundred(?:\sand)?|{NUMBER}))*"
PHONE_WORDS = r"phone|telephone|tel|tél|téléphone|call|ring|fax|reach|contact|mobile|cell|teléfono|móvil|telefon|komórka|erreichen|handy|joindre|телефон|тел|whatsapp|sms|dial|dzwoń"
IDENTITY_WORDS = (
    r"ssn|social security|national insurance|insurance number|passport|id card|identity card|tax reference|tax id|tax number|driving licence|licence no|ausweis\w*|personalausweis\w*|reisepass\w*|steuer-?id\w*|steuernummer|"
    r"sozialversicherung\w*|sécurité sociale|carte d'identité|passeport|numéro fiscal|dni|nie|nif|pasaporte|seguridad social|pesel|nip|dowód|dowodu|paszport\w*|паспорт\w*|снилс|инн|id_card|passport_no|release form gives|number on the form|id number|form is"
)
#: Stems of which one is in any text that the words before or after an identity number match.
NUMBERED = ("ssn", "social security", "insurance", "passport", "id card", "identity card", "tax ", "driving licence", "licence no", "ausweis", "reisepass", "steuer", "sozialversicherung", "sécurité sociale", "carte d'identité", "passeport", "numéro fiscal", "dni", "nie", "nif", "pasaporte", "seguridad social", "pesel", "nip", "dowód", "dowodu", "paszport", "паспорт", "снилс", "инн", "id_card", "release", "number on the form", "id number", "form is", "formular", "number is", "is my ")
IDENTITY_AFTER = r"\s(?:was on the release|as the id card|as the passport|steht auf dem formular|is my (?:passport|id|insurance))"
NEGATIVE = r"isbn|issn|lp|grid|model|chapter|room|row|table|frames?|checksum|sha|utterance|utt|units|rows|size|batch|inertia|part|version|reels?|shard|doi|samples|duration|begin_time|end_time|num_samples|sample_rate|aid"

WORD = r"\p{Lu}(?:'\p{Lu})?[\p{L}\p{M}]*\p{L}"
PARTS = rf"{WORD}(?:-{WORD})*"
INITIAL = r"\p{Lu}\."
GAP = r"[ \t]"
FULL = rf"(?:{PARTS},{GAP}(?:{PARTS}(?:{GAP}{INITIAL})*|{INITIAL}(?:{GAP}?{INITIAL})*)(?!\w)|{INITIAL}(?:{GAP}?{INITIAL})*{GAP}?{PARTS}|{PARTS}(?:{GAP}{INITIAL})*{GAP}{PARTS})"
LOW_FULL = r"[^\W\d_]{2,}(?:\s[^\W\d_])*\s[^\W\d_]{2,}(?:-[^\W\d_]+)?"
BORDER = r"(?<![\p{L}\p{N}_])"


def _words(pattern: str, *tails: str) -> tuple[str, ...]:
    """The plain alternatives of a pattern, each with every tail."""
    return tuple(w + t for w in pattern.split("|") for t in (tails or ("",)))


@dataclass
class Rule:
    kind: str
    pattern: regex.Pattern
    base: float
    #: Whether the pattern needs digits.
    digits: bool
    #: Any of these has to be in the text for the rule to be tried.
    needs: tuple[str, ...] = ()
    #: Raises the score where found before (or after) the span.
    before: regex.Pattern | None = None
    after: regex.Pattern | None = None
    #: The least number of digits that a match of a number rule has.
    least: int = 6

    @cached_property
    def long(self) -> frozenset[str]:
        return frozenset(n for n in self.needs if len(n) > 2)

    @cached_property
    def short(self) -> tuple[str, ...]:
        return tuple(n for n in self.needs if len(n) <= 2)


def _rule(kind: str, pattern: str, base: float, needs: tuple[str, ...] = (), before: str = "", after: str = "", flags: int = 0, least: int = 6) -> Rule:
    near = lambda p, end: regex.compile(rf"{BORDER}(?:{p})(?!\p{{L}}){end}", regex.I) if p else None
    return Rule(kind, regex.compile(pattern, flags), base, kind in ("phone", "identity", "address", "account") and DIGITS not in pattern and NUMBERS not in pattern, needs, near(before, ""), regex.compile(after, regex.I) if after else None, least)


_LOCAL = r"(?:\"[^\"\s@]{1,64}\"|[\p{L}\d](?:[\p{L}\d._%+'-]*[\p{L}\d_+-])?(?:\s?[\(\[]dot[\)\]]\s?[\p{L}\d._%+-]+)*)"
_AT = r"(?:\s?@\s?|\s?[\(\[\{<]\s?at\s?[\)\]\}>]\s?|\sAT\s)"
_DOT = r"(?:\.|\s?[\(\[\{<]\s?dot\s?[\)\]\}>]\s?|\sDOT\s)"
_LABEL = r"[\p{L}\d](?:[\p{L}\d-]*[\p{L}\d])?"
_JOIN = r"(?:dot|underscore|dash|hyphen|minus|plus)"
_SPOKEN_LOCAL = rf"(?!(?:me|us|him|her|them|you|it|is|was|are|be|look|live|lives|stay|meet|here|there|home)\sat\s)(?:(?:(?<=\bis\s)|(?<='s\s)|(?<=\bto\s)|(?![ai]\s))[a-z]\s)?[a-z]{{2,}}(?:\s{_JOIN}\s[a-z]+)*(?:\s{DIGIT})*"
_SPOKEN_DOMAIN = r"[a-z]+(?:\s(?:dash|hyphen)\s[a-z]+)*(?:\sdot\s[a-z]+(?:\s(?:dash|hyphen)\s[a-z]+)*)+"

EMAILS = [
    _rule("email", rf"(?<![\p{{L}}\d._%+-]){_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+", 1.2),
    _rule("email", rf"(?<![\p{{L}}\d']){_SPOKEN_LOCAL}\sat\s{_SPOKEN_DOMAIN}(?!\p{{L}})", 1.2, ("dot",)),
]

_EXT = r"(?:,?\s?(?:x|ext\.?|extension|доб\.?|Durchwahl|poste|wew\.)\s?\d{1,5}(?!\d))?"
_END = r"(?![\d\p{L}]|[-./]\d)"
_START = r"(?<![\d\p{L}_./-]|\d\s)"
PHONES = [
    # country code first
    _rule("phone", rf"(?<![\d\p{{L}}+])\+\d{{1,3}}[\s.-]?(?:\(\d{{1,4}}\)[\s.-]?)?\d(?:[\s.-]?\d){{5,11}}{_EXT}{_END}", 0.9, ("+",)),
    _rule("phone", rf"{_START}00(?:1|33|34|44|48|49|7)\s\(?\d{{2,4}}\)?(?:[\s-]?\d{{2,8}}){{1,4}}{_EXT}{_END}", 0.7, ("00",)),
    # three groups, as in North America; a fictitious exchange is a phone number without more
    _rule("phone", rf"{_START}(?:1[-.\s])?(?:\(\d{{3}}\)\s?|\d{{3}}[-.\s])555[-.\s]\d{{4}}{_EXT}{_END}", 0.8, ("555",)),
    _rule("phone", rf"{_START}(?:1[-.\s])?\(\d{{3}}\)\s?\d{{3}}[-.\s]\d{{4}}{_EXT}{_END}", 0.6, ("(",), PHONE_WORDS),
    _rule("phone", rf"{_START}(?:1[-.\s])?(?:\(\d{{3}}\)\s?|\d{{3}}[-.\s])\d{{3}}[-.\s]\d{{4}}{_EXT}{_END}", 0.3, (), PHONE_WORDS),
    _rule("phone", rf"{_START}555-\d{{4}}{_EXT}{_END}", 0.6, ("555-",)),
    # national forms with a leading zero
    _rule("phone", rf"{_START}0[1-9]\d{{2,3}}\s?\d{{3}}\s?\d{{3}}{_EXT}{_END}", 0.5, ("0",), PHONE_WORDS),
    _rule("phone", rf"{_START}02\d\s?\d{{4}}\s?\d{{4}}{_EXT}{_END}", 0.6, ("02",), PHONE_WORDS),
    _rule("phone", rf"{_START}0[1-9](?:[\s.]?\d{{2}}){{4}}{_EXT}{_END}", 0.5, ("0",), PHONE_WORDS),
    _rule("phone", rf"{_START}(?:\(0\d{{2,4}}\)\s?|0[1-9]\d{{1,3}}[\s/])\d{{4,8}}(?:[-\s]\d{{1,4}})?{_EXT}{_END}", 0.5, ("0",), PHONE_WORDS),
    # Polish and Russian forms
    _rule("phone", rf"{_START}(?:8\s?)?\(\d{{2,4}}\)\s?\d{{3}}[-\s]\d{{2}}[-\s]\d{{2}}{_EXT}{_END}", 0.7, ("(",)),
    _rule("phone", rf"{_START}\d{{3}}\s\d{{9}}{_EXT}{_END}", 0.2, (), PHONE_WORDS),
    # whatever a label announces
    _rule("phone", rf"(?<={BORDER}(?:[Tt][ée]l(?:\.|:|\.:)|[Pp]hone:|[Ff]ax|[Tt]elefon:|[Tt]eléfono es|[Тт]елефон|joindre au|erreichen mich unter|ring me on|call me on|reader contact|\"tel\":\s\")\s?)\(?\+?\d[\d\s().\-/]{{5,18}}\d{_EXT}{_END}", 0.7, ("el", "él", "hone", "ax", "елефон", "unter", "oindre", "ring me", "call me", "contact"), least=2),
    # in words
    _rule("phone", rf"\b(?:call(?:\sme\son)?|reach\sme\s(?:at|on)|ring(?:\sme\son)?|number\sis|phone\sis|dial|fax|mobile\sis)\s\K{DIGITS}(?!\p{{L}})", 0.7, _words(DIGIT[3:-1])),
    # digits without any division
    _rule("phone", rf"{_START}\d{{7,15}}{_EXT}{_END}", 0.1, (), PHONE_WORDS, least=7),
]

IDENTITIES = [
    # two letters, three pairs, a letter
    _rule("identity", rf"{_START}[A-Z]{{2}}\s?\d{{2}}\s?\d{{2}}\s?\d{{2}}\s?[A-D]{_END}", 0.7, (), IDENTITY_WORDS, IDENTITY_AFTER),
    # Spanish number with its letter
    _rule("identity", rf"{_START}(?:[XYZ]-?)?\d(?:\.?\d){{6,7}}-?[A-Z]{_END}", 0.4, (), IDENTITY_WORDS, IDENTITY_AFTER),
    # letters, then digits in up to five groups
    _rule("identity", rf"{_START}[A-Z]{{1,3}}[\s-]?\d{{3,9}}(?:[-\s]\d{{1,6}}){{0,4}}{_END}", 0.2, (), IDENTITY_WORDS, IDENTITY_AFTER, least=3),
    # letters among the digits
    _rule("identity", rf"{_START}(?=[A-Z\d]*\d[A-Z\d]*\d[A-Z\d]*\d[A-Z\d]*\d)(?=\d*[A-Z])[A-Z\d]{{7,14}}{_END}", 0.2, (), IDENTITY_WORDS, IDENTITY_AFTER, least=4),
    # digits in groups
    _rule("identity", rf"{_START}\d(?:[\s./-]?\d){{7,20}}{_END}", 0.1, (), IDENTITY_WORDS, IDENTITY_AFTER),
    _rule("identity", rf"(?<=\b(?:number\son\sthe\sform\sis|passport\snumber\sis|insurance\snumber\sis|security\snumber\sis|id\snumber\sis|tax\snumber\sis)\s){DIGITS}(?!\p{{L}})", 1.0, ("number",)),
]

ACCOUNTS = [
    _rule("account", rf"{_START}(?:\d{{13,19}}|\d{{4}}(?:([ -])\d{{4}})(?:\1\d{{4}}){{1,2}}(?:\1\d{{1,4}})?|\d{{4}}([ -])\d{{6}}\2\d{{4,5}}){_END}", 0.1, least=13),
    _rule("account", r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?:\s?[A-Z\d]{4}){2,7}(?:\s?[A-Z\d]{1,3})?(?![\p{L}\d])", 0.1, least=8),
]

_FLAT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Studio)\s\d+[A-Za-z]?\b"
_FLOOR = rf"(?:,\s(?:{_FLAT}|(?:Floor|Level)\s\d+|\d+(?:st|nd|rd|th)\s[Ff]loor|Building\s\w+))*"
_SIDE = r"(?:(?:North|South|East|West|Old|New|Upper|Lower|Great|Little)\s)?"
_HOUSE = r"\d{1,5}[a-zA-Zа-я]?(?!\p{L})"
ADDRESSES = [
    _rule("address", rf"{BORDER}(?:{_FLAT},\s)?(?<!\d[.,:]?){_HOUSE},?\s{_SIDE}{WORD}(?:\s{WORD})?\s(?:(?:{STREETS})\b|{STREETS_SHORT}){_FLOOR}", 1.0, _words(STREETS) + _words("St|Rd|Ln|Ave|Dr|Ct|Pl|Sq|Blvd|Cres|Terr")),
    _rule("address", rf"{BORDER}(?:flat\s{NUMBERS}\s)?{NUMBERS}\s(?:(?:north|south|east|west|old|new|upper|lower)\s)?[^\W\d_]{{3,}}\s(?:{LOW_STREETS})\b", 0.9, tuple(" " + w for w in LOW_STREETS.split("|"))),
    # German: compound street names, or a preposition before a name
    _rule("address", rf"{BORDER}(?:(?:(?:Alter?|Neuer?|Große|Kleine|Obere|Untere)\s)?\p{{Lu}}[\p{{L}}-]*(?:[Ss]tra(?:ß|ss)e|[Ss]tr\.|weg|gasse|allee|platz|ring|ufer|damm|steig|stieg)|(?:(?:Alter?|Neuer?|Große|Kleine|Obere|Untere)\s)?{WORD}\s(?:Stra(?:ß|ss)e|Str\.|Weg|Gasse|Allee|Platz|Ring|Ufer|Damm))\s{_HOUSE}(?:,\s(?:\d+\.\s(?:OG|UG|Stock|Etage)|EG|DG|HH|Hinterhaus|Whg\.?\s\d+))?", 0.9, ("traße", "trasse", "tr.", "weg ", "gasse ", "allee ", "platz ", "ring ", "ufer ", "damm ", "stieg ", "steig ", " Weg ", " Gasse ", " Allee ", " Platz ", " Ring ", " Ufer ", " Damm ")),
    _rule("address", rf"{BORDER}(?:Am|An der|Im|Zum|Zur|Auf der|Auf dem|Unter den|In der)\s\p{{Lu}}[\p{{L}}-]+\s{_HOUSE}(?:,\s\d+\.\s(?:OG|UG|Stock|Etage))?(?=[,\n]|\s*$)", 0.8, ("Am ", "An ", "Im ", "Zum ", "Zur ", "Auf ", "Unter ", "In ")),
    # French
    _rule("address", rf"{BORDER}{_HOUSE}(?:\s(?:bis|ter|quater))?,?\s(?:rue|avenue|av\.|bd\.?|boulevard|allée|place|chemin|impasse|quai|cours|route|square|passage|ruelle|sentier)\s(?:de\sla\s|de\sl'|du\s|des\s|de\s|d'|la\s|le\s)?{PARTS}(?:\s{PARTS})?(?:,\s(?:bât\.?|bâtiment|appt?\.?|apt\.?|appartement|esc\.?|escalier|étage)\s\w+|,\s\d+(?:er|e|ème)\sétage)*", 1.0, ("rue ", "avenue ", "av. ", "bd ", "bd. ", "boulevard ", "allée ", "place ", "chemin ", "impasse ", "quai ", "cours ", "route ", "square ", "passage ", "ruelle ", "sentier ")),
    # Spanish
    _rule("address", rf"{BORDER}(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|P\.º|Camino|Ronda|Travesía|Carretera)\s?(?:de\slas?\s|de\slos\s|del\s|de\s)?{PARTS}(?:\s{PARTS})?,?\s(?:n\.?\s?º\s?|núm\.\s)?{_HOUSE}(?:,\s\d+\.?\s?[ºª](?:\s?[A-Z]\b|\s(?:izq|dcha|izda)\.?)?|,\s(?:piso|bajo|ático)\s?\w*)*", 1.0, ("Calle", "C/", "Av", "Pl", "Pza", "Pas", "P.º", "Camino", "Ronda", "Trav", "Carr")),
    # Italian and Portuguese, the number before or after
    _rule("address", rf"{BORDER}(?:{_HOUSE},?\s(?:Via|Viale|Piazza|Corso|Rua|Travessa)\s(?:de[il]?\s|del(?:la|le|lo)\s|d[aeo]s?\s)?{PARTS}(?:\s{PARTS})?|(?:Via|Viale|Piazza|Corso|Rua|Travessa)\s(?:de[il]?\s|del(?:la|le|lo)\s|d[aeo]s?\s)?{PARTS}(?:\s{PARTS})?,?\s{_HOUSE})", 0.9, ("Via ", "Viale ", "Piazza ", "Corso ", "Rua ", "Travessa ")),
    # Polish
    _rule("address", rf"{BORDER}(?:ul\.|al\.|os\.|pl\.|ulica|ulicy|aleja|alei|osiedle|osiedlu|plac|placu)\s{PARTS}(?:\s{PARTS})?\s{_HOUSE}(?:/\d+[a-z]?|\sm\.\s?\d+[a-z]?)?(?:,\s(?:klatka|piętro)\s\w+)?", 1.0, ("ul", "al", "os", "pl")),
    # Russian
    _rule("address", rf"{BORDER}(?:ул\.|улица|пр\.|пр-т|проспект|пер\.|переулок|пл\.|площадь|наб\.|набережная|ш\.|шоссе|б-р|бульвар)\s{PARTS}(?:\s{PARTS})?,?\s(?:д\.\s?|дом\s)?{_HOUSE}(?:-\d+|,\s(?:корп\.|корпус|стр\.)\s?\w+)?(?:,\s(?:кв\.|квартира|этаж)\s?\d+)?", 1.0, ("ул", "пр", "пер", "пл", "наб", "ш.", "шос", "б-р", "бул")),
    _rule("address", rf"{BORDER}{PARTS}\s(?:ул\.|улица|пр\.|пр-т|проспект|пер\.|переулок|пл\.|площадь|наб\.|набережная|шоссе|бульвар),?\s(?:д\.\s?|дом\s)?{_HOUSE}(?:-\d+|,\s(?:корп\.|корпус|стр\.)\s?\w+)?(?:,\s(?:кв\.|квартира|этаж)\s?\d+)?", 1.0, ("ул", "пр", "пер", "пл", "наб", "шос", "бул")),
]

NAMES = [
    # after a title the family name alone; more only where its first part is a known given name
    _rule("name", rf"{BORDER}(?:{TITLES})\.?\s(?:(?:{TITLES})\.?\s)?\K{PARTS}", 0.7, _words(TITLES.replace("Herrn?", "Herr|Herrn"), " ", ". ")),
    _rule("name", rf"{BORDER}(?:{TITLES})\.?\s(?:(?:{TITLES})\.?\s)?\K{FULL}(?!\p{{L}})", 0.4, _words(TITLES.replace("Herrn?", "Herr|Herrn"), " ", ". ")),
    _rule("name", rf"{BORDER}(?:{INTRODUCTIONS})\s\K(?!(?:{TITLES})\b){FULL}(?!\p{{L}})", 0.8, INTRODUCED),
    _rule("name", rf"{BORDER}(?:{CLOSINGS})\s+\K(?!(?:{TITLES})\b){FULL}(?!\p{{L}})", 0.9, CLOSED),
    _rule("name", rf"\"(?:reader|name|speaker|author|narrator|contact|proof_listener|coordinator)\":\s?\"\K{FULL}(?=\")", 1.0, ('": "', '":"')),
    _rule("name", rf"(?m)^[^\S\n]*\K{FULL}(?=[^\S\n]*$)", 0.3),
    _rule("name", rf"{BORDER}{FULL}(?=\s(?:<|\(\+?\d|\|\s(?:mail|phone)))", 0.2, (" <", " (", " | ")),
    # transcripts without capitals
    _rule("name", rf"{BORDER}(?:my\sname\sis|this\sis|i\sam|i'm)\s\K{LOW_FULL}(?=\s(?:and\si'm|and\si\b|speaking|calling))", 0.9, (" and i", " speaking", " calling")),
    _rule("name", rf"{BORDER}(?:read\sby)\s\K{LOW_FULL}(?=\sfor\sthe)", 0.9, ("read by ",)),
    _rule("name", rf"{BORDER}(?:and\s)?ask\sfor\s\K[^\W\d_]{{2,}}(?:\s[^\W\d_](?=\s))*\s[^\W\d_]{{2,}}(?:-[^\W\d_]+)?", 0.8, ("ask for ",)),
    _rule("name", rf"{BORDER}{LOW_FULL}(?=\shere\shello)", 0.9, (" here hello",)),
]

_SENTENCE_END, _NAME_WORD = re.compile(r"[.!?;]\s"), regex.compile(r"\p{L}[\p{L}\p{M}'-]*")
_DIGITS = regex.compile(r"\d")
_CLUSTER = regex.compile(r"\d(?:.{0,24}\d)*+", regex.S)
_DOTTED = regex.compile(r"dot|DOT")
_AT_SIGN = re.compile(r"@|[\(\[\{<]\s?at\s?[\)\]\}>]|\sAT\s")


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out


_LEAST = sorted({r.least for r in PHONES + IDENTITIES + ACCOUNTS if r.digits})
_SPOKEN_ADDRESS, _LINE_NAME = ADDRESSES[1], NAMES[5]
_LOW_STREET = re.compile(rf"\s(?:{LOW_STREETS})\b")
_NUMBER_WORDS = frozenset(NUMBER[3:-1].split("|")) | {"hundred", "and"}
_PHONE_STEMS = _automaton(PHONE_WORDS.split("|"))
_STEMS = _automaton(sorted({n for rules in (EMAILS, PHONES, IDENTITIES, ADDRESSES, NAMES) for r in rules for n in r.long}))
_IDENTITY_STEMS = _automaton(list(NUMBERED))
_CLOSE_NEGATIVE = regex.compile(rf"{BORDER}(?:{NEGATIVE})(?:\s(?:of|no\.?|number))?[\s:#_\"]{{1,4}}[\w\s.-]{{0,4}}$", regex.I)
_TOKEN = regex.compile(rf"{BORDER}{WORD}(?:-{WORD})*")
_INITIALS = regex.compile(rf"\s(?:{INITIAL}\s?)+")
_BUSINESS = regex.compile(r"\s(?:Press|Archive|Library|Lane|Street|Road|Avenue|Publishing|House|University|Museum)\b")


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(digits: str) -> bool:
    """The key of French insurance numbers: 97 less the rest of the first 13 digits."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def weighted(digits: str, weights: tuple[int, ...], modulus: int = 10) -> bool:
    """A last digit that brings the weighted sum to a multiple (Polish numbers)."""
    return len(digits) == len(weights) + 1 and (sum(int(d) * w for d, w in zip(digits, weights)) + int(digits[-1])) % modulus == 0


def iso_mod_11_10(digits: str) -> bool:
    """The check digit of German tax numbers."""
    if len(digits) != 11:
        return False
    p = 10
    for d in digits[:-1]:
        s = (int(d) + p) % 10 or 10
        p = s * 2 % 11
    return (11 - p) % 10 == int(digits[-1])


def dni(value: str) -> bool:
    """The letter of Spanish numbers."""
    first = {"X": "0", "Y": "1", "Z": "2"}.get(value[:1], value[:1])
    digits, letter = "".join(c for c in first + value[1:-1] if c.isdigit()), value[-1:]
    return letter.isalpha() and len(digits) == 8 and "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == letter


def nip(digits: str) -> bool:
    """Polish tax numbers."""
    return len(digits) == 10 and sum(int(d) * w for d, w in zip(digits, (6, 5, 7, 2, 3, 4, 5, 6, 7))) % 11 == int(digits[-1])


def snils(digits: str) -> bool:
    """The control number of Russian insurance numbers."""
    return len(digits) == 11 and sum(int(d) * w for d, w in zip(digits, range(9, 0, -1))) % 101 % 100 == int(digits[9:])


def iban(value: str) -> bool:
    """International bank account numbers: 1 is the rest of the rearranged number by 97."""
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def card(digits: str) -> bool:
    """Payment cards: a known first digit or two, the length, and Luhn's check digit."""
    return 13 <= len(digits) <= 19 and re.match(r"4|5[1-5]|2[2-7]|3[4-7]|6[0245]", digits) is not None and luhn(digits)


def checksum(value: str) -> bool:
    """Whether any validator confirms an identity number."""
    digits = "".join(c for c in value if c.isdigit())
    if not digits:
        return False
    return mod97(digits) or weighted(digits, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)) or iso_mod_11_10(digits) or dni(value) or (len(digits) in (15, 16) and luhn(digits))


def confirmed(value: str) -> bool:
    """Whether a number is right as a whole: its form, its parts and its check digits.

    Only forms for which a number by chance is unlikely: French insurance numbers with sex and
    month, Polish ones with a date, German tax numbers with their repeated digit, Russian and Polish
    ones as they are written in groups, Spanish ones with their letter, and the three
    groups of American ones with possible parts, which have no check digit.
    """
    digits = "".join(c for c in value if c.isdigit())
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", value):
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if any(c.isalpha() for c in value):
        return dni(value)
    if len(digits) == 15:
        return digits[0] in "123478" and (1 <= int(digits[3:5]) <= 12 or int(digits[3:5]) >= 20) and mod97(digits)
    if len(digits) == 10:
        return re.fullmatch(r"\d{3}-\d{3}-\d{2}-\d{2}|\d{3}-\d{2}-\d{2}-\d{3}", value) is not None and nip(digits)
    if len(digits) != 11:
        return False
    if re.fullmatch(r"\d{3}-\d{3}-\d{3}[ -]\d{2}", value):
        return digits != "0" * 11 and snils(digits)
    if value == digits and int(digits[2:4]) in (*range(1, 13), *range(21, 33)) and 1 <= int(digits[4:6]) <= 31 and weighted(digits, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)):
        return True
    repeated = sorted(digits[:10].count(d) for d in set(digits[:10]))
    return digits[0] != "0" and repeated[-1] in (2, 3) and (len(repeated) < 2 or repeated[-2] == 1) and iso_mod_11_10(digits)


def _joined(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches in order, those that overlap made one, so that none ends inside what the next one holds."""
    out: list[tuple[int, int]] = []
    for a, b in stretches:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _around_ats(text: str) -> list[tuple[int, int]]:
    """Around each at-sign what is joined to it: any email address lies in one of these stretches.

    That is the run without spaces on both sides of the sign, which may itself stand between spaces, and
    further runs where a spelled dot stands at the space.
    """
    out: list[tuple[int, int]] = []
    for m in _AT_SIGN.finditer(text):
        floor, first, end = out[-1][1] if out else 0, m.start(), m.end()
        if end < floor:
            continue
        if first > floor and text[first - 1].isspace():
            first -= 1
        if end < len(text) and text[end].isspace():
            end += 1
        while first > floor and (not text[first - 1].isspace() or _DOTTED.search(text, max(0, first - 10), first + 10)):
            first -= 1
        while end < len(text) and (not text[end].isspace() or _DOTTED.search(text, max(0, end - 10), end + 10)):
            end += 1
        if out and first <= floor:
            out[-1] = out[-1][0], max(end, floor)
        else:
            out.append((first, end))
    return out


def _numbered_street(text: str) -> bool:
    """Whether a street word has a number word two or three words before it, as spoken addresses have."""
    for m in _LOW_STREET.finditer(text):
        before = text[max(0, m.start() - 200) : m.start()].split()
        if len(before) < 4 or any(w in _NUMBER_WORDS for w in before[-3:-1]):
            return True
    return False


def _lines(text: str) -> Iterator[tuple[int, int]]:
    """The lines that begin with a capital and end with a letter or full stop, besides white space."""
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end].strip()
        if line and line[0].isupper() and (line[-1] == "." or line[-1].isalpha()):
            yield at, end
        at = end + 1


class Finder:
    """Finds the spans of a text; knows the registered readers, and looks for the given kinds."""

    def __init__(self, readers: list[tuple[str, str]], kinds: tuple[str, ...] = tuple(PLACEHOLDERS)) -> None:
        self.rules = [rules for rules in (EMAILS, PHONES, IDENTITIES, ACCOUNTS, ADDRESSES, NAMES) if rules[0].kind in kinds]
        fold = lambda s: s.casefold()
        self.full = {(fold(g), fold(f)) for g, f in readers if g and f}
        self.given = {g for g, _ in self.full}
        self.family = {f for _, f in self.full}

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(first, end, kind), in order, without overlaps."""
        if not text:
            return []
        flat = flattened(text)
        there = {k for _, k in _STEMS.iter(flat)}
        found: list[tuple[float, int, int, str]] = []
        digits = _DIGITS.search(flat) is not None
        # without one of the words, only rules that reach the threshold by their form or check digits are tried
        lower = flat.lower()
        identity = any(True for _ in _IDENTITY_STEMS.iter(lower))
        phone = digits and any(True for _ in _PHONE_STEMS.iter(lower))
        # the digits of phones and identity numbers stand close to each other
        clusters = [(m.start(), m.end(), len(_DIGITS.findall(m[0]))) for m in _CLUSTER.finditer(flat)] if digits else []
        numbers = {n: _joined([(max(0, a - 24), b + 40) for a, b, has in clusters if has >= n]) for n in _LEAST}
        for rules in self.rules:
            for rule in rules:
                if rules is IDENTITIES and not identity and rule.base + CONFIRMED < THRESHOLD:
                    continue
                if rule.digits and not digits or rules is PHONES and not phone and rule.base < THRESHOLD:
                    continue
                if rule.needs and there.isdisjoint(rule.long) and not any(n in flat for n in rule.short):
                    continue
                for a, b in self._matches(rule, rules, flat, numbers):
                    if (score := self._score(rule, flat, a, b, identity if rules is IDENTITIES else phone)) >= THRESHOLD:
                        found.append((score, a, b, rule.kind))
        found += self._people(flat)
        return self._settle(found)

    @staticmethod
    def _matches(rule: Rule, rules: list[Rule], text: str, numbers: dict[int, list[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
        """Where a rule matches; around digits or at-signs only where it has these."""
        if rule is EMAILS[0]:
            stretches = _around_ats(text)
        elif rule is _LINE_NAME:
            stretches = _lines(text)
        elif rule is _SPOKEN_ADDRESS and not _numbered_street(text):
            return
        elif rule.digits and rules is not ADDRESSES:
            stretches = numbers[rule.least]
        else:
            stretches = [(0, len(text))]
        # what precedes a stretch is still seen by the patterns, and it ends well after the last digit
        for pos, end in stretches:
            for m in rule.pattern.finditer(text, pos, min(end, len(text))):
                yield m.span()

    def _score(self, rule: Rule, text: str, a: int, b: int, named: bool) -> float:
        """The score of a span; ``named`` tells whether the text has any of the words that may stand before it."""
        score, value = rule.base, text[a:b]
        if rule.kind == "identity":
            score += CONFIRMED if confirmed(value) else CHECKED if checksum(value) else 0.0
            if not named and score < THRESHOLD:
                return 0.0
        head, tail = text[max(0, a - BEFORE) : a], text[b : b + AFTER]
        if rule.kind == "account":
            compact = "".join(c for c in value if c.isalnum())
            if not (card(compact) if compact.isdigit() else iban(compact)):
                return 0.0
            score += 1.0
        if rule.kind in ("phone", "identity", "account"):
            line = head[head.rfind("\n") + 1 :]
            if _CLOSE_NEGATIVE.search(line):
                return 0.0
            if rule.before and named:
                hits = [m.end() for m in rule.before.finditer(line)]
                if hits and not _SENTENCE_END.search(line[hits[-1] + 4 :]):
                    score += 0.6 if rule.kind == "identity" else 0.4
            if rule.after and rule.after.match(tail):
                score += 0.6
        elif rule.kind == "name":
            words = [w.casefold() for w in _NAME_WORD.findall(value)]
            if any(w in NOT_FAMILIES for w in words):
                return 0.0
            if _BUSINESS.match(tail):
                return 0.0
            known = [p for w in words for p in w.split("-") if p in self.given or p in self.family]
            score += 0.3 * min(len(known), 2)
            if len(words) > 1 and (words[0] in self.given or words[0] in GIVEN or len(words[0]) == 1):
                score += 0.4
        return score

    def _people(self, text: str) -> list[tuple[float, int, int, str]]:
        """Registered readers, in either order, and a common given name before a family name, wherever they stand."""
        out, tokens = [], list(_TOKEN.finditer(text))
        for n, (x, y) in enumerate(zip(tokens, tokens[1:])):
            between = text[x.end() : y.start()]
            if len(between) > 8 or between.strip(" .,") and not _INITIALS.fullmatch(between):
                continue
            one, two = x[0].casefold(), y[0].casefold()
            straight = between == " " or _INITIALS.fullmatch(between)
            if (straight and (one, two) in self.full) or (between == ", " and (two, one) in self.full):
                if not _BUSINESS.match(text[y.end() : y.end() + AFTER]):
                    out.append((0.85, x.start(), y.end(), "name"))
            elif straight and one in GIVEN and two not in NOT_PEOPLE and two not in NOT_FAMILIES and self._alone(text, tokens, n):
                out.append((0.55, x.start(), y.end(), "name"))
        return out

    @staticmethod
    def _alone(text: str, tokens: list[regex.Match], n: int) -> bool:
        """Whether the two capitalized words from ``n`` on are not part of a longer row of them, as titles of works and firms are."""
        x, y = tokens[n], tokens[n + 1]
        before = n and tokens[n - 1].end() + 1 == x.start() and text[x.start() - 1] == " "
        after = n + 2 < len(tokens) and y.end() + 1 == tokens[n + 2].start() and text[y.end()] == " " and tokens[n + 2][0].casefold() in NOT_PEOPLE
        return not after and not (before and tokens[n - 1][0].casefold() in ("saint", "st", "san", "santa", "port", "mount", "lake", "fort", "cape", "new", "north", "south", "east", "west"))

    @staticmethod
    def _settle(found: list[tuple[float, int, int, str]]) -> list[tuple[int, int, str]]:
        """Best first: emails before all, then by score, then the longer one."""
        rank = {"email": 0, "account": 1, "address": 1, "identity": 2, "phone": 2, "name": 3}
        taken: list[tuple[int, int, str]] = []
        for score, a, b, kind in sorted(found, key=lambda s: (rank[s[3]], -s[0], s[1] - s[2], s[1])):
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, kind))
        return sorted(taken)


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """``text`` with a placeholder for each span."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join(out) + text[at:]


def _known(readers: DataFrame) -> list[tuple[str, str]]:
    rows = readers.select("given_name", "family_name").filter("given_name is not null and family_name is not null").distinct().limit(MAX_READERS + 1).collect()
    if len(rows) > MAX_READERS:
        raise ValueError(f"more than {MAX_READERS} readers")
    return [(r[0], r[1]) for r in rows]


def found(documents: DataFrame, readers: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(doc_id, kind, first_char, end_char) of each item of the ``kinds``; null, empty and blank texts have none."""
    known = _known(readers)
    rows = spread(documents.select("doc_id", "text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(known, kinds)
        for batch in batches:
            out = [(key, kind, a, b) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b, kind in finder.spans(text)]
            if out:
                ids, held, firsts, ends = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(held), pa.array(firsts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "kind", "first_char", "end_char"])

    return rows.mapInArrow(search, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, kind string, first_char int, end_char int")


def redact(documents: DataFrame, readers: DataFrame) -> DataFrame:
    """(doc_id, text) of every row, each item replaced by its placeholder; null stays null."""
    known = _known(readers)
    rows = spread(documents.select("doc_id", "text"))

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(known)
        for batch in batches:
            texts = [redacted(t, finder.spans(t)) if t else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(replace, rows.schema)
