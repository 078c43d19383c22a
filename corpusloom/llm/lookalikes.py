"""Problem 4: one consistent form for texts that look the same.

Compatibility forms that look the same (widths, ligatures, Roman numeral letters, spaces) are
resolved, ignorable characters deleted and accents decomposed. Each token then is a lattice: a
letter with look-alikes in other scripts may be any of them. Viterbi picks the spelling with the
best score under character bigrams of single-script tokens, learned from the corpus itself, with a
penalty for changing the script. The lattice and its scores depend only on what a token looks
like, so all tokens of one look get one form.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe import spread
from corpusloom.operators.joins import split_join
from corpusloom.session import checkpointed

#: Look-alike letters, Latin first (fixed values; after Unicode's confusables data). Digits are not among them: 0 and O,
#: or 1 and l, differ visibly in common fonts, and a form that took one for the other would change numbers.
CLASSES = (
    "aаɑ", "cсϲᴄⲥ", "dԁ", "eе", "gɡց", "hһհ", "iі", "jјϳ", "lӏ", "nո", "oоοօᴏⲟ", "pрρⲣ", "qԛ", "sѕꜱ", "uսυᴜ", "vνѵᴠ", "wԝᴡ", "xх", "yуү", "zᴢ",
    "AАΑⲀᎪꓮ", "BВΒⲂᏴꓐ", "CСϹⲤᏟꓚ", "DᎠꓓ", "EЕΕᎬꓰ", "FϜꓝ", "GԌᏀꓖ", "HНΗⲎᎻꓧ", "IІΙӀⲒꓲ", "JЈͿᎫꓙ", "KКΚⲔᏦꓗ", "LᏞꓡ", "MМΜⲘᎷꓟ", "NΝⲚꓠ", "OОΟՕⲞꓳ", "PРΡⲢᏢꓑ", "QԚ", "RᎡꓣ", "SЅՏᏚꓢ", "TТΤⲦᎢꓔ", "UՍꓴ", "VѴᏙꓦ", "WԜᎳꓪ", "XХΧⲬꓫ", "YҮΥⲨꓬ", "ZΖᏃꓜ",
)
#: Scripts whose letters are told apart; other letters count as one.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "COPTIC", "CHEROKEE", "LISU")
#: Letters that are symbols of their own, besides the look-alikes: the basic alphabets of four scripts.
ALPHABETS = frozenset(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x391, 0x3CA), *range(0x400, 0x460), *range(0x531, 0x557), *range(0x561, 0x587)]))
#: Log score lost for a change of script within a token, and for a spelling that never occurs.
CHANGE, UNSEEN = 1000.0, 0.1
#: A worker keeps the form of this many tokens.
KNOWN, KNOWN_CHARS = 200_000, 64
FIELDS = {"mls_transcripts": "transcript", "voxpopuli": "raw_text"}

_MEMBERS = {c: group for group in CLASSES for c in group}
#: Deleted: format characters, fillers, variation selectors and other default ignorable characters.
_IGNORED = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]+")
_SPACES = regex.compile(r"\p{Zs}")
_TOKEN = regex.compile(r"[^\s]+")
#: Compatibility forms that look like what they stand for; others (raised, circled, fractions) keep their look.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")


@lru_cache(maxsize=100_000)
def _resolved(c: str) -> str:
    tag, _, rest = unicodedata.decomposition(c).partition(" ")
    if not tag.startswith("<"):
        return c
    full = unicodedata.normalize("NFKC", c)
    if tag in _SAME_LOOK:
        return full
    # ligatures and Roman numerals; not the long s and the Greek symbol letters, which look different
    if tag == "<compat>" and all(x.isalpha() for x in full) and c != "ſ" and not 0x3D0 <= ord(c) <= 0x3FF:
        return full
    return c


def plain(text: str) -> str:
    """``text`` decomposed, with look-equal compatibility forms resolved and ignorable characters deleted."""
    if text.isascii():
        return text
    kept = _IGNORED.sub("", text)
    return unicodedata.normalize("NFD", _SPACES.sub(" ", "".join(map(_resolved, kept))))


@lru_cache(maxsize=100_000)
def _script(c: str) -> str:
    if not c.isalpha():
        return ""
    name = unicodedata.name(c, "").split(" ")[0]
    return name if name in SCRIPTS else "OTHER"


@lru_cache(maxsize=100_000)
def _symbol(c: str) -> str:
    """What the bigrams count: look-alikes and letters of the alphabets by themselves, other letters by script, all else as one."""
    return c if c in _MEMBERS or c in ALPHABETS else _script(c) or "-"


def bigrams(tokens: Counter) -> Counter:
    """Counts of symbol pairs in the tokens whose letters are of one script; '^' begins a token."""
    out: Counter = Counter()
    for token, n in tokens.items():
        bases = [c for c in plain(token) if not unicodedata.combining(c)]
        if len({s for s in map(_script, bases) if s}) == 1:
            symbols = ["^", *map(_symbol, bases)]
            for pair in zip(symbols, symbols[1:]):
                out[pair] += n
    return out


class Speller:
    """Finds the form of tokens and texts under given bigram counts."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        total = sum(counts.values()) + 1
        self.score = {pair: math.log((n + UNSEEN) / total) for pair, n in counts.items()}
        self.unseen = math.log(UNSEEN / total)
        self.known: dict[str, str] = {}

    def _step(self, a: str, b: str) -> float:
        x, y = _symbol(a) if a != "^" else a, _symbol(b)
        score = self.score.get((x, y), self.unseen)
        one, two = _script(a) if a != "^" else "", _script(b)
        return score - (CHANGE if one and two and one != two else 0.0)

    def token(self, token: str) -> str:
        """The best path through the token's lattice; ties go to the earlier member of a class."""
        found = self.known.get(token)
        if found is not None:
            return found
        looks = plain(token)
        path: list[tuple[str, float, int]] = []
        columns: list[list[tuple[str, float, int]]] = []
        last = [("^", 0.0, 0)]
        for c in looks:
            if unicodedata.combining(c):
                column = [(c, s, k) for k, (_, s, _) in enumerate(last)]
                columns.append(column)
                # marks carry the letter before them along
                last = [(letter, s, k) for k, (letter, s, _) in enumerate(last)]
                continue
            column = []
            for member in _MEMBERS.get(c, c):
                best, at = max(((s + self._step(a, member), -k) for k, (a, s, _) in enumerate(last)), default=(0.0, 0))
                column.append((member, best, -at))
            columns.append(column)
            last = column
        if columns:
            k = max(range(len(last)), key=lambda i: (last[i][1], -i))
            for column in reversed(columns):
                path.append(column[k])
                k = column[k][2]
        out = unicodedata.normalize("NFC", "".join(c for c, _, _ in reversed(path)))
        if len(token) <= KNOWN_CHARS:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[token] = out
        return out

    def text(self, text: str) -> str:
        """The consistent form of a text; spaces of any width become plain ones, line breaks stay."""
        kept = text if text.isascii() else _SPACES.sub(" ", _IGNORED.sub("", text))
        known, out = self.known, []
        for part in kept.split(" "):
            form = known.get(part)
            # other white space than blanks stays where it is
            out.append(_TOKEN.sub(lambda m: self.token(m[0]), part) if form is None else form)
        return " ".join(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    tokens: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                tokens.update(text.split())
        if len(tokens) > KNOWN:
            total.update(bigrams(tokens))
            tokens.clear()
    total.update(bigrams(tokens))
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in total]), pa.array([b for _, b in total]), pa.array(list(total.values()), pa.int64())], names=["a", "b", "n"])


def learn(tables: list[DataFrame]) -> dict[tuple[str, str], int]:
    """Bigram counts over all texts of the tables (single column each).

    The symbols are bounded by the look-alike table, the alphabets and the scripts, so at most (some 450)
    squared pairs come to the driver, whatever the size of the corpus.
    """
    parts = [spread(t).mapInArrow(_count, "a string, b string, n bigint") for t in tables]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    return {(r["a"], r["b"]): r["n"] for r in union.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


def _rows(table: DataFrame, column: str) -> DataFrame:
    return table.select(F.col("_row_idx"), F.col(column).alias("text"))


def consistent(tables: dict[str, DataFrame], fields: dict[str, str] = FIELDS) -> DataFrame:
    """(field, _row_idx, text): every row's text in its consistent form; null stays null, '' stays ''."""
    rows = {fields[name]: _rows(t, fields[name]) for name, t in tables.items()}
    counts = learn([r.select("text") for r in rows.values()])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(counts)
        for batch in batches:
            texts = [t and speller.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_row_idx", "text"])

    out = None
    for field, r in rows.items():
        part = spread(r).mapInArrow(spell, r.schema).select(F.lit(field).alias("field"), "_row_idx", "text")
        out = part if out is None else out.union(part)
    return out


def _keyed(tables: dict[str, DataFrame], fields: dict[str, str]) -> DataFrame:
    """(field, _row_idx, look, own): digests of each text's form and of the text itself; null for a null text."""
    rows = {fields[name]: _rows(t, fields[name]) for name, t in tables.items()}
    counts = learn([r.select("text") for r in rows.values()])
    digest = lambda s: hashlib.blake2b(s.encode(), digest_size=16).digest()

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(counts)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            looks = [None if t is None else digest(speller.text(t)) for t in texts]
            own = [None if t is None else digest(t) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(looks, pa.binary()), pa.array(own, pa.binary())], names=["_row_idx", "look", "own"])

    keyed = None
    for field, r in rows.items():
        part = spread(r).mapInArrow(key, f"_row_idx {r.schema['_row_idx'].dataType.simpleString()}, look binary, own binary")
        part = part.select(F.lit(field).alias("field"), "_row_idx", "look", "own")
        keyed = part if keyed is None else keyed.union(part)
    return checkpointed(keyed)


def classes(tables: dict[str, DataFrame], fields: dict[str, str] = FIELDS) -> DataFrame:
    """(field, _row_idx, look_class, n_rows, n_links): every row with its class of equal look.

    ``look_class`` is the least ``_row_idx`` of the class, ``n_rows`` its size and ``n_links`` the rows of the
    class whose characters differ from this row's. A row with a null text has no class and no links.
    This is linear in the rows: copies are not expanded into pairs.
    """
    keyed = _keyed(tables, fields)
    texts = checkpointed(keyed.filter("look is not null").groupBy("field", "look", "own").agg(F.count(F.lit(1)).alias("n"), F.min("_row_idx").alias("least")))
    looks = texts.groupBy("field", "look").agg(F.sum("n").alias("n_rows"), F.min("least").alias("look_class"))
    told = split_join(texts, looks, ["field", "look"], ["own"]).select("field", "own", "look_class", "n_rows", (F.col("n_rows") - F.col("n")).alias("n_links"))
    sizes = texts.select("field", "own", F.col("n").alias("_n"))
    out = split_join(keyed.filter("look is not null"), told, ["field", "own"], ["_row_idx"], sizes=sizes).select("field", "_row_idx", "look_class", "n_rows", "n_links")
    none = keyed.filter("look is null").select("field", "_row_idx", F.lit(None).cast(out.schema["look_class"].dataType).alias("look_class"), F.lit(0).cast("bigint").alias("n_rows"), F.lit(0).cast("bigint").alias("n_links"))
    return out.union(none)


def found(tables: dict[str, DataFrame], fields: dict[str, str] = FIELDS) -> DataFrame:
    """(field, row_a, row_b): pairs of rows of one table that look the same but differ in characters.

    Rows are keyed by digests of the form and of the text itself. Only forms with two texts or more
    go on; their distinct texts are paired, and rows are joined to the pairs of texts, so that the
    work is that of the pairs to be returned and copies of one text never meet each other. The
    pairs are what is asked for here; ``classes`` gives the same links in one row for each row.
    """
    keyed = _keyed(tables, fields).filter("look is not null")
    several = keyed.groupBy("field", "look").agg(F.min("own").alias("least"), F.max("own").alias("most"), F.count(F.lit(1)).alias("n")).filter("least <> most")
    # no key of the joins below has more rows than the largest of these looks
    largest = several.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    varied = keyed.join(several, ["field", "look"], "left_semi")
    texts = varied.select("field", "look", "own").distinct()
    other = texts.withColumnRenamed("own", "own_b")
    pairs = split_join(texts.withColumnRenamed("own", "own_a"), other, ["field", "look"], ["own_a"], most=largest).filter("own_a < own_b").select("field", "own_a", "own_b")
    left = varied.select("field", F.col("own").alias("own_a"), F.col("_row_idx").alias("a"))
    right = varied.select("field", F.col("own").alias("own_b"), F.col("_row_idx").alias("b"))
    one = split_join(left, pairs, ["field", "own_a"], ["a"], most=largest).select("field", "own_b", "a")
    both = split_join(one, right, ["field", "own_b"], ["a"], most=largest)
    return both.select("field", F.least("a", "b").alias("row_a"), F.greatest("a", "b").alias("row_b"))
