import pytest
from pyspark.sql import functions as F

from corpusloom.constants import MAX_UNIT
from corpusloom.functions import normalize, romanize, text, units


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("unit", [0, 1, 4999, 30_000, MAX_UNIT])
def test_pua_round_trip(spark, unit):
    pua = one(spark, units.unit_to_pua(F.lit(unit)))
    assert pua == chr(983_040 + unit)
    assert one(spark, units.pua_to_unit(F.lit(pua))) == unit


@pytest.mark.parametrize("unit", [-1, MAX_UNIT + 1])
def test_units_out_of_range_raise(spark, unit):
    with pytest.raises(Exception, match="private-use"):
        one(spark, units.unit_to_pua(F.lit(unit)))


@pytest.mark.parametrize("bad", ["", "a", chr(983_040) * 2, chr(1_048_574)])
def test_not_a_unit_raises(spark, bad):
    with pytest.raises(Exception, match="not one unit"):
        one(spark, units.pua_to_unit(F.lit(bad)))


def test_unit_arrays(spark):
    assert one(spark, units.units_to_pua(F.array(F.lit(0), F.lit(5)))) == chr(983_040) + chr(983_045)
    assert one(spark, units.units_to_pua(F.array().cast("array<int>"))) == ""
    assert one(spark, units.without_repeats(F.array(*map(F.lit, [1, 1, 2, 1, 1])))) == [1, 2, 1]


@pytest.mark.parametrize(("seconds", "frame"), [(0.0, 0), (1.0, 50), (0.5, 25), (0.02, 1), (10.0, 500), (0.039, 1)])
def test_time_to_frame(spark, seconds, frame):
    assert one(spark, units.time_to_frame(F.lit(seconds))) == frame


@pytest.mark.parametrize(("span", "expected"), [((0.0, 0.01), (0, 1)), ((0.01, 0.02), (0, 1)), ((0.5, 1.5), (25, 75))])
def test_frame_slice(spark, span, expected):
    a, b = units.frame_slice(F.lit(span[0]), F.lit(span[1]))
    assert (one(spark, a), one(spark, b)) == expected
    a, b = units.frame_slice(F.lit(span[0]), F.lit(span[1]), 8000, 160)
    assert (one(spark, a), one(spark, b)) == expected


@pytest.mark.parametrize(("size", "padded"), [(0, 0), (1, 128), (128, 128), (129, 256), (32_000, 32_000)])
def test_padded_vocabulary(spark, size, padded):
    assert one(spark, units.padded_vocabulary(F.lit(size))) == padded


@pytest.mark.parametrize(
    ("given", "expected"),
    [("Hello", "hello"), ("a1b2c3", "a b c"), ("123abc", "abc"), ("it's", "it's"), ("!?-", ""), ("", ""), ("  a   b ", "a b"), (None, None)],
)
def test_normalize_uroman(spark, given, expected):
    assert one(spark, text.normalize_uroman(F.lit(given).cast("string"))) == expected


def test_tokenize(spark):
    assert one(spark, text.tokenize(F.lit("  a　b\tc\n"))) == ["a", "b", "c"]
    assert one(spark, text.tokenize(F.lit(""))) == []
    assert one(spark, text.tokenize(F.lit("a||b|"), "|")) == ["a", "", "b", ""]


def test_letters_and_tags(spark):
    assert one(spark, text.letter_tokens(F.array(F.lit("hello"), F.lit("42")))) == ["h e l l o", ""]
    assert one(spark, text.substitute_punctuation_tags(F.lit("YES <COMMA> NO <QUESTIONMARK>"))) == "YES, NO?"
    assert one(spark, text.is_garbage(F.lit("x<SIL>y"))) and not one(spark, text.is_garbage(F.lit("sil")))
    assert one(spark, text.strip_punctuation(F.lit("It's, So!"))) == "its so"


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("Hello, World!", "hello world"), ("HELLO", "hello"), ("call 123 now", "call now"), ("123", "123"), ("hello 123", "hello"), ("a  b", "a b"), ("", ""), ("   ", ""),
        ("see (john 3:16) here", "see here"), ("a’b’c", "a’b'c".replace("’", " ")), ("ｆｕｌｌ", "full"), ("x&lt;y", "xy"), ("٢٣ a", "٢٣ a"), (None, None),
    ],
)
def test_text_normalize(given, expected):
    assert normalize.normalized(given) == expected


def test_text_normalize_options():
    assert normalize.normalized("A (b) c", brackets=True) == "a c"
    assert normalize.normalized("A b", lower=False) == "A b"
    assert normalize.normalized("a 1 b", numbers=False) == "a 1 b"
    assert normalize.normalized("soft­hyphen", "mon") == "softhyphen"
    assert normalize.normalized("é", "jav") == "e"


@pytest.mark.parametrize(
    ("given", "expected"),
    [("hello", "hello"), ("Москва", "Moskva"), ("λόγος", "logos"), ("한국어", "hangugeo"), ("ひらがな", "hiragana"), ("きゃく", "kyaku"), ("がっこう", "gakkou"), ("नमस्ते", "namaste"), ("राम", "raam"), ("१२", "12"), ("café", "cafe"), ("", ""), ("書", "書")],
)
def test_romanize(given, expected):
    assert romanize.Romanizer().romanize(given) == expected


def test_romanization_rules():
    engine = romanize.Romanizer().load(["::s 書 ::t shu", "::s sch ::t sh ::lcode deu", "::s s ::t z ::lcode deu ::at-start-of-word", "::s 書籍 ::t shuji"])
    assert engine.romanize("書") == "shu" and engine.romanize("書籍書") == "shujishu"
    assert engine.romanize("schas", "deu") == "shas" and engine.romanize("sas", "deu") == "zas" and engine.romanize("schas") == "schas"
    assert romanize.romanized_line(engine, "::lcode deu sas") == "zas"
    assert '"shu"' in engine.output("書", form="edges")


def test_romanize_columns(spark):
    out = spark.createDataFrame([("Да", ["нет", None]), (None, None)], "a string, b array<string>").select(romanize.romanize(F.col("a")), romanize.romanize_tokens(F.col("b"))).collect()
    assert [tuple(r) for r in out] == [("Da", ["net", None]), (None, None)]
