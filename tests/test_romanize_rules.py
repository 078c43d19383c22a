import pytest
from pyspark.sql import functions as F

from corpusloom.functions import romanize


def test_more_rules_than_are_sent_raise(spark, monkeypatch):
    monkeypatch.setattr(romanize, "MAX_RULES", 3, raising=False)
    lines = spark.createDataFrame([(f"::s {c} ::t x",) for c in "abcd"], "value string")
    assert len(romanize.read_rules(lines.limit(3))) == 3
    with pytest.raises(ValueError, match="more than 3 rules"):
        romanize.read_rules(lines)


SAMPLES = [
    ("ألاسكا", "", "alaska"), ("यह एक अच्छा अनुवाद है.", "hin", "yah ek acchaa anuvaad hai."), ("ちょっとまってください", "", "chottomattekudasai"), ("Μπανγκαλόρ", "ell", "Mpangkalor"), ("Зеленський", "ukr", "Zelenskyy"), ("കേരളം", "mal", "keerallam"),
    ("เชียงใหม่", "", "cheiiynghaim"), ("กรุงเทพ", "", "krungtheph"), ("อาหาร", "", "aahaar"), ("ລາວ", "", "laaw"), ("⠠⠓⠑⠇⠇⠕", "", "Hello"), ("Θεσσαλονίκη", "", "Thessalonike"), ("ΘΕΣΣΑΛΟΝΙΚΗ", "", "THESSALONIKE"), ("23½", "", "23 1/2"), ("½", "", "1/2"),
    ("საქართველო", "", "sakartvelo"), ("Հայաստան", "", "Hayastan"), ("ኢትዮጵያ", "", "iteyopheyaa"), ("ᏣᎳᎩ", "", "tsalagi"), ("မြန်မာ", "", "mranmaa"), ("ខ្មែរ", "", "khmaera"), ("ⲙ̀ⲡⲓ", "", "empi"), ("한국어", "", "hangugeo"), ("マッチャ", "", "matcha"),
    ("தமிழ்", "", "tamizh"), ("తెలుగు", "", "telugu"), ("বাংলা", "", "baanlaa"), ("ਪੰਜਾਬੀ", "", "panjaabii"), ("ગુજરાતી", "", "gujaraatii"), ("ಕನ್ನಡ", "", "kannadda"), ("ශ්‍රී", "", "shrii"), ("שלום", "", "shlvm"), ("ދިވެހި", "", "dhivehi"), ("ㄅㄆㄇ", "", "bpm"), ("ꆈꌠ", "", "nuosu"),
]


@pytest.mark.parametrize(("text", "language", "expected"), SAMPLES)
def test_samples_of_scripts(text, language, expected):
    assert romanize.Romanizer().romanize(text, language) == expected


def test_columns_read_words_like_whole_lines(spark):
    texts = [t for t, _, _ in SAMPLES] + ["Да и нет", "a  b ", "", None, "::lcode ukr Зеленський и", "нет ½ 23½"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", romanize.romanize(F.col("t")).alias("r")).collect()
    engine = romanize.Romanizer()
    assert all(r["r"] == (None if texts[r["k"]] is None else romanize.romanized_line(engine, texts[r["k"]])) for r in got)
    rules = ["::s нет ::t no", "::s а б ::t ab"]
    ruled = spark.createDataFrame([("нет а б",)], "t string").select(romanize.romanize(F.col("t"), rules=rules).alias("r")).first()["r"]
    assert ruled == "no ab"
