import random

import pii_texts
import pytest

from corpusloom.llm import pii

FINDER = pii.Finder([])


def items(text, finder=FINDER):
    return [(k, text[a:b]) for a, b, k in finder.spans(text)]


@pytest.mark.parametrize("sentences", [pii_texts.SEEN, pii_texts.HELD_OUT])
def test_recall_and_precision_on_other_texts(sentences):
    recall, precision, missed, wrong = pii_texts.measured(FINDER.spans, sentences)
    assert recall >= 0.9 and precision >= 0.9, (missed, wrong)


@pytest.mark.parametrize(
    ("right", "wrong"),
    [
        ("4111 1111 1111 1111", "4111 1111 1111 1112"),
        ("DE89370400440532013000", "DE89370400440532013001"),
        ("2 55 08 14 168 025 38", "2 55 08 14 168 025 39"),
        ("44051401359", "44051401358"),
        ("86 095 742 719", "86 095 742 718"),
        ("112-233-445 95", "112-233-445 96"),
        ("12345678Z", "12345678A"),
        ("X1234567L", "X1234567M"),
        ("526-104-08-28", "526-104-08-29"),
    ],
)
def test_check_digits_decide_without_words(right, wrong):
    assert [x for _, x in items(f"so it was {right} in the end")] == [right]
    assert items(f"so it was {wrong} in the end") == []


def test_words_name_numbers_whose_check_digits_are_wrong():
    # test data, and people who mistype, give such numbers; a wrong card or account number is none
    assert items("DNI 12345678A") == [("identity", "12345678A")]
    assert items("my pesel 44051401358") == [("identity", "44051401358")]
    assert items("card number 4111 1111 1111 1112") == []


def test_kinds_of_the_found_query_leave_accounts_out():
    text = "Card 4111 1111 1111 1111, IBAN DE89370400440532013000, mail a@b.test"
    assert items(text) == [("account", "4111 1111 1111 1111"), ("account", "DE89370400440532013000"), ("email", "a@b.test")]
    assert items(text, pii.Finder([], pii.KINDS)) == [("email", "a@b.test")]
    assert pii.redacted(text, FINDER.spans(text)) == "Card [ACCOUNT], IBAN [ACCOUNT], mail [EMAIL]"


@pytest.mark.parametrize("text", ["passport: ABC1234D", "passport: X12Y34Z5", "My passport number is AB 12345"])
def test_labelled_passports_of_few_digits(text):
    assert items(text) == [("identity", text.split(": ")[-1].removeprefix("My passport number is "))]


def test_emails_in_stretches_equal_those_in_the_whole_text():
    rng = random.Random(6)
    parts = ["a", "bob.c", "@", " @ ", " (at) ", "[at]", " AT ", ".", " (dot) ", "[dot]", " DOT ", "x-y", "org", " ", "\n", "é", '"q r"', "<", "at", "dot"]
    rule = pii.EMAILS[0]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(3, 40)))
        assert [m.span() for m in rule.pattern.finditer(text)] == list(FINDER._matches(rule, pii.EMAILS, text, {})), text


def test_lines_and_number_words_hold_every_match():
    rng = random.Random(7)
    parts = ["Jan Novak", "J. R. Berg", "Ann", "\n", " ", "\t", ".", "\r\n", "x", "Écle Ôta-Li", ","]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert [m.span() for m in pii._LINE_NAME.pattern.finditer(text)] == list(FINDER._matches(pii._LINE_NAME, pii.NAMES, text, {})), repr(text)
    words = ["flat", "two", "forty", "hundred", "and", "north", "mill", "road", "way", "the", "hill", "court"]
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
        rule = pii._SPOKEN_ADDRESS
        assert [m.span() for m in rule.pattern.finditer(text)] == list(FINDER._matches(rule, pii.ADDRESSES, text, {})), text
