import pytest

from corpusloom.llm import pii

FINDER = pii.Finder([])


def items(text):
    return [(k, text[a:b]) for a, b, k in FINDER.spans(text)]


@pytest.mark.parametrize("number", ["QQ 12 34 56 C", "12345678Z"])
def test_numbers_that_need_no_word(number):
    assert items(f"so it was {number} in the end") == [("identity", number)]


@pytest.mark.parametrize(("text", "number"), [("my passport number C4VMV1M52 is new", "C4VMV1M52"), ("the id card AB 123 was lost", "AB 123")])
def test_labelled_numbers_of_few_digits(text, number):
    assert items(text) == [("identity", number)]


def test_phone_label_before_few_digits():
    assert items("Tel. 12 - 34 5, please") == [("phone", "12 - 34 5")]


@pytest.mark.parametrize("number", ["eight three four nine six eight three", "four", "double nine six"])
def test_spoken_phones_of_any_digits(number):
    assert items(f"call {number}") == [("phone", number)]


@pytest.mark.parametrize("email", ["j" * 700 + "@x.test", "j@" + "x" * 700 + ".test", "j (dot) doe" * 60 + "@" + "ab DOT " * 90 + "test", "a@b.test"])
def test_emails_of_any_length(email):
    assert items(f"write, {email}, today; or to c@d.test") == [("email", email), ("email", "c@d.test")]
    assert items(f"{'write, ' * 99}{email}, {'today; ' * 99}c@d.test")[0] == ("email", email)


def test_labels_that_announce_phones():
    assert items("Phone: 12-345678 and") == items("phone: 12-345678") == [("phone", "12-345678")]


def test_number_in_words_on_another_line():
    assert items("the number on the form is\nzero four") == [("identity", "zero four")]


def test_stretches_around_many_at_signs():
    assert pii._around_ats("@" * 50_000) == [(0, 50_000)]


def test_title_in_two_forms():
    assert items("dort sah Herr Bauer zu") == [("name", "Bauer")]
