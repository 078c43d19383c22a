import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import bpe, packing, pii

DOCS = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.FOLDER}/{bpe.VOCABULARY}")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", None, "  \t\n ", "Hello, world! it's 1234567", "<|endoftext|> is text", "a" * 9000, "\x1c\x1d x\x1f \x85y", "᠎   z", "½²٣४", "😀" * 500, " " * 5000 + "x", "naïve café été 音声認識 한국어 आवाज", "\U000f0c9b\U000f1221" * 300, "word " * 5000]


def test_ids_equal_the_library(spark, reference):
    rng = random.Random(4)
    noise = ["".join(chr(rng.choice([rng.randrange(32, 0xD7FF), rng.randrange(0xE000, 0x10FFFF), rng.randrange(32, 127)])) for _ in range(400)) for _ in range(15)]
    texts = TEXTS + noise + ["".join(rng.choice("etaoinshr") for _ in range(6000))]
    out = {r["doc_id"]: r["ids"] for r in bpe.encode(spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], DOCS)).collect()}
    assert all(out[k] == reference(t or "") for k, t in enumerate(texts))


def test_very_long_text_and_forgotten_words(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 50)
    enc = bpe.Encoder(bpe.FOLDER, bpe.VOCABULARY)
    text = " ".join(f"word{k % 700}" for k in range(200_000))
    flat = lambda words: [x for ids in words for x in ids]
    assert flat(next(enc.encode_batch([text]))) == reference(text)
    many = [f"some text {k} of words {k * 7} {'z' * 70}{k}" for k in range(300)]
    assert [flat(x) for x in enc.encode_batch(many)] == [reference(t) for t in many]


def test_ways_for_long_words_and_texts_give_the_same_ids(monkeypatch):
    enc = bpe.Encoder(bpe.FOLDER, bpe.VOCABULARY)
    flat = lambda words: [x for ids in words for x in ids]
    rng = random.Random(3)
    texts = [None, "", "it's 'tis we'll 12 x", "".join(rng.choice("thequickabrown'. \x1c\t\n") for _ in range(3000)), "ab" * 400 + " ünd é́ 12\u00a0x", "\u2003 \x85 a"]
    expected = [flat(x) for x in enc.encode_batch(texts)]
    monkeypatch.setattr(bpe, "STEP_BYTES", 3)
    assert [flat(x) for x in bpe.Encoder(bpe.FOLDER, bpe.VOCABULARY).encode_batch(texts)] == expected
    monkeypatch.setattr(bpe, "LONG_TEXT", 5)
    assert [flat(x) for x in bpe.Encoder(bpe.FOLDER, bpe.VOCABULARY).encode_batch(texts)] == expected
    assert all(enc.ascii_word.findall(t) == enc.word.findall(t) for t in texts if t and t.isascii())
    assert [enc.decode(x) for x in expected] == [t or "" for t in texts]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"id": 1, "content": "x", "special": False}]}, {"model": {"type": "BPE", "dropout": 0.1}}])
def test_tokenizer_files_of_another_kind_raise(tmp_path, change):
    import json

    whole = {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "model": {"type": "BPE", "vocab": {}, "merges": []}}
    (tmp_path / "good.json").write_text(json.dumps(whole))
    assert bpe.read_model(str(tmp_path / "good.json"))["merges"] == []
    (tmp_path / "other.json").write_text(json.dumps(whole | change))
    with pytest.raises(ValueError, match="no plain byte-level BPE"):
        bpe.read_model(str(tmp_path / "other.json"))


def test_round_trip_on_tables(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], DOCS)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()} == {k: t or "" for k, t in enumerate(TEXTS)}


def test_patterns_use_every_item_and_fill_well():
    rng = np.random.default_rng(0)
    counts = np.zeros(2049, dtype=np.int64)
    np.add.at(counts, np.clip(rng.lognormal(5.2, 0.9, 20_000).astype(int), 1, 2048), 1)
    plan = packing.patterns(counts)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += times
    assert all(used[x] == counts[x] for x in range(1, 2049))
    total = (counts * np.arange(2049)).sum()
    assert total / (sum(t for _, t in plan) * 2048) > 0.999
    assert packing.patterns(np.zeros(11, dtype=np.int64)) == []


def test_packing_places_every_token_once(spark):
    rng = random.Random(5)
    texts = ["word " * rng.randrange(0, 60) for _ in range(300)] + [None, "", "w " * 130, "w " * 64, "a a"] + ["same text"] * 40
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], DOCS)
    rows = packing.pack(docs, capacity=64).collect()
    sizes = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(docs).collect()}
    assert {k: sum(r["n_tokens"] for r in rows if r["doc_id"] == k) for k in sizes} == sizes
    at = {}
    for r in rows:
        at.setdefault(r["sequence"], []).append((r["offset"], r["offset"] + r["n_tokens"]))
        if sizes[r["doc_id"]] <= 64:
            assert r["piece"] == 0 and r["first_token"] == 0
    for spans in at.values():
        spans = sorted(s for s in spans if s[1] > s[0])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and (not spans or spans[-1][1] <= 64)
    full = sum(sizes.values()) / 64
    assert max(at) + 1 <= full * 1.05 + 1
    assert {r["doc_id"] for r in packing.found(docs, 64).collect()} == {k for k, n in sizes.items() if n > 64}


def test_found_documents_come_from_the_placement(spark):
    texts = ["w " * 40, "w " * 8, None, "w " * 200, "w " * 16]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], DOCS)
    plan = packing.found(docs, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "ArrowEvalPython" in plan
    checked = packing.checked(docs, 16).first().asDict()
    assert checked == {"documents": 5, "pieces_of_none": 0, "broken": 0, "overfull": 0, "full": True}


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    only = packing.pack(spark.createDataFrame([(1, None, ""), (2, "", "")], DOCS)).collect()
    assert [(r["n_tokens"], r["sequence"]) for r in only] == [(0, 0), (0, 0)]


FINDER = pii.Finder([("Hope", "Deck"), ("Mark", "Fern")])


def items(text):
    return [(k, text[a:b]) for a, b, k in FINDER.spans(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Write to jane.doe+x@mail.example.com, please.", [("email", "jane.doe+x@mail.example.com")]),
        ("try jane AT example DOT org now", [("email", "jane AT example DOT org")]),
        ('or "j.d.8"@x.test; j＠example.net', [("email", '"j.d.8"@x.test'), ("email", "j＠example.net")]),
        ("the address is jane underscore doe at mailbox dot test all lower case", [("email", "jane underscore doe at mailbox dot test")]),
        ("You can ring me on +44 (0)20 7946 0378 ext. 329 after six.", [("phone", "+44 (0)20 7946 0378 ext. 329")]),
        ("Tel. ０１６３２ ９６０２７１ x１３", [("phone", "０１６３２ ９６０２７１ x１３")]),
        ("please call triple five four six three and ask for grole garos that day", [("phone", "triple five four six three"), ("name", "grole garos")]),
        ("Grid 833-229-8272 of the score sheet is void. LP 11-0516-59, ISBN 978-0-00-805830-5.", []),
        ("SSN 000-99-5231, as you asked. Tax reference: QQ 84 42 86 C", [("identity", "000-99-5231"), ("identity", "QQ 84 42 86 C")]),
        ("so the number on the form is zero zero one two three i think", [("identity", "zero zero one two three")]),
        ("I live at 42 Nock Rd, Apt 22, Gourstead.", [("address", "42 Nock Rd, Apt 22")]),
        ("Vivo en C/ Koren, 178, 2.º B, Herenham. Mieszkam przy ul. Stuth 76 m. 40, X.", [("address", "C/ Koren, 178, 2.º B"), ("address", "ul. Stuth 76 m. 40")]),
        ("Meine Anschrift: Alte Feilker Straße 171, 00708 Gourstead.", [("address", "Alte Feilker Straße 171")]),
        ("They walked along Theck Lane at dusk. Room 753, second floor, is the booth.", []),
        ("My name is Meinni T. Siloudale and I read.", [("name", "Meinni T. Siloudale")]),
        ("Mrs Pagras's recordings, fax 311-555-0172, attention Ms Veck Every day", [("name", "Pagras"), ("phone", "311-555-0172"), ("name", "Veck")]),
        ("we saw Hope Deck and Fern, Mark there; The Hope Press printed it", [("name", "Hope Deck"), ("name", "Fern, Mark")]),
        ("", []),
        ("   \n", []),
    ],
)
def test_items(text, expected):
    assert items(text) == expected


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.weighted("44051401359", (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)) and not pii.weighted("44051401358", (1, 3, 7, 9, 1, 3, 7, 9, 1, 3))
    assert pii.dni("12345678Z") and not pii.dni("12345678A")
    assert pii.iso_mod_11_10("86095742719") and not pii.iso_mod_11_10("86095742718")
    first = "1850578006084"
    assert pii.mod97(first + f"{97 - int(first) % 97:02}")


def test_redaction_on_tables(spark):
    docs = spark.createDataFrame([(1, "My name is Mark Fern and I read. mail a@b.test", "en"), (2, None, "en"), (3, "", None), (4, "x" * 200_000, "en")], "doc_id bigint, text string, kind string")
    readers = spark.createDataFrame([("Mark", "Fern", 1), (None, "X", 2)], "given_name string, family_name string, doc_id int")
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs, readers).collect()}
    assert out[1] == "My name is [NAME] and I read. mail [EMAIL]" and out[2] is None and out[3] == "" and len(out[4]) == 200_000
    assert {(r["doc_id"], r["kind"], r["first_char"], r["end_char"]) for r in pii.found(docs, readers).collect()} == {(1, "name", 11, 20), (1, "email", 38, 46)}
    assert pii.found(docs.limit(0), readers).count() == 0
