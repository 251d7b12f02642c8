import random
import re
from datetime import date

from footfall.llm import pii

KEY = b"test"


def test_feistel_is_a_permutation():
    f = pii.Feistel(KEY)
    for n in (1, 2, 7, 100, 997, 4096):
        assert sorted(f("kind", n, x) for x in range(n)) == list(range(n))
    assert [f("a", 997, x) for x in range(20)] != [f("b", 997, x) for x in range(20)]
    assert [pii.Feistel(b"x")("a", 997, x) for x in range(20)] != [f("a", 997, x) for x in range(20)]


def test_formats_and_links():
    replace = pii.Replacer(KEY)
    values = {
        "n_email": "Jo.Doe81@mail7.example.com", "n_card": "4111 1111 1111 1111", "n_phone": "+1 (654) 555-4136", "n_ssn": "123-45-6789",
        "n_date": "1987-02-28", "n_ip": "53.61.123.170", "n_iban": "DE89 3704 0044 0532 0130 00",
    }
    for name, value in values.items():
        text, counts = replace(f"é {value}, and {value}.")
        assert counts == {name: 2} and value not in text, (name, text, counts)
        made = text[2 : 2 + len(value)]
        assert text == f"é {made}, and {made}."
        assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", made))) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", value)))
        assert pii.Replacer(KEY)(made)[1] == {name: 1}
    for value in ("03/12/1999", "12/31/1999", "31.12.1999", "+44 20 7946 0958", "+12025550123", "212-555-0199"):
        text, counts = replace(value)
        assert sum(counts.values()) == 1 and text != value and len(text) == len(value), value
    made = replace("12/31/1999")[0]
    date(int(made[6:]), int(made[:2]), int(made[3:5]))


def test_invalid_stay():
    text = "4111111111111112 300.1.1.1 000-12-3456 2021-02-30 DE88 3704 0044 0532 0130 00 version 1.2.3 12345 a@b 99/99/2000 1.2.3.4.5"
    assert pii.Replacer(KEY)(text) == (text, {})


def test_neighbours():
    replace = pii.Replacer(KEY)
    text = "4111111111111111 4012888888881881 130.87.1.2 +1 (654) 555-4136 4111111111111111 AB12 4111 1111 1111 1111"
    assert replace(text)[1] == {"n_card": 4, "n_ip": 1, "n_phone": 1}


def test_card_bijection():
    f = pii.Feistel(KEY)
    draw = random.Random(2)
    cards = set()
    while len(cards) < 500:
        body = "4" + "".join(draw.choice("0123456789") for _ in range(14))
        cards.add(body + str(pii.luhn(body)))
    made = {pii._card(f, c) for c in cards}
    assert len(made) == 500 and all(pii.luhn(c[:-1]) == int(c[-1]) for c in made)


def test_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a.b-" * 50_000 + "@", "+" + "1 " * 100_000, "AB12" * 50_000):
        assert pii.Replacer(KEY)(text)[0] == text


def test_frames(spark):
    rows = [(1, "mail a.b@c.example.com", 5, "x"), (1, "mail a.b@c.example.com", 5, "x"), (None, None, None, None), (2, "", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_ip long, value string")
    out = pii.pseudonymise(docs, KEY).collect()
    assert len(out) == 4 and sum(r.n_email for r in out) == 2 and {r.value for r in out} == {"x", None, "y"} and {r.n_ip for r in out} == {0}
    assert len({r.text for r in out if r.doc_id == 1}) == 1
    assert pii.pseudonymise(docs.limit(0), KEY).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    card = re.compile(r"(?<![0-9])4[0-9]{15}(?![0-9])|\+1 \([0-9]{3}\) 555-[0-9]{4}|[\w.]+@mail[0-9]\.example\.com")
    n = 0
    for row in pii.pseudonymise(docs, KEY).collect():
        found = card.findall(before[row.doc_id])
        n += len(found)
        assert not any(v in row.text for v in found)
        assert found or sum((row.n_email, row.n_card, row.n_phone)) == 0
    assert n > 50
