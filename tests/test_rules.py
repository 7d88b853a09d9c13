"""Detection rules on own cases: what is found, and that offsets are right."""

import pytest
from pyspark.sql import functions as F

from maskwright.functions import pii
from maskwright.operators.detect import detect

CASES = [
    ("mail 🦊 jan.n@example.com, łucja@example.org", ["jan.n@example.com", "łucja@example.org"]),
    ("a@b.com+anna@c.org x", ["a@b.com", "+anna@c.org"]),
    ("call 555-123-4567 or (555) 123-4567 ext. 12", ["555-123-4567", "(555) 123-4567 ext. 12"]),
    ("198.51.100.123 443 1024 tel555-123-4567", ["198.51.100.123"]),
    ("+44 20 7946 0958 24h", ["+44 20 7946 0958"]),
    ("+44 20 7946 0958 555-123-4567", ["+44 20 7946 0958", "555-123-4567"]),
    ("v1.2.3.4 1.2.3.4.5", []),
    ("[IPv6:2001:db8::1] std::cout 12:30:45 ::1", ["2001:db8::1"]),
    ("#99999 4111 1111 1111 1111 4111 1111 1111 1112", ["4111 1111 1111 1111"]),
    ("GB82 WEST 1234 5698 7654 32. GB82 WEST 1234 5698 7654 33", ["GB82 WEST 1234 5698 7654 32"]),
    ("123-45-6789 SSN: 123456789 000-12-3456 123456789", ["123-45-6789", "123456789"]),
    ("PASSWORD=${SECRET}\nmax_tokens: 4096\napi_key=api_key", []),
    ("password: str, token: Option<String>", []),
    ('password = "a1-" + "b2-" + "c3"\nretries = 3', ["a1-", "b2-", "c3"]),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    return {r.i: (r.text, r.spans) for r in detect(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    text, spans = found[i]
    assert all(text[s.start : s.end] == s.value for s in spans)
    assert [s.value for s in spans] == CASES[i][1]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("x",)], "text string")
    plan = detect(df)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "Exchange" not in plan


def spans_found(spark, rule, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [[(s.start, s.value) for s in r.s] for r in rows.select("id", rule(F.col("text")).alias("s")).orderBy("id").collect()]


def test_addresses_are_read_from_whole_runs(spark):
    assert spans_found(spark, pii.detect_ipv4, [
        "1.2.3.4, www.10.0.0.255.example", "1.2.3.4.5 x1.2.3.4 1.2.3.4y 256.1.1.1 01.2.3.4", "0.0.0.0:80 a.1.2.3.4.b", "1.2.3",
    ]) == [[(0, "1.2.3.4"), (13, "10.0.0.255")], [], [(0, "0.0.0.0"), (13, "1.2.3.4")], []]


def test_cards_are_read_group_by_group(spark):
    assert spans_found(spark, pii.detect_card, [
        "4111 1111 1111 1111.", "12 4111-1111-1111-1111 3", "4111 1111-1111 1111", "a4111111111111111 4111111111111111z", "3782 822463 10005",
        "1.4111111111111111", "9111111111111111", "6304000000000000 5555555555554444",
    ]) == [
        [(0, "4111 1111 1111 1111")], [(3, "4111-1111-1111-1111")], [], [], [(0, "3782 822463 10005")], [], [],
        [(0, "6304000000000000"), (17, "5555555555554444")],
    ]


def test_account_numbers_back_off_by_words(spark):
    assert spans_found(spark, pii.detect_iban, [
        "DE89370400440532013000", "de89 3704 0044 0532 0130 00 is mine", "DE89 3704 0044 0532 0130 01", "xDE89370400440532013000",
        "NL91 ABNA 0417 1643 00 word", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 32é",
    ]) == [
        [(0, "DE89370400440532013000")], [(0, "de89 3704 0044 0532 0130 00")], [], [], [(0, "NL91 ABNA 0417 1643 00")],
        [(0, "GB82 WEST 1234 5698 7654 32")], [(0, "GB82 WEST 1234 5698 7654 32")],
    ]


def test_groups_that_fit_no_number_cost_no_reading(spark, monkeypatch):
    from maskwright.functions.spans import HIT

    read = lambda text, *_: F.when(text.isNotNull(), F.raise_error(F.lit("read in groups")).cast(f"array<{HIT}>"))
    monkeypatch.setattr(pii, "_us_numbers", read)
    monkeypatch.setattr(pii, "hits", read)
    texts = ["ring +44 20 7946 0958 24h", "4111 1111 11", "3782-822463", "555-123-45678", "12-123-4567", "5551 1234 5678 x"]
    for rule in (pii.detect_phone_us, pii.detect_card):
        assert spans_found(spark, rule, texts) == [[]] * len(texts)


def test_groups_that_may_be_a_number_are_read(spark):
    assert spans_found(spark, pii.detect_phone_us, [
        "15551234567 1555-123-4567", "1 (555) 123.4567", "(555)123-4567", "1-555 123-4567 ext. 9", "+1 555‑123–4567;", "٥٥٥-١٢٣-٤٥٦٧",
    ]) == [
        [(12, "1555-123-4567")], [(0, "1 (555) 123.4567")], [(0, "(555)123-4567")], [(0, "1-555 123-4567 ext. 9")], [(0, "+1 555‑123–4567")],
        [(0, "٥٥٥-١٢٣-٤٥٦٧")],
    ]
    assert spans_found(spark, pii.detect_card, ["4222222222222", "3782-822463-10005 ", "12-4111-1111-1111-1111", "4000 0000 0000 0000 006"]) == [
        [(0, "4222222222222")], [(0, "3782-822463-10005")], [(3, "4111-1111-1111-1111")], [(0, "4000 0000 0000 0000 006")],
    ]
    assert spans_found(spark, pii.detect_phone_intl, ["+44 20 7946 0958x12", "+44 20 7946 0958 24h", "+1 23 4", "(+49) 30 1234567, x"]) == [
        [(0, "+44 20 7946 0958x12")], [(0, "+44 20 7946 0958")], [], [(0, "(+49) 30 1234567")],
    ]


def test_escaped_names_are_decoded_and_form_fields_end(spark):
    from maskwright.functions import secrets

    found = [
        (r'{"pass\u0077ord":"one \"a\" b"}', [r'one \"a\" b']),
        (r'{"b":"{\"pass\\u0077ord\":\"two\",\"n\":1}"}', ["two"]),
        (r'{"db\u005fpassword":"three"}', ["three"]),
        (r'{"b":"{\"\\u0064b_password\":\"four\"}"}', ["four"]),
        (r'{"b":"{\"c\":\"{\\\"pass\\\\u0077ord\\\":\\\"five\\\"}\"}"}', ["five"]),
        (r'{"b":"{\"c\\u0061f\":\"{\\\"password\\\":\\\"six\\\"}\"}"}', ["six"]),
        ("pass%77ord=se%20ven&next=home", ["se%20ven"]),
        ("a=1&db%5Fpassword=eight", ["eight"]),
        ("body 'password=ni(ne&user=x'", ["ni(ne"]),
        (r'{"pass\u0077ord_length":"24"}', []),
        (r'{"pass\uZZZZord":"literal"}', []),
        ("page%5Fsize=20&sort=up", []),
    ]
    got = spans_found(spark, secrets.detect_escaped_secret, [t for t, _ in found])
    assert [[v for _, v in spans] for spans in got] == [v for _, v in found]
    assert all(text[start:].startswith(v) for (text, _), spans in zip(found, got, strict=True) for start, v in spans)
