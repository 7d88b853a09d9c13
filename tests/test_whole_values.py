"""Values of any length are found whole, and no session is left out."""

import pytest
from pyspark.sql import functions as F

from maskwright.functions import secrets
from maskwright.operators import jsondata, review
from maskwright.streaming import activity

LONG = "Ab1" * 100_000
LINES = "".join(f"  line{i}\n" for i in range(3000))
COOKIES = "".join(f"k{i}=v; " for i in range(2000))


@pytest.mark.parametrize(
    ("rule", "text", "value"),
    [
        ("api_key_prefix", f"x sk-{LONG} y", f"sk-{LONG}"),
        ("api_key_prefix", f"x ghp_{LONG}", f"ghp_{LONG}"),
        ("auth_header", f"Authorization: Bearer {LONG} y", LONG),
        ("url_credential", f"http://{'u' * 500}:{'p' * 900}@host.example/", "u" * 500 + ":" + "p" * 900),
        ("labelled_secret", 'password = "' + 'a\\"b' * 50_000 + '"\n', 'a\\"b' * 50_000),
        ("labelled_secret", "very_" * 30 + 'password = "hunter2hunter"', "hunter2hunter"),
        ("cookie", f"Cookie: {COOKIES}sid={LONG}; b=1", LONG),
        ("cookie", "Set-Cookie: a=1 2; Secure; x_token=abc def; HttpOnly", "abc"),
        ("block_secret", f"password: |\n{LINES}b: 1", LINES.rstrip("\n")),
    ],
)
def test_secrets_of_any_length(spark, rule, text, value):
    found = getattr(secrets, f"detect_{rule}")(F.col("t"))
    row = spark.createDataFrame([(text,)], "t string").select(found.alias("x")).first()
    assert [s.value for s in row.x] == [value]


def test_json_strings_with_many_escapes(spark):
    text = '{"a":"' + "\\n" * 100_000 + '","password":"x"}'
    row = spark.createDataFrame([(text,)], "t string").select(jsondata.string_tokens(F.col("t")).alias("x")).first()
    assert [(len(s.raw), s.name) for s in row.x] == [(3, None), (200_002, "a"), (10, None), (3, "password")]


def test_review_reads_clauses(spark):
    rows = [
        ("Passport: AB 12345; born 1980-02-03, lives at 12 St. James Rd. near it.",),
        ('Recovery code = "a b; c" and employee Ann J. Lee, ok',),
        ("use the form and enter hunter2 to log in",),
        ("the webhook of team b is at https://hooks.example.test/x1).",),
    ]
    got = review.review(spark.createDataFrame(rows, "text string")).collect()
    assert {(r.kind, r.value) for r in got} == {
        ("PASSPORT", "AB 12345"), ("DOB", "1980-02-03"), ("ADDRESS", "12 St. James Rd. near it"),
        ("CREDENTIAL", "a b; c"), ("PERSON", "Ann J. Lee"), ("PASSWORD", "hunter2"),
        ("TOKEN", "https://hooks.example.test/x1"),
    }


def test_every_session_is_reported(spark):
    requests = spark.range(1000).select(
        F.col("id").cast("string").alias("session"), F.lit("r").alias("request_id"), F.current_timestamp().alias("ts"),
        F.lit(True).alias("forwarded"), F.lit(True).alias("completed"), F.lit("[EMAIL_1]").alias("masked_text"),
    )
    summary = activity.activity_summary(requests, "salt")
    assert summary.count() == 1000
    assert activity.support_totals(summary).first()["requests"] == 1000
    assert activity.activity_summary(requests, "salt", newest=5).count() == 5
