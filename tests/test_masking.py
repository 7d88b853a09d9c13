"""Masking, restoring, vaults, search and streams against plain models."""

from pyspark.sql import functions as F

from maskwright.operators import search
from maskwright.operators.restore import restore, restore_rows
from maskwright.plans.masking import KEYS, mask_rows, mask_sessions
from maskwright.streaming.mask import settled


def test_round_trip_and_numbers(spark):
    rows = [
        (1, "a@b.com, c@d.org, a@b.com; My password is 'mira@example.org plus words'. [EMAIL_1] 555-123-4567"),
        (2, "nothing"),
        (3, "+44 20 7946 0958 555-123-4567 x@y.io"),
    ]
    out = restore_rows(mask_rows(spark.createDataFrame(rows, "id int, text string"), literals=True)).collect()
    assert all(r.restored == r.text and not r.warnings for r in out)
    first = next(r for r in out if r.id == 1)
    assert first.masked == (
        "[EMAIL_1], [EMAIL_2], [EMAIL_1]; My password is '[PASSWORD_1]'. [LITERAL_1] [PHONE_1]"
    )


def test_sessions_share_one_vault_and_continue(spark):
    rows = [("s", 1, 0, "x@a.io then y@a.io"), ("s", 2, 0, "y@a.io and z@a.io"), ("t", 1, 0, "z@a.io")]
    df = spark.createDataFrame(rows, "session string, seq bigint, section int, text string")
    out = mask_sessions(df)
    masked = {(r.session, r.seq): r.masked for r in out.masked.collect()}
    assert masked == {
        ("s", 1): "[EMAIL_1] then [EMAIL_2]", ("s", 2): "[EMAIL_2] and [EMAIL_3]", ("t", 1): "[EMAIL_1]",
    }
    more = spark.createDataFrame([("s", 3, 0, "w@a.io x@a.io")], df.schema)
    assert mask_sessions(more, out.vault).masked.first().masked == "[EMAIL_4] [EMAIL_1]"
    text = out.masked.select(*KEYS, F.col("masked").alias("text"))
    back = restore(text, out.vault, KEYS)
    assert {(r.session, r.seq): r.restored for r in back.collect()} == {(a, b): t for a, b, _, t in rows}


def test_search_equals_brute_force(spark):
    texts = spark.createDataFrame(
        [(1, "Jan Nowak and January, Nowakem _Jan_ 山田太郎さん"), (2, "aaaa Jan"), (3, "x" * 700 + "Jan Nowak" + "y" * 700)],
        "id int, text string",
    )
    values = ["Jan Nowak", "Jan", "Nowak", "山田", "aa", "x"]
    found = search.find_values(texts, spark.createDataFrame([(v,) for v in values], "value string"), ["id"])
    got = sorted((r.id, r.start, r.value) for r in found.collect())
    want = sorted(
        (r.id, i, v) for r in texts.collect() for v in values
        for i in range(len(r.text)) if r.text.startswith(v, i)
    )
    assert got == want


def test_every_split_settles_to_the_same_text():
    text = "Hi [PERSON_1], \\[person 2\\] and scores[email1] 【IPV4_1】 [x"
    for size in range(1, len(text)):
        pieces = [text[i : i + size] for i in range(0, len(text), size)]
        pending, before, out = "", "", []
        for n, piece in enumerate(pieces):
            pending += piece
            k = settled(pending, before, True, n == len(pieces) - 1)
            assert len(pending) - k < 76
            out.append(pending[:k])
            before, pending = pending[k - 1 : k] or before, pending[k:]
        assert "".join(out) == text
        assert all("[PERSON_1]" in p or "PERSON" not in p for p in out)
