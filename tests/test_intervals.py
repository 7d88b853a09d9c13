"""Resolution over tables against the plain best-first walk."""

import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators import intervals
from maskwright.operators.resolve import resolve_merged

SCHEMA = "doc string, start int, end int, value string, entity_type string, source string, priority int, rule int"


def best_first(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[1] - s[2], -s[6], s[1], s[7])):
        if all(s[2] <= k[1] or k[2] <= s[1] for k in kept):
            kept.append(s)
    return kept


def spans_of(doc, text, n, longest, rng):
    out = set()
    for _ in range(n):
        start = rng.randrange(len(text) - 1)
        end = min(len(text), start + 1 + rng.randrange(longest))
        out.add((doc, start, end, text[start:end], rng.choice(["A", "B"]), "made", rng.randrange(3), rng.randrange(1000)))
    unique = {}
    for s in out:  # one row per place, priority and rule
        unique[(s[1], s[2], s[6], s[7])] = s
    return list(unique.values())


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    texts = {
        "dense": "".join(rng.choice("ab, ") for _ in range(400)), "long": "".join(rng.choice("xé \U0001f600.") for _ in range(3000)),
        "wide": "".join(rng.choice("a    ,,") for _ in range(900)), "few": "one two",
    }
    sizes = {"dense": (250, 30), "long": (300, 25), "wide": (150, 400), "few": (3, 5)}
    rows = [s for doc, text in texts.items() for s in spans_of(doc, text, *sizes[doc], rng)]
    # A staircase: every span waits for the one before it.
    rows += [("stairs", 3 * i, 3 * i + 5, "abcde", "A", "made", 0, i) for i in range(200)]
    texts["stairs"] = "".join("abcde"[0] for _ in range(605))
    return texts, rows


@pytest.mark.parametrize("few, rounds", [(64, 24), (0, 4), (5, 24)])
def test_rounds_give_the_best_first_walk(spark, made, few, rounds):
    _, rows = made
    got = intervals.resolve_table(spark.createDataFrame(rows, SCHEMA), ["doc"], few, rounds).collect()
    want = [s for doc in {r[0] for r in rows} for s in best_first([r for r in rows if r[0] == doc])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_visible_letters(spark, made):
    texts, rows = made
    kept = [s for doc in texts for s in best_first([r for r in rows if r[0] == doc])]
    table = spark.createDataFrame(rows, SCHEMA)
    table = table.where("doc <> 'long'").unionByName(spark.createDataFrame([r for r in rows if r[0] == "long" and r not in kept], SCHEMA))
    rows = [r for r in rows if r[0] != "long" or r not in kept]
    got = intervals.still_visible(table, spark.createDataFrame(kept, SCHEMA), ["doc"]).collect()
    hidden = {(k[0], p) for k in kept for p in range(k[1], k[2])}
    letter = lambda c: c.isalnum()
    assert len(got) == len(rows)
    for r in got:
        want = sum(letter(c) for p, c in enumerate(r.value, r.start) if (r.doc, p) not in hidden)
        assert r.visible == want, r


def test_merging_equals_the_form_inside_a_row(spark, made):
    texts, rows = made
    texts = {k: v for k, v in texts.items() if k != "stairs"}
    rows = [r for r in rows if r[0] in texts]
    table = spark.createDataFrame(rows, SCHEMA)
    got = intervals.merge_partial_table(table, ["doc"], few=3).collect()
    one = F.struct("start", "end", "value", "entity_type", "source", "priority", "rule")
    arrays = table.groupBy("doc").agg(F.collect_list(one).alias("spans")).join(
        spark.createDataFrame(list(texts.items()), "doc string, text string"), "doc")
    inside = arrays.select("doc", F.explode(resolve_merged(F.col("text"), F.col("spans"))).alias("s")).select(
        "doc", "s.start", "s.end", "s.entity_type", "s.source", F.size("s.members").cast("bigint").alias("members")).collect()
    assert sorted((r.doc, r.start, r.end, r.entity_type, r.source, r.members) for r in got) == sorted(map(tuple, inside))
    assert any(r.members > 1 for r in got)


def test_no_spans(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert intervals.merge_partial_table(none, ["doc"]).count() == 0


@pytest.mark.parametrize("gathered", [1 << 20, 20])
def test_islands_of_one_part_are_decided_in_it(spark, made, monkeypatch, gathered):
    """Only islands that may reach over parts are left for the rounds, and no row is lost or doubled."""
    _, rows = made
    monkeypatch.setattr(intervals, "GATHERED", gathered)
    lone = [("lone", 40 * i + 7 * (i % 3) + k, 40 * i + 7 * (i % 3) + k + 9, "a b c d e", "A", "made", k % 2, i) for i in range(500) for k in (0, 4, 8)]
    rows = [r for r in rows if r[0] in ("dense", "few")] + lone
    left = []
    over_parts = intervals._resolve_over_parts
    monkeypatch.setattr(intervals, "_resolve_over_parts", lambda spans, *a: left.append(spans.count()) or over_parts(spans, *a))
    got = intervals.resolve_table(spark.createDataFrame(rows, SCHEMA), ["doc"], 4).collect()
    want = [s for doc in {r[0] for r in rows} for s in best_first([r for r in rows if r[0] == doc])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert left[0] < len(rows) / 2
