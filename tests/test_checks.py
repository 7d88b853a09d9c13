"""Leak checks inside a row against a plain model, merged spans included."""

import random

from maskwright.functions.spans import SPANS
from maskwright.operators.resolve import resolve
from maskwright.plans.masking import mask_rows


def checked(spark, rows):
    """Per row of (text, [(start, end, source)]): the kept spans and the values reported."""
    made = [(i, t, [(a, b, t[a:b], "NAME", src, 0, k) for k, (a, b, src) in enumerate(spans)]) for i, (t, spans) in enumerate(rows)]
    df = resolve(spark.createDataFrame(made, f"id int, text string, spans {SPANS}"))
    out = mask_rows(df.withColumnRenamed("kept", "own"), detected=True).orderBy("id")
    return [([(k.start, k.end, len(k.members)) for k in r.own], {w.value for w in r.warnings}) for r in out.collect()]


def test_a_value_cut_by_a_merged_span_is_reported(spark):
    merged = [(0, 4, "regex"), (3, 6, "regex")]
    got = checked(spark, [
        ("ABCDEFGH, EFGH", [*merged, (10, 14, "regex")]),  # EF is hidden, GH is not
        ("ABCDEFGH, EF", [*merged, (10, 12, "regex")]),  # hidden as a whole
        ("ABCDEFGH, DEFG", [*merged, (10, 14, "regex")]),  # reaches into a span that was kept before merging
        ("ABCDEFGHx EFGH", [*merged, (10, 14, "manual")]),  # no whole token
        ("ABCDEFGH, EFGH", [*merged, (10, 14, "manual")]),
    ])
    assert [kept[0] for kept, _ in got] == [(0, 6, 1)] * 5
    assert [values for _, values in got] == [{"EFGH"}, set(), set(), set(), {"EFGH"}]


def model(text, spans, kept):
    """The values visible between placeholders, or cut by merged spans; found by trying every place."""
    first = []
    for s in sorted(range(len(spans)), key=lambda k: (spans[k][0] - spans[k][1], spans[k][0], k)):
        if all(spans[s][1] <= spans[k][0] or spans[k][1] <= spans[s][0] for k in first):
            first.append(s)
    tokens = {text[a:b] for a, b, src in spans if src == "manual"}
    covered = {c for a, b, _ in kept for c in range(a, b)}
    merged = {c for a, b, n in kept if n for c in range(a, b)}
    solid = {c for k in first for c in range(spans[k][0], spans[k][1])}
    word = lambda c: text[c].isalnum()
    out = set()
    for a, b, _ in [*spans, *kept]:
        value = text[a:b]
        for at in range(len(text) - len(value) + 1):
            end, place = at + len(value), set(range(at, at + len(value)))
            for wall, hit in ((covered, not place & covered), (solid, not place & solid and place & merged and not place <= merged)):
                glued = (at and at - 1 not in wall and word(at - 1) and word(at)) or (
                    end < len(text) and end not in wall and word(end) and word(end - 1))
                if text[at:end] == value and hit and not (value in tokens and glued):
                    out.add(value)
    return out


def test_leaks_in_rows_equal_the_model(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        text = "".join(rng.choice("aab ") for _ in range(14))
        places = {tuple(sorted(rng.sample(range(15), 2))) for _ in range(rng.randint(1, 4))}
        rows.append((text, [(a, min(b, a + 5), "manual" if rng.random() < 0.2 else "regex") for a, b in sorted(places)]))
    got = checked(spark, rows)
    assert [values for _, values in got] == [model(t, s, kept) for (t, s), (kept, _) in zip(rows, got, strict=True)]
    assert sum(any(n for _, _, n in kept) for kept, _ in got) > 50
