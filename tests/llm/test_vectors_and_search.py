"""Whitening, lexical search and the compression classifier against plain versions."""

import math
import random
import zlib

import numpy as np
import pytest
from brute import lexical as brute_lexical, whitened as brute_whitened

from maskwright.llm import bidiagonal, compression, lexical, whitening

random.seed(11)
ODD = [None, "", " ", ".", "ABC abc Abc", "a" * 50_000, "é É ß 世界 世 a1b2 A1B2", "a.b-c_d\x00e\x7ff", "x\U0001f600y x", "the " * 30_000, "\n\nthe\n"]
VOCABULARY = ["the", "of", "tion", "ing", "é", "世", "a1", "zz", "rare", "ABC", "Of", "THE", "thé"]


def sentence(n):
    return "".join(random.choice(VOCABULARY) + random.choice([" ", ", ", "\n", "-"]) for _ in range(n))


@pytest.mark.parametrize("matrix", [
    np.random.default_rng(1).normal(size=(7, 7)), np.eye(6), np.zeros((4, 4)), np.ones((5, 5)), np.diag([3.0, 3, 3, 1e-9, 0]),
    np.diag(np.ones(5), 1), 1e100 * np.random.default_rng(2).normal(size=(4, 4)), 1e-100 * np.eye(3),
], ids=range(8))
def test_bidiagonal_solver(matrix):
    values, vectors = bidiagonal.largest(matrix, len(matrix))
    size = np.abs(matrix).max(initial=0)
    if not size:
        assert len(values) == 0
        return
    small = matrix / size
    want = np.linalg.svd(small, compute_uv=False) ** 2
    kept = want > 1e-28
    assert values / size / size == pytest.approx(want[kept], rel=1e-12)
    assert vectors.T @ vectors == pytest.approx(np.eye(kept.sum()), abs=1e-13)
    assert small.T @ (small @ vectors) == pytest.approx(vectors * want[kept], abs=1e-13)


def test_small_singular_values_keep_their_digits():
    a, b = np.array([1.0, 1e-8, 1e-16]), np.array([0.5, 0.25e-8])
    got = bidiagonal.squares(a, b)
    assert got.prod() == pytest.approx((a**2).prod(), rel=1e-13)  # the determinant, beyond what its largest value rounds


def check_whitened(spark, rows, **names):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, whitened int, dim int").repartition(7)
    got = whitening.whiten(table).collect()
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v, *_ in rows]
    want = brute_whitened(rows)
    assert len(got) == sum(map(len, want.values()))
    found = {}
    for r in got:
        assert r.identity_error < 1e-9
        found.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, abs(r.whitened), r.explained))
    assert found.keys() == want.keys()
    for key in want:
        for a, b in zip(sorted(found[key]), sorted(want[key]), strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-7, abs=1e-7)
    return got


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12)
    rows = [(i, [float(c) for c in v], "x", 1, 2) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[5][1], "x", 1, 2) for i in range(40)]  # copies count once in the fit
    rows += [(None, rows[7][1], None, None, None), (7, rows[9][1], "x", 1, 2)]  # no key; a repeated key
    rows += [(2000, None, "x", 1, 2), (2001, [], "x", 1, 2), (2002, [1.0, None] * 6, "x", 1, 2), (2003, [math.nan] * 12, "x", 1, 2), (2004, [math.inf] * 12, "x", 1, 2)]
    got = check_whitened(spark, rows)
    assert {r.vec_id for r in got}.isdisjoint(range(2000, 2005))


def test_whitening_of_little_variance(spark):
    line = [(i, [float(i % 4), 2.0 * (i % 4), 1.0], "", 0, 0) for i in range(40)]
    assert {r.component for r in check_whitened(spark, line)} == {1}
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(one).count() == 0
    assert whitening.whiten(one.limit(0)).count() == 0


def test_whitening_of_several_lengths_and_long_entries(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=3 + i % 2)]) for i in range(60)] + [(100, [1e300, 0.0, -1e300]), (101, [3e9, 1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    four = [(i, v) for i, v in rows if len(v) == 4]
    want = brute_whitened(four)
    assert {(r.vec_id, r.component): r.deviation for r in got if r.vec_id % 2 and r.vec_id < 100} == {k: v[0][1] for k, v in want.items()}
    assert all(r.deviation is None for r in got if r.vec_id == 100)


@pytest.fixture(scope="module")
def texts():
    rows = list(enumerate(ODD)) + [(100 + i, sentence(random.randint(0, 60))) for i in range(150)]
    rows += [(300 + i, "the rare zz of tion") for i in range(40)] + [(None, "rare rare zz"), (7, "zz the zz")]  # ties; no key; a repeated key
    return rows


@pytest.mark.parametrize("limits", [{}, {"TERMS": 7, "CELLS": 50}], ids=["one block", "many blocks"])
def test_lexical_search(spark, monkeypatch, texts, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    items = [(1, "The rare, the ZZ."), (2, None), (3, ""), (4, "tion tion tion of"), (4, "of"), (None, "é 世"), (5, "nowhere"), (6, " ".join(VOCABULARY)), (8, "a1b2 世界 thé")]
    docs = spark.createDataFrame([(*r, 1, "s", 0) for r in texts], "doc_id long, text string, rank int, item string, score int").repartition(6)
    asked = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, number int, doc_id int")
    got = [tuple(r) for r in lexical.search(docs, asked).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute_lexical(texts, items), key=key)


def test_lexical_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("text is null"), items).count() == 0
    assert [tuple(r)[:3] for r in lexical.search(docs, items).collect()] == [(1, 1, 1)]


def quality_text(good):
    words = ["".join(random.choice(["an", "er", "in", "tion", "th", "es", "ly"]) for _ in range(random.randint(1, 4))) for _ in range(random.randint(20, 300))]
    return " ".join(words) + "." if good else " ".join(f"{w.upper()}!!" for w in words)


@pytest.fixture(scope="module")
def graded():
    return [(i, quality_text(i % 3 > 0), int(i % 3 > 0)) for i in range(900)]


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_compression_classifier(spark, graded):
    odd = [(5000, None), (5001, ""), (5002, "x"), (5003, "é" * 100_000), (None, graded[1][1]), (1, graded[1][1])]
    docs = spark.createDataFrame([(i, t, "s", 1, 2.0) for i, t, _ in graded] + [(*r, None, None, None) for r in odd],
                                 "doc_id long, text string, key string, label int, difference double").repartition(5)
    labels = spark.createDataFrame(
        [(i, q, 0, "") for i, _, q in graded] + [(5002, 7, 0, ""), (None, 1, 0, ""), (5003, None, 0, ""), (1, 1, 0, "")],
        "doc_id long, quality int, toxic int, text string",
    )
    got = compression.classify(docs, labels).collect()
    assert len(got) == len(graded) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    score = {r.doc_id: r.predicted for r in got}
    judged = [(score[i], q) for i, _, q in graded if held(i)]
    assert sum(a == b for a, b in judged) / len(judged) > 0.98
    assert len({r.score for r in got if r.doc_id in (5000, 5001)}) == 1 and len({r.score for r in got if r.doc_id in (1, None)}) == 1
    again = {r.doc_id: r.score for r in compression.classify(docs.repartition(3), labels).collect()}
    assert again == {r.doc_id: r.score for r in got}


def test_held_out_labels_teach_nothing(spark, graded):
    docs = spark.createDataFrame([r[:2] for r in graded], "doc_id long, text string")
    labels = [(i, q) for i, _, q in graded]
    wrong = [(i, 1 - q if held(i) else q) for i, q in labels]
    a, b = ({r.doc_id: r.score for r in compression.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (labels, wrong))
    assert a == b


def test_compression_with_few_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, "other text"), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in compression.classify(docs, none).collect()} == {0.5}
    assert compression.classify(docs.limit(0), none).count() == 0
    few = spark.createDataFrame([(i, 1) for i in range(1, 4)] + [(2, 0)], "doc_id long, quality int")
    assert all(0.5 <= r.score <= 1 for r in compression.classify(docs, few).collect())


def test_curve_follows_the_counts():
    x = np.linspace(-0.1, 0.1, 21)
    share = 1 / (1 + np.exp(-(40 * x + 0.5)))
    slope, offset = compression.curve(x, 1e5 * share, 1e5 * (1 - share))
    assert (slope, offset) == pytest.approx((40, 0.5), rel=1e-2)


def test_whole_texts_are_compressed():
    tail = b"THE END!! " * 60
    sizes = compression.Sizes(b"")
    body = random.randbytes(5000)
    assert sizes.of(memoryview(body + tail)) > sizes.of(memoryview(body))
    assert sum(len(x) for x in compression.chunks(memoryview(body + tail))) == 5600
