"""The ten operators against plain versions, with nulls, copies, ties and odd texts."""

import random

import numpy as np
import pytest
from brute import jaccard as brute_jaccard
from brute import masked, private as brute_private, quality as brute_quality, repeats as brute_repeats, sha, unigram
from pyspark.sql import functions as F

from maskwright.llm import bpe, components, extract, jaccard, licenses, maxent, mixing, private, quality, repeats, topk

random.seed(7)
LETTERS = [" ", "  ", "\n", "a", "B", "é", "ß", "1", "<|endoftext|>", "'s", "世", " ", "\t", ".", "!!", "the ", "word and ", "x" * 40, "\U0001f600", " z"]
PRIVATE = ["a", "b.c", "@", ".", "%", "1", "23", "255", "256", ".1", "+", " ", "-", "(", ")", "\n", "4111 1111 1111 1111", "4111111111111111",
           "é", "\U0001f600", "+1 743-555-0100", "x@y.co", "a@b.c_d@e.f", "1.2.3.4", "0001.02.3.4", "﷐", "378282246310005"]


def words(n):
    return ["".join(random.choice("abcdefgh") for _ in range(4)) for _ in range(n)]


def family(text, n, edits):
    out = []
    for i in range(n):
        own = list(text)
        for k in random.sample(range(len(own)), edits):
            own[k] = f"e{i}x{k}"
        out.append(" ".join(own))
    return out


SHARED = words(60)
TEXTS = [
    None, "", " \n", "a b", "a  b", "a b c", "x " * 300, " ".join(words(30) + SHARED + words(30)), " ".join(SHARED), " ".join(words(9) + SHARED),
    *family(words(120), 12, 2), *family(words(200), 6, 5), *["same text of some words in a row"] * 3,
    *("".join(random.choice(LETTERS) for _ in range(random.randint(0, 60))) for _ in range(60)),
    *("".join(random.choice(PRIVATE) for _ in range(random.randint(0, 40))) for _ in range(200)),
    "a@b" + ".c" * 20_000, "1" * 20_000, " " * 20_000, "a" * 20_000, "a@b.c " * 800,
    "so " * 40 + licenses.TEMPLATES[3][1] + " and" * 9, "Released under the MIT License.", "license " * 9,
]
ROWS = [(i, text, f"s{i % 4}" if i % 9 else None) for i, text in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns bear names that operators use themselves.
    return spark.createDataFrame(
        [(*r, 1, 2.0, "x") for r in ROWS], "doc_id long, text string, source string, size long, score double, spans string"
    ).repartition(5)


def test_quality(docs):
    got = {r[0]: tuple(r)[1:6] for r in quality.judge(docs).collect()}
    assert got == {i: brute_quality(text) for i, text, _ in ROWS}


def test_hosts_that_mostly_fail_are_rejected(spark):
    good = " ".join(words(80))
    rows = [(i, good if i % 10 == 0 else "bad", "junk") for i in range(100)] + [(100 + i, good if i % 10 else "bad", f"h{i % 5}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert kept == {i for i, text, host in rows if text == good and host != "junk"}
    assert {r.doc_id for r in quality.keep(docs).collect()} == kept


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()))
    source = {i: s for i, _, s in ROWS}
    assert len(rows) == len(ROWS) and sum({source[r.doc_id]: r.target for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))
    for name in set(source.values()):
        own = [r for r in rows if source[r.doc_id] == name]
        assert all(r.taken <= 3 * r["size"] for r in own) and own[0].target <= 3 * own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2
    times = {r.doc_id: r["count"] for r in mixing.repeat(docs).groupBy("doc_id").count().collect()}
    assert {r.doc_id: r.taken // r["size"] for r in rows if r.taken} == {k: n for k, n in times.items() if next(r["size"] for r in rows if r.doc_id == k)}


def test_bpe_round_trip(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(docs).collect()}
    listed = {r.doc_id: list(r.ids) for r in bpe.encode_ids(docs).collect()}
    for i, text, _ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))), i
        assert listed[i] == ids


def test_private(docs):
    got = {r.doc_id: r for r in private.detect(docs).collect()}
    assert {i: tuple(r)[1:6] for i, r in got.items()} == {i: brute_private(text) for i, text, _ in ROWS}
    hidden = {r.doc_id: r.text for r in private.redact(docs).collect()}
    assert hidden == {i: text if text is None else masked(text, got[i].spans) for i, text, _ in ROWS}


def test_jaccard(docs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs).collect()}
    assert [got[i] for i, _, _ in ROWS] == brute_jaccard([(i, text) for i, text, _ in ROWS])
    kept = jaccard.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _ in ROWS if got[i][0] == i]


def test_jaccard_splits_large_nodes(spark, monkeypatch):
    """Small limits make families and common passages take every way."""
    for name, value in (("NODE", 6), ("BLOCK", 8), ("SKETCH_BLOCK", 8)):
        monkeypatch.setattr(jaccard, name, value)
    common = words(40)
    texts = family(words(150), 40, 2) + [" ".join(words(100) + common + words(100)) for _ in range(60)] + family(words(90), 5, 1)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == brute_jaccard(rows)


def test_jaccard_of_slot_templates(spark, monkeypatch):
    """Pairs whose common shingles are all in large mixed nodes: texts of slots with a few values each."""
    monkeypatch.setattr(jaccard, "NODE", 4)
    values = [[words(12) for _ in range(5)] for _ in range(12)]
    texts = []
    for _ in range(400):
        text = sum((random.choice(v) for v in values), [])
        texts += [" ".join(text), " ".join(text[:62] + words(8) + text[70:])]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [got[i] for i, _ in rows] == brute_jaccard(rows)


def test_jaccard_recall_at_the_threshold():
    """Sets that share eight of ten shingles, or one of which holds the other, in nodes that are all split to the end."""
    rng, missed, n = np.random.default_rng(5), 0, 2000
    for k in range(n):
        keys = np.sort(rng.integers(0, 1 << 63, 90, np.uint64))
        a, b = (keys[:81], keys[9:]) if k % 2 else (keys, keys[18:])
        ends = []
        for own in (a, b):
            nodes = own[jaccard.picked(own, np.float64(len(own)), jaccard.runs(jaccard.RECALL), 0x51ED)].view(np.int64)
            for _ in range(1, jaccard.DEPTH):
                _, nodes = jaccard.paths(own, nodes.tolist())
            ends.append(nodes)
        missed += not len(np.intersect1d(*ends))
    assert missed <= 2 * (1 - jaccard.RECALL) * n


def test_survivors_tell_rows_of_one_key_apart(spark):
    long, other = " ".join(words(60)), " ".join(words(60))
    rows = [(1, long), (1, long), (1, other), (2, long), (3, ""), (3, ""), (None, other)]
    kept = jaccard.survivors(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, long), (1, other), (3, ""), (3, "")])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)] + [(200, k) for k in range(201, 260)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, **{k: 200 for k in range(200, 260)}}


def test_repeats(docs):
    assert {tuple(r) for r in repeats.repeated(docs).collect()} == brute_repeats([(i, text) for i, text, _ in ROWS])


def test_repeats_at_a_second_place(spark):
    """A passage twice in one text; another text has it, but only in the surroundings of the first place."""
    rows = []
    for k in range(0, 24, 2):
        shared, before, after = words(60), words(60), words(60)
        whole = before + shared + after
        rows += [(k, " ".join(whole + words(80) + shared + words(70))), (k + 1, " ".join(whole))]
    got = repeats.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {tuple(r) for r in got} == brute_repeats(rows)


def test_topk(spark):
    random.seed(3)
    rows = [(i, [float(np.float32(random.gauss(0, 0.2))) for _ in range(24)]) for i in range(300)]
    rows += [(300, None), (350, [float("nan")] * 24), (351, [1e300] * 24), (400, [0.1, 0.2]), (401, [0.5, 0.2]), (450, []), (7, rows[7][1]), (50, rows[50][1])]
    got = topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 50 == 0).collect()
    plain = [(i, np.floor(256 * np.array(v))) for i, v in rows if v and np.isfinite(v).all()]
    want = []
    for i, v in {i: v for i, v in plain if i % 50 == 0}.items():
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), j) for j, w in plain if j != i and len(w) == len(v))
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores[:5])]
    small = lambda rows: sorted(r for r in rows if abs(r[3]) < 1 << 60)
    assert small(map(tuple, got)) == small(want)


def test_maxent(spark):
    random.seed(4)
    grammar = {w: random.sample(words(30), 3) for w in words(20)}
    texts = []
    for _ in range(400):
        text = []
        for _ in range(20):
            w = random.choice(list(grammar))
            text += [w, random.choice(grammar[w])]
        texts.append(" ".join(text))
    rows = list(enumerate([None, "", "unseen", *texts]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in maxent.score(docs).collect()}
    for (i, _), (held, n, known, total, base) in zip(rows, unigram(rows), strict=True):
        assert tuple(got[i])[1:5] == (held, n, known, total) and got[i].base_score == pytest.approx(base)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_maxent_gives_probabilities(spark):
    """Over all next words, known and unseen by class, chances add up to one."""
    rows = spark.createDataFrame([(" ".join(words(40) + ["the", "of"] * 20), i % 2) for i in range(30)], "_text string, _half int")
    model, vocabulary = maxent.fit(spark, rows)
    size = 10**model.class_log
    held = np.zeros(maxent.CLASSES)
    for r in vocabulary.collect():
        at, there = model.head.find(np.array([r.word], np.int64).view(np.uint64))
        known = there[0] and model.head.rank[at[0]] < maxent.KNOWN
        own = maxent.END_CLASS if np.uint64(np.int64(r.word).view(np.uint64)) == maxent.END else (
            model.head.company[model.head.rank[at[0]]] if known else maxent.COMPANY_CLASSES + r.ending)
        held[own] += r.c + 1
    inner = np.delete(held + 1 - size, maxent.END_CLASS)
    assert np.abs(inner).max() < 1e-6
    scores = maxent.class_scores(model.weights, model.bias, np.zeros((4, 1), np.int64))
    assert np.exp(scores).sum() == pytest.approx(1, abs=1e-5)


def test_maxent_tells_words_of_a_class_apart_by_what_comes_before(spark, monkeypatch):
    """Chances of a class's words add up to one in every context, follow counts before learning, and differ after."""
    monkeypatch.setattr(maxent, "company_classes", lambda profile: np.zeros(len(profile), np.int64))
    rng = random.Random(8)
    names, ends = [f"n{i}" for i in range(12)], [f"e{i}" for i in range(12)]
    rows = []
    for i in range(300):
        pairs = [rng.randrange(12) for _ in range(30)]
        rows.append((" ".join(f"{names[k]} {ends[k]}" for k in pairs), i % 2))
    model, _ = maxent.fit(spark, spark.createDataFrame(rows, "_text string, _half int"))
    place = np.arange(len(model.head.hash))
    klass = np.where(model.head.hash == maxent.END, maxent.END_CLASS, model.head.company[model.head.rank])
    texts = maxent.Texts(0, np.frombuffer(b"n3 e3", np.uint8), np.array([0, 5]))
    t = maxent.tokens(texts)
    at, there, ids = model.head.ids(t)
    features = maxent.contexts(t, ids)[:, 1:2]
    rivals = place[klass == klass[at[1]]]
    assert there.all() and len(rivals) > 1
    spot = np.repeat(features, len(rivals) + 1, axis=1)
    leaf = np.append(rivals, len(model.head.hash) + klass[at[1]])
    for inner in (np.zeros_like(model.inner), model.inner):
        assert np.exp(maxent.word_logs(model.tree, inner, spot, leaf)).sum() == pytest.approx(1, abs=1e-5)
    by_count = maxent.word_logs(model.tree, np.zeros_like(model.inner), spot, leaf)[:-1]
    assert by_count / np.log(10) == pytest.approx(np.log10(model.head.count[rivals] + 1.0) - model.class_log[klass[at[1]]], abs=1e-4)
    own = list(rivals).index(at[1])
    learned = maxent.word_logs(model.tree, model.inner, spot, leaf)
    assert learned[own] > by_count[own] + 0.3 and learned.argmax() == own


def test_maxent_takes_its_frequent_words_by_rank(spark, monkeypatch):
    """Also where one count has more words than there is room for."""
    monkeypatch.setattr(maxent, "HEAD", 12)
    text = " ".join(f"w{i}" for i in range(40)) + " a a a b b"
    model, vocabulary = maxent.fit(spark, spark.createDataFrame([(text, 0), ("a b", 1)], "_text string, _half int"))
    ranked = sorted(vocabulary.collect(), key=lambda r: (-r.c, r.word))[:12]
    assert sorted(model.head.hash.view(np.int64).tolist()) == sorted(r.word for r in ranked)
    assert sorted(model.head.count.tolist()) == sorted(r.c for r in ranked)


def test_licenses(docs):
    want = {}
    for i, text, _ in ROWS:
        own = licenses.template_words(text or "")
        for name, body in licenses.TEMPLATES:
            template = licenses.template_words(body)
            needed = set(licenses.template_shingles(template))
            length = min(x for x in licenses.LENGTHS if len(template) <= x)
            for at in range(0, len(own), length // 2):
                share = len(needed & set(licenses.template_shingles(own[at : at + length + length // 2]))) / len(needed)
                if share >= 0.8:
                    want[i, name] = max(want.get((i, name), (0, 0)), (share, -at))
    got = {(r.doc_id, r.license): (r.containment, -r.word) for r in licenses.scan(docs).collect()}
    assert got == want and len(want) == 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "<p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div id="cookie-notice">We use cookies, do you agree?</div>
<div class="wrap"><div class="col"><div class="post"><h2>Title &amp; more</h2>
<p>One long paragraph, with commas, and <b>more</b>
   words to make it long enough to score well, yes.<br>
<p>Two: a long paragraph with <a href="x>y">a link</a>, and 1 &lt; 2&nbsp;too.<ul><li>item one</li><li>item two</ul><p>Short.</div>
<div class="related"><ul><li><a>other page</a><li><a>another page</a></ul></div></div>
<div class="sidebar"><p>Side text that is long enough, surely, to score some points here.</p></div></div>
<div id="comments"><p>I think, this is, a comment which is long, and long, and long.</p></div><!-- end --><form>Mail <input></form><footer>&copy; us</footer>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain words, without any markup at all, stay"), (5, "u", "<p>a<p>b<script>x"), (1, "u", PAGE)]
    got = extract.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text long")).collect()
    text = "Title & more\nOne long paragraph, with commas, and more words to make it long enough to score well, yes.\n" \
        "Two: a long paragraph with a link, and 1 < 2 too.\nitem one\nitem two\nShort."
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == text and by[1].n_chars == len(text)
    assert (by[2].text, by[3].text, by[4].text, by[5].text) == ("", "", rows[3][2], "a\nb")


PROSE = "A paragraph that is long enough, with commas, to be read as the text of the page."


@pytest.mark.parametrize("before", [
    "<svg class='icon'/>", "<math/>", "<svg class='icon'/><svg><path d='x'/></svg>", "<svg viewBox='0 0 1 1'><path>", "<div><svg></div>",
    "<object data=x>", "<object data=x><div><object></object></div>",
    "<svg><title>no</title><svg>no</svg>no</svg>", "<svg><foreignObject><div>no</div></foreignObject>no</svg>", "<svg><style>p{}/*<p>*/</style>no</svg>",
    "<object><p>no</p></object>",
])
def test_extraction_after_svg_and_the_like(before):
    """Elements closed in themselves or not at all don't take the rest of the page; closed ones go whole."""
    page = f"<body>{before}<p>{PROSE}</p><p>{PROSE}</p></body>"
    assert extract.main_text(page) == f"{PROSE}\n{PROSE}"
    assert extract.main_text(page.replace("</body>", "<svg><path/></svg></body>")) == f"{PROSE}\n{PROSE}"


def test_extraction_of_a_page_in_a_form():
    form = "<form><label>Your name, your mail, and some words to us</label><input></form>"
    assert extract.main_text(f"<body><form action=x.aspx><nav>Menu</nav><div><p>{PROSE}</p><p>{PROSE}</p></div></form></body>") == f"{PROSE}\n{PROSE}"
    assert extract.main_text(f"<body><div><p>{PROSE}</p><p>{PROSE}</p>{form}</div></body>") == f"{PROSE}\n{PROSE}"


OPERATORS = {
    "quality": quality.judge, "keep": quality.keep, "mix": mixing.mix, "repeat": mixing.repeat, "bpe": bpe.digests, "private": private.detect,
    "redact": private.redact, "jaccard": jaccard.join, "survivors": jaccard.survivors, "repeats": repeats.repeated, "maxent": maxent.score, "licenses": licenses.scan,
}


CLASHING = ["class", "_key", "_rep", "__class", "_bad", "_is", "__none", "__source", "__last", "__copy", "__spans", "_row", "_text", "size", "_merit"]


@pytest.mark.parametrize("stage", [quality.keep, jaccard.survivors, private.redact, mixing.repeat])
def test_stages_keep_columns_of_any_name(spark, stage):
    schema = "doc_id long, text string, source string" + "".join(f", `{c}` string" for c in [*CLASHING, "a.b"])
    good = [(1000 + i, " ".join(words(80)), "good") for i in range(9)]
    rows = [(*r, *(f"{c} {r[0]}" for c in [*CLASHING, "a.b"])) for r in ROWS + good] + [(ROWS[9][0], *ROWS[10][1:], *([None] * (len(CLASHING) + 1)))]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    out = stage(docs)
    plain = stage(docs.select("doc_id", "text", "source"))
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(map(repr, (r[:3] for r in got))) == sorted(map(repr, map(tuple, plain.collect()))) and got
    given = {(r[0], r[3:]) for r in rows}
    assert all((r[0], r[3:]) in given for r in got)


def test_mixing_prefers_long_texts(spark):
    """Inclusion probabilities follow merit: the copies' words by size class come near what each class is due."""
    rows = [(i, " ".join(["w"] * (3 if i % 2 else 700)), "ab"[i % 4 // 2]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    for name, weight in (("a", 5), ("b", 2)):
        own = [r for r in got if rows[r.doc_id][2] == name]
        assert own[0].target == pytest.approx(sum(r["size"] for r in got) * weight / 7)
        short, long = ([r.taken / r["size"] for r in own if r["size"] == n] for n in (3, 700))
        assert sum(long) / len(long) == pytest.approx(own[0].target / sum(r["size"] for r in own), abs=0.02)
        # Two binary digits against ten.
        assert sum(short) / len(short) == pytest.approx(sum(long) / len(long) / 5, abs=0.04)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows_and_null_keys(spark, name):
    schema = "doc_id long, text string, source string"
    assert OPERATORS[name](spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None), (None, "a b", None), (None, "a b", None), (5, "a b", "s")]
    out = OPERATORS[name](spark.createDataFrame(rows, schema)).count()
    per_row = name in ("quality", "mix", "bpe", "private", "redact", "jaccard", "maxent")
    assert out == 4 if per_row else out <= (12 if name == "repeat" else 4)


def test_words_of_the_head_are_found_by_their_top_bits():
    r = np.random.default_rng(3)
    for hashes in (np.zeros(1, np.uint64), np.array([1, 2, 3, 1 << 63, 2**64 - 1], np.uint64), np.unique(r.integers(0, 1 << 64, 5000, np.uint64))):
        head = maxent.Head(hashes, np.ones(len(hashes)), np.arange(len(hashes)))
        asked = np.concatenate((hashes, hashes + np.uint64(1), r.integers(0, 1 << 64, 500, np.uint64)))
        at, there = head.find(asked)
        place = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
        assert len(head.begin) == 1 << maxent.TOP_BITS
        assert (at == place).all() and (there == (hashes[place] == asked)).all()
