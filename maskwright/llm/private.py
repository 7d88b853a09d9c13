"""Personal data in texts by weak supervision, in Spark's own expressions only.

Patterns propose spans. Five labelers vote on each: the strict rule, the shape,
a gazetteer, words before it that speak for it, and words that speak against.
How often each pattern of votes occurs is counted over all texts; expectation
maximisation on these counts estimates how reliable each labeler is, and its
verdicts train the final classifier. Spans of the strict rules always stay;
the classifier decides about looser ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.spans import MARK, fence, scratch
from maskwright.llm.rows import boxed

KINDS = ("email", "ip", "card", "phone")
#: Characters before a span that the labelers see.
CONTEXT = 24
EM_ROUNDS = 25
TRAINING_ROUNDS = 300
STEP = 0.5
#: Looser spans are added from this probability on.
THRESHOLD = 0.9

# The strict patterns. A run is matched from its beginning or from
# the end of the match before (\G), so that each character is visited few times;
# possessive loops neither backtrack nor recurse.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser forms.
EMAIL_LOOSE = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]++)++"
IP_LOOSE = r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])"
PHONE_LOOSE = r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

# Gazetteers and context words.
TOP_DOMAINS = "com org net edu gov mil int info biz io dev app ai de fr es it nl uk eu us ca au jp cn in br ru ch at be se no dk fi pl pt example test".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 370 371 372 380 385 420 421 852 886 966 971 972".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|60|64|65|62|35)"
CUES = {
    "email": r"mail|contact|write|reach|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|addr|login|from",
    "card": r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|pay",
    "phone": r"phone|call|tel|fax|mobile|whatsapp|contact|anruf|llam",
}
AGAINST = r"(?:version|build|release|order|isbn|issn|doi|serial|ticket|invoice|part|model|ref|id|no\.?|#)[\s:#=]*$"

SPAN = "array<struct<kind:int,start:int,end:int,value:string,before:string,strict:boolean>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each element, the sum (or other fold from 0) of those before it.

    Blocks of about the square root of the length keep the work below
    quadratic, and no array grows step by step.
    """

    def fold(items: Column) -> Column:
        return F.aggregate(items, F.lit(0), add)

    def inner(x: Column) -> Column:
        n, width = x["n"], x["width"]
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(n) - 1) / width).cast("int")), lambda b: fold(F.slice(n, b * width + 1, width))
        )
        return let(
            F.struct(n.alias("n"), width.alias("width"), let(
                blocks, lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda b: fold(F.slice(s, F.lit(1), b)))
            ).alias("before")),
            lambda y: F.transform(
                F.sequence(F.lit(0), F.size(y["n"]) - 1),
                lambda i: add(
                    F.get(y["before"], F.floor(i / y["width"]).cast("int")),
                    fold(F.slice(y["n"], F.floor(i / y["width"]).cast("int") * y["width"] + 1, (i % y["width"]).cast("int"))),
                ),
            ),
        )

    return let(F.struct(numbers.alias("n"), F.ceil(F.sqrt(F.size(numbers))).cast("int").alias("width")), inner)


def find(text: Column, pattern: str, kind: str, strict: bool, cheap: Column, valid: Callable[[Column], Column]) -> Column:
    """Matches of ``pattern`` in ``text`` (free of marks) that are ``valid``, as SPAN.

    Each match is put between marks and the text split at them: every second
    piece is a match, and the lengths of the pieces give the offsets.
    """
    none = F.expr(f"cast(array() as {SPAN})")

    def spans(pieces: Column) -> Column:
        found = let(
            F.struct(pieces.alias("p"), running(F.transform(pieces, lambda x: F.length(x)), lambda a, b: a + b).alias("at")),
            lambda x: F.transform(
                F.sequence(F.lit(1), F.size(x["p"]) - 1, F.lit(2)),
                lambda i: F.struct(
                    F.lit(KINDS.index(kind)).alias("kind"),
                    F.get(x["at"], i).alias("start"),
                    (F.get(x["at"], i) + F.length(F.get(x["p"], i))).alias("end"),
                    F.get(x["p"], i).alias("value"),
                    F.right(F.get(x["p"], i - 1), F.lit(CONTEXT)).alias("before"),
                    F.lit(strict).alias("strict"),
                ),
            ),
        )
        return F.when(F.size(pieces) > 1, F.filter(found, lambda s: valid(s["value"]))).otherwise(none)

    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    return F.when(cheap, let(F.split(marked, MARK, -1), spans)).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def octets(value: Column) -> Column:
    """Whether all parts are at most 255, whatever zeros lead them."""
    bare = F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    return F.forall(bare, lambda x: F.when(F.length(x) <= 3, F.coalesce(x.try_cast("int"), F.lit(0)) <= 255).otherwise(False))


def luhn(number: Column) -> Column:
    """Whether the digits pass the check digit rule."""
    reverse = F.reverse(number)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def card_of(low: int, high: int) -> Callable[[Column], Column]:
    return lambda value: let(digits(value), lambda n: F.when(F.length(n).between(low, high), luhn(n)).otherwise(False))


def yes(value: Column) -> Column:
    return F.length(value) > 0


def candidates(text: Column) -> Column:
    """Strict and loose spans of a text without marks; loose ones never touch a strict one."""
    strict = F.concat(
        find(text, EMAIL, "email", True, text.contains("@"), yes),
        find(text, IP, "ip", True, text.contains("."), octets),
        find(text, CARD, "card", True, F.lit(True), card_of(16, 19)),
        find(text, PHONE, "phone", True, text.contains("+"), lambda v: F.length(digits(v)).between(8, 15)),
    )
    loose = F.concat(
        find(text, EMAIL_LOOSE, "email", False, text.rlike(r"(?i)[\[(]at[\])]"), yes),
        find(text, IP_LOOSE, "ip", False, text.rlike(r"[0-9a-fA-F]:[0-9a-fA-F]{1,4}:[0-9a-fA-F]{1,4}:"), yes),
        find(text, CARD, "card", False, F.lit(True), card_of(13, 15)),
        find(text, PHONE_LOOSE, "phone", False, text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), yes),
    )
    return let(
        F.struct(strict.alias("s"), loose.alias("l")),
        lambda x: F.concat(x["s"], F.filter(
            x["l"], lambda c: ~F.exists(x["s"], lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        )),
    )


def by_kind(kind: Column, choices: dict[str, Column]) -> Column:
    out = F.lit(False)
    for name, choice in choices.items():
        out = F.when(kind == KINDS.index(name), choice).otherwise(out)
    return out


def votes(span: Column) -> list[Column]:
    """The five labelers."""
    kind, value, before = span["kind"], span["value"], F.lower(span["before"])
    number = digits(value)
    return [
        span["strict"],
        by_kind(kind, {
            "email": value.rlike(r"\.\x20?[A-Za-z]{2,}$") & ~value.startswith("."),
            "ip": value.contains(":") | ~value.rlike(r"(^|\.)0[0-9]"),
            "card": value.rlike(r"^[0-9]+$|^[0-9]{4}([\x20-])[0-9]{4,6}\1[0-9]{4,5}(\1[0-9]{1,4})*$"),
            "phone": F.length(number).between(10, 13),
        }),
        by_kind(kind, {
            "email": F.lower(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS),
            "ip": ~value.rlike(r"^(?:0+|127|255)\."),
            "card": number.rlike(ISSUERS),
            "phone": number.rlike("^(?:" + "|".join(CALLING_CODES) + ")") & value.startswith("+"),
        }),
        by_kind(kind, {name: before.rlike(cue) for name, cue in CUES.items()}),
        before.rlike(AGAINST),
    ]


def features(span: Column) -> Column:
    """The classifier's inputs: a constant, the votes, the kind, and two of form."""
    kind, value = span["kind"], span["value"]
    flags = [
        F.lit(True), *votes(span), *(kind == i for i in range(len(KINDS))),
        F.length(value) >= 14, value.rlike(r"[\x20().-]"),
    ]
    return F.array(*(F.when(x, 1.0).otherwise(0.0) for x in flags))


VOTES = 5
FEATURES = 1 + VOTES + len(KINDS) + 2


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector(size: int, of: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(*(F.lit(i) for i in range(size))), of)


def reliabilities(patterns: Column) -> Column:
    """Expectation maximisation over counted patterns: struct ``prior``, ``hit``, ``slip``.

    ``hit`` and ``slip`` are each labeler's chance to vote for a true and for a
    false span; half a vote either way keeps them from 0 and 1.
    """
    start = F.struct(
        F.lit(0.5).alias("prior"),
        F.array(*(F.lit(x) for x in (0.8, 0.8, 0.8, 0.4, 0.1))).alias("hit"),
        F.array(*(F.lit(x) for x in (0.2, 0.4, 0.4, 0.2, 0.4))).alias("slip"),
    )

    def step(model: Column, _: Column) -> Column:
        weighed = F.transform(patterns, lambda p: F.struct(
            p["x"].alias("x"), (p["n"] * belief(model, p["x"])).alias("t"), p["n"].cast("double").alias("n")
        ))

        def update(w: Column) -> Column:
            true = F.aggregate(w, F.lit(0.0), lambda s, p: s + p["t"])
            all_ = F.aggregate(w, F.lit(0.0), lambda s, p: s + p["n"])
            return F.struct(
                ((true + 0.5) / (all_ + 1)).alias("prior"),
                vector(VOTES, lambda j: (
                    F.aggregate(w, F.lit(0.5), lambda s, p: s + p["t"] * F.get(p["x"], j + 1)) / (true + 1)
                )).alias("hit"),
                vector(VOTES, lambda j: (
                    F.aggregate(w, F.lit(0.5), lambda s, p: s + (p["n"] - p["t"]) * F.get(p["x"], j + 1)) / (all_ - true + 1)
                )).alias("slip"),
            )

        return let(weighed, update)

    return F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), start, step)


def belief(model: Column, x: Column) -> Column:
    """The chance that a span with these votes is true."""

    def side(rates: Column) -> Column:
        return F.aggregate(
            F.zip_with(rates, F.slice(x, 2, VOTES), lambda r, v: F.when(v > 0, r).otherwise(1 - r)), F.lit(1.0), lambda s, r: s * r
        )

    true, false = model["prior"] * side(model["hit"]), (1 - model["prior"]) * side(model["slip"])
    return true / (true + false)


def trained(patterns: Column, model: Column) -> Column:
    """Weights of the logistic classifier that follows the beliefs, by gradient steps."""

    def fit(p: Column) -> Column:
        total = F.aggregate(p, F.lit(1e-9), lambda s, q: s + q["n"])
        zero = F.array(*(F.lit(0.0) for _ in range(FEATURES)))

        def step(w: Column, _: Column) -> Column:
            error = F.transform(p, lambda q: F.struct(
                q["x"].alias("x"), (q["n"] * (q["t"] - 1 / (1 + F.exp(-dot(w, q["x"])))) / total).alias("e")
            ))
            return let(error, lambda e: vector(FEATURES, lambda j: F.get(w, j) + STEP * F.aggregate(
                e, F.lit(0.0), lambda s, q: s + q["e"] * F.get(q["x"], j)
            )))

        return F.aggregate(F.sequence(F.lit(1), F.lit(TRAINING_ROUNDS)), zero, step)

    judged = F.transform(patterns, lambda p: F.struct(
        p["x"].alias("x"), p["n"].cast("double").alias("n"), belief(model, p["x"]).alias("t")
    ))
    return let(judged, fit)


def classifier(docs: DataFrame, text: str = "text") -> list[float]:
    """Weights learned from all texts: at most 2 ^ 11 counted patterns meet in one row."""
    spans = docs.select(fence(candidates(scratch(F.coalesce(F.col(text), F.lit(""))))).alias("s"))
    counted = spans.select(F.explode("s").alias("s")).select(features(F.col("s")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    one = counted.agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("p"))
    with_model = one.withColumn("m", fence(reliabilities(F.col("p"))))
    return list(with_model.select(trained(F.col("p"), F.col("m")).alias("w")).first()["w"])


def chosen(text: Column, weights: list[float]) -> Column:
    """Strict spans and the looser ones that the classifier accepts."""
    def accept(span: Column) -> Column:
        score = sum((F.lit(w) * F.get(span, F.lit(i)) for i, w in enumerate(weights)), F.lit(0.0))
        return 1 / (1 + F.exp(-score)) >= THRESHOLD

    return F.filter(candidates(text), lambda s: F.when(s["strict"], True).otherwise(let(features(s), accept)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by kind, then start, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, counts of strict spans by kind, ``base_sha256`` and ``spans``: one row per row.

    Offsets are code points of the whole text. Null texts are empty; repeated
    rows each give a row; other columns are ignored; no rows give no rows.
    """
    weights = classifier(docs, text)
    rows = docs.select(F.col(key).alias("_key"), fence(chosen(scratch(F.coalesce(F.col(text), F.lit(""))), weights)).alias("_spans"))
    rows = rows.withColumn("_strict", F.filter("_spans", lambda s: s["strict"]))

    def count(i: int) -> Column:
        return F.size(F.filter("_strict", lambda s: s["kind"] == i)).cast("long")

    return rows.select(
        F.col("_key").alias(key), *(count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)),
        F.sha2(listed(F.col("_strict")), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each stretch of overlapping spans replaced by its first span's kind."""
    names = F.array(*(F.lit(f"[{kind.upper()}]") for kind in KINDS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def rebuild(x: Column) -> Column:
        s, reach = x["s"], x["reach"]
        firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i)["start"] >= F.get(reach, i))
        return let(F.struct(s.alias("s"), reach.alias("reach"), firsts.alias("f")), lambda y: F.concat(
            F.array_join(F.transform(y["f"], lambda i: F.concat(
                F.substring(text, F.get(y["reach"], i) + 1, F.get(y["s"], i)["start"] - F.get(y["reach"], i)),
                F.get(names, F.get(y["s"], i)["kind"]),
            )), ""),
            F.substring(text, F.array_max(F.transform(y["s"], lambda s: s["end"])) + 1, F.length(text)),
        ))

    def go(s: Column) -> Column:
        return let(F.struct(s.alias("s"), running(F.transform(s, lambda p: p["end"]), lambda a, b: F.greatest(a, b)).alias("reach")), rebuild)

    return F.when(F.size(spans) > 0, let(order, go)).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by placeholders; null stays null.

    Other columns stay as they are, whatever their names.
    """
    weights = classifier(docs, text)
    rows = boxed(docs, _text=F.col(text), _spans=fence(chosen(scratch(F.coalesce(F.col(text), F.lit(""))), weights)))
    hidden = masked(F.col("_text"), F.col("_spans"))
    return rows.select(*(hidden.alias(c) if c.lower() == text.lower() else F.col("_row").getField(c).alias(c) for c in docs.columns))
