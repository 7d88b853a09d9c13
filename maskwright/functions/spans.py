"""Spans as columns: finding matches with their offsets inside Catalyst.

``regexp_extract_all`` gives values but no offsets. Every match is therefore
wrapped in a noncharacter, the text is split on it, and the lengths of the
pieces give the offsets (in code points, as Spark's ``length`` counts them).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = (
    "struct<start:int,end:int,value:string,entity_type:string,"
    "source:string,priority:int,rule:int>"
)
SPANS = f"array<{SPAN}>"
HIT = "struct<start:int,value:string,after:string>"

MARK = "﷐"  # noncharacters: never assigned, so never meaningful text
AFTER = "﷑"
#: Up to so many numbers are summed one by one.
FEW = 32
#: A match and the text right after it, for rules that choose their own end.
CONTEXT = rf"(?=((?s:.{{0,24}})))"


def no_spans() -> Column:
    return F.expr(f"cast(array() as {SPANS})")


def no_hits() -> Column:
    return F.expr(f"cast(array() as array<{HIT}>)")


def marked(text: Column) -> Column:
    """Whether ``text`` really holds one of the two marks."""
    return text.contains(MARK) | text.contains(AFTER)


def scratch(text: Column) -> Column:
    """``text`` with the two marks replaced one for one, so they are free."""
    return F.when(marked(text), F.translate(text, MARK + AFTER, "￾￾")).otherwise(text)


def hits(text: Column, pattern: str, replacement: str = f"{MARK}$0{MARK}") -> Column:
    """Every match of ``pattern`` with its start and the text after it.

    ``replacement`` says what the match becomes: the text between two marks is
    the value; what follows an AFTER mark inside it is look-ahead text.
    """
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(replacement)), MARK, -1)

    size = lambda piece: F.length(F.substring_index(piece, AFTER, 1))

    def hit(start: Column, piece: Column) -> Column:
        return F.struct(
            start.alias("start"), F.substring_index(piece, AFTER, 1).alias("value"),
            F.when(piece.contains(AFTER), F.substring_index(piece, AFTER, -1)).alias("after"),
        )

    def found(parts: Column) -> Column:
        return let(
            F.struct(parts.alias("p"), running(F.transform(parts, size)).alias("at")),
            lambda x: F.transform(
                F.sequence(F.lit(1), F.size(x["p"]) - 1, F.lit(2)),
                lambda i: let(F.get(x["p"], i), lambda piece: hit(F.get(x["at"], i), piece)),
            ),
        )

    # Without a match there is one piece, the text; with one match, what is before it is its start.
    one = lambda parts: F.array(hit(size(F.get(parts, 0)), F.get(parts, 1)))
    return let(pieces, lambda parts: F.when(F.size(parts) == 3, one(parts)).when(F.size(parts) > 1, found(parts)).otherwise(no_hits()))


def running(numbers: Column, add=lambda a, b: a + b) -> Column:
    """For each number, the sum (or other fold from 0) of those before it.

    A few are folded one by one. Of more, blocks of about the square root of the
    length are folded first, so that neither the work nor the copying of arrays is quadratic.
    """
    total = lambda items: F.aggregate(items, F.lit(0), add)

    def inner(x: Column) -> Column:
        n, width = x["n"], x["width"]
        sums = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(n) - 1) / width).cast("int")), lambda b: total(F.slice(n, b * width + 1, width))
        )
        earlier = let(sums, lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda b: total(F.slice(s, F.lit(1), b))))
        return let(
            F.struct(n.alias("n"), width.alias("width"), earlier.alias("before")),
            lambda y: F.transform(
                F.sequence(F.lit(0), F.size(y["n"]) - 1),
                lambda i: let(F.floor(i / y["width"]).cast("int"), lambda b: add(
                    F.get(y["before"], b), total(F.slice(y["n"], b * y["width"] + 1, i - b * y["width"]))
                )),
            ),
        )

    def blocks(n: Column) -> Column:
        return let(F.struct(n.alias("n"), F.ceil(F.sqrt(F.size(n))).cast("int").alias("width")), inner)

    def few(n: Column) -> Column:
        return F.aggregate(
            F.slice(n, F.lit(1), F.size(n) - 1), F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(add(F.element_at(sums, -1), x)))
        )

    return let(numbers, lambda n: F.when(F.size(n) > FEW, blocks(n)).when(F.size(n) > 0, few(n)).otherwise(F.expr("cast(array() as array<int>)")))


def marks(text: Column, pattern: str) -> Column:
    """Start offsets of a zero-width ``pattern``."""
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(MARK)), MARK, -1)
    begin = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc, piece):
        pos = acc["pos"] + F.length(piece)
        return F.struct(
            pos.alias("pos"), F.concat(acc["out"], F.array(pos)).alias("out")
        )

    ends = F.aggregate(pieces, begin, step, lambda acc: acc["out"])
    return F.slice(ends, 1, F.size(ends) - 1)


def span(start, value, entity_type, source, priority, rule) -> Column:
    entity_type = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    return F.struct(
        start.cast("int").alias("start"),
        (start + F.length(value)).cast("int").alias("end"),
        value.alias("value"),
        entity_type.alias("entity_type"),
        F.lit(source).alias("source"),
        F.lit(priority).alias("priority"),
        F.lit(rule).alias("rule"),
    )


def to_spans(found: Column, entity_type, rule, source="regex", priority=0) -> Column:
    """Turn hits (null or empty values dropped) into spans."""
    kept = F.filter(found, lambda h: F.length(h["value"]) > 0)
    return F.transform(
        kept, lambda h: span(h["start"], h["value"], entity_type, source, priority, rule)
    )


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fence(value: Column) -> Column:
    """``value``, computed once.

    A filter or explode above a projection is pushed below it with the whole
    expression copied in, for every place the column is used; over a chain of
    span columns the copies multiply. An expression that is not deterministic
    stays where it is. The number of the task's partition is one, and its range
    is not known to the optimizer, as that of a random number is.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def first(items: Column) -> Column:
    """First element, or null."""
    return F.get(items, F.lit(0))


def guard(condition: Column, spans: Column) -> Column:
    """Skip the costly pass where a cheap test shows it can't find anything."""
    return F.when(condition, spans).otherwise(no_spans())


def ordered(spans: Column) -> Column:
    """By start, longest first, then rule order."""
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("a"), (-s["end"]).alias("b"), (-s["priority"]).alias("c"),
            s["rule"].alias("d"), s.alias("s"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["s"])
