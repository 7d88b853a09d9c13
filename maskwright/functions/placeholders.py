"""Placeholders ``[TYPE_N]`` as columns: format, parse, loose forms, splicing."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .spans import hits, let


def format_placeholder(entity_type: Column, number: Column) -> Column:
    ok = entity_type.rlike(f"^{X.TYPE_NAME}$") & number.between(1, X.MAX_NUMBER)
    text = F.concat(F.lit("["), entity_type, F.lit("_"), number.cast("string"), F.lit("]"))
    return F.when(ok, text).otherwise(F.raise_error(F.lit("invalid placeholder type or number")))


def placeholder_type(placeholder: Column) -> Column:
    kind = F.regexp_extract(placeholder, rf"^{X.PLACEHOLDER}$", 1)
    return F.when(kind != "", kind)


def placeholder_number(placeholder: Column) -> Column:
    return F.regexp_extract(placeholder, rf"^{X.PLACEHOLDER}$", 2).try_cast("int")


def tokens(text: Column, tolerant: bool) -> Column:
    """Placeholder-like tokens of ``text``, with offsets."""
    return hits(text, X.LOOSE if tolerant else X.EXACT)


def candidates(written: Column) -> Column:
    """The exact placeholders a written one may stand for, most likely first.

    Case, spacing, dashes and leading zeros are normalized. Without a
    separator before the digits every split is tried, longest type first.
    """
    body = F.regexp_replace(written, r"^\\?[\[［【][ \t]*|[ \t]*\\?[\]］】]$", "")
    norm = F.upper(F.regexp_replace(F.trim(body), r"[ \t_-]+", "_"))

    def splits(text):
        digits = F.length(F.regexp_extract(text, "([0-9]+)$", 1))
        size = F.length(text)
        head = size - digits
        at = F.when(
            F.substr(text, head, F.lit(1)) == "_", F.array(head)
        ).otherwise(F.sequence(size - 1, head, F.lit(-1)))

        def name(n):
            kind = F.regexp_replace(F.substr(text, F.lit(1), n), "_+$", "")
            number = F.substr(text, n + 1).try_cast("bigint")
            ok = kind.rlike(f"^{X.TYPE_NAME}$") & number.between(1, X.MAX_NUMBER)
            return F.when(ok, F.concat(F.lit("["), kind, F.lit("_"), number.cast("string"), F.lit("]")))

        return F.filter(F.transform(at, name), lambda c: c.isNotNull())

    loose = F.when(
        norm.rlike("[0-9]$"), let(norm, splits)
    ).otherwise(F.expr("cast(array() as array<string>)"))
    # The exact text always stands for itself first.
    exact = F.when(written.rlike(f"^{X.EXACT}$"), F.array(written)).otherwise(
        F.expr("cast(array() as array<string>)")
    )
    return F.array_distinct(F.concat(exact, loose))


def splice(text: Column, edits: Column) -> Column:
    """Replace the ranges of ``edits`` (sorted, disjoint ``start, end, new``)."""
    pieces = F.transform(
        edits,
        lambda e, i: let(
            F.coalesce(F.get(edits, i - 1)["end"], F.lit(0)),
            lambda last: F.concat(F.substr(text, last + 1, e["start"] - last), e["new"]),
        ),
    )
    tail = F.substr(text, F.coalesce(F.get(edits, F.size(edits) - 1)["end"], F.lit(0)) + 1)
    return F.when(F.size(edits) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)


def gaps(text: Column, spans: Column) -> Column:
    """The text left between ``spans``, as ``start, text``, empty ones dropped."""
    inner = F.transform(
        spans,
        lambda s, i: let(
            F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)),
            lambda last: F.struct(
                last.alias("start"), F.substr(text, last + 1, s["start"] - last).alias("text")
            ),
        ),
    )
    last = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0))
    tail = F.array(F.struct(last.alias("start"), F.substr(text, last + 1).alias("text")))
    return F.filter(F.concat(inner, tail), lambda g: F.length(g["text"]) > 0)
