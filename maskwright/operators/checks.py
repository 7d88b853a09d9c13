"""Checks of masked text: leaks, placeholder-like input, rendering, routing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import placeholders as P
from ..functions.spans import let, no_spans
from .resolve import resolve_overlaps

WARNING = (
    "struct<code:string,entity_type:string,placeholder:string,value:string,length:int>"
)


def holds_token(text: Column, value: Column) -> Column:
    """Whether ``value`` occurs in ``text`` as a whole token (column form).

    A side is guarded only where the value itself ends in a word character.
    """
    first = F.substr(value, F.lit(1), F.lit(1))
    last = F.substr(value, F.length(value), F.lit(1))
    quoted = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(
        F.when(first.rlike(X.WORD_CHAR), F.lit(f"(?<!{X.WORD_CHAR})")).otherwise(F.lit("")),
        quoted,
        F.when(last.rlike(X.WORD_CHAR), F.lit(f"(?!{X.WORD_CHAR})")).otherwise(F.lit("")),
    )
    return text.contains(value) & F.regexp_like(text, pattern)


def kept_before(kept: Column, spans: Column) -> Column:
    """The spans that were kept before some were merged; none in a text without a merged span."""
    return F.when(F.exists(kept, lambda k: F.size(k["members"]) > 0), resolve_overlaps(spans)).otherwise(no_spans())


def cut_in_row(text: Column, kept: Column, before: Column) -> Column:
    """Where an occurrence that a merged span hides only part of may be: ``text, begin, end``.

    ``before`` are the spans kept before merging. One row for every stretch outside the kept spans that lies, with what a merged span covers
    beside it, in one gap between the spans before merging: the gap's text, and the stretch in it.
    """
    own = lambda g: F.struct(
        g.alias("g"),
        F.filter(kept, lambda k: (k["start"] < g["start"] + F.length(g["text"])) & (g["start"] < k["end"])).alias("k"),
    )

    def stretches(x: Column) -> Column:
        g, inside = x["g"], x["k"]
        size = F.length(g["text"])
        edge = lambda at: F.least(F.greatest(at - g["start"], F.lit(0)), size)
        row = lambda begin, end: F.struct(g["text"].alias("text"), begin.alias("begin"), end.alias("end"))
        rows = F.transform(inside, lambda k, i: row(edge(F.coalesce(F.get(inside, i - 1)["end"], F.lit(0))), edge(k["start"])))
        last = F.array(row(edge(F.get(inside, F.size(inside) - 1)["end"]), size))
        return F.filter(F.concat(rows, last), lambda r: r["begin"] < r["end"])

    reached = F.filter(F.transform(P.gaps(text, before), own), lambda x: F.size(x["k"]) > 0)
    cut = F.flatten(F.transform(reached, stretches))
    none = F.expr("cast(array() as array<struct<text:string,begin:int,end:int>>)")
    return F.when(F.size(before) > 0, cut).otherwise(none)


def _reaches(cut: Column, v: Column) -> Column:
    """Whether the value ``v`` occurs in a gap so that it covers some of the stretch outside."""
    size = F.length(v["value"])
    left = F.greatest(cut["begin"] - size + 1, F.lit(0))
    window = F.substr(cut["text"], left + 1, cut["end"] + size - 1 - left)

    def token(w: Column) -> Column:
        glued = lambda a, b: F.substr(cut["text"], a, F.lit(1)).rlike(X.WORD_CHAR) & F.substr(cut["text"], b, F.lit(1)).rlike(X.WORD_CHAR)
        at = lambda i: (F.substr(w, i, size) == v["value"]) & ~(
            ((left + i > 1) & glued(left + i - 1, left + i)) | glued(left + i + size - 1, left + i + size)
        )
        return F.exists(F.sequence(F.lit(1), F.length(w) - size + 1), at)

    return let(window, lambda w: w.contains(v["value"]) & F.when(v["token"], token(w)).otherwise(True))


def leaks_in_row(text: Column, kept: Column, spans: Column, entities: Column, cut: Column) -> Column:
    """Values of this text still visible between its placeholders.

    Registered values count as whole tokens, all others as substrings; no
    value is matched across a placeholder. Where a merged span swallowed the
    edge of an occurrence, the gaps between the spans it replaced are
    searched too, for occurrences that do not lie inside merged spans
    (``cut`` says where they can be, see `cut_in_row`).
    """
    known = F.array_distinct(
        F.concat(
            F.transform(kept, lambda k: F.struct(k["value"].alias("value"), F.lit(False).alias("token"))),
            F.transform(
                spans,
                lambda s: F.struct(s["value"].alias("value"), (s["source"] == "manual").alias("token")),
            ),
        )
    )

    def find(left):
        # A value registered by hand is only a token, whatever else found it.
        visible = F.filter(
            known,
            lambda v: ~(
                ~v["token"]
                & F.exists(known, lambda o: o["token"] & (o["value"] == v["value"]))
            )
            & (
                F.exists(
                    left,
                    lambda g: F.when(v["token"], holds_token(g["text"], v["value"])).otherwise(
                        g["text"].contains(v["value"])
                    ),
                )
                | F.exists(cut, lambda c: _reaches(c, v))
            ),
        )
        return F.transform(
            visible,
            lambda v: let(
                F.get(F.filter(entities, lambda e: e["value"] == v["value"]), F.lit(0)),
                lambda e: F.struct(
                    F.lit("leak").alias("code"),
                    F.coalesce(
                        P.placeholder_type(e["placeholder"]),
                        F.get(F.filter(spans, lambda s: s["value"] == v["value"]), F.lit(0))["entity_type"],
                        F.lit("?"),
                    ).alias("entity_type"),
                    e["placeholder"].alias("placeholder"),
                    v["value"].alias("value"),
                    F.length(v["value"]).alias("length"),
                ),
            ),
        )

    return F.when(
        F.size(spans) > 0, let(P.gaps(text, kept), find)
    ).otherwise(F.expr(f"cast(array() as array<{WARNING}>)"))


def placeholder_like(text: Column, kept: Column, used_types: Column, tolerant: bool = True) -> Column:
    """Tokens left unmasked that a later restore would read as placeholders."""
    left = F.flatten(F.transform(P.gaps(text, kept), lambda g: P.tokens(g["text"], tolerant)))
    written = F.array_distinct(F.transform(left, lambda h: h["value"]))
    counted = F.filter(
        written,
        lambda w: w.rlike(f"^{X.EXACT}$")
        | F.exists(
            P.candidates(w),
            lambda c: F.array_contains(used_types, F.coalesce(P.placeholder_type(c), F.lit(""))),
        ),
    )
    null = F.lit(None).cast("string")
    out = F.transform(
        counted,
        lambda w: F.struct(
            F.lit("placeholder_like").alias("code"), null.alias("entity_type"), null.alias("placeholder"),
            w.alias("value"), F.length(w).alias("length"),
        ),
    )
    empty = F.expr(f"cast(array() as array<{WARNING}>)")
    return F.when(text.rlike(r"[\[［【]"), out).otherwise(empty)


def render_warnings(warnings: Column, redact: bool = False) -> Column:
    """Warnings as sentences; with ``redact`` no value is quoted."""

    def one(w):
        known = F.coalesce(F.concat(F.lit(" ("), w["placeholder"], F.lit(")")), F.lit(""))
        if redact:
            leak = F.concat(w["entity_type"], known)
            label = F.concat(w["length"].cast("string"), F.lit(" characters"))
        else:
            leak = F.concat(w["value"], known)
            label = w["value"]
        return F.when(
            w["code"] == "leak",
            F.concat(F.lit("not masked everywhere: "), leak),
        ).otherwise(
            F.concat(
                F.lit("text that restoring would take for a placeholder: "), label,
            )
        )

    return F.transform(warnings, one)


def redact(df: DataFrame, warnings: str = "warnings") -> DataFrame:
    """Drop the values from the warnings themselves."""
    return df.withColumn(
        warnings, F.transform(warnings, lambda w: w.withField("value", F.lit(None).cast("string")))
    )


def route(df: DataFrame, warnings: str = "warnings") -> tuple[DataFrame, DataFrame]:
    """Split into rows without warnings and rows to quarantine."""
    clean = F.size(warnings) == 0
    return df.where(clean), df.where(~clean)


def strict(df: DataFrame, warnings: str = "warnings") -> DataFrame:
    """Fail the job at the first row with a warning."""
    checked = F.when(
        F.size(warnings) > 0,
        F.raise_error(F.concat(F.size(warnings).cast("string"), F.lit(" warning(s) in strict mode"))),
    ).otherwise(F.col(warnings))
    return df.withColumn(warnings, checked)


def fold(text: Column) -> Column:
    """Lower case, without spaces, underscores or dashes."""
    return F.regexp_replace(F.lower(text), r"[\s_-]+", "")
