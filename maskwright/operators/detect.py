"""Detection: text in, candidate spans out, in one narrow stage."""

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import pii, secrets
from ..functions.spans import SPANS, fence, guard, let, marked, no_spans, scratch


def cues_of(text: Column) -> Column:
    """Cheap tests that let most texts skip most rules, computed once a row."""
    return F.struct(
        pii.has_digits(text).alias("digits"), text.rlike(secrets.CUE).alias("label")
    )


def candidates(
    text: Column,
    *,
    patterns: Mapping[str, str] | None = None,
    builtins: bool = True,
    literals: bool = False,
    literal_types: Column | None = None,
    field: Column | None = None,
    plugins: Iterable[Callable[[Column], Column]] = (),
    rules: Iterable[str] | None = None,
    cues: Column | None = None,
) -> Column:
    """Candidate spans of ``text``, as one array column.

    A custom pattern replaces the built-in rule of its name. ``literals``
    also reports placeholder-shaped text (of ``literal_types``, or of any
    type). ``plugins`` are column functions giving spans of their own.
    """
    patterns = dict(patterns or {})
    cues = cues_of(text) if cues is None else cues
    wanted = [t for t in (rules or (X.PII_TYPES + X.SECRET_TYPES)) if t not in patterns]
    found = []
    if builtins:
        if "EMAIL" in wanted:
            found.append(pii.detect_email(text))
        numeric = [r(text) for k in X.PII_TYPES[1:] if k in wanted for r in pii.RULES[k]]
        if numeric:
            found.append(guard(cues["digits"], F.flatten(F.array(*numeric))))
    found += pii.detect_custom(text, patterns)
    base = pii.shrink_phones(F.flatten(F.array(*found))) if found else F.expr(f"cast(array() as {SPANS})")
    kinds = [t for t in X.SECRET_TYPES if t in wanted] if builtins else []
    if kinds:
        cued = F.flatten(F.array(*[rule(text) for rule in secrets.CUED_RULES]))
        spotted = F.flatten(
            F.array(*[rule(text) for rule in secrets.SECRET_RULES], guard(cues["label"], cued))
        )
        if len(kinds) < len(X.SECRET_TYPES):
            spotted = F.filter(spotted, lambda s: s["entity_type"].isin(*kinds))
        base = let(F.concat(base, spotted), secrets.drop_email_in_credential)
    base = pii.dedupe(base)
    if field is not None and kinds:
        named = F.filter(secrets.detect_field(text, field), lambda s: s["entity_type"].isin(*kinds))
        base = F.concat(base, named)
    if literals:
        base = F.concat(pii.detect_literal(text, literal_types), base)
    for plugin in plugins:
        base = F.concat(base, plugin(text))
    return base


_built: dict = {}


def _staged_candidates(spark, field: str | None, options: dict) -> Column:
    """The rules over the staged columns, built once per session and options."""
    key = (id(spark.sparkContext), field, repr(sorted(options.items(), key=lambda kv: kv[0])))
    if key not in _built:
        _built[key] = candidates(
            F.col("_copy"), field=F.col(field) if field else None, cues=F.col("_cues"), **options
        )
    return _built[key]


def detect(df: DataFrame, text: str = "text", *, field: str | None = None, **options) -> DataFrame:
    """Add ``spans``: every candidate, offsets in code points.

    The text is matched on a copy without the two mark characters; where a
    text really holds them, the values are read back from the original.
    """
    staged = df.withColumn("_copy", scratch(F.col(text)))
    staged = staged.withColumn("_cues", cues_of(F.col("_copy")))
    spans = _staged_candidates(df.sparkSession, field, options)
    original = F.transform(
        F.col("spans"),
        lambda s: s.withField(
            "value", F.substr(F.col(text), s["start"] + 1, s["end"] - s["start"])
        ),
    )
    out = staged.withColumn("spans", fence(F.coalesce(spans, no_spans()))).drop("_copy", "_cues")
    return out.withColumn("spans", fence(F.when(marked(F.col(text)), original).otherwise(F.col("spans"))))


def validate(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Fail the job when a span does not match its text."""
    wrong = F.exists(
        F.col(spans),
        lambda s: (s["start"] < 0)
        | (s["start"] >= s["end"])
        | (s["end"] > F.length(F.col(text)))
        | (F.substr(F.col(text), s["start"] + 1, s["end"] - s["start"]) != s["value"]),
    )
    checked = F.when(wrong, F.raise_error(F.lit("a span does not match the text"))).otherwise(F.col(spans))
    return df.withColumn(spans, checked)


def named_entities(df: DataFrame, model, text: str = "text", max_length: int = 1_000_000) -> DataFrame:
    """Add spans of a user's name model, an Arrow function ``texts -> lists``.

    ``model`` is a pandas UDF returning ``array<struct<start:int,end:int,label:string>>``;
    labels are mapped to types, others are dropped. A text over ``max_length``
    fails the job: it is never cut.
    """
    labels = F.create_map(*[F.lit(x) for pair in X.NER_LABELS.items() for x in pair])
    checked = F.when(
        F.length(text) > max_length, F.raise_error(F.lit("text too long for the name model"))
    ).otherwise(F.col(text))
    found = df.withColumn("_named", model(checked))
    spans = F.transform(
        F.filter(F.col("_named"), lambda e: labels[e["label"]].isNotNull()),
        lambda e: F.struct(
            e["start"].alias("start"), e["end"].alias("end"),
            F.substr(F.col(text), e["start"] + 1, e["end"] - e["start"]).alias("value"),
            labels[e["label"]].alias("entity_type"), F.lit("local_names").alias("source"),
            F.lit(X.NAMES).alias("priority"), F.lit(900).alias("rule"),
        ),
    )
    base = F.col("spans") if "spans" in df.columns else F.expr(f"cast(array() as {SPANS})")
    return validate(found.withColumn("spans", F.concat(base, spans)).drop("_named"), text)
