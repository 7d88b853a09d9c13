"""Masking plans: one text a session (narrow), and sessions of many texts."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import placeholders as P
from ..functions.spans import fence, let, no_spans
from ..operators import checks, vault as V
from ..operators.detect import detect
from ..operators.normalize import assign_normalized
from ..operators.resolve import resolve
from .runtime import pin

ENTITY = (
    "struct<placeholder:string,value:string,entity_type:string,start:int,end:int,source:string>"
)


def number_in_row(kept: Column) -> Column:
    """Entities of one text that is a session of its own.

    A value keeps the type it was first seen with; numbers count each type's
    distinct values in reading order. All inside the row: no shuffle.
    """
    # Sorted by value and place, the first of each value is next to the others;
    # sorted by type and place, its number is its distance from the type's first.
    placed = F.array_sort(F.transform(kept, lambda s, i: F.struct(s["value"].alias("value"), i.alias("i"), s["entity_type"].alias("kind"))))

    def names(rows):
        firsts = F.filter(F.transform(rows, lambda r, k: F.when((k == 0) | (F.get(rows, k - 1)["value"] != r["value"]), r)), lambda r: r.isNotNull())
        typed = F.array_sort(F.transform(firsts, lambda r: F.struct(r["kind"].alias("kind"), r["i"].alias("i"), r["value"].alias("value"))))

        def numbered(rows):
            begins = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda k: (k == 0) | (F.get(rows, k - 1)["kind"] != F.get(rows, k)["kind"]))
            where = let(begins, lambda b: F.map_from_arrays(F.transform(b, lambda k: F.get(rows, k)["kind"]), b))
            return let(where, lambda w: F.map_from_arrays(
                F.transform(rows, lambda r: r["value"]),
                F.transform(rows, lambda r, k: P.format_placeholder(r["kind"], k - w[r["kind"]] + 1)),
            ))

        return let(typed, numbered)

    entities = let(
        let(placed, names),
        lambda m: F.transform(
            kept,
            lambda s: let(m[s["value"]], lambda name: F.struct(
                name.alias("placeholder"), s["value"].alias("value"), P.placeholder_type(name).alias("entity_type"),
                s["start"].alias("start"), s["end"].alias("end"), s["source"].alias("source"),
            )),
        ),
    )
    return F.when(F.size(kept) > 0, entities).otherwise(F.expr(f"cast(array() as array<{ENTITY}>)"))


def apply_mask(text: Column, entities: Column) -> Column:
    edits = F.transform(
        entities,
        lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["placeholder"].alias("new")),
    )
    return P.splice(text, edits)


def mask_rows(
    df: DataFrame, text: str = "text", *, warnings: bool = True, tolerant: bool = True,
    detected: bool = False, **options,
) -> DataFrame:
    """Mask a table where every row is a session of its own.

    One narrow stage: no shuffle, no Python. Adds ``masked``, ``entities``
    and ``warnings``. With ``detected`` the table already has ``spans``.
    """
    found = df if detected else detect(df, text, **options)
    out = resolve(found, text=text)
    out = out.withColumn("entities", fence(number_in_row(F.col("kept"))))
    out = out.withColumn("masked", fence(apply_mask(F.col(text), F.col("entities"))))
    if warnings:
        used = F.array_distinct(F.transform("entities", lambda e: e["entity_type"]))
        out = out.withColumn("_before", fence(checks.kept_before(F.col("kept"), F.col("spans"))))
        out = out.withColumn("_cut", fence(checks.cut_in_row(F.col(text), F.col("kept"), F.col("_before"))))
        out = out.withColumn(
            "warnings",
            fence(
                F.concat(
                    checks.placeholder_like(F.col(text), F.col("kept"), used, tolerant),
                    checks.leaks_in_row(F.col(text), F.col("kept"), F.col("spans"), F.col("entities"), F.col("_cut")),
                )
            ),
        ).drop("_before", "_cut")
    return out.drop("spans", "kept")


class MaskOutput(NamedTuple):
    """Everything a masking run produces, as tables; ``added`` is what it added to the vault's."""

    masked: DataFrame
    entities: DataFrame
    vault: DataFrame
    remembered: DataFrame
    merged: DataFrame
    added: dict[str, DataFrame]


KEYS = ["session", "seq", "section"]


def explode_entities(found: DataFrame) -> DataFrame:
    """One row per kept span, without the text."""
    return found.select(*KEYS, F.explode("kept").alias("s")).select(*KEYS, "s.*")


def mask_sessions(
    df: DataFrame, vault: DataFrame | None = None, *, text: str = "text",
    normalize: bool = False, remembered: DataFrame | None = None,
    merged: DataFrame | None = None, detected: bool = False, **options,
) -> MaskOutput:
    """Mask texts that share vaults: ``session, seq, section, text``.

    The spans are written once, without the texts; values are pre-aggregated
    and numbered in a way that no session has to fit in one task; the texts
    are then joined with their own placeholders only.
    """
    found = df if detected else detect(df, text, **options)
    entities = pin(explode_entities(resolve(found, text=text).select(*KEYS, "kept")))
    if normalize:
        new, aliases = assign_normalized(entities, vault, merged)
    else:
        new, aliases = V.assign(entities, vault), None
    new = pin(new)
    full = new if vault is None else vault.unionByName(new)
    named = full.select("session", "value", "placeholder", "entity_type")
    if aliases is not None:
        named = named.unionByName(aliases.select(*named.columns))
    placed = pin(V.placeholders_for(entities, named))
    edits = placed.groupBy(*KEYS).agg(
        F.array_sort(
            F.collect_list(F.struct("start", "end", F.col("placeholder").alias("new")))
        ).alias("_edits")
    )
    masked = (
        df.join(edits, KEYS, "left")
        .withColumn(
            "masked",
            P.splice(F.col(text), F.coalesce("_edits", F.expr("cast(array() as array<struct<start:int,end:int,new:string>>)"))),
        )
        .drop("_edits")
    )
    members = placed.select(
        "session", "seq", "section", "start", "placeholder", F.explode("members").alias("m")
    ).select("session", "seq", "section", "start", "placeholder", "m.value", "m.entity_type")
    spellings = placed.where(F.lit(False)).select(*members.columns)
    if aliases is not None:
        spellings = aliases.select(
            "session", "seq", "section", "start", "placeholder", "value", "entity_type"
        )
    kept = V.fresh_spellings(members.unionByName(spellings), full, remembered)
    marks = V.fresh_marks(placed, merged)
    return MaskOutput(
        masked, placed, full, kept if remembered is None else remembered.unionByName(kept),
        marks if merged is None else merged.select("session", "placeholder").unionByName(marks),
        {"values": new, "remembered": kept, "merged": marks},
    )


def round_trip(
    df: DataFrame, model, text: str = "text", *, strict: bool = False, tolerant: bool = True, **options
) -> DataFrame:
    """Mask each text, ask ``model`` with the masked one only, and restore its reply.

    ``model`` is a function of a column (an Arrow function, or an expression).
    Adds ``masked``, ``entities``, ``warnings``, ``reply`` and ``restored``. With
    ``strict`` the job fails at the first text with a warning; else such a text
    is not sent: its ``reply`` is null.
    """
    from ..operators.restore import restore_in_row

    out = mask_rows(df, text, literals=True, tolerant=tolerant, **options)
    if strict:
        out = checks.strict(out)
    sendable = F.when(F.size("warnings") == 0, F.col("masked"))
    out = out.withColumn("reply", fence(model(sendable)))
    restored = restore_in_row(F.col("reply"), F.col("entities"), tolerant)["text"]
    return out.withColumn("restored", fence(F.when(F.col("reply").isNotNull(), restored)))


def entity_view(masked_rows: DataFrame, keys: list[str], entities: str = "entities") -> DataFrame:
    """One row per placeholder that stands in a masked text, with its value and place."""
    return masked_rows.select(*keys, F.explode(entities).alias("e")).select(*keys, "e.*")


def span_view(found: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """One row per span of a table of candidates or kept spans."""
    return found.select(*keys, F.explode(spans).alias("s")).select(*keys, "s.*")


SEAM = "\n\ufdd2\n"


def mask_json_rows(df: DataFrame, column: str, **options) -> DataFrame:
    """Mask a JSON column, every row a session of its own; one narrow stage.

    All strings of a row, keys too, are found as one text joined by a mark
    that no value can contain, so that they share the row's placeholders. A
    string under a key that names a credential is a secret as a whole. Adds
    ``masked_json``, ``entities`` and ``refused``: why a row can't be masked
    (its ``masked_json`` is null then):

    * ``invalid``: not JSON, or with the mark in it;
    * ``number``: a number that would be masked if it were text;
    * ``across``: a value that reaches over two strings;
    * ``keys``: two different keys would become the same.
    """
    from ..functions.secrets import detect_field
    from ..functions.spans import running
    from ..operators.jsondata import STRING, string_tokens, to_json_string, valid

    body = F.col(column)
    none = F.expr("cast(null as string)")
    outside = F.regexp_replace(body, F.lit(STRING), F.lit(" "))
    numbers = F.regexp_extract_all(outside, F.lit(r"[-+]?[0-9][0-9.eE+-]*+"), F.lit(0))
    out = df.withColumn("_numbers", fence(F.coalesce(F.array_join(numbers, "\n"), F.lit(""))))
    out = detect(out, "_numbers", **options).withColumn("_number", F.size("spans") > 0).drop("spans", "_numbers")

    out = out.withColumn("_tokens", fence(F.coalesce(string_tokens(body), string_tokens(F.lit("")))))
    texts = F.transform("_tokens", lambda t: F.coalesce(t["text"], F.lit("")))
    out = out.withColumn("_text", fence(F.array_join(texts, SEAM)))
    out = detect(out, "_text", **options)
    starts = running(F.transform("_tokens", lambda t: F.length(F.coalesce(t["text"], F.lit(""))) + len(SEAM)))
    named = let(starts, lambda at: F.flatten(F.transform("_tokens", lambda t, i: F.transform(
        F.when(t["name"].isNotNull() & t["text"].isNotNull(), detect_field(t["text"], t["name"])).otherwise(no_spans()),
        lambda s: s.withField("start", F.get(at, i)).withField("end", F.get(at, i) + F.length(t["text"])),
    ))))
    out = out.withColumn("spans", fence(F.concat("spans", named)))
    out = mask_rows(out, "_text", warnings=False, detected=True)

    out = out.withColumn("_pieces", fence(F.split("masked", SEAM, -1)))
    keys = F.filter(F.transform("_tokens", lambda t: F.when(t["is_key"], t["text"])), lambda x: x.isNotNull())
    new_keys = F.filter(F.transform("_tokens", lambda t, i: F.when(t["is_key"], F.get("_pieces", i))), lambda x: x.isNotNull())
    whole = (F.size("_tokens") == 0) | (F.size("_pieces") == F.size("_tokens"))
    out = out.withColumn("refused", fence(
        F.when(body.isNull(), none)
        .when(~valid(body) | body.contains(SEAM[1]) | F.col("_text").contains(SEAM + SEAM[1]), "invalid")
        .when(F.col("_number"), "number").when(~whole, "across")
        .when(F.size(F.array_distinct(new_keys)) < F.size(F.array_distinct(keys)), "keys").otherwise(none)
    ))
    edits = F.filter(
        F.transform(
            "_tokens",
            lambda t, i: F.struct(
                t["start"].alias("start"), t["end"].alias("end"),
                F.when(F.get("_pieces", i) != t["text"], to_json_string(F.get("_pieces", i))).alias("new"),
            ),
        ),
        lambda e: e["new"].isNotNull(),
    )
    done = F.when(F.size("_tokens") > 0, P.splice(body, edits)).otherwise(body)
    return out.withColumn("masked_json", F.when(F.col("refused").isNull(), done)).drop(
        "_tokens", "_text", "_pieces", "_number", "masked"
    )


def restore_json_rows(df: DataFrame, column: str, entities: str = "entities") -> DataFrame:
    """Restore inside the strings of a JSON column that carries its entities.

    Adds ``restored_json`` and ``restore_refused``: ``keys`` where two different
    keys would become the same (``restored_json`` is null then).
    """
    from ..operators.jsondata import keys_of, restore_json_in_row
    from ..operators.restore import restore_in_row

    one = lambda text: restore_in_row(text, F.col(entities), tolerant=False)["text"]
    out = df.withColumn("restored_json", fence(restore_json_in_row(F.col(column), one)))
    fewer = F.size(keys_of(F.col("restored_json"))) < F.size(keys_of(F.col(column)))
    out = out.withColumn("restore_refused", fence(F.when(fewer, "keys")))
    return out.withColumn("restored_json", F.when(F.col("restore_refused").isNull(), F.col("restored_json")))
