"""Restore: put the originals back, exactly, once, left to right."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import placeholders as P
from ..functions.spans import fence, let
from ..plans.runtime import lookup_join, pin

REPAIRED = "struct<written:string,placeholder:string>"


def restore_in_row(text: Column, vault: Column, tolerant: bool = True) -> Column:
    """Restore with the text's own ``placeholder, value`` pairs.

    Gives ``text, restored_count, unknown, repaired``; no shuffle.
    """
    names = F.map_from_entries(
        F.array_distinct(F.transform(vault, lambda e: F.struct(e["placeholder"], e["value"])))
    )
    types = F.array_distinct(F.transform(vault, lambda e: P.placeholder_type(e["placeholder"])))

    def resolve(found):
        return F.struct(
            P.splice(
                text,
                F.transform(
                    F.filter(found, lambda t: t["value"].isNotNull()),
                    lambda t: F.struct(
                        t["start"].alias("start"), (t["start"] + F.length(t["written"])).alias("end"),
                        t["value"].alias("new"),
                    ),
                ),
            ).alias("text"),
            F.size(F.filter(found, lambda t: t["value"].isNotNull())).alias("restored_count"),
            F.array_distinct(
                F.transform(F.filter(found, lambda t: t["unknown"]), lambda t: t["written"])
            ).alias("unknown"),
            F.transform(
                F.filter(found, lambda t: t["value"].isNotNull() & (t["placeholder"] != t["written"])),
                lambda t: F.struct(t["written"].alias("written"), t["placeholder"].alias("placeholder")),
            ).alias("repaired"),
        )

    def tokens(names):
        def one(h):
            options = P.candidates(h["value"]) if tolerant else F.array(h["value"])

            def chosen(options):
                hit = F.get(F.filter(options, lambda c: names[c].isNotNull()), F.lit(0))
                unknown = hit.isNull() & (
                    h["value"].rlike(f"^{X.EXACT}$")
                    | F.exists(options, lambda c: F.array_contains(types, P.placeholder_type(c)))
                )
                return F.struct(
                    h["start"].alias("start"), h["value"].alias("written"), hit.alias("placeholder"),
                    F.when(hit.isNotNull(), names[hit]).alias("value"), unknown.alias("unknown"),
                )

            return let(options, chosen)

        return F.transform(P.tokens(text, tolerant), one)

    return let(let(names, tokens), resolve)


def restore_rows(
    df: DataFrame, text: str = "masked", entities: str = "entities", tolerant: bool = True
) -> DataFrame:
    """Restore rows that carry their own entities."""
    out = df.withColumn("_r", fence(restore_in_row(F.col(text), F.col(entities), tolerant)))
    return out.withColumns(
        {
            "restored": F.col("_r.text"),
            "restored_count": F.col("_r.restored_count"),
            "unknown": F.col("_r.unknown"),
            "repaired": F.col("_r.repaired"),
        }
    ).drop("_r")


def restore(
    df: DataFrame, vault: DataFrame, keys: list[str], *, text: str = "text", tolerant: bool = True
) -> DataFrame:
    """Restore texts from a vault table; ``keys`` (with session) name a text.

    Tokens are looked up by an equi-join on (session, placeholder) in which
    no hot placeholder can fill a task, and put back text by text. Adds
    ``restored, restored_count, unknown, repaired``.
    """
    names = list(dict.fromkeys(["session", *keys]))
    has_bracket = F.col(text).rlike(r"[\[［【]")
    options = P.candidates(F.col("t.value")) if tolerant else F.array(F.col("t.value"))
    tokens = (
        df.where(has_bracket)
        .select(*names, F.explode(P.tokens(F.col(text), tolerant)).alias("t"))
        .select(*names, F.col("t.start").alias("start"), F.col("t.value").alias("written"), options.alias("_options"))
        .select(*names, "start", "written", F.posexplode_outer("_options").alias("pos", "placeholder"))
    )
    tokens = pin(tokens)
    found = lookup_join(tokens, vault.select("session", "placeholder", "value"), ["session", "placeholder"])
    used = (
        vault.select("session", P.placeholder_type(F.col("placeholder")).alias("_type"))
        .distinct().withColumn("_used", F.lit(True))
    )
    found = found.withColumn("_type", P.placeholder_type(F.col("placeholder"))).join(
        used, ["session", "_type"], "left"
    )
    known = F.col("value").isNotNull()
    per_token = found.groupBy(*names, "start", "written").agg(
        F.min_by(F.when(known, F.struct("placeholder", "value")), F.when(known, F.col("pos"))).alias("hit"),
        F.max(F.coalesce("_used", F.lit(False))).alias("_used"),
    )
    hit = F.col("hit").isNotNull()
    unknown = ~hit & (F.col("written").rlike(f"^{X.EXACT}$") | F.col("_used"))
    token = F.struct(
        "start", (F.col("start") + F.length("written")).alias("end"), F.col("hit.value").alias("new"),
        "written", F.col("hit.placeholder").alias("placeholder"), unknown.alias("unknown"),
    )
    per_text = per_token.groupBy(*names).agg(F.array_sort(F.collect_list(token)).alias("_t"))
    out = df.join(per_text, names, "left").withColumn(
        "_t", F.coalesce("_t", F.expr(
            "cast(array() as array<struct<start:int,end:int,new:string,written:string,placeholder:string,unknown:boolean>>)"
        ))
    )
    edits = F.filter("_t", lambda t: t["new"].isNotNull())
    return out.withColumns(
        {
            "restored": P.splice(F.col(text), edits),
            "restored_count": F.size(edits),
            "unknown": F.array_distinct(
                F.transform(F.filter("_t", lambda t: t["unknown"]), lambda t: t["written"])
            ),
            "repaired": F.transform(
                F.filter("_t", lambda t: t["new"].isNotNull() & (t["placeholder"] != t["written"])),
                lambda t: F.struct(t["written"].alias("written"), t["placeholder"].alias("placeholder")),
            ),
        }
    ).drop("_t")


def trace_masks(df: DataFrame, masked: str = "masked", entities: str = "entities", original: str = "text") -> DataFrame:
    """Recover the replaced ranges from the masked text alone.

    Adds ``traced`` (type, start, end; literal text left out) and ``exact``:
    whether putting the values back gives the original.
    """
    mark = "struct<entity_type:string,start:int,end:int>"
    staged = restore_rows(df, masked, entities, tolerant=False)
    names = F.map_from_entries(
        F.array_distinct(F.transform(entities, lambda e: F.struct(e["placeholder"], e["value"])))
    )
    staged = staged.withColumn("_names", fence(names))
    known = F.transform(
        F.filter(P.tokens(F.col(masked), False), lambda t: F.col("_names")[t["value"]].isNotNull()),
        lambda t: F.struct(
            P.placeholder_type(t["value"]).alias("kind"), t["start"].alias("start"),
            F.length(t["value"]).alias("written"), F.length(F.col("_names")[t["value"]]).alias("size"),
        ),
    )
    staged = staged.withColumn("_known", fence(known))
    begin = F.struct(F.lit(0).alias("shift"), F.expr(f"cast(array() as array<{mark}>)").alias("out"))

    def step(acc, t):
        start = (t["start"] + acc["shift"]).cast("int")
        item = F.struct(t["kind"].alias("entity_type"), start.alias("start"), (start + t["size"]).alias("end"))
        return F.struct(
            (acc["shift"] + t["size"] - t["written"]).alias("shift"),
            F.when(t["kind"] != X.LITERAL, F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"),
        )

    traced = F.aggregate("_known", begin, step, lambda a: a["out"])
    return (
        staged.withColumn("traced", fence(traced))
        .withColumn("exact", F.col("restored") == F.col(original))
        .drop("_names", "_known", "restored", "restored_count", "unknown", "repaired")
    )
