"""Known values wherever they are: the last pass, leak checks, policies."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import placeholders as P
from ..functions.secrets import is_code_value
from ..functions.spans import SPANS, span
from ..plans.runtime import pin, small
from .checks import fold
from .resolve import resolve_leftmost
from .search import find_values

KEYS = ["session", "seq", "section"]


def _spellings(value: Column) -> Column:
    """A value as written, and as written inside a JSON string (both ways)."""
    quoted = F.to_json(F.struct(value.alias("v")))
    inner = F.substr(quoted, F.lit(7), F.length(quoted) - 8)
    escaped = F.array_join(
        F.transform(
            F.split(inner, ""),
            lambda c: F.when(
                c.rlike(r"[^\x00-\x7f]"),
                F.lower(F.concat(F.lit("\\u"), F.lpad(F.hex(F.encode(c, "UTF-16BE")), 4, "0"))),
            ).otherwise(c),
        ),
        "",
    )
    astral = value.rlike(r"[\x{10000}-\x{10ffff}]")
    return F.array_distinct(F.array(value, inner, F.when(astral, inner).otherwise(escaped)))


def known_values(vault: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """What the last pass looks for: session, value, spelling, type, whole word.

    Literals and short values are left out, and stored secrets that read as
    code. A detected secret that is one word of letters counts only as a word.
    """
    kind, value = F.col("entity_type"), F.col("value")
    secret = kind.isin(*X.SECRET_TYPES)
    stored = vault.select("session", "value", "entity_type", "placeholder").where(
        (kind != X.LITERAL)
        & (F.length(value) >= X.MIN_KNOWN_LENGTH)
        & ~(secret & is_code_value(value, F.lit("")))
    )
    base = stored.withColumn("word", secret & value.rlike(r"^\p{L}+$"))
    if registry is not None:
        listed = registry.where(F.length("value") >= X.MIN_KNOWN_LENGTH).select("value", F.lit(True).alias("_listed"))
        base = base.join(listed, "value", "left").withColumn(
            "word", F.col("word") & F.col("_listed").isNull()
        ).drop("_listed")
    return base.withColumn("spelling", F.explode(_spellings(value)))


def mask_known(masked: DataFrame, vault: DataFrame, registry: DataFrame | None = None, text: str = "masked") -> DataFrame:
    """Replace every known value still present, even glued to other text.

    Longest at the earliest place first; existing placeholders are skipped.
    """
    known = known_values(vault, registry)
    values = known.select("session", F.col("spelling").alias("value"), "placeholder", "word")
    found = find_values(masked.select(*KEYS, text), values, KEYS, by=["session"], text=text)
    body = F.col(text)
    end = F.col("start") + F.length("value")
    hit = span(F.col("start"), F.col("value"), F.col("placeholder"), "known", 0, 0)
    per_text = found.groupBy(*KEYS).agg(F.collect_list(F.struct("word", hit.alias("s"))).alias("_found"))
    out = masked.join(per_text, KEYS, "left")

    def free(h):
        s = h["s"]
        before = F.when(s["start"] > 0, F.substr(body, s["start"], F.lit(1))).otherwise("")
        glued = before.rlike(f"^{X.WORD}") | F.substr(body, s["end"] + 1, F.lit(1)).rlike(f"^{X.WORD}")
        return ~(h["word"] & glued)

    exact = F.transform(
        P.tokens(body, False),
        lambda t: span(t["start"], t["value"], F.lit(None).cast("string"), "placeholder", 0, 0),
    )
    usable = F.transform(F.filter("_found", free), lambda h: h["s"])
    out = out.withColumn(
        "_edits",
        F.when(F.col("_found").isNotNull(), resolve_leftmost(F.concat(exact, usable))).otherwise(
            F.expr(f"cast(array() as {SPANS})")
        ),
    )
    edits = F.transform(
        F.filter("_edits", lambda s: s["source"] == "known"),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("new")),
    )
    return out.withColumn(text, P.splice(body, edits)).drop("_found", "_edits")


def withhold_lines(masked: DataFrame, vault: DataFrame, text: str = "masked") -> DataFrame:
    """Replace each line that still holds a known value by a fixed notice."""
    values = known_values(vault).where(~F.col("word")).select("session", F.col("spelling").alias("value"))
    lines = masked.select(*KEYS, F.posexplode(F.split(text, "\n")).alias("_line", "_text"))
    shown = lines.withColumn("_text", F.regexp_replace("_text", X.EXACT, "\u0000"))
    bad = (
        find_values(shown, values, [*KEYS, "_line"], by=["session"], text="_text")
        .groupBy(*KEYS).agg(F.collect_set("_line").alias("_bad"))
    )
    kept = F.transform(
        F.split(text, "\n"),
        lambda line, i: F.when(F.array_contains("_bad", i), F.lit(X.WITHHELD)).otherwise(line),
    )
    return masked.join(bad, KEYS, "left").withColumn(
        text, F.when(F.col("_bad").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text))
    ).drop("_bad")


def leak_check(
    masked: DataFrame, vault: DataFrame, remembered: DataFrame | None = None,
    registry: DataFrame | None = None, text: str = "masked",
) -> DataFrame:
    """Known values still visible between placeholders: one row each a text.

    Registered values count as whole tokens, others as substrings, none
    across a placeholder. Gives ``KEYS, code, entity_type, placeholder,
    value, length``.
    """
    known = vault.select("session", "value", "entity_type", "placeholder")
    if remembered is not None:
        extra = remembered.join(vault.select("session", "value"), ["session", "value"], "left_anti")
        known = known.unionByName(extra.select(*known.columns))
    if registry is not None:
        listed = registry.select("value", F.lit(True).alias("token")).distinct()
        known = known.join(listed, "value", "left").withColumn("token", F.coalesce("token", F.lit(False)))
    else:
        known = known.withColumn("token", F.lit(False))
    shown = masked.select(*KEYS, F.regexp_replace(text, X.EXACT, "\u0000").alias("_text"))
    found = find_values(shown, known, KEYS, by=["session"], text="_text", token="token")
    return found.select(
        *KEYS, F.lit("leak").alias("code"), "entity_type", "placeholder", "value",
        F.length("value").alias("length"),
    ).distinct()


def cut_leaks(entities: DataFrame, texts: DataFrame, vault: DataFrame, text: str = "text") -> DataFrame:
    """Known values that a merged placeholder hides only part of.

    Searched in the original text; an occurrence counts when it reaches into
    a merged span but does not lie inside touching merged spans.
    """
    merged = entities.where(F.col("source") == "merged")
    affected = merged.select(*KEYS).distinct()
    runs = merged.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_m")
    )
    members = entities.select(
        *KEYS, F.when(F.size("members") > 0, F.col("members")).otherwise(
            F.array(F.struct(F.col("value").alias("value"), F.col("entity_type").alias("entity_type")))
        ).alias("_v"),
    )
    sessions = affected.select("session").distinct()
    values = vault.select("session", "value", "entity_type", "placeholder").join(
        sessions if small(sessions) else sessions.hint("merge"), "session", "left_semi"
    )
    # Texts, runs and kept spans may be as many as the texts: they are never broadcast by a guess.
    found = find_values(
        texts.join(affected.hint("merge"), KEYS, "left_semi").select(*KEYS, text), values, KEYS, by=["session"], text=text
    ).withColumn("end", F.col("start") + F.length("value"))
    fused = F.aggregate(
        "_m",
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, m: F.when(
            F.get(acc, F.size(acc) - 1)["end"] == m["start"],
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), m["end"].alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(m))),
    )
    kept = entities.where(F.col("source") != "merged").groupBy(*KEYS).agg(
        F.collect_list(F.struct("start", "end")).alias("_k")
    )
    out = found.join(runs.withColumn("_m", fused).hint("merge"), KEYS).join(kept.hint("merge"), KEYS, "left")
    touches = F.exists("_m", lambda m: (m["start"] < F.col("end")) & (F.col("start") < m["end"]))
    inside = F.exists("_m", lambda m: (m["start"] <= F.col("start")) & (F.col("end") <= m["end"]))
    hidden = F.coalesce(
        F.exists("_k", lambda k: (k["start"] < F.col("end")) & (F.col("start") < k["end"])), F.lit(False)
    )
    return out.where(touches & ~inside & ~hidden).select(*KEYS, "value", "entity_type", "placeholder").distinct()


def count_private_values(payloads: DataFrame, vault: DataFrame, text: str = "text") -> DataFrame:
    """Distinct known values in each payload (session, seq, section)."""
    values = vault.where(F.col("entity_type") != X.LITERAL).select("session", "value")
    found = find_values(payloads.select(*KEYS, text), values, KEYS, by=["session"], text=text)
    counts = found.groupBy(*KEYS).agg(F.countDistinct("value").alias("private_values"))
    return payloads.join(counts, KEYS, "left").withColumn(
        "private_values", F.coalesce("private_values", F.lit(0))
    )


def decide(counted: DataFrame, destinations: DataFrame) -> DataFrame:
    """allow, ask or deny a payload by where it goes.

    ``destinations`` has ``destination, kind`` with kind local, shell or
    remote; an unknown destination counts as remote.
    """
    kind = F.coalesce("kind", F.lit("remote"))
    return counted.join(destinations, "destination", "left").withColumn(
        "decision",
        F.when((kind == "local") | (F.col("private_values") == 0), "allow")
        .when(kind == "shell", "ask").otherwise("deny"),
    )


def folded_match(names: DataFrame, values: DataFrame, name: str = "name", min_length: int = 3) -> DataFrame:
    """Names that hold a value ignoring case, spaces, ``_`` and ``-``."""
    folded = (
        values.select("value", fold(F.col("value")).alias("_f"))
        .where(F.length("_f") >= min_length)
        .select("value", F.col("_f"))
    )
    targets = names.select(name).distinct().withColumn("_t", fold(F.col(name)))
    found = find_values(
        targets, folded.select(F.col("_f").alias("value"), F.col("value").alias("original")), [name], text="_t"
    )
    return found.select(name, F.col("original").alias("value")).distinct()
