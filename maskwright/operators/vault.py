"""The vault: one stable placeholder per value and session, as a table.

``vault`` columns: session, entity_type, number, placeholder, value, seq,
section, start (where the value was first seen) and first_seen.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.placeholders import format_placeholder
from ..plans.runtime import lookup_join, running_total

VAULT = (
    "session string, entity_type string, number bigint, placeholder string, value string, "
    "seq bigint, section int, start int, first_seen timestamp"
)
REMEMBERED = "session string, value string, entity_type string, placeholder string"
MERGED = "session string, placeholder string"
SESSIONS = "session string, generation bigint, last_used timestamp"
ORDER = ["seq", "section", "start"]


def empty_vault(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VAULT)


def first_seen_values(entities: DataFrame) -> DataFrame:
    """One row per session and value: its first type and place (pre-aggregated)."""
    place = F.struct(*ORDER)
    return (
        entities.groupBy("session", "value")
        .agg(F.min_by("entity_type", place).alias("entity_type"), F.min(place).alias("_at"))
        .select("session", "value", "entity_type", *[F.col(f"_at.{c}").alias(c) for c in ORDER])
    )


def number_values(new: DataFrame, vault: DataFrame | None = None) -> DataFrame:
    """Give each new value the next number of its session and type.

    Numbers follow reading order. The highest number so far enters as one
    more row with its own weight, ahead of all others, so nothing is joined
    and no session has to fit in one task.
    """
    rows = new.withColumn("_weight", F.lit(1).cast("bigint")).withColumn("_late", F.lit(1))
    if vault is not None:
        so_far = vault.groupBy("session", "entity_type").agg(F.max("number").alias("_weight"))
        rows = rows.unionByName(so_far.withColumn("_late", F.lit(0)), allowMissingColumns=True)
    order = ["_late", *ORDER, "value"]
    ranked = running_total(rows, ["session", "entity_type"], order, "_weight", "number")
    return (
        ranked.where(F.col("_late") == 1)
        .drop("_weight", "_late")
        .withColumn("placeholder", format_placeholder(F.col("entity_type"), F.col("number")))
        .withColumn("first_seen", F.current_timestamp())
        .select(*[c.strip().split(" ")[0] for c in VAULT.split(",")])
    )


def assign(entities: DataFrame, vault: DataFrame | None = None) -> DataFrame:
    """New vault rows for every value of ``entities`` not yet in ``vault``."""
    new = first_seen_values(entities)
    if vault is not None:
        new = new.join(vault.select("session", "value"), ["session", "value"], "left_anti")
    return number_values(new, vault)


def placeholders_for(entities: DataFrame, vault: DataFrame) -> DataFrame:
    """Entities with their ``placeholder``, and the type it was stored with."""
    known = vault.select("session", "value", "placeholder", F.col("entity_type").alias("stored_type"))
    joined = lookup_join(entities, known, ["session", "value"])
    return joined.withColumn("entity_type", F.coalesce("stored_type", "entity_type")).drop("stored_type")


def lookup_values(placeholders: DataFrame, vault: DataFrame) -> DataFrame:
    """Rows of (session, placeholder) with their original ``value``."""
    return lookup_join(
        placeholders, vault.select("session", "placeholder", "value"), ["session", "placeholder"]
    )


def items(vault: DataFrame) -> DataFrame:
    """Mappings in creation order."""
    return vault.orderBy("session", *ORDER).select("session", "placeholder", "value")


def sizes(vault: DataFrame) -> DataFrame:
    return vault.groupBy("session").agg(F.count(F.lit(1)).alias("values"))


def fresh_spellings(candidates: DataFrame, vault: DataFrame, remembered: DataFrame | None = None) -> DataFrame:
    """Spellings without a placeholder of their own that are not kept yet.

    The first placeholder wins; a value stored in its own right, or already
    remembered, is left out. ``candidates`` has session, value, entity_type,
    placeholder and the reading-order columns.
    """
    place = F.struct(*ORDER)
    fresh = candidates.groupBy("session", "value").agg(
        F.min_by("entity_type", place).alias("entity_type"),
        F.min_by("placeholder", place).alias("placeholder"),
    )
    out = fresh.join(vault.select("session", "value"), ["session", "value"], "left_anti")
    if remembered is not None:
        out = out.join(remembered.select("session", "value"), ["session", "value"], "left_anti")
    return out


def remember(candidates: DataFrame, vault: DataFrame, remembered: DataFrame | None = None) -> DataFrame:
    """All spellings kept for leak checks, with those of ``candidates``."""
    fresh = fresh_spellings(candidates, vault, remembered)
    return fresh if remembered is None else remembered.unionByName(fresh)


def fresh_marks(entities: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """Placeholders that cover several matches and are not marked yet."""
    new = entities.where(F.col("source") == "merged").select("session", "placeholder").distinct()
    return new if merged is None else new.join(merged.select("session", "placeholder"), ["session", "placeholder"], "left_anti")


def mark_merged(entities: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """All placeholders that cover several matches (insert only)."""
    new = fresh_marks(entities, merged)
    return new if merged is None else merged.select("session", "placeholder").unionByName(new)


def clear(table: DataFrame, session: str) -> DataFrame:
    """Forget one session; its numbers restart at 1."""
    return table.where(F.col("session") != session)


def touch(sessions: DataFrame, used: DataFrame) -> DataFrame:
    """Merge new uses (session, ts); a session not seen before gets a generation."""
    now = used.groupBy("session").agg(F.max("ts").alias("_ts"))
    both = sessions.join(now, "session", "full_outer")
    return both.select(
        "session",
        F.coalesce("generation", F.unix_micros("_ts")).alias("generation"),
        F.greatest("last_used", "_ts").alias("last_used"),
    )


def purge(tables: dict[str, DataFrame], sessions: DataFrame, older_than_days: float, now) -> dict:
    """Drop every table's rows of sessions unused for longer than the interval.

    Returns the tables left, the sessions left, and ``purged``: the sessions
    that went.
    """
    if older_than_days < 0:
        raise ValueError("older_than must not be negative")
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(older_than_days * 86400.0))
    gone = sessions.where(F.col("last_used") < cutoff).select("session")
    left = {n: t.join(gone, "session", "left_anti") for n, t in tables.items()}
    return {**left, "sessions": sessions.join(gone, "session", "left_anti"), "purged": gone}


def literal_types(vault: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Types whose placeholder-shaped text must be escaped."""
    spark = vault.sparkSession
    fixed = spark.createDataFrame(
        [(t,) for t in X.PII_TYPES + X.SECRET_TYPES + X.REVIEW_TYPES], "entity_type string"
    )
    out = fixed.unionByName(vault.select("entity_type"))
    if registry is not None:
        out = out.unionByName(registry.select("entity_type"))
    return out.distinct()
