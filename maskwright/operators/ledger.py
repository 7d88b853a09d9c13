"""The ledger: what was really written, so that history replays masked.

Rows: session, kind (text, tool, seen), key, digest, masked, used.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEDGER = "session string, kind string, key string, digest string, masked string, used timestamp"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_leaves(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One digest per JSON value whatever its key order, spacing or number form.

    Every leaf becomes path, kind and value; numbers compare as doubles.
    """
    from .jsondata import leaves

    flat = leaves(df, keys, column)
    number = F.col("value").try_cast("double")
    value = F.when(
        F.col("kind") == "number", F.coalesce((number + F.lit(0.0)).cast("string"), F.col("value"))
    ).otherwise(F.col("value"))
    value = F.when(value == "-0.0", "0.0").otherwise(value)
    line = F.struct(F.array_join("path", "\u0001").alias("p"), F.col("kind").alias("k"), F.coalesce(value, F.lit("")).alias("v"))
    return flat.groupBy(*keys).agg(
        digest(F.to_json(F.array_sort(F.collect_list(line)))).alias("digest")
    )


def record(ledger: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Add rows; the latest one of each (session, kind, key) stays."""
    both = rows if ledger is None else ledger.unionByName(rows)
    order = F.struct("used", "masked")
    return both.groupBy("session", "kind", "key").agg(
        F.max_by("digest", order).alias("digest"), F.max_by("masked", order).alias("masked"),
        F.max("used").alias("used"),
    ).select("session", "kind", "key", "digest", "masked", "used")


def text_rows(restored: DataFrame, text: str = "restored", masked: str = "masked", used: str = "used") -> DataFrame:
    """Ledger rows of restored replies: only the masked text is kept."""
    d = digest(F.col(text))
    return restored.select(
        "session", F.lit("text").alias("kind"), d.alias("key"), d.alias("digest"),
        F.col(masked).alias("masked"), F.col(used).alias("used"),
    )


def seen_rows(values: DataFrame, value: str = "value", used: str = "used") -> DataFrame:
    d = digest(F.col(value))
    return values.select(
        "session", F.lit("seen").alias("kind"), d.alias("key"), d.alias("digest"),
        F.lit(None).cast("string").alias("masked"), F.col(used).alias("used"),
    )


def replay_replies(sections: DataFrame, ledger: DataFrame, text: str = "text", out: str = "masked") -> DataFrame:
    """Assistant text restored before goes back as it was recorded."""
    known = ledger.where(F.col("kind") == "text").select(
        "session", F.col("key").alias("_d"), F.col("masked").alias("_recorded")
    )
    asked = sections.withColumn(
        "_d", F.when(F.col("role") == "assistant", digest(F.col(text)))
    )
    return asked.join(known, ["session", "_d"], "left").withColumn(
        out, F.coalesce("_recorded", out) if out in sections.columns else F.col("_recorded")
    ).withColumn("replayed", F.col("_recorded").isNotNull()).drop("_d", "_recorded")


def replay_tool_inputs(calls: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tool inputs (session, tool_id, digest) whose recorded form still matches."""
    known = ledger.where(F.col("kind") == "tool").select(
        "session", F.col("key").alias("tool_id"), "digest", F.col("masked").alias("replayed")
    )
    return calls.join(known, ["session", "tool_id", "digest"], "left")


def seen(values: DataFrame, ledger: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Opaque values that may pass (seen before), and those that may not."""
    known = ledger.where(F.col("kind") == "seen").select("session", F.col("digest").alias("_d"))
    asked = values.withColumn("_d", digest(F.col(value)))
    return (
        asked.join(known, ["session", "_d"], "left_semi").drop("_d"),
        asked.join(known, ["session", "_d"], "left_anti").drop("_d"),
    )


def purge(ledger: DataFrame, older_than_days: float, now) -> DataFrame:
    """Drop the ledger of sessions whose last use is older than the interval."""
    if older_than_days < 0:
        raise ValueError("older_than must not be negative")
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(older_than_days * 86400.0))
    stale = ledger.groupBy("session").agg(F.max("used").alias("_u")).where(F.col("_u") < cutoff)
    return ledger.join(stale.select("session"), "session", "left_anti")
