"""The registry of exact values, and custom patterns."""

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X

REGISTRY = "entity_type string, value string"


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Read ``{type: [values]}`` files as rows."""
    raw = spark.read.option("wholetext", True).text(path)
    pairs = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("entity_type", "v"))
    return pairs.select("entity_type", F.explode("v").alias("value"))


def registry_errors(registry: DataFrame) -> DataFrame:
    """Rows that may not be registered, and why."""
    many = registry.groupBy("value").agg(F.countDistinct("entity_type").alias("_n")).where("_n > 1")
    kind, value = F.col("entity_type"), F.col("value")
    reason = (
        F.when(F.length(F.trim(value)) == 0, "blank value")
        .when(value.rlike(r"[\r\n]"), "value on several lines")
        .when(~kind.rlike(f"^{X.TYPE_NAME}$"), "invalid type name")
        .when(kind == X.LITERAL, "reserved type name")
        .when(F.col("_n").isNotNull(), "value with several types")
    )
    return (
        registry.join(many, "value", "left").withColumn("reason", reason)
        .where(F.col("reason").isNotNull()).select("entity_type", "value", "reason")
    )


def validated(registry: DataFrame) -> DataFrame:
    """The registry, or a failure when any row is wrong (values not quoted)."""
    wrong = registry_errors(registry).groupBy("reason").count().collect()  # five reasons at most
    if wrong:
        raise ValueError("; ".join(f"{r['reason']}: {r['count']}" for r in wrong))
    return registry.dropDuplicates(["value"])


def registry_add(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Add values; a value already registered keeps its one type."""
    fresh = new.dropDuplicates(["value"]).join(registry.select("value"), "value", "left_anti")
    return registry.select("entity_type", "value").unionByName(fresh.select("entity_type", "value"))


def registry_remove(registry: DataFrame, gone: DataFrame) -> DataFrame:
    return registry.join(gone.select("value"), "value", "left_anti").select("entity_type", "value")


def registry_counts(registry: DataFrame) -> DataFrame:
    """How many values each type has; no value is shown."""
    return registry.groupBy("entity_type").agg(F.countDistinct("value").alias("values"))


def load_patterns(source: str | dict, max_length: int = 2000) -> dict[str, str]:
    """Custom ``{type: regex}``, checked. Patterns use Java's dialect.

    Repeating a group without a possessive quantifier can exhaust the stack
    on long texts, so such patterns are refused, as are over-long ones.
    """
    patterns = json.loads(source) if isinstance(source, str) else dict(source)
    for kind, regex in patterns.items():
        if not re.fullmatch(X.TYPE_NAME, kind) or kind == X.LITERAL:
            raise ValueError(f"invalid entity type {kind!r}")
        if not isinstance(regex, str) or len(regex) > max_length:
            raise ValueError(f"pattern of {kind} is not a string of at most {max_length} characters")
        if re.search(r"\)(?:[*+]|\{\d+,\})(?!\+)", regex):
            raise ValueError(f"pattern of {kind} repeats a group without a bound: add '+' to make it possessive")
        from pyspark.sql import SparkSession as S

        spark = S.getActiveSession()
        if spark is not None:
            try:
                spark._jvm.java.util.regex.Pattern.compile(regex)
            except Exception as error:
                raise ValueError(f"invalid regex for {kind}") from error
    return patterns
