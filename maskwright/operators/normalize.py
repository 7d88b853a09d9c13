"""Equivalence keys: when two spellings are one value (opt in)."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as X
from ..functions import pii
from ..functions.spans import fence, let
from ..plans.runtime import evenly, pin
from .vault import ORDER, first_seen_values, number_values


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def key_email(value: Column, compose=None) -> Column:
    """Lower case, composed (NFC). Glued or encoded text has no key.

    Only non-ASCII rows need ``compose``; Spark has no built-in for it.
    """
    local = F.regexp_replace(value, "@[^@]*$", "")
    odd = F.exists(
        F.split(value, ""), lambda c: (F.lower(c) != c) & (F.upper(F.lower(c)) != c)
    )
    usable = (
        pii.is_email(value)
        & ~local.rlike("[=&/!#$^~]|%[0-9A-Fa-f]{2}")
        & ~F.when(value.rlike(r"[^\x00-\x7f]"), odd).otherwise(F.lit(False))
    )
    lower = F.lower(value)
    if compose is not None:
        lower = F.coalesce(compose(F.when(lower.rlike(r"[^\x00-\x7f]"), lower)), lower)
    return F.when(usable, lower)


def _ascii_digits(text: Column) -> Column:
    only = F.regexp_replace(text, r"[^\p{Nd}]", "")
    # Fixed value: decimal digits of the scripts that print phone numbers.
    digits = "0123456789٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९০১২৩৪৫৬৭৮৯๐๑๒๓๔๕๖๗๘๙０１２３４５６７８９"
    return F.translate(only, digits, "0123456789" * 7)


def key_phone(value: Column) -> Column:
    """E.164 digits and extension; without "+" a number is North American."""
    tail = F.regexp_extract(value, rf"({X.EXTENSION})$", 1)
    base = F.substr(value, F.lit(1), F.length(value) - F.length(tail))
    ext = F.when(tail != "", F.concat(F.lit(";ext="), _ascii_digits(tail))).otherwise("")
    digits = _ascii_digits(base)
    american = F.when(base.startswith("+") | (F.length(digits) == 11), F.concat(F.lit("+"), digits, ext)).otherwise(
        F.concat(F.lit("+1"), digits, ext)
    )
    direct = F.regexp_replace(base, rf"^(\(?\+[1-9]{X.DIGIT}{{0,2}}\)?){X.SEP}?\(0\)", "$1")
    abroad = F.when(
        value.rlike(rf"^{X.PHONE_INTL}{X.EXTENSION}?$") & pii.plausible(base) & ~direct.contains("(0)"),
        F.concat(F.lit("+"), _ascii_digits(direct), ext),
    )
    return F.when(pii.is_phone_us(value), american).otherwise(abroad)


def key_ipv6(value: Column) -> Column:
    """The 128-bit value as 32 hex digits."""
    quad = F.transform(F.split(F.regexp_extract(value, r"([0-9.]+\.[0-9.]+)$", 1), r"\."), lambda o: o.try_cast("int"))
    as_hex = F.when(
        value.contains("."),
        F.concat(
            F.regexp_replace(value, r"[0-9.]+\.[0-9.]+$", ""),
            F.lower(F.hex(F.get(quad, F.lit(0)) * 256 + F.get(quad, F.lit(1)))), F.lit(":"),
            F.lower(F.hex(F.get(quad, F.lit(2)) * 256 + F.get(quad, F.lit(3)))),
        ),
    ).otherwise(F.lower(value))

    def expand(text):
        groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
        left = groups(F.substring_index(text, "::", 1))
        right = F.when(text.contains("::"), groups(F.substring_index(text, "::", -1))).otherwise(
            F.expr("cast(array() as array<string>)")
        )
        zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
        return F.array_join(
            F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), ""
        )

    return F.when(value.rlike("^[0-9A-Fa-f:.]+$") & pii.is_ipv6(value), let(as_hex, expand))


def key_card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    ok = value.rlike(f"^[0-9]+(?:{X.CARD_SEP}[0-9]+)*$") & F.length(digits).between(12, 19)
    return F.when(ok, digits)


def key_iban(value: Column) -> Column:
    compact = F.upper(F.regexp_replace(value, X.GROUP_SPACE, ""))
    ok = value.rlike(f"^[A-Za-z]{{2}}[0-9]{{2}}[A-Za-z0-9]*(?:{X.GROUP_SPACE}[A-Za-z0-9]+)*$")
    return F.when(ok & F.length(compact).between(15, 34), compact)


NORMALIZERS = {
    "EMAIL": lambda c: key_email(c, _nfc),
    "PHONE": key_phone,
    "IPV6": key_ipv6,
    "CREDIT_CARD": key_card,
    "IBAN": key_iban,
}


def value_key(entity_type: Column, value: Column, normalizers=None) -> Column:
    """The key of ``value`` for its type; null means: match exactly."""
    out = F.lit(None).cast("string")
    for kind, make in (normalizers or NORMALIZERS).items():
        out = F.when(entity_type == kind, make(F.when(entity_type == kind, value))).otherwise(out)
    return out


def assign_normalized(
    entities: DataFrame, vault: DataFrame | None = None, merged: DataFrame | None = None,
    normalizers=None,
) -> tuple[DataFrame, DataFrame]:
    """New vault rows, and aliases: spellings that share a stored placeholder.

    In order: a value's own placeholder; that of the first stored, unmerged
    value of the same type and key; a new one, which the first spelling in
    reading order gets. Merged spans never have a key.
    """
    place = F.struct(*ORDER)
    whole = entities.groupBy("session", "value").agg(
        F.min_by("entity_type", place).alias("entity_type"),
        F.min(place).alias("_at"),
        F.min_by("source", place).alias("source"),
    ).select("session", "value", "entity_type", "source", *[F.col(f"_at.{c}").alias(c) for c in ORDER])
    if vault is not None:
        whole = whole.join(vault.select("session", "value"), ["session", "value"], "left_anti")
    key = F.when(F.col("source") != "merged", value_key(F.col("entity_type"), F.col("value"), normalizers))
    exact = F.concat(F.lit("="), F.col("value"))
    # Keys are costly and the rows are few bytes: they are worked out once, by all cores.
    keyed = pin(evenly(whole).withColumn("key", key).withColumn(
        "class", F.coalesce(F.concat(F.lit("~"), F.col("key")), exact)
    ))
    group = ["session", "entity_type", "class"]
    heads = keyed.groupBy(*group).agg(
        F.min_by("value", place).alias("head"), F.min(place).alias("_head")
    )
    if vault is not None:
        stored = vault
        if merged is not None:
            stored = stored.join(merged.select("session", "placeholder"), ["session", "placeholder"], "left_anti")
        index = pin(
            evenly(stored).withColumn("key", fence(value_key(F.col("entity_type"), F.col("value"), normalizers)))
            .where(F.col("key").isNotNull())
            .groupBy("session", "entity_type", F.concat(F.lit("~"), F.col("key")).alias("class"))
            .agg(F.min_by("placeholder", F.struct("number", *ORDER)).alias("shared"))
        )
        heads = heads.join(index, group, "left")
    else:
        heads = heads.withColumn("shared", F.lit(None).cast("string"))
    fresh = heads.where(F.col("shared").isNull()).select(
        "session", F.col("head").alias("value"), "entity_type",
        *[F.col(f"_head.{c}").alias(c) for c in ORDER],
    )
    new = number_values(fresh, vault)
    named = (
        heads.join(new.select("session", F.col("value").alias("head"), "entity_type", "placeholder"),
                   ["session", "head", "entity_type"], "left")
        .select(*group, "head", F.coalesce("shared", "placeholder").alias("placeholder"), "shared")
    )
    aliases = (
        keyed.join(named, group)
        .where((F.col("value") != F.col("head")) | F.col("shared").isNotNull())
        .select("session", "value", "entity_type", "placeholder", *ORDER)
    )
    return new, aliases
