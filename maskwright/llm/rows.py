"""Rows that are carried through an operator beside its own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boxed(docs: DataFrame, **own: Column) -> DataFrame:
    """Each row of ``docs`` as one struct ``_row`` beside the given columns, so that no name clashes."""
    return docs.select(F.struct(*own_columns(docs)).alias("_row"), *(value.alias(name) for name, value in own.items()))


def own_columns(docs: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
