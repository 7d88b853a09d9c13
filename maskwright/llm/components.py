"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.plans.runtime import pin

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node that each node of ``edges`` (``a``, ``b``) reaches.

    Alternating large-star and small-star rounds: every node hands the smallest
    node it knows to its larger neighbours, then to itself and its smaller
    ones. Each round is a partial aggregation and a join by node, in which
    Spark splits a hot node; the number of rounds grows with the logarithm of
    the graph, and each is cut off by a checkpoint.
    """
    now = pin(_down(edges.where(F.col("a") != F.col("b"))))
    seen = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).withColumn("m", F.least("m", "hi"))
        large = both.where(F.col("lo") > F.col("hi")).join(least, "hi").select(F.col("lo").alias("a"), F.col("m").alias("b"))
        now = _down(large)
        least = now.groupBy("hi").agg(F.min("lo").alias("m"))
        small = now.join(least, "hi")
        small = small.select(F.col("lo").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("hi").alias("a"), F.col("m").alias("b")))
        now = pin(_down(small.where(F.col("a") != F.col("b"))))
        code = F.xxhash64("hi", "lo")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(code), F.sum(F.shiftright(code, 16))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node to the smaller."""
    return edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
