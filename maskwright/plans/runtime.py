"""Cutting lineage, broadcast limits, and joins and ranks that survive hot keys."""

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only if it is known to have at most this many rows.
BROADCAST_ROWS = 200_000
#: A key is hot when it holds more rows than this, and more than one
#: ten-thousandth of all rows: so there are never over 10 000 hot keys.
HOT_ROWS = 100_000
HOT_SHARE = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir`` of the session.

    Only a local session without one (a test) gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="maskwright-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(
    df: DataFrame, group: list[str], order: list[str], weight: str, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` up to each row, within its group.

    A group may be as large as the table: rows are range-partitioned by group
    and order, summed inside each partition, and shifted by what earlier
    partitions hold of the same group. Only a group that continues from the
    partition before needs a shift, so the broadcast table has at most one
    row per partition. ``order`` must be total within a group.
    """
    n = partitions(df.sparkSession)
    ranged = pin(
        df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id())
    )
    here = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = (
        ranged.groupBy("_part", *group)
        .agg(F.sum(weight).alias("_weight"))
        .withColumn("_shift", F.sum("_weight").over(earlier))
        .where(F.col("_shift").isNotNull())
        .drop("_weight")
    )
    return (
        ranged.withColumn(out, F.sum(weight).over(here))
        .join(F.broadcast(shifts), ["_part", *group], "left")
        .withColumn(out, F.col(out) + F.coalesce("_shift", F.lit(0)))
        .drop("_part", "_shift")
    )


def sweep(df: DataFrame, group: list[str], at: str, reach: list[str]) -> DataFrame:
    """Walk the points ``at`` of each group: unique points, in order, in equal parts.

    Every column of ``reach`` becomes its largest value up to the point, and
    ``next`` the following point (null at a group's last). A group may be as large as
    the table; like in ``running_total`` a part hands on one row per group that
    goes on in another part, so what is broadcast has at most one row per part.
    """
    n = partitions(df.sparkSession)
    ranged = pin(df.repartitionByRange(n, *group, at).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy("_part", *group).orderBy(at)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = Window.partitionBy(*group).orderBy("_part")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("_part", *group).agg(F.min(at).alias("_first"), *[F.max(c).alias(f"_max_{c}") for c in reach])
    handed = ends.select(
        "_part", *group, F.lead("_first").over(parts).alias("_next"), *[F.max(f"_max_{c}").over(earlier).alias(f"_before_{c}") for c in reach],
    ).where(F.col("_next").isNotNull() | F.greatest(*[F.col(f"_before_{c}").isNotNull().cast("int") for c in reach], F.lit(0)).cast("boolean"))
    walked = ranged.select(
        "_part", *group, at, F.lead(at).over(here).alias("next"), *[F.max(c).over(upto).alias(c) for c in reach]
    ).join(F.broadcast(handed), ["_part", *group], "left")
    return walked.select(
        *group, at, F.coalesce("next", "_next").alias("next"),
        *[F.greatest(c, f"_before_{c}").alias(c) for c in reach],
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core work when the input is one small unsplittable file.

    Matching is bound by computing, not reading. An input that already has a
    partition for every core, as any large one has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2, key) if df.rdd.getNumPartitions() <= cores // 2 else df


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows from which much is computed, dealt to four tasks a core.

    How many files or row groups hold them says nothing about the work: a table
    of a million short rows may be one of each. Rows are dealt out by turns, so
    that no value of theirs can gather them. An input of more partitions stays as it is.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism * 4
    return evenly(df) if df.rdd.getNumPartitions() < tasks else df


def evenly(df: DataFrame) -> DataFrame:
    """The same for rows behind a shuffle, which are put together to few tasks by their bytes."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4)


def small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether ``df`` has at most ``limit`` rows (reads at most one more)."""
    limit = BROADCAST_ROWS if limit is None else limit
    return df.limit(limit + 1).count() <= limit


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join against a table with at most one row per key.

    Rows of ``left`` under a hot key are answered from a broadcast of the hot
    keys only (at most ten thousand rows by definition); all other rows go
    through a shuffle in which no key is hot. ``left`` should be pinned: it
    is read three times.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = left.count()
    limit = max(HOT_ROWS, total // HOT_SHARE)
    # What the optimizer guesses of derived tables can be far too small: nothing but
    # the hot keys may be broadcast.
    right_rows = right.hint("merge")
    if total <= limit:
        return left.join(right_rows, keys, "left")
    hot_keys = counts.where(F.col("_n") > limit).select(*keys)
    hot = pin(right.join(F.broadcast(hot_keys), keys, "left_semi"))
    known = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    added = [c for c in right.columns if c not in keys]
    warm = known.where("_hot").select(*left.columns, *added)
    cold = known.where(F.col("_hot").isNull()).select(*left.columns)
    return warm.unionByName(cold.join(right_rows, keys, "left").select(*left.columns, *added))
