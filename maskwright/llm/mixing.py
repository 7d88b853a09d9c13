"""Mix sources to target weights by Pareto order sampling.

A source's target follows from its weight. Its documents are due copies in
proportion to their merit, the binary digits of their size, so that long texts
are preferred a little; whole copies are certain, and the fraction is the
document's inclusion probability in a fixed-size sample. Documents are ranked by
random odds over inclusion odds (Rosen's Pareto order sampling) and taken from
the front until the words that are left to the source are used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.rows import boxed
from maskwright.plans.runtime import lookup_join, pin, running_total, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: No source, and no document, is repeated more often than this.
MOST_COPIES = 3
SEED = "mix-1"
#: The table of sources is broadcast up to this many rows; beyond, it is shuffled.
SOURCES_BROADCAST = 50_000


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the key's text, alike in every run and engine."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Add ``target`` to a table of sources: ``_none``, ``_source``, ``source_size``.

    Sources by code point, null last, take the weights in turn. A target is
    ``min(most * size, level * weight)`` with one level for all, so that the
    targets add up to all sizes: source i is capped if the total at level
    ``most * size_i / weight_i`` does not exceed the sum. Ranks and prefix sums
    are range-partitioned, so the number of sources is not bounded.
    """
    ranked = running_total(sizes.withColumn("_one", F.lit(1)), [], ["_none", "_source"], "_one", "_rank")
    share = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", share).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    order = ["_level", "_none", "_source"]
    ranked = ranked.withColumn("_level", F.col("_cap") / F.col("_weight"))
    summed = running_total(running_total(ranked, [], order, "_cap", "_caps"), [], order, "_weight", "_weights")
    summed = pin(summed)
    whole = summed.agg(F.sum("source_size").alias("total"), F.sum("_weight").alias("weight")).first()
    total, weight = float(whole["total"] or 0), float(whole["weight"] or 0)
    capped = F.col("_caps") + F.col("_level") * (F.lit(weight) - F.col("_weights")) <= F.lit(total)
    top = summed.where(capped).agg(F.max("_caps").alias("caps"), F.max("_weights").alias("weights")).first()
    caps, used = float(top["caps"] or 0), float(top["weights"] or 0)
    level = (total - caps) / (weight - used) if weight > used else 0.0
    return summed.select(
        "_none", "_source", "source_size",
        F.when(capped, F.col("_cap")).otherwise(F.least("_cap", F.lit(level) * F.col("_weight"))).alias("target"),
    )


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def merit_of(size: Column) -> Column:
    """A document's claim on copies beside others of its source: the binary digits of its size."""
    return F.length(F.bin(size)).cast("long")


def pareto(key: Column, part: Column) -> Column:
    """Random odds over inclusion odds; what can't be sampled comes last."""
    u = uniform(key)
    odds = part / (1 - part)
    return F.when(part > 0, (u / (1 - u)) / odds).otherwise(float("inf"))


def with_levels(classes: DataFrame) -> DataFrame:
    """Add ``copies``, ``_whole`` and ``_part`` to ``_none``, ``_source``, ``_merit``, ``_words``, ``source_size``, ``target``.

    A document of merit m is due ``min(MOST_COPIES, level * m)`` copies, with one
    level a source, so that the copies' words add up to the target. Merits are
    few (a size has at most 63 digits), so a source is a small window.
    """
    before = Window.partitionBy("_none", "_source").orderBy(F.col("_merit").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    source = Window.partitionBy("_none", "_source")
    most, claim = F.lit(float(MOST_COPIES)), F.col("_merit") * F.col("_words")
    # The highest merits reach the cap first: whether one does at the level that just brings it there.
    full = classes.withColumn("_full", most * F.sum("_words").over(before)).withColumn("_claims", F.sum(claim).over(before))
    full = full.withColumn("_all", F.sum(claim).over(source))
    capped = F.col("_full") + (most / F.col("_merit")) * (F.col("_all") - F.col("_claims")) <= F.col("target")
    full = full.withColumn("_capped", capped)
    full = full.withColumn("_used", F.coalesce(F.max(F.when(F.col("_capped"), F.col("_full"))).over(source), F.lit(0.0)))
    full = full.withColumn("_met", F.coalesce(F.max(F.when(F.col("_capped"), F.col("_claims"))).over(source), F.lit(0)))
    level = F.try_divide(F.col("target") - F.col("_used"), F.col("_all") - F.col("_met"))
    copies = F.when(F.col("_words") == 0, 0.0).when(F.col("_capped"), most).otherwise(F.least(most, level * F.col("_merit")))
    return full.withColumn("copies", copies).select(
        "_none", "_source", "_merit", "_words", "source_size", "target",
        F.floor("copies").alias("_whole"), (F.col("copies") - F.floor("copies")).alias("_part"),
    )


def ranked(docs: DataFrame, key: str, source: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Every row in Pareto order with ``_picked``, and the table of sources and merits."""
    sized = pin(docs.select(
        F.col(key).alias("_key"), F.col(source).isNull().alias("_none"), F.coalesce(F.col(source), F.lit("")).alias("_source"),
        words_in(F.col(text)).alias("size"),
    ).withColumn("_merit", merit_of(F.col("size"))))
    words = pin(sized.groupBy("_none", "_source", "_merit").agg(F.sum("size").alias("_words")))
    whole = targets(words.groupBy("_none", "_source").agg(F.sum("_words").alias("source_size")))
    classes = pin(with_levels(words.join(whole, ["_none", "_source"])))
    certain = classes.groupBy("_none", "_source").agg(F.sum(F.col("_whole") * F.col("_words")).alias("_certain"))
    rows = lookup_join(sized, classes.join(certain, ["_none", "_source"]).drop("_words"), ["_none", "_source", "_merit"])
    rows = rows.withColumn("_pareto", pareto(F.col("_key"), F.col("_part"))).withColumnRenamed("_part", "_rest")
    rows = running_total(rows, ["_none", "_source"], ["_pareto", "_key", "size"], "size", "_sum")
    left = F.col("target") - F.col("_certain")
    return rows.withColumn("_picked", (F.col("_rest") > 0) & (F.col("_sum") - F.col("size") / 2 <= left)), classes


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``key``, ``size``, ``source_size``, ``target``, ``taken``: one row per row of ``docs``.

    ``taken`` is a whole number of copies times ``size``; a source's sum is off
    its target by at most half its largest document. A document is due copies by
    the binary digits of its size, so inclusion probabilities differ inside a
    source. A null text has size 0, a null source is a source of its own, a null
    key a key like any other; repeated rows compete like different ones; other
    columns are ignored; no rows give no rows.
    """
    rows, _ = ranked(docs, key, source, text)
    taken = F.col("size") * (F.col("_whole") + F.col("_picked").cast("int"))
    return rows.select(F.col("_key").alias(key), "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeat(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns, whatever their names.

    What is taken of a source is all that comes before one place in its Pareto
    order, so texts need only that place and the copies of each merit, at most 64
    rows per source, and are not shuffled. Rows that tie there (repeated rows)
    are taken alike.
    """
    rows, classes = ranked(docs, key, source, text)
    last = rows.where("_picked").groupBy("_none", "_source").agg(F.max(F.struct("_pareto", "_key", "size")).alias("_last"))
    places = pin(classes.join(last, ["_none", "_source"], "left").select("_none", "_source", "_merit", "_whole", "_part", "_last"))
    few = small(places, SOURCES_BROADCAST)
    size = words_in(F.col(text))
    own = boxed(
        docs, _key=F.col(key), size=size, _none=F.col(source).isNull(), _source=F.coalesce(F.col(source), F.lit("")), _merit=merit_of(size),
    )
    joined = own.join(F.broadcast(places) if few else places, ["_none", "_source", "_merit"])
    here = F.struct(pareto(F.col("_key"), F.col("_part")).alias("_pareto"), "_key", "size")
    picked = F.coalesce((F.col("_part") > 0) & (here <= F.col("_last")), F.lit(False))
    times = (F.col("_whole") + picked.cast("int")).cast("int")
    return joined.select("_row", F.explode(F.array_repeat(F.lit(1), times))).select("_row.*")
