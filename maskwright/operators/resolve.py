"""Overlap resolution: interval algebra over the spans of one text.

Overlapping spans form islands; everything is decided inside an island, so
the work grows with the size of the islands, not with the text.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import SPAN, SPANS, fence, let, ordered, running

MEMBER = "struct<value:string,entity_type:string>"
KEPT = SPAN.replace("rule:int>", f"rule:int,members:array<{MEMBER}>>")


def islands(spans: Column) -> Column:
    """Group spans (sorted by start) into runs that overlap, transitively.

    A span begins a run if it starts at or after the furthest end before it.
    """
    def runs(x):
        fresh = F.filter(F.sequence(F.lit(0), F.size(x["s"]) - 1), lambda i: F.get(x["s"], i)["start"] >= F.get(x["reach"], i))
        return let(
            F.struct(x["s"].alias("s"), fresh.alias("f")),
            lambda y: F.transform(
                y["f"],
                lambda at, k: F.slice(y["s"], at + 1, F.coalesce(F.get(y["f"], k + 1), F.size(y["s"])) - at),
            ),
        )

    reach = lambda s: running(F.transform(s, lambda e: e["end"]), lambda a, b: F.greatest(a, b))
    grouped = lambda s: let(F.struct(s.alias("s"), reach(s).alias("reach")), runs)
    none = F.expr(f"cast(array() as array<{SPANS}>)")
    return let(spans, lambda s: F.when(F.size(s) > 0, grouped(s)).otherwise(none))


def _ranked(spans: Column) -> Column:
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            (s["start"] - s["end"]).alias("a"), (-s["priority"]).alias("b"),
            s["start"].alias("c"), s["rule"].alias("d"), s.alias("s"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def greedy(spans: Column) -> Column:
    """Longest first, then priority, then start: keep what overlaps nothing kept."""
    keep = F.aggregate(
        _ranked(spans),
        F.expr(f"cast(array() as {SPANS})"),
        lambda kept, s: F.when(
            F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept
        ).otherwise(F.concat(kept, F.array(s))),
    )
    return ordered(keep)


def resolve_overlaps(spans: Column) -> Column:
    """The kept spans of a text, ordered by start."""
    return F.flatten(
        F.transform(
            islands(ordered(spans)),
            lambda i: F.when(F.size(i) == 1, i).otherwise(greedy(i)),
        )
    )


def uncovered(s: Column, kept: Column) -> Column:
    """What of span ``s`` lies outside every kept span (sorted by start)."""
    begin = F.struct(s["start"].alias("pos"), F.lit("").alias("text"))
    piece = lambda a, b: F.substr(s["value"], a - s["start"] + 1, F.greatest(b - a, F.lit(0)))
    return F.aggregate(
        kept,
        begin,
        lambda acc, k: F.struct(
            F.greatest(acc["pos"], k["end"]).alias("pos"),
            F.concat(acc["text"], piece(acc["pos"], F.least(k["start"], s["end"]))).alias("text"),
        ),
        lambda acc: F.concat(acc["text"], piece(acc["pos"], s["end"])),
    )


def _alone(s: Column) -> Column:
    return s.withField("members", F.expr(f"cast(array() as array<{MEMBER}>)")).cast(KEPT)


def _merge_island(text: Column, island: Column) -> Column:
    def decide(kept):
        partial = F.filter(
            island, lambda s: ~F.array_contains(kept, s) & uncovered(s, kept).rlike(r"[\p{L}\p{N}]")
        )

        def group(items):
            held = F.filter(items, lambda s: F.array_contains(kept, s))

            def merged(best):
                start = F.array_min(F.transform(items, lambda s: s["start"]))
                end = F.array_max(F.transform(items, lambda s: s["end"]))
                whole = F.struct(
                    start.alias("start"), end.alias("end"),
                    F.substr(text, start + 1, end - start).alias("value"),
                    best["entity_type"].alias("entity_type"), F.lit("merged").alias("source"),
                    best["priority"].alias("priority"), best["rule"].alias("rule"),
                    F.transform(
                        held,
                        lambda s: F.struct(s["value"].alias("value"), s["entity_type"].alias("entity_type")),
                    ).alias("members"),
                )
                return F.array(whole).cast(f"array<{KEPT}>")

            return F.when(
                F.size(held) == F.size(items), F.transform(held, _alone)
            ).otherwise(let(F.element_at(_ranked(held), 1), merged))

        plain = F.transform(kept, _alone)
        regrouped = lambda extra: F.flatten(
            F.transform(islands(ordered(F.concat(kept, extra))), group)
        )
        return let(
            partial, lambda extra: F.when(F.size(extra) == 0, plain).otherwise(regrouped(extra))
        )

    return let(greedy(island), decide)


def resolve_merged(text: Column, spans: Column) -> Column:
    """Kept spans, with partly visible losers merged in (see README).

    A merged span covers its whole group and lists the kept spans it
    replaces as ``members``; other kept spans have no members.
    """
    several = F.flatten(
        F.transform(
            islands(ordered(spans)),
            lambda i: F.when(
                F.size(i) == 1, F.transform(i, _alone)
            ).otherwise(_merge_island(text, i)),
        )
    )
    return F.when(F.size(spans) == 1, F.transform(spans, _alone)).otherwise(several)


def resolve(df: DataFrame, spans: str = "spans", text: str = "text") -> DataFrame:
    """Add ``kept``: non-overlapping spans that hide every detected character."""
    return df.withColumn("kept", fence(resolve_merged(F.col(text), F.col(spans))))


def resolve_leftmost(spans: Column) -> Column:
    """Earliest start, then longest; the next starts at or after the last end."""
    begin = F.struct(F.lit(0).alias("end"), F.expr(f"cast(array() as {SPANS})").alias("out"))
    return F.aggregate(
        ordered(spans),
        begin,
        lambda acc, s: F.when(
            s["start"] >= acc["end"],
            F.struct(s["end"].alias("end"), F.concat(acc["out"], F.array(s)).alias("out")),
        ).otherwise(acc),
        lambda acc: acc["out"],
    )


def island_ids(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Table form of `islands`: number the overlapping runs of each text.

    Touching spans stay apart. Window partitions are single texts, so this
    form also serves texts with very many spans.
    """
    by_start = Window.partitionBy(*keys).orderBy("start", F.desc("end"))
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    flagged = spans.withColumn("_reach", F.max("end").over(before)).withColumn(
        "_new", (F.col("_reach").isNull() | (F.col("start") >= F.col("_reach"))).cast("int")
    )
    through = by_start.rowsBetween(Window.unboundedPreceding, 0)
    return flagged.withColumn("island", F.sum("_new").over(through)).drop("_reach", "_new")


def merge_islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """One row per island: its extent, and the type of its best span."""
    best = F.struct(
        (F.col("end") - F.col("start")).alias("length"), F.col("priority"), (-F.col("start")).alias("early")
    )
    return (
        island_ids(spans, keys)
        .groupBy(*keys, "island")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.max_by("entity_type", best).alias("entity_type"),
            F.count(F.lit(1)).alias("members"),
        )
    )
