"""Measuring detection: exact scores, coverage, leaks, regressions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = ["doc", "section", "entity_type", "start", "end"]


def outcomes(gold: DataFrame, spans: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """One row per span in either table, marked tp, fp or fn (full outer join)."""
    g = gold.select(*SPAN).distinct().withColumn("_g", F.lit(1))
    s = spans.select(*SPAN).distinct().withColumn("_s", F.lit(1))
    out = g.join(s, SPAN, "full_outer").select(
        *SPAN,
        (F.col("_g").isNotNull() & F.col("_s").isNotNull()).cast("int").alias("tp"),
        F.col("_g").isNull().cast("int").alias("fp"),
        F.col("_s").isNull().cast("int").alias("fn"),
    )
    return out if attributes is None else out.join(attributes, "doc", "left")


def ratio(part, whole):
    """Four decimals; null when undefined."""
    return F.round(F.try_divide(part, F.nullif(whole, F.lit(0))), 4)


def score(marked: DataFrame, by: list[str]) -> DataFrame:
    """Totals by each attribute and overall, in one pass of grouping sets."""
    sets = [[F.col(c)] for c in by] + [[]]
    return (
        marked.groupingSets(sets, *[F.col(c) for c in by])
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
        .withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    )


def covered(gold: DataFrame, spans: DataFrame) -> DataFrame:
    """Gold spans that lie inside one replacement (range semi join by text)."""
    s = spans.select("doc", "section", F.col("start").alias("a"), F.col("end").alias("b"))
    inside = (
        (gold["doc"] == s["doc"]) & (gold["section"] == s["section"])
        & (s["a"] <= gold["start"]) & (s["b"] >= gold["end"])
    )
    return gold.join(s, inside, "left_semi")


def _union_ranges(spans: DataFrame) -> DataFrame:
    """Overlapping or touching ranges of each text joined, so no character counts twice."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "end")))
    fused = F.aggregate(
        "_r",
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, r: F.when(
            F.get(acc, F.size(acc) - 1)["end"] >= r["start"],
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.get(acc, F.size(acc) - 1)["start"].alias("start"),
                        F.greatest(F.get(acc, F.size(acc) - 1)["end"], r["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(r))),
    )
    typed = spans.select("doc", "section", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    return typed.groupBy("doc", "section").agg(ordered.alias("_r")).select("doc", "section", fused.alias("ranges"))


def _overlap(ranges, start, end):
    return F.coalesce(
        F.aggregate(
            ranges, F.lit(0),
            lambda acc, r: acc + F.greatest(F.least(r["end"], end) - F.greatest(r["start"], start), F.lit(0)),
        ),
        F.lit(0),
    )


def character_coverage(gold: DataFrame, hidden: DataFrame, flagged: DataFrame) -> DataFrame:
    """Characters of each gold span hidden, flagged, and either."""
    key = ["doc", "section"]
    both = hidden.select(*key, "start", "end").unionByName(flagged.select(*key, "start", "end"))
    out = gold
    for name, spans in (("hidden", hidden), ("flagged", flagged), ("either", both)):
        out = out.join(_union_ranges(spans).withColumnRenamed("ranges", f"_{name}"), key, "left")
    start, end = F.col("start").cast("int"), F.col("end").cast("int")
    return out.select(
        *gold.columns,
        _overlap(F.col("_hidden"), start, end).alias("masked_characters"),
        _overlap(F.col("_flagged"), start, end).alias("review_characters"),
        _overlap(F.col("_either"), start, end).alias("masked_or_flagged_characters"),
    )


def overmasked(gold: DataFrame, hidden: DataFrame) -> DataFrame:
    """Hidden characters of each text that no gold span asked for."""
    key = ["doc", "section"]
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, r: a + r["end"] - r["start"])
    h = _union_ranges(hidden).withColumnRenamed("ranges", "_h")
    g = _union_ranges(gold).withColumnRenamed("ranges", "_g")
    shared = F.aggregate("_g", F.lit(0), lambda a, r: a + _overlap(F.col("_h"), r["start"], r["end"]))
    return h.join(g, key, "left").select(
        *key, (total(F.col("_h")) - F.coalesce(shared, F.lit(0))).alias("overmasked_characters")
    )


def summarize_leaks(marks: DataFrame, by: list[str]) -> DataFrame:
    """Fully, partly and not masked spans, and those exposed in ready requests.

    ``marks`` has start, end, masked_characters, review_characters, status
    and the ``by`` attributes; one pass of grouping sets.
    """
    size, hidden = F.col("end") - F.col("start"), F.col("masked_characters")
    n = lambda condition: F.sum(condition.cast("int"))
    sets = [[F.col(c)] for c in by] + [[]]
    return marks.groupingSets(sets, *[F.col(c) for c in by]).agg(
        F.count(F.lit(1)).alias("annotations"),
        n(hidden == size).alias("fully_masked"),
        n((hidden > 0) & (hidden < size)).alias("partially_masked"),
        n(hidden == 0).alias("unmasked"),
        n(F.col("review_characters") == size).alias("fully_flagged_for_review"),
        n((hidden < size) & (F.col("status") == "ready")).alias("exposed_in_ready_requests"),
    )


def summarize_requests(requests: DataFrame) -> DataFrame:
    """Ready, held and refused requests, and harmless ones that were held."""
    n = lambda condition: F.sum(condition.cast("int"))
    return requests.agg(
        F.count(F.lit(1)).alias("requests"),
        *[n(F.col("status") == s).alias(f"{s}_requests") for s in ("ready", "held", "refused")],
        n(F.col("annotations") == 0).alias("negative_requests"),
        n((F.col("annotations") == 0) & (F.col("status") == "held")).alias("negative_held_requests"),
        n(F.coalesce("restored", F.lit(False))).alias("restored_requests"),
    )


def restoration_check(restored: DataFrame, original: str = "text", text: str = "restored") -> DataFrame:
    return restored.agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum((F.col(original) == F.col(text)).cast("int")).alias("exact_restorations"),
    )


def latency_stats(samples: DataFrame, column: str = "ms") -> DataFrame:
    return samples.agg(
        F.count(column).alias("samples"),
        F.round(F.percentile(column, 0.5), 4).alias("median"),
        F.round(F.percentile_approx(column, 0.95, 100_000), 4).alias("p95"),
    )


def regressions(now: DataFrame, base: DataFrame) -> DataFrame:
    """Per case, every way in which ``now`` is worse than ``base``.

    Both have run, id, status, masked_characters, masked_or_flagged_characters
    (arrays), exact_fp, exact_fn, overmasked_characters,
    review_harmless_characters, exposed_annotations and restored.
    """
    n, b = now.alias("n"), base.alias("b")
    both = n.join(b, [F.col("n.run") == F.col("b.run"), F.col("n.id") == F.col("b.id")], "full_outer")
    c = lambda side, name: F.col(f"{side}.{name}")
    issue = lambda condition, text: F.when(condition, F.lit(text))
    same = c("n", "id").isNotNull() & c("b", "id").isNotNull()

    def less(metric):
        shorter = F.size(c("n", metric)) != F.size(c("b", metric))
        worse = F.exists(F.zip_with(c("n", metric), c("b", metric), lambda x, y: x < y), lambda w: w)
        return issue(same & (shorter | worse), f"less:{metric}")

    found = F.array(
        issue(~same, "cases_differ"),
        *[less(m) for m in ("masked_characters", "masked_or_flagged_characters")],
        *[
            issue(same & (c("n", m) > c("b", m)), f"more:{m}")
            for m in ("exact_fp", "exact_fn", "overmasked_characters", "review_harmless_characters")
        ],
        issue(same & ~F.coalesce(c("n", "restored"), F.lit(False)), "not_restored"),
        issue(same & (c("n", "status") == "refused"), "refused"),
        issue(
            same & (c("n", "status") == "held") & (c("b", "status") == "ready")
            & (F.size(c("n", "masked_characters")) == 0),
            "held_without_need",
        ),
        issue(
            same & (c("b", "status") == "held") & (c("n", "status") == "ready")
            & (c("n", "exposed_annotations") > 0),
            "released_unmasked",
        ),
    )
    return both.select(
        F.coalesce(c("n", "run"), c("b", "run")).alias("run"),
        F.coalesce(c("n", "id"), c("b", "id")).alias("id"),
        F.explode(F.filter(found, lambda i: i.isNotNull())).alias("issue"),
    )


def fingerprint(text):
    """SHA-256 of the text with newlines as ``\\n``."""
    return F.sha2(F.regexp_replace(text, "\r\n?", "\n"), 256)
