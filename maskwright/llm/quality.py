"""Quality rules for documents and, from their failures, for whole hosts.

Each text is measured on its own. Failures are then counted by host, the
failure rate of each host is drawn towards the rate of all hosts by a beta
prior fitted to the hosts themselves, and a host whose rate stays too high
loses its remaining documents as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.rows import boxed
from maskwright.llm.words import CONTINUATION, SPACE, grams, mix, pieces, repeated, span_hash, words
from maskwright.plans.runtime import pin, small

MIN_WORDS = 50
#: A text fails if more than half of its words stand in repeated three-word windows.
WINDOW = 3
REPEATED_PERCENT = 50
#: A host is rejected if its shrunk rate of failures exceeds this.
HOST_RATE = 0.5
#: Rejected hosts are broadcast up to this many; beyond, they are joined by a shuffle.
HOSTS_BROADCAST = 50_000

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure_texts(column: pa.Array) -> pa.StructArray:
    """The five measures of each text; null counts as empty."""
    parts = []
    for texts in pieces(column):
        rows, data = len(texts), texts.data
        found = words(texts)
        prefix = texts.hashes()
        hashes = span_hash(prefix, found.start, found.end)
        salt = mix(np.arange(1, rows + 1, dtype=np.uint64))

        key, at = grams(hashes, found.row, WINDOW)
        again = at[repeated(key ^ salt[found.row[at]])] if len(at) else at
        covered = np.zeros(len(hashes), bool)
        for k in range(WINDOW):
            covered[again + k] = True

        newline = np.flatnonzero(data == 10)
        begin = np.unique(np.concatenate((texts.starts[:-1], newline + 1)))
        begin = begin[begin < len(data)]
        stop = np.append(begin[1:], len(data))[: len(begin)]
        stop = stop - (data[stop - 1] == 10)
        filled = np.searchsorted(found.start, stop) > np.searchsorted(found.start, begin)
        begin, stop = begin[filled], stop[filled]
        row = np.searchsorted(texts.starts, begin, "right") - 1
        line = span_hash(prefix, begin, stop) ^ salt[row]
        _, unique = np.unique(line, return_index=True)
        lines = np.bincount(row, minlength=rows)

        parts.append((
            found.counts(rows),
            texts.sums(~SPACE[data] & ~CONTINUATION[data]),
            texts.sums(SYMBOL[data]),
            lines - np.bincount(row[unique], minlength=rows),
            np.bincount(found.row[covered], minlength=rows),
        ))
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], list(MEASURES))


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in MEASURES]))
def measures(text: pa.Array) -> pa.Array:
    return measure_texts(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEATED_PERCENT * n_words)


def host_rates(judged: DataFrame, host: str = "source", failed: str = "base_failed") -> DataFrame:
    """One row per host: ``n``, ``fails``, ``rate`` (shrunk), ``rejected``.

    The beta prior has the mean rate of all documents; its strength comes from
    the moments of the hosts' rates: strength = mean (1 - mean) / between - 1,
    where ``between`` is the variance of the rates beyond what chance explains.
    At least two documents' worth, so that a host of one bad page is not lost.
    Hosts with a null name form one host.
    """
    hosts = pin(judged.groupBy(host).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("fails")
    ))
    total = hosts.agg(
        F.sum("n").alias("docs"), F.sum("fails").alias("fails"), F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("fails") * F.col("fails") / F.col("n")).alias("squares"),
    ).first()
    docs, n_hosts = total["docs"] or 0, total["hosts"]
    mean = (total["fails"] or 0) / docs if docs else 0.0
    spread = mean * (1 - mean)
    # Weighted by documents: sum n_i (r_i - mean)^2 = squares - docs mean^2.
    between = ((total["squares"] or 0.0) - docs * mean * mean - (n_hosts - 1) * spread) / docs if docs else 0.0
    strength = max(2.0, spread / between - 1) if between > 0 else 1e6
    rate = (F.col("fails") + F.lit(strength * mean)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > HOST_RATE)


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """``key``, the measures, ``base_failed``, ``kept``: one row per row of ``docs``.

    Repeated rows are each judged; a null text has no words and fails; other
    columns are ignored; an empty table gives an empty result.
    """
    measured = docs.select(F.col(key).alias("_key"), F.col(host).alias("_host"), measures(F.col(text)).alias("_m"))
    judged = pin(measured.select("_key", "_host", "_m.*").withColumn(
        "base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))
    ))
    bad = _rejected(judged, "_host", "base_failed")
    return _host_join(judged, bad, "_host").select(
        F.col("_key").alias(key), *MEASURES, "base_failed",
        (~F.col("base_failed") & F.col("_bad").isNull()).alias("kept"),
    )


def keep(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever their names.

    Texts are measured twice, once for the hosts and once to filter, and never
    shuffled unless very many hosts are rejected.
    """
    m = measures(F.col(text))
    short = m["n_words"], m["n_repeat_words"]
    judged = docs.select(F.col(host).alias("_host"), base_failed(*short).alias("_failed"))
    bad = _rejected(judged, "_host", "_failed")
    passed = boxed(docs.where(~base_failed(*short)), _host=F.col(host))
    return _host_join(passed, bad, "_host").where(F.col("_bad").isNull()).select("_row.*")


def _rejected(judged: DataFrame, host: str, failed: str) -> DataFrame:
    return pin(host_rates(judged, host, failed).where("rejected").select(host, F.lit(True).alias("_bad")))


def _host_join(rows: DataFrame, bad: DataFrame, host: str) -> DataFrame:
    """Left join with the rejected hosts, by broadcast only if they are few."""
    few = small(bad, HOSTS_BROADCAST)
    bad = bad.withColumnRenamed(host, "_is")
    bad = F.broadcast(bad) if few else bad
    return rows.join(bad, F.col(host).eqNullSafe(F.col("_is")), "left").drop("_is")
