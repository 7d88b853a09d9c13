"""Ranked lexical search: an automaton of all items' terms reads the documents.

Nothing is indexed. The terms of all items form one Aho-Corasick automaton, in
which a term stands between two guards. Every byte of a text that belongs to no
term becomes a guard as well, so the automaton finds whole terms only, and each
occurrence once. One scan counts, for each term, the documents that hold it;
a second one scores: what the automaton puts out is mapped to the items that ask
for it, and every task hands on its best documents per item.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.words import Texts, pieces
from maskwright.plans.runtime import pin, running_total

#: Terms of one automaton; items beyond that get a further one. One item is never cut.
TERMS = 100_000
#: Cells of documents times items, and products, that are held at once.
CELLS = 1 << 21
TOP = 20

# Fixed values of the ranking.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNIT, SATURATION, LENGTH_SHARE, LENGTH_SCALE = 1_000_000_000, 1000, 25, 12

GUARD = 0x20
IN_TERM = np.zeros(256, bool)
IN_TERM[0x30:0x3A] = IN_TERM[0x41:0x5B] = IN_TERM[0x61:0x7B] = IN_TERM[0x80:] = True
#: What the automaton reads for each byte: lower case, and a guard for all that is in no term.
READ = np.arange(256, dtype=np.uint8)
READ[0x41:0x5B] += 0x20
READ[~IN_TERM] = GUARD

COUNTED = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("n", T.LongType())])
BEST = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("item", T.IntegerType()),
    T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType()),
])
#: Rows of COUNTED that are not about a term: documents with terms, and terms in all.
DOCUMENTS, LENGTH = -1, -2


@dataclass
class Asked:
    """Some items: their distinct terms, and for each term the items that hold it and how often."""

    name: str
    terms: list[str]
    begin: np.ndarray
    item: np.ndarray
    times: np.ndarray
    items: int


def asked(rows: list) -> Asked:
    """From (place, term, times) of some items."""
    terms = sorted({r["term"] for r in rows})
    number = {term: k for k, term in enumerate(terms)}
    term = np.array([number[r["term"]] for r in rows], np.int64)
    order = np.argsort(term, kind="stable")
    begin = np.searchsorted(term[order], np.arange(len(terms) + 1))
    item = np.array([r["place"] for r in rows], np.int64)[order]
    times = np.array([r["times"] for r in rows], np.int64)[order]
    return Asked(uuid.uuid4().hex, terms, begin, item, times, int(item.max(initial=-1)) + 1)


class _Built:
    """The automaton that this worker built last."""

    name = ""
    automaton: ahocorasick.Automaton


def automaton(items: Asked) -> ahocorasick.Automaton:
    if _Built.name != items.name:
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, term in enumerate(items.terms):
            # One character stands for one byte, so places are places of bytes.
            made.add_word(f" {term.encode().decode('latin-1')} ", k)
        made.make_automaton()
        _Built.name, _Built.automaton = items.name, made
    return _Built.automaton


def lengths(texts: Texts) -> np.ndarray:
    """Terms of each row."""
    solid = IN_TERM[texts.data]
    after = np.append(False, solid[:-1])[: len(solid)]
    begins = texts.starts[:-1]
    after[begins[begins < len(solid)]] = False
    return texts.sums(solid & ~after)


def occurrences(found: ahocorasick.Automaton, texts: Texts, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every term in every row that holds it, by row."""
    body = np.insert(READ[texts.data], texts.starts, GUARD).tobytes().decode("latin-1")
    hits = np.fromiter(chain.from_iterable(found.iter(body)), np.int64).reshape(-1, 2)
    # The guard before row i stands at starts[i] + i; the byte before a match's last guard is in its row.
    row = np.searchsorted(texts.starts + np.arange(len(texts.starts)), hits[:, 0] - 1, "right") - 1
    pair, count = np.unique(row * terms + hits[:, 1], return_counts=True)
    return pair // terms, pair % terms, count


class Ranking:
    """The best documents of each item so far: highest score, then smallest id, null last."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.bar = np.ones(items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.null = np.zeros(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, score = np.append(self.item, item), np.append(self.score, score)
        doc, null = np.append(self.doc, doc), np.append(self.null, null)
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        kept = np.arange(len(item)) - np.searchsorted(item, item) < self.top
        self.item, order = item[kept], order[kept]
        self.score, self.doc, self.null = score[order], doc[order], null[order]
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.bar)) == self.top)
        last = np.searchsorted(self.item, full, "right") - 1
        self.bar[full] = self.score[last]


def slices(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs of consecutive places whose sizes add up to at most ``limit``, or one place."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield slice(at, to)
        at = to


def rank_piece(
    texts: Texts, doc: np.ndarray, null: np.ndarray, items: Asked, weight: np.ndarray, documents: int, length: int, best: Ranking
) -> None:
    row, term, count = occurrences(automaton(items), texts, len(items.terms))
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths(texts) * documents) // length
    part = weight[term] * ((UNIT * count) // (SATURATION * count + LENGTH_SCALE * m[row]))
    holders = items.begin[term + 1] - items.begin[term]
    rows_at_once = max(1, CELLS // max(1, items.items))
    for first in range(0, len(texts), rows_at_once):
        here = slice(*np.searchsorted(row, (first, first + rows_at_once)))
        cells = np.zeros(min(rows_at_once, len(texts) - first) * items.items, np.int64)
        for cut in slices(holders[here], CELLS):
            n = holders[here][cut]
            if not n.sum():
                continue
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(items.begin[term[here][cut]], n)
            place = np.repeat((row[here][cut] - first) * items.items, n) + items.item[step]
            np.add.at(cells, place, np.repeat(part[here][cut], n) * items.times[step])
        cells = cells.reshape(-1, items.items)
        at, item = np.nonzero(cells >= best.bar)
        if len(at):
            best.add(item, cells[at, item], doc[texts.first + first + at], null[texts.first + first + at])


def statistics(texts: DataFrame, items: Asked) -> tuple[np.ndarray, int, int]:
    """Documents that hold each term; documents with any term; all their terms. ``texts`` has one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(items.terms) + 2, np.int64)
        for batch in batches:
            for part in pieces(batch.column(0)):
                _, term, _ = occurrences(automaton(items), part, len(items.terms))
                held[:-2] += np.bincount(term, minlength=len(items.terms))
                n = lengths(part)
                held[DOCUMENTS] += np.count_nonzero(n)
                held[LENGTH] += n.sum()
        names = np.append(np.arange(len(items.terms)), (LENGTH, DOCUMENTS))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(names[some], pa.int32()), pa.array(held[some], pa.int64())], COUNTED.names)

    # One row a term: as many as the automaton has.
    counted = {r["term"]: r["n"] for r in texts.mapInArrow(run, COUNTED).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.array([counted.get(k, 0) for k in range(len(items.terms))], np.int64)
    return df, counted.get(DOCUMENTS, 0), counted.get(LENGTH, 0)


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def search_block(docs: DataFrame, items: Asked, top: int) -> DataFrame:
    """``item`` (its place), ``doc_id``, ``score`` and ``rank`` of some items. ``docs`` has id and text."""
    df, documents, length = statistics(docs.select("text"), items)
    weight = weights(df, documents)
    # A task hands on few rows an item, but there may be very many tasks: they are ranked
    # in as many shards as a shard has tasks, and the shards' best then together.
    shards = max(1, math.isqrt(docs.rdd.getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Ranking(items.items, top)
        for batch in batches:
            ids, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            if length:
                for part in pieces(batch.column(1)):
                    rank_piece(part, ids, null, items, weight, documents, length, best)
        n = len(best.item)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, TaskContext.get().partitionId() % shards), pa.int32()), pa.array(best.item, pa.int32()),
             pa.array(best.doc, pa.int64(), mask=best.null), pa.array(best.score, pa.int64())], BEST.names
        )

    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    found = docs.mapInArrow(run, BEST)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "shard").orderBy(*order))).where(F.col("rank") <= top)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", top: int = TOP,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` highest-scoring documents of each item.

    Every row of ``docs`` is a document and every row of ``items`` an item, so a
    repeated item repeats its results and a repeated document may be ranked twice.
    Null and empty texts hold no terms: such documents are not counted, such items
    have no results. Equal scores go by id, null ids last. Other columns are
    ignored. An empty table gives an empty result. Texts of any length are read
    whole.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("times")))
    wanted = pin(
        items.select(F.col(item_key).cast("long").alias("item_id"), terms_of(F.col(item_text)).alias("terms"))
        .where(F.size("terms") > 0).withColumn("number", F.monotonically_increasing_id())
    ).select("item_id", "number", held.alias("held"), F.size(F.array_distinct("terms")).cast("long").alias("size"))
    total = wanted.agg(F.sum("size")).first()[0] or 0
    if total > TERMS:
        ranked = running_total(wanted.withColumn("all", F.lit(0)), ["all"], ["number"], "size", "sofar").drop("all")
        wanted = pin(ranked.withColumn("block", F.floor((F.col("sofar") - F.col("size")) / TERMS)).drop("sofar"))
    else:
        wanted = wanted.withColumn("block", F.lit(0).cast("long"))
    out = None
    for block in range(int(-(-total // TERMS))):
        # Terms of a block: at most TERMS and those of its last item.
        own = wanted.where(F.col("block") == block)
        numbers = [tuple(r) for r in own.select("number", "item_id").orderBy("number").collect()]
        if not numbers:
            continue
        place = {number: k for k, (number, _) in enumerate(numbers)}
        rows = own.select("number", F.explode("held").alias("h")).select("number", "h.*").collect()
        found = search_block(docs, asked([{"place": place[r["number"]], "term": r["term"], "times": r["times"]} for r in rows]), top)
        names = spark.createDataFrame([(k, item_id) for k, (_, item_id) in enumerate(numbers)], "item int, item_id long")
        found = found.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
