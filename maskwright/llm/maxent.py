"""Hashed maximum-entropy language model with classes, trained and scored on Spark.

The chance of a word is that of its class in its context times that of the word
within the class in its context. The first is a softmax over hashed features of the
words before (the last word, the last two, and those one and two further back).
The second is one over the words of the class, of the last word and the last two,
taken in steps of two: the words are leaves of a binary tree, and at each node of a word's path
a softmax of two, whose zero weights give shares by counts, says which way. Words beyond the
most frequent ones share one leaf a class, by their counts. Frequent words get their
class from the company they keep, all others from their ending, so words never
seen have a class as well.

Every task takes gradient steps over its own documents; its changes, weighted
by how often it saw each feature, are averaged over tasks between rounds.
A document belongs to one of the rounds and is learned from once. As many tasks as
the cluster has cores are averaged, so scores depend on that number.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.words import Texts, mix, pieces, span_hash, words
from maskwright.plans.runtime import pin

#: At most so many words, the most frequent, whose counts every task holds; the counts of all
#: others are joined.
HEAD = 1 << 17
#: The most frequent of them, which contexts tell apart and which are classed by company.
KNOWN = 1 << 13
#: Words of the head are looked up by so many top bits of their hashes.
TOP_BITS = 18
#: Most frequent words that company is measured by.
ANCHORS = 48
COMPANY_CLASSES = 31
ENDING_CLASSES = 32
CLASSES = COMPANY_CLASSES + ENDING_CLASSES + 1
END_CLASS = CLASSES - 1
FEATURES = 1 << 15
#: Weights of the softmax within classes, hashed by node and feature; a multiple of CLASSES.
INNER = 1 << 19
#: Features (of those of a token) that it uses.
INNER_FEATURES = (0, 1)
ROUNDS = 2
#: A feature seen n times in a piece moves by RATE n / (n + STIFF) times its mean error.
RATE, STIFF = 1.5, 4.0
INNER_RATE = 1.5
#: Rows of a table that are summed together.
BLOCK = 64
PIECE_BYTES = 1 << 20
#: Tokens of one gradient step, and that are scored at once: their tables fit a core's cache.
STEP_TOKENS = 1 << 13
END = np.uint64(0x5EED0FE4D0C5)
BEFORE_START = KNOWN + ENDING_CLASSES

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

COUNTED = T.StructType([T.StructField("word", T.LongType()), T.StructField("ending", T.IntegerType()), T.StructField("c", T.LongType())])
PARTS = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("data", T.BinaryType())])


@dataclass
class Tokens:
    """Words of some texts and one end each: hash, row and ending class."""

    rows: int
    hash: np.ndarray
    row: np.ndarray
    ending: np.ndarray


def tokens(texts: Texts) -> Tokens:
    texts = Texts(texts.first, LOWER[texts.data], texts.starts)
    found = words(texts)
    n, rows = len(found.row), len(texts)
    count = found.counts(rows)
    place = np.arange(n) + found.row
    ends = np.cumsum(count) + np.arange(rows)
    hashes = np.full(n + rows, END, np.uint64)
    hashes[place] = span_hash(texts.hashes(), found.start, found.end)
    row = np.empty(n + rows, np.int64)
    row[place], row[ends] = found.row, np.arange(rows)
    ending = np.zeros(n + rows, np.uint64)
    last = texts.data[found.end - 1].astype(np.uint64)
    earlier = texts.data[np.maximum(found.end - 2, found.start)].astype(np.uint64)
    earlier2 = texts.data[np.maximum(found.end - 3, found.start)].astype(np.uint64)
    ending[place] = mix(last + (earlier << np.uint64(8)) + (earlier2 << np.uint64(16))) % np.uint64(ENDING_CLASSES)
    return Tokens(rows, hashes, row, ending.astype(np.int64))


@dataclass
class Head:
    """The most frequent words by hash: their counts, rank by frequency, and class."""

    hash: np.ndarray
    count: np.ndarray
    rank: np.ndarray
    company: np.ndarray | None = None

    @cached_property
    def begin(self) -> np.ndarray:
        """Where the hashes with the same top bits begin; few share them."""
        return np.searchsorted(self.hash, np.arange(1 << TOP_BITS, dtype=np.uint64) << np.uint64(64 - TOP_BITS))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = len(self.hash) - 1
        at = np.minimum(self.begin[(hashes >> np.uint64(64 - TOP_BITS)).astype(np.int64)], last)
        less = np.flatnonzero(self.hash[at] < hashes)
        while len(less):
            less = less[at[less] < last]
            at[less] += 1
            less = less[self.hash[at[less]] < hashes[less]]
        return at, self.hash[at] == hashes

    def ids(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the head, whether there, and the id as a context: rank or ending."""
        at, there = self.find(t.hash)
        rank = self.rank[at]
        return at, there, np.where(there & (rank < KNOWN), rank, KNOWN + t.ending)

    def classes(self, t: Tokens, ids: np.ndarray) -> np.ndarray:
        out = COMPANY_CLASSES + t.ending
        frequent = ids < KNOWN
        out[frequent] = self.company[ids[frequent]]
        out[t.hash == END] = END_CLASS
        return out


def contexts(t: Tokens, ids: np.ndarray) -> np.ndarray:
    """Feature numbers of each token: the word before, the two before, skips by one and by two."""
    back = []
    for k in (1, 2, 3):
        b = np.full(len(ids), BEFORE_START, np.int64)
        same = t.row[k:] == t.row[:-k]
        b[k:][same] = ids[:-k][same]
        back.append(b)
    one, two, three = (b.astype(np.uint64) for b in back)
    size = np.uint64(FEATURES)
    # The first KNOWN + ENDING_CLASSES + 1 features are the words before themselves.
    free = np.uint64(BEFORE_START + 1)
    spread = lambda x, salt: mix(x + np.uint64(salt)) % (size - free) + free
    return np.stack((one, spread(one * size + two, 1 << 40), spread(two, 2 << 40), spread(three, 3 << 40))).astype(np.int64)


@dataclass
class Tree:
    """The words of each class as leaves of a binary tree, heavy ones high.

    A leaf is a word's place in the head or, behind all these, the class whose other words it
    stands for. Of each leaf: the nodes above it and which way to go; of each node, what
    the counts say about the way.
    """

    begin: np.ndarray
    length: np.ndarray
    node: np.ndarray
    way: np.ndarray
    prior: np.ndarray
    #: log10 of the counts plus one that the words of the leaf for others have together, by class.
    rest_log: np.ndarray

    def leaf(self, at: np.ndarray, there: np.ndarray, klass: np.ndarray) -> np.ndarray:
        return np.where(there, at, len(self.length) - CLASSES + klass)

    def paths(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token, node and way of every step to the leaves."""
        length = self.length[leaf]
        token = np.repeat(np.arange(len(leaf)), length)
        at = np.arange(len(token)) + np.repeat(self.begin[leaf] - (np.cumsum(length) - length), length)
        return token, self.node[at], self.way[at]


def tree_of(count: np.ndarray, klass: np.ndarray, size: np.ndarray) -> Tree:
    """Trees over words of the head, whose counts, classes and classes' sizes are given."""
    words = len(count)
    held = np.bincount(klass, count + 1.0, CLASSES) - np.bincount(klass[count == 0], minlength=CLASSES)
    rest = np.maximum(size - held, 1.0)
    leaves = words + CLASSES
    mass, parent, way = [*(count + 1.0).tolist(), *rest.tolist()], [-1] * leaves, [0] * leaves
    order = np.argsort(klass, kind="stable")
    bounds = np.searchsorted(klass[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        if c == END_CLASS:
            continue
        heap = [(mass[words + c], words + c), *((mass[w], w) for w in order[bounds[c] : bounds[c + 1]].tolist() if count[w])]
        heapq.heapify(heap)
        while len(heap) > 1:
            light = heapq.heappop(heap)
            heavy = heap[0]
            node = len(mass)
            mass.append(light[0] + heavy[0])
            parent.append(-1)
            way.append(0)
            parent[light[1]] = parent[heavy[1]] = node
            way[heavy[1]] = 1
            heapq.heapreplace(heap, (mass[node], node))
    mass, parent, way = np.array(mass), np.array(parent), np.array(way)
    prior = np.zeros(len(mass) - leaves, np.float32)
    below = np.flatnonzero(parent >= 0)
    np.add.at(prior, parent[below] - leaves, np.where(way[below] == 1, 1, -1) * np.log(mass[below]))
    steps, now = [], np.arange(leaves)
    own = now
    while True:
        up = parent[now]
        on = up >= 0
        own, now, up = own[on], now[on], up[on]
        if not len(own):
            break
        steps.append((own, up - leaves, way[now]))
        now = up
    at, node, turn = (np.concatenate([x[k] for x in steps]) if steps else np.zeros(0, np.int64) for k in range(3))
    length = np.bincount(at, minlength=leaves)
    order = np.argsort(at, kind="stable")
    return Tree(np.cumsum(length) - length, length, node[order].astype(np.int32), turn[order].astype(np.int8), prior, np.log10(rest))


def inner_scores(
    tree: Tree, inner: np.ndarray, features: np.ndarray, leaf: np.ndarray
) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each step to the leaves: token, its weights' places, the way, and the log odds of way 1."""
    token, node, way = tree.paths(leaf)
    base = node.astype(np.uint64) * np.uint64(FEATURES)
    places = [(mix(base + features[k].astype(np.uint64)[token]) & np.uint64(INNER - 1)).astype(np.int64) for k in INNER_FEATURES]
    odds = tree.prior[node]
    for p in places:
        odds = odds + inner[p]
    return token, places, way, odds


def word_logs(tree: Tree, inner: np.ndarray, features: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Log probability (natural) of each token's leaf within its class."""
    token, _, way, odds = inner_scores(tree, inner, features, leaf)
    against = np.where(way == 1, -odds, odds).astype(np.float64)
    # The log of 1 + exp(against), without overflow.
    return -np.bincount(token, np.maximum(against, 0.0) + np.log1p(np.exp(-np.abs(against))), len(leaf))


def class_scores(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Log probabilities (natural) of all classes for each token."""
    z = raw_scores(weights, bias, features)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def class_logs(weights: np.ndarray, bias: np.ndarray, features: np.ndarray, klass: np.ndarray) -> np.ndarray:
    """The same of each token's own class only."""
    z = raw_scores(weights, bias, features)
    own = z[np.arange(len(klass)), klass]
    return own - np.log(np.exp(z, out=z).sum(1))


def raw_scores(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    z = np.take(weights, features[0], axis=0)
    more = np.empty_like(z)
    for f in features[1:]:
        z += np.take(weights, f, axis=0, out=more, mode="clip")
    z += bias
    z -= z.max(1, keepdims=True)
    return z


def training(key: Column) -> Column:
    """Whether a document is learned from: crc32 of its id's text mod 7 is not 2 (null: as an empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 7 != 2


def per_piece(column: pa.Array) -> Iterator[tuple[Texts, Tokens]]:
    for texts in pieces(column, PIECE_BYTES):
        yield texts, tokens(texts)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in pieces(batch.column(0), 3 * PIECE_BYTES):
            t = tokens(texts)
            word, first, count = np.unique(t.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.view(np.int64)), pa.array(t.ending[first].astype(np.int32)), pa.array(count)], COUNTED.names
            )


def blocks_out(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A float table as rows of BLOCK lines each."""
    for begin in range(0, len(table), BLOCK):
        part = table[begin : begin + BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([begin // BLOCK], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], PARTS.names
            )


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(data, np.float32).astype(np.float64)
            total[block] = total[block] + part if block in total else part
    for block, part in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], PARTS.names
        )


def summed(docs: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], shape: tuple[int, int]) -> np.ndarray:
    """The sum of the tables that tasks make of their documents; of fixed size.

    As many tasks as the cluster has cores, each over many files.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = docs.coalesce(max(1, cores)).mapInArrow(work, PARTS)
    out = np.zeros(shape, np.float32)
    for block, data in parts.repartition("block").mapInArrow(add_blocks, PARTS).collect():
        part = np.frombuffer(data, np.float32).reshape(-1, shape[1])
        out[block * BLOCK : block * BLOCK + len(part)] = part
    return out


def company_classes(profile: np.ndarray) -> np.ndarray:
    """Cluster words by how often each anchor stands near them (k-means on directions)."""
    seen = profile.sum(1)
    expected = profile.sum(0) + 1.0
    scaled = np.log1p(profile / (expected / expected.sum()) / (seen[:, None] + 20.0))
    scaled -= scaled[seen > 0].mean(0) if (seen > 0).any() else 0
    scaled /= np.linalg.norm(scaled, axis=1, keepdims=True) + 1e-9
    centres = scaled[: 4 * COMPANY_CLASSES : 4].copy()
    label = np.zeros(len(scaled), np.int64)
    for _ in range(15):
        label = (scaled @ centres.T).argmax(1)
        for c in range(len(centres)):
            own = scaled[label == c]
            if len(own):
                centres[c] = own.mean(0)
                centres[c] /= np.linalg.norm(centres[c]) + 1e-9
    return label


@dataclass
class Model:
    """What every task holds; of fixed size."""

    head: Head
    weights: np.ndarray
    bias: np.ndarray
    class_log: np.ndarray
    tokens: int
    types: int
    tree: Tree
    inner: np.ndarray


def past(groups: list, most: int) -> tuple[int | None, int]:
    """The group (value, number) in which more than ``most`` are reached, and how many are left for it."""
    for own, n in groups:
        if n > most:
            return own, most
        most -= n
    return None, most


def most_frequent(vocabulary: DataFrame) -> DataFrame:
    """The HEAD first words by count and hash, and few more: those that share the last one's top bits."""
    def sizes(words: DataFrame, by: Column) -> list:
        return [tuple(r) for r in words.groupBy(by.alias("own")).agg(F.count(F.lit(1)).alias("n")).collect()]

    # Counts in steps of an eighth of an octave, then the counts of the step in which HEAD is
    # reached, then hashes of that count by their top bits: the driver never gets a row per word.
    step = F.floor(F.log2("c") * 8).cast("int")
    border, left = past(sorted(sizes(vocabulary, step), reverse=True), HEAD)
    if border is None:
        return vocabulary.select("word", "c", "ending")
    least, left = past(sorted(sizes(vocabulary.where(step == border), F.col("c")), reverse=True), left)
    bits = F.shiftright("word", 48)
    last, _ = past(sorted(sizes(vocabulary.where(F.col("c") == least), bits)), left)
    return vocabulary.where((F.col("c") > least) | ((F.col("c") == least) & (bits <= last))).select("word", "c", "ending")


def fit(spark: SparkSession, rows: DataFrame) -> tuple[Model, DataFrame]:
    """Learn from ``rows`` (``_text``, ``_half``): the model and the counts of all words."""
    counted = rows.select("_text").mapInArrow(count_words, COUNTED)
    vocabulary = pin(counted.groupBy("word").agg(F.sum("c").alias("c"), F.min("ending").alias("ending")))
    whole = vocabulary.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = most_frequent(vocabulary).toPandas()
    top = top.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)[:HEAD]
    hashes = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    head = Head(hashes[order], top["c"].to_numpy(np.int64)[order], order.astype(np.int64))
    if not len(head.hash):
        head = Head(np.zeros(1, np.uint64), np.zeros(1, np.int64), np.full(1, HEAD))
    endings = top["ending"].to_numpy(np.int64)[order] if len(top) else np.zeros(1, np.int64)

    shared = spark.sparkContext.broadcast(head)

    def company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros((KNOWN * ANCHORS,), np.float64)
        for batch in batches:
            for _, t in per_piece(batch.column(0)):
                _, _, ids = shared.value.ids(t)
                for k in (1, 2):
                    same = t.row[k:] == t.row[:-k]
                    a, b = ids[:-k], ids[k:]
                    for w, x in ((a, b), (b, a)):
                        hit = same & (w < KNOWN) & (x < ANCHORS)
                        near += np.bincount(w[hit] * ANCHORS + x[hit], minlength=len(near))
        yield from blocks_out(near.reshape(KNOWN, ANCHORS))

    head.company = company_classes(summed(rows.select("_text"), company, (KNOWN, ANCHORS)))
    shared.unpersist()

    # Sizes of the classes: counts plus one for each word and one for all unseen words.
    frequent = spark.createDataFrame(
        [(int(h), int(c)) for h, c in zip(head.hash[head.rank < KNOWN].view(np.int64), head.company[head.rank[head.rank < KNOWN]], strict=True)], "word long, company int"
    )
    by_class = vocabulary.join(F.broadcast(frequent), "word", "left").withColumn(
        "class", F.when(F.col("word") == int(END.view(np.int64)), END_CLASS).otherwise(F.coalesce("company", F.col("ending") + COMPANY_CLASSES))
    ).groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    size, seen = np.ones(CLASSES), np.ones(CLASSES)
    for c, n, v in by_class.collect():
        size[c] += n + v
        seen[c] += n
    size[END_CLASS] = 1 + max(0.0, seen[END_CLASS] - 1)  # its only word is the end
    bias = np.log(seen / seen.sum()).astype(np.float32)
    model = Model(head, np.zeros((FEATURES, CLASSES), np.float32), bias, np.log10(size), whole["n"] or 0, whole["v"], None, np.zeros(INNER, np.float32))
    known = Tokens(0, head.hash, np.zeros(0, np.int64), endings)
    model.tree = tree_of(head.count, head.classes(known, np.where(head.rank < KNOWN, head.rank, KNOWN + endings)), size)
    for half in range(ROUNDS):
        change, inner = one_round(spark, model, rows.where(F.col("_half") == half).select("_text"))
        model.weights, model.inner = model.weights + change, model.inner + inner
    return model, vocabulary


def one_round(spark: SparkSession, model: Model, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The change of weights, of classes and within them, after every task has gone over its documents once."""
    shared = spark.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights, seen = m.weights.copy(), np.zeros(FEATURES)
        inner, inner_seen = m.inner.copy(), np.zeros(INNER, np.float32)
        for batch in batches:
            for _, t in per_piece(batch.column(0)):
                at, there, ids = m.head.ids(t)
                features, target = contexts(t, ids), m.head.classes(t, ids)
                leaf = m.tree.leaf(at, there, target)
                for begin in range(0, len(target), STEP_TOKENS):
                    part = slice(begin, begin + STEP_TOKENS)
                    step(weights, m.bias, features[:, part], target[part], seen)
                    inner_step(m.tree, inner, features[:, part], leaf[part], inner_seen)
        change = (weights - m.weights) * seen[:, None].astype(np.float32)
        lines = lambda x: np.hstack((x.reshape(-1, CLASSES), np.zeros((INNER // CLASSES, 1), np.float32)))
        yield from blocks_out(np.vstack((
            np.hstack((change, seen[:, None].astype(np.float32))), lines((inner - m.inner) * inner_seen), lines(inner_seen)
        )))

    more = INNER // CLASSES
    total = summed(rows, learn, (FEATURES + 2 * more, CLASSES + 1))
    shared.unpersist()
    inner, inner_seen = (total[FEATURES + k * more : FEATURES + (k + 1) * more, :-1].ravel() for k in (0, 1))
    total = total[:FEATURES]
    return total[:, :-1] / np.maximum(total[:, -1:], 1.0), inner / np.maximum(inner_seen, 1.0)


def inner_step(tree: Tree, inner: np.ndarray, features: np.ndarray, leaf: np.ndarray, seen: np.ndarray) -> None:
    """The same within classes."""
    _, places, way, odds = inner_scores(tree, inner, features, leaf)
    error = way - 1.0 / (1.0 + np.exp(-odds))
    place = np.concatenate(places)
    number = np.bincount(place, minlength=INNER)
    total = np.bincount(place, np.tile(error, len(places)), INNER)
    own = np.flatnonzero(number)
    inner[own] += INNER_RATE / len(places) * total[own] / (number[own] + STIFF)
    seen[own] += number[own]


def step(weights: np.ndarray, bias: np.ndarray, features: np.ndarray, target: np.ndarray, seen: np.ndarray) -> None:
    """One gradient step over some tokens, each feature scaled by how often it occurs."""
    error = raw_scores(weights, bias, features)
    np.exp(error, out=error)
    error *= -1 / error.sum(1, keepdims=True)
    error[np.arange(len(target)), target] += 1
    for f in features:
        order = np.argsort(f.astype(np.uint16) if FEATURES <= 1 << 16 else f, kind="stable")
        ranked = f[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        number = np.diff(np.append(first, len(ranked)))
        own = ranked[first]
        rows = np.take(error, order, axis=0)
        # The first rows of all features at once, then the second ones; few features have many.
        total, k, left = rows[first], 1, np.flatnonzero(number > 1)
        while k < 8 and len(left):
            total[left] += rows[first[left] + k]
            k += 1
            left = left[number[left] > k]
        for j in left.tolist():
            total[j] += rows[first[j] + k : first[j] + number[j]].sum(0)
        weights[own] += (RATE / len(features) / (number + STIFF)).astype(np.float32)[:, None] * total
        seen[own] += number


SCORED = [
    T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()),
    T.StructField("base", T.DoubleType()), T.StructField("model", T.DoubleType()),
    T.StructField("rare", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.LongType())]))),
]


def score_texts(model: Model, column: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
    """Per piece: sums over the words of the head, and the counts of each text's other words."""
    for texts, t in per_piece(column):
        at, there, ids = model.head.ids(t)
        klass = model.head.classes(t, ids)
        features, leaf = contexts(t, ids), model.tree.leaf(at, there, klass)
        log = np.empty(len(klass))
        for begin in range(0, len(klass), STEP_TOKENS):
            part = slice(begin, begin + STEP_TOKENS)
            log[part] = class_logs(model.weights, model.bias, features[:, part], klass[part]) + word_logs(model.tree, model.inner, features[:, part], leaf[part])
        log /= np.log(10)
        own = np.where(there, np.log10(model.head.count[at] + 1.0), 0.0)
        within = np.where(there | (klass == END_CLASS), 0.0, -model.tree.rest_log[klass])
        n = t.rows
        rare = np.flatnonzero(~there)
        code = mix(t.hash[rare]) ^ mix(t.row[rare].astype(np.uint64) + np.uint64(1))
        order = np.lexsort((code, t.row[rare]))
        rare, code = rare[order], code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(rare) else np.zeros(0, np.int64)
        number = np.diff(np.append(first, len(rare)))
        owner = t.row[rare[first]]
        bounds = np.searchsorted(owner, np.arange(n + 1))
        items = pa.StructArray.from_arrays([pa.array(t.hash[rare[first]].view(np.int64)), pa.array(number)], ["word", "n"])
        yield texts.first, [
            pa.array(np.bincount(t.row, minlength=n)), pa.array(np.bincount(t.row[there], minlength=n)),
            pa.array(np.bincount(t.row, own, n)), pa.array(np.bincount(t.row, log + within, n)),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items),
        ]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Scores are log10 probabilities of whole texts with their end. Null texts
    are empty; repeated rows count and are scored each; other columns are
    ignored; no rows give no rows, and without training documents all words
    are unseen.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), training(F.col(key)).alias("_train"))
    half = F.pmod(F.xxhash64("_key", F.length("_text")), F.lit(ROUNDS)).cast("int")
    model, vocabulary = fit(spark, rows.where("_train").select("_text", half.alias("_half")))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, columns in score_texts(shared.value, batch.column(2)):
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), *columns], ["_key", "_train", *(f.name for f in SCORED)]
                )

    schema = T.StructType([rows.schema["_key"], rows.schema["_train"], *SCORED])
    scored = pin(rows.select("_key", "_train", "_text").mapInArrow(run, schema)).withColumn("_row", F.monotonically_increasing_id())
    rare = scored.select("_row", F.explode("rare").alias("r")).select("_row", "r.*")
    found = rare.join(vocabulary.select("word", "c"), "word").groupBy("_row").agg(
        F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("log")
    )
    shift = float(np.log10(model.tokens + model.types + 1))
    log = F.coalesce("log", F.lit(0.0))
    return scored.join(found, "_row", "left").select(
        F.col("_key").alias(key), (~F.col("_train")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * shift).alias("base_score"), (F.col("model") + log).alias("score"),
    )
