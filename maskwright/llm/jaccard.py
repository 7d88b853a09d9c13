"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles. Every run picks, by hashes that all texts
share, about ``1 / (0.8 size)`` of a text's shingles; texts that picked the same
shingle meet in a node. Runs are repeated until a pair at the threshold is
missed less often than the target recall allows. The members of a small node
are compared by brute force on short sketches. A large node is split again on
further picks, unless the picks show that its members are alike throughout:
then splitting would not end, and it is compared in blocks. Texts that sketches
connect form a cluster, and inside each cluster the whole sets are compared,
every pair once; links are counted, never written out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.components import components
from maskwright.llm.rows import boxed
from maskwright.llm.words import _BASE, grams, mix, pieces, span_hash, words
from maskwright.plans.runtime import partitions, pin

SHINGLE = 5
#: Links have a Jaccard similarity of at least this many tenths.
TENTHS = 8
RECALL = 0.999
#: Nodes up to this size are compared at once; larger ones are split.
NODE = 256
#: Members of a block of whole sets, and of sketches; two blocks meet in one comparison.
BLOCK = 256
SKETCH_BLOCK = 512
#: A sketch holds a byte of the smallest shingle in each of so many ranges.
RANGES = 64
#: Sketches of a pair at the threshold agree in 0.8 of the ranges, off by 0.05 (one
#: deviation) or less; pairs down to 4.4 deviations are kept.
AGREE = 0.58
DEPTH = 4
#: Runs of picks inside each split: a pair stays together in one of two at least.
SPLITS = 2
#: A node whose members share this much on average is not split further.
DENSE = 0.6
#: Of a large node, the sketches of about so many members say whether it is such a one.
WITNESSES = 64
#: Bytes of a shingle's hash in the sets that are compared: two different shingles of two
#: texts of a thousand each agree with a chance of one in a million.
BYTES = 5
#: Columns of the incidence matrix that are multiplied together.
COLUMNS = 2048


def survival(children: float, levels: int) -> float:
    """Chance that a pair is still together after so many splits, if a node that holds both
    has ``children`` that do on average (a branching process)."""
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-children * alive)
    return alive


def runs(recall: float) -> int:
    """Two sets at similarity J share J of the larger one's shingles at least, so that at the
    threshold each run of picks has them meet once on average, or more. In the worst case all
    these nodes are large and mixed and are split DEPTH - 1 times."""
    return math.ceil(-math.log(1 - recall) / survival(SPLITS, DEPTH - 1))


def shingle_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes | None]]]:
    """Per piece of the column: sorted distinct shingles, bounds by row, and the class of each row.

    A class is a 128-bit digest of the word sequence. A text of fewer than five
    words has one shingle, all its words; one without words has none, and no class.
    """
    for texts in pieces(column):
        rows, found = len(texts), words(texts)
        hashes = span_hash(texts.hashes(), found.start, found.end)
        count = found.counts(rows)
        first = np.concatenate(([0], np.cumsum(count)))
        keys, at = grams(hashes, found.row, SHINGLE)
        row = found.row[at]
        place = np.arange(len(hashes), dtype=np.uint64) - first[found.row].astype(np.uint64)
        low = _row_sums(mix(hashes + mix(place)), first)
        high = _row_sums(mix(hashes ^ mix(place + np.uint64(1 << 40))), first)
        few = np.flatnonzero((count > 0) & (count < SHINGLE))
        keys, row = np.concatenate((keys, mix(low[few]))), np.concatenate((row, few))
        order = np.lexsort((keys, row))
        keys, row = keys[order], row[order]
        if len(keys):
            new = np.append(True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]))
            keys, row = keys[new], row[new]
        digest = np.stack((low, high), 1).tobytes()
        classes = [digest[16 * i : 16 * i + 16] if count[i] else None for i in range(rows)]
        yield keys, np.searchsorted(row, np.arange(rows + 1)), classes


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def picked(keys: np.ndarray, size: np.ndarray, times: int, salt: int) -> np.ndarray:
    """Whether a set of ``size`` shingles picks each of ``keys`` in one of ``times`` runs."""
    share = np.minimum(times * 10 / (TENTHS * size), 1.0)
    return (mix(keys ^ np.uint64(salt)) >> np.uint64(11)) < share * (1 << 53)


def sketch_rows(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A byte for each range of hashes: of the smallest shingle in it, or 0 if there is none."""
    n = len(bounds) - 1
    row, place = np.repeat(np.arange(n), np.diff(bounds)), (keys >> np.uint64(58)).astype(np.int64)
    new = np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1])) if len(keys) else np.zeros(0, bool)
    out = np.zeros((n, RANGES), np.uint8)
    out[row[new], place[new]] = mix(keys[new]) % np.uint64(255) + np.uint64(1)
    return out


def first_nodes(column: pa.Array, times: int) -> pa.StructArray:
    classes, nodes, sketches = [], [], []
    for keys, bounds, own in shingle_sets(column):
        size = np.repeat(np.diff(bounds), np.diff(bounds))
        chosen = picked(keys, size, times, 0x51ED)
        total = np.concatenate(([0], np.cumsum(chosen)))[bounds]
        nodes.append(pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(keys[chosen].view(np.int64))))
        classes += own
        data = sketch_rows(keys, bounds).tobytes()
        sketches += [data[RANGES * i : RANGES * (i + 1)] for i in range(len(own))]
    lists = pa.concat_arrays(nodes) if nodes else pa.array([], pa.list_(pa.int64()))
    return pa.StructArray.from_arrays([pa.array(classes, pa.binary()), lists, pa.array(sketches, pa.binary())], ["class", "nodes", "sketch"])


def members_schema(key: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("_key", key), T.StructField("class", T.BinaryType()), T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])


def paths(keys: np.ndarray, large: list[int]) -> tuple[list[int], np.ndarray]:
    """Where a set goes from its large nodes when they are split: parents and children."""
    parents: list[int] = []
    nodes: list[np.ndarray] = [np.zeros(0, np.int64)]
    for parent in large:
        salt = np.uint64((parent * _BASE + 77) & 0xFFFFFFFFFFFFFFFF)
        took = keys[picked(keys, np.float64(len(keys)), SPLITS, salt)]
        parents += [parent] * len(took)
        nodes.append(mix(took + salt).view(np.int64))
    return parents, np.concatenate(nodes)


def path_lists(sets: list[np.ndarray], large: list[list[int] | None]) -> pa.ListArray:
    """The paths of each set, as lists of parent and child."""
    parents, children, ends = [], [np.zeros(0, np.int64)], [0]
    for keys, nodes in zip(sets, large, strict=True):
        own, reached = paths(keys, nodes or [])
        parents += own
        children.append(reached)
        ends.append(len(parents))
    items = pa.StructArray.from_arrays([pa.array(parents, pa.int64()), pa.array(np.concatenate(children))], ["parent", "child"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


PATHS = T.ArrayType(T.StructType([T.StructField("parent", T.LongType()), T.StructField("child", T.LongType())]))


def packed(keys: np.ndarray) -> bytes:
    """The first BYTES bytes of each hash; they stay sorted."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(data, np.uint8).reshape(-1, BYTES)
    return out.view(">u8").ravel().astype(np.uint64)


def shared(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """How many keys each two of ``n`` rows have in common; (row, key) pairs are distinct."""
    out = np.zeros((n, n), np.float64)
    order = np.argsort(keys, kind="stable")
    rows, keys = rows[order], keys[order]
    if not len(keys):
        return out
    column = np.cumsum(np.append(False, keys[1:] != keys[:-1]))
    common = np.bincount(column) > 1  # a key of one row joins nothing
    keep = common[column]
    rows, column = rows[keep], (np.cumsum(common) - 1)[column[keep]]
    for begin in range(0, int(common.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (begin, begin + COLUMNS))
        block = np.zeros((n, COLUMNS), np.float32)
        block[rows[lo:hi], column[lo:hi] - begin] = 1
        out += block @ block.T
    return out


def similar_sets(data: list[bytes]) -> np.ndarray:
    """Which two sets are linked: at least 0.8 of their union is shared."""
    sets = [unpacked(x) for x in data]
    size = np.array([len(x) for x in sets], np.float64)
    both = shared(np.repeat(np.arange(len(sets)), size.astype(np.int64)), np.concatenate(sets), len(sets))
    return both * (10 + TENTHS) >= TENTHS * (size[:, None] + size[None, :])


def similar_sketches(data: list[bytes]) -> np.ndarray:
    """Which two sketches agree in enough of the ranges that either has."""
    sketch = np.frombuffer(b"".join(data), np.uint8).reshape(-1, RANGES)
    n = len(sketch)
    if n <= 48:
        a, b = sketch[:, None, :], sketch[None, :, :]
        return ((a == b) & (a > 0)).sum(2) >= AGREE * ((a | b) > 0).sum(2)
    same, there = np.zeros((n, n), np.uint8), np.zeros((n, n), np.uint8)
    for own in sketch.T:
        filled = own > 0
        same += (own[:, None] == own[None, :]) & filled[:, None]
        there += filled[:, None] | filled[None, :]
    return same >= AGREE * there


def roots(link: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches over links."""
    label = np.arange(len(link))
    while True:
        lowest = np.minimum(label, np.where(link, label[None, :], len(link)).min(1))
        lowest = lowest[lowest]
        if (lowest == label).all():
            return label
        label = lowest


COMPARED = T.StructType([T.StructField("class", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("root", T.BinaryType())])


def compare_groups(batches: Iterator[pa.RecordBatch], similar: Callable[[list[bytes]], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Compare the members of each (node, a, b), whose rows stand together, by class.

    Of each member that has a link: how many rows it is linked to, and the first
    member of its group that links lead to. Two blocks are compared across, one
    with itself inside.
    """
    group: tuple | None = None
    rows: list[tuple] = []

    def finish() -> pa.RecordBatch | None:
        kept = [r for i, r in enumerate(rows) if not i or r[0] != rows[i - 1][0]]  # a row repeated whole
        if len(kept) < 2:
            return None
        link = similar([r[3] for r in kept])
        np.fill_diagonal(link, False)
        if group[1] != group[2]:
            side = np.array([r[1] for r in kept])
            link &= side[:, None] != side[None, :]
        if not link.any():
            return None
        links, root, hit = link @ np.array([r[2] for r in kept], np.int64), roots(link), np.flatnonzero(link.any(1))
        return pa.RecordBatch.from_arrays([
            pa.array([kept[i][0] for i in hit], pa.binary()), pa.array(links[hit], pa.int64()),
            pa.array([kept[i][0] for i in root[hit]], pa.binary()),
        ], COMPARED.names)

    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
        for here, row in zip(keys, zip(*(batch.column(k).to_pylist() for k in range(3, 7)), strict=True), strict=True):
            if here != group:
                if (out := finish()) is not None:
                    yield out
                group, rows = here, []
            rows.append(row)
    if (out := finish()) is not None:
        yield out


def compared(members: DataFrame, block: int, similar: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """Compare ``data`` of the members (``node``, ``n``, ``class``, ``copies``) of each node.

    A node is dealt into blocks by hash; every two blocks form a group, so that
    no task holds more than two blocks of a node and each pair meets once.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    grouped = (
        members.withColumn("i", F.pmod(F.shiftright(F.xxhash64("class"), 20), blocks).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("node", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "class", "i", "copies", "data")
    )
    ordered = grouped.repartition(partitions(members.sparkSession), "node", "a", "b").sortWithinPartitions("node", "a", "b", "class")
    return ordered.mapInArrow(lambda x: compare_groups(x, similar), COMPARED)


def edges_of(found: DataFrame) -> DataFrame:
    return found.where(F.col("class") != F.col("root")).select(F.col("class").alias("a"), F.col("root").alias("b")).distinct()


def classes_of(docs: DataFrame, key: str, text: str, times: int) -> DataFrame:
    """``_key``, ``class``, first ``nodes`` and ``sketch`` of every row."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = first_nodes(batch.column(1), times)
            yield pa.RecordBatch.from_arrays([batch.column(0), got.field(0), got.field(1), got.field(2)], ["_key", "class", "nodes", "sketch"])

    return rows.mapInArrow(run, members_schema(rows.schema["_key"].dataType))


def sets_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``class``, ``copies``, ``set`` and the ``paths`` from its large nodes, for the ``wanted``
    (``_rep``, ``class``, ``copies``, ``large``: nodes).

    Texts go through one shuffle by key, and only those of classes that met
    another are turned into sets.
    """
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = texts.join(wanted, F.col("_key").eqNullSafe(F.col("_rep"))).select("class", "copies", "large", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for keys, bounds, own in shingle_sets(batch.column("_text")):
                part = batch.slice(at, len(own))
                at += len(own)
                right = [i for i, x in enumerate(part.column("class").to_pylist()) if x == own[i]]  # else another text of this key
                kept = part.take(pa.array(right, pa.int64()))
                # As they are kept, in whole bytes: deeper splits start from the kept sets.
                sets = [packed(keys[bounds[i] : bounds[i + 1]]) for i in right]
                steps = path_lists([unpacked(x) for x in sets], kept.column("large").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [kept.column("class"), kept.column("copies"), pa.array(sets, pa.binary()), steps], ["class", "copies", "set", "paths"]
                )

    schema = T.StructType([rows.schema["class"], rows.schema["copies"], T.StructField("set", T.BinaryType()), T.StructField("paths", PATHS)])
    return rows.mapInArrow(run, schema)


def steps_on(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """``class``, ``parent``, ``child``: where the members of some nodes (``class``, ``node``) go from there."""
    asked = sizes.groupBy("class").agg(F.collect_list("node").alias("large"))
    rows = sets.select("class", "set").join(asked, "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = path_lists([unpacked(x) for x in batch.column("set").to_pylist()], batch.column("large").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("class"), steps], ["class", "paths"])

    schema = T.StructType([T.StructField("class", T.BinaryType()), T.StructField("paths", PATHS)])
    return rows.mapInArrow(run, schema).select("class", F.explode("paths").alias("p")).select("class", "p.*")


@F.arrow_udf(T.DoubleType())
def mean_agreement(sketches: pa.Array) -> pa.Array:
    """How much of their ranges the sketches of each list share, in the mean of all its pairs."""
    out = []
    for data in sketches.to_pylist():
        sketch = np.frombuffer(b"".join(data), np.uint8).reshape(-1, RANGES)
        same = there = 0.0
        for own in sketch.T:
            count = np.bincount(own, minlength=256).astype(float)
            filled = count[1:].sum()
            same += (count[1:] * (count[1:] - 1)).sum()
            there += len(own) * (len(own) - 1) - count[0] * (count[0] - 1) if filled else 0.0
        out.append(same / there if there else 0.0)
    return pa.array(out, pa.float64())


def dense_nodes(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """``node`` of those whose members are alike throughout, by the sketches of some members chosen by hash.

    Whether a node is split or compared as it is, no pair is lost; this only tells
    in advance which nodes splitting would multiply without end.
    """
    chosen = large.where(F.pmod(F.xxhash64("class", "node"), F.col("n")) < WITNESSES).join(sketches.select("class", "data"), "class")
    judged = chosen.groupBy("node").agg(F.collect_list("data").alias("data")).select("node", mean_agreement("data").alias("agree"))
    return judged.where(F.col("agree") >= DENSE).select("node")


def leaves_of(sizes: DataFrame, steps: DataFrame, sets: DataFrame) -> DataFrame:
    """``class``, ``node``, ``n``: what is compared of large nodes, after splitting.

    ``sizes``: the members of large nodes (``class``, ``node``, ``n``); ``steps``: where each
    class goes from there (``class``, ``parent``, ``child``). Paths are made level by
    level, for the nodes that are really split.
    """
    done = sizes.limit(0)
    for level in range(1, DEPTH + 1):
        if sizes.isEmpty():
            break
        if level == DEPTH:
            done = done.unionByName(sizes)
            break
        if level > 1:
            steps = steps_on(sets, sizes)
        here = sizes.select("class", F.col("node").alias("parent"), F.col("n").alias("whole"))
        kids = pin(steps.join(here, ["class", "parent"]).select("class", "parent", "child", "whole"))
        counts = pin(kids.groupBy("parent", "child").agg(F.count(F.lit(1)).alias("m"), F.max("whole").alias("whole")))
        # The pairs that picks bring together, against all pairs: the members' mean similarity.
        alike = pin(counts.groupBy("parent").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"), F.max("whole").alias("whole")).where(
            F.col("pairs") * (TENTHS / 10) >= SPLITS * DENSE * F.col("whole") * F.col("whole")
        ).select("parent"))
        done = done.unionByName(sizes.join(alike.withColumnRenamed("parent", "node"), "node", "left_semi").select("class", "node", "n"))
        further = counts.where("m > 1").join(alike, "parent", "left_anti").select("parent", "child", "m")
        split = pin(kids.join(further, ["parent", "child"]).select("class", F.col("child").alias("node"), F.col("m").alias("n")))
        done = done.unionByName(split.where(F.col("n") <= NODE))
        sizes = split.where(F.col("n") > NODE)
    return done.select("class", "node", "n")


def linked(docs: DataFrame, key: str, text: str, recall: float) -> tuple[DataFrame, DataFrame]:
    """Every row's ``_key`` and ``class``; every class's ``root`` (the smallest class that
    links lead to), first key ``_rep``, ``copies`` and ``links`` (null without any)."""
    rows = pin(classes_of(docs, key, text, runs(recall)))
    reps = pin(rows.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("_key").alias("_rep"), F.count(F.lit(1)).alias("copies"), F.min("nodes").alias("nodes"), F.min("sketch").alias("sketch")
    ))
    met = reps.select("class", F.explode("nodes").alias("node"))
    met = pin(met.join(met.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "node"))
    sketches = reps.select("class", F.lit(1).alias("copies"), F.col("sketch").alias("data"))
    alike = pin(edges_of(compared(met.where(F.col("n") <= NODE).join(sketches, "class"), SKETCH_BLOCK, similar_sketches)))
    big = met.where(F.col("n") > NODE)
    dense = dense_nodes(big, sketches).withColumn("dense", F.lit(True))
    big = pin(big.join(dense, "node", "left"))
    mixed, whole = big.where("dense is null"), big.where("dense")
    # Nodes of one family often have the very same members; compared as they are, one of them stands for all.
    code = F.xxhash64("class")
    same = whole.groupBy("node", "n").agg(F.bit_xor(code).alias("x"), F.bit_xor(F.xxhash64(code, F.lit(1))).alias("y"))
    whole = whole.join(same.groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node"), "node", "left_semi")
    large = big.groupBy("class").agg(F.collect_list(F.when(F.col("dense").isNull(), F.col("node"))).alias("large"))
    ends = alike.select(F.col("a").alias("class")).unionByName(alike.select(F.col("b").alias("class"))).distinct()
    wanted = ends.join(large, "class", "full").join(reps.select("class", "_rep", "copies"), "class")
    sets = pin(sets_of(docs, wanted, key, text))
    steps = sets.select("class", F.explode("paths").alias("p")).select("class", "p.*")
    leaves = leaves_of(mixed.select("class", "node", "n"), steps, sets).unionByName(whole.select("class", "node", "n")).distinct()
    more = edges_of(compared(leaves.join(sketches, "class"), SKETCH_BLOCK, similar_sketches))

    clusters = components(alike.unionByName(more)).withColumnRenamed("node", "class").withColumnRenamed("root", "node")
    clusters = pin(clusters)
    sized = clusters.join(clusters.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node")
    exact = pin(compared(sets.select("class", "copies", F.col("set").alias("data")).join(sized, "class"), BLOCK, similar_sets))

    links = exact.groupBy("class").agg(F.sum("links").alias("links"))
    group = components(edges_of(exact)).withColumnRenamed("node", "class")
    known = reps.select("class", "_rep", "copies").join(links, "class", "left").join(group, "class", "left")
    return rows.select("_key", "class"), known.withColumn("root", F.coalesce("root", "class"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """``key``, ``class_id``, ``n_copies``, ``n_links``: one row per row of ``docs``.

    ``class_id`` is the smallest key in the group of texts that links connect,
    ``n_copies`` the rows with the same words, ``n_links`` the other rows whose
    shingles are similar (copies included). Null, empty and wordless texts link
    to nothing and form groups of their own. A text of fewer than five words
    links only to the same words. Rows of one key with different texts are
    different rows; other columns are ignored.
    """
    rows, known = linked(docs, key, text, recall)
    smallest = known.where(F.col("links").isNotNull()).groupBy("root").agg(F.min("_rep").alias("_least"))
    known = known.join(smallest, "root", "left").select(
        "class", F.coalesce("_least", "_rep").alias("_class_id"), "copies",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    out = rows.join(known, "class", "left")
    return out.select(
        F.col("_key").alias(key), F.coalesce("_class_id", "_key").alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


@F.arrow_udf(T.BinaryType())
def class_of(text: pa.Array) -> pa.Array:
    return pa.array([x for _, _, own in shingle_sets(text) for x in own], pa.binary())


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """One row of each group of linked texts, that with the smallest key, and all wordless rows.

    All columns stay, whatever their names. Only rows whose key occurs more than once are told apart by their words.
    """
    rows, known = linked(docs, key, text, recall)
    first = known.groupBy("root").agg(F.min(F.struct("_rep", "class")).alias("f")).select("f.*")
    stay = pin(first.unionByName(rows.where(F.col("class").isNull()).select(F.col("_key").alias("_rep"), "class")))
    ids = stay.select("_rep").distinct()
    kept = boxed(docs, _key=F.col(key), _text=F.col(text)).join(ids, F.col("_key").eqNullSafe(F.col("_rep")), "left_semi")
    twice = pin(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_key").alias("_again")))
    if twice.isEmpty():
        return kept.select("_row.*")
    same = F.col("_key").eqNullSafe(F.col("_again"))
    repeated = kept.join(twice, same, "left_semi").withColumn("_class", class_of(F.col("_text")))
    exact = F.col("_key").eqNullSafe(F.col("_rep")) & F.col("_class").eqNullSafe(F.col("class"))
    repeated = repeated.join(stay.distinct(), exact, "left_semi")
    worded = repeated.where(F.col("_class").isNotNull()).dropDuplicates(["_key", "_class"])
    wordless = repeated.where(F.col("_class").isNull())
    once = kept.join(twice, same, "left_anti")
    return once.select("_row").unionByName(worded.select("_row")).unionByName(wordless.select("_row")).select("_row.*")
