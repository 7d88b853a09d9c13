"""Overlap resolution over tables of spans: for texts with very many of them.

The same results as ``operators.resolve`` gives inside a row. Spans that
overlap form islands. Spans are dealt out once, by place; an island that lies
in one part is decided there, best first. Of the islands that may reach over
parts small ones are resolved as arrays; in larger ones a span that beats every
span it overlaps is kept, what it overlaps goes, and this is repeated. No two
spans are ever paired: of two that overlap, the longer one covers an end of the
other, so a span only needs to know the best one over each of its ends. Inside a
part the places of kept spans are marked; in the rounds a span is cut into few
blocks whose length is a power of two, an end lies in one block of each length,
and both meet there.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spans import SPANS
from ..plans.runtime import lookup_join, partitions, pin, running_total, sweep
from .resolve import greedy

#: Islands of at most so many spans are resolved as one array.
FEW = 64
#: After so many rounds what is left, chains in which each span waits for the one before, is
#: resolved text by text.
ROUNDS = 24
#: An island of more spans than this isn't gathered in a task's memory; rounds decide it.
GATHERED = 1 << 20
#: Texts of a part are laid behind each other at this distance, more than any text is long.
APART = 1 << 34

LETTERS = regex.compile(r"[\p{L}\p{N}]+")


def _rank() -> Column:
    """Smaller is better: longest, highest priority, first, first rule; ``id`` tells equal spans apart."""
    return F.struct(
        (F.col("start") - F.col("end")).alias("a"), (-F.col("priority")).alias("b"), F.col("start").alias("c"),
        F.col("rule").alias("d"), F.col("id").alias("id"),
    )


def _levels(spans: DataFrame) -> int:
    longest = spans.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 1
    return int(longest).bit_length()


def _blocks(levels: int) -> Column:
    """The blocks that make up a span: at most two of each length."""
    # At each level the span, cut to whole blocks, may stick out by one to the left and to the right.
    return F.expr(f"""
        filter(flatten(transform(sequence(0, {levels}), k -> transform(
            array(struct(shiftright(start + shiftleft(1L, k) - 1, k) AS l, shiftright(cast(end AS bigint), k) AS r)),
            x -> struct(k, x.l, x.r)))), x -> x.l < x.r AND (x.l % 2 = 1 OR x.r % 2 = 1))""")


def _covered(spans: DataFrame, keys: list[str], levels: int, *columns: str) -> DataFrame:
    out = spans.select(*keys, *columns, F.explode(_blocks(levels)).alias("x"))
    places = F.filter(
        F.array(F.when(F.col("x.l") % 2 == 1, F.col("x.l")), F.when(F.col("x.r") % 2 == 1, F.col("x.r") - 1)), lambda i: i.isNotNull()
    )
    return out.select(*keys, *columns, F.col("x.k").alias("k"), F.explode(places).alias("i"))


def _ends(spans: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Each span's first and last place, in the block of each length."""
    points = spans.select(*keys, "id", "rank", F.explode(F.array(F.col("start").cast("bigint"), F.col("end").cast("bigint") - 1)).alias("p"))
    blocks = F.expr(f"transform(sequence(0, {levels}), k -> struct(k, shiftright(p, k) AS i))")
    return points.select(*keys, "id", "rank", F.explode(blocks).alias("x")).select(*keys, "id", "rank", "x.k", "x.i")


def numbered_islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``island``: where the run of overlapping spans begins that a span belongs to."""
    by_start = spans.groupBy(*keys, "start").agg(F.max("end").alias("end"))
    # What reaches over a start is the furthest end of all earlier starts.
    walked = sweep(by_start, keys, "start", ["end"])
    fresh = walked.where(F.col("next").isNotNull() & (F.col("next") >= F.col("end"))).select(*keys, F.col("next").alias("start"), F.col("next").alias("begin"))
    firsts = by_start.groupBy(*keys).agg(F.min("start").alias("start")).withColumn("begin", F.col("start"))
    starts = by_start.select(*keys, "start").join(fresh.unionByName(firsts).distinct(), [*keys, "start"], "left")
    named = sweep(starts, keys, "start", ["begin"]).select(*keys, "start", F.col("begin").alias("island"))
    return spans.join(named, [*keys, "start"])


def _one_by_one(spans: pd.DataFrame) -> pd.DataFrame:
    """The spans of one text that are kept, best first, each checked against its neighbours."""
    import bisect

    begins, ends, kept = [], [], []
    for row in spans.sort_values(["a", "b", "c", "d", "id"]).itertuples():
        at = bisect.bisect_left(begins, row.end)
        if at and ends[at - 1] > row.start:
            continue
        begins.insert(at, row.start)
        ends.insert(at, row.end)
        kept.append(row.id)
    return pd.DataFrame({"id": kept})


class Chunk:
    """Whole islands of a part, sorted by text and start; ``start`` and ``end`` tell texts apart."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        text = rows.column("_text").combine_chunks()
        fresh = np.ones(len(rows), bool)
        fresh[1:] = pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        self.text = np.cumsum(fresh)
        odd = np.zeros(len(rows), bool)
        for name in rows.column_names:
            if name in ("end", "priority", "rule", "value"):
                odd |= rows.column(name).is_null().to_numpy()
        whole = lambda name: rows.column(name).cast(pa.int64()).fill_null(-APART // 4).to_numpy()
        self.start, self.end = whole("start") + self.text * APART, whole("end") + self.text * APART
        self.priority, self.rule = whole("priority"), whole("rule")
        odd |= self.end <= self.start
        reach = np.maximum.accumulate(self.end)
        # A text whose ends so far are all null has no reach yet: its island goes on.
        known = reach[:-1] >= self.text[1:] * APART - APART // 8
        fresh[1:] |= known & (self.start[1:] >= reach[:-1])
        self.begins = np.flatnonzero(fresh)
        self.island = np.cumsum(fresh) - 1
        self.odd = np.bincount(self.island, odd) > 0

    def part(self, mask: np.ndarray) -> "Chunk":
        return Chunk(self.rows.filter(pa.array(mask)))

    def best_first(self) -> tuple[np.ndarray, np.ndarray]:
        """The order from best to worst, and which spans are kept."""
        order = np.lexsort((np.arange(len(self.start)), self.rule, self.start, -self.priority, self.start - self.end))
        places = np.unique(np.concatenate((self.start, self.end - 1)))
        first, last = np.searchsorted(places, self.start)[order].tolist(), np.searchsorted(places, self.end - 1)[order].tolist()
        taken, kept = bytearray(len(places)), []
        # What a span overlaps and was kept before is not shorter, so it covers an end of the span.
        for a, b in zip(first, last):
            free = not (taken[a] or taken[b])
            kept.append(free)
            if free:
                taken[a : b + 1] = b"\1" * (b + 1 - a)
        out = np.zeros(len(order), bool)
        out[order] = kept
        return order, out


def _walk(rows: DataFrame, keys: list[str], decide: Callable[[Chunk], pa.Table], schema: T.StructType) -> DataFrame:
    """Islands that surely lie in one part go through ``decide``; rows of all others come back with ``_rest``.

    What comes from earlier parts reaches less than the longest span's length over the first
    start of a part; what goes on in a later one is the last island.
    """
    for name in (*keys, "start"):
        rows = rows.where(F.col(name).isNotNull())
    longest = rows.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    columns = rows.columns
    parts = rows.repartitionByRange(partitions(rows.sparkSession), *keys, "start").sortWithinPartitions(*keys, "start")
    out = T.StructType([*schema, T.StructField("_rest", T.BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pending, border, adrift = None, [], None, False

        def given(table: pa.Table, rest: bool) -> Iterator[pa.RecordBatch]:
            have = dict(zip(table.column_names, table.columns)) | {"_rest": pa.chunked_array([pa.array(np.full(len(table), rest))])}
            filled = [have.get(f.name, pa.nulls(len(table), kind)).cast(kind) for f, kind in zip(out, kinds)]
            yield from pa.table(filled, names=out.names).to_batches()

        def settle(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
            """Decide all islands but the open one, which is returned as a table."""
            nonlocal border, adrift
            chunk = Chunk(table)
            if border is None:
                border = (table.column("_text")[0], int(chunk.start[0]) - APART + longest)
            cut = len(table) if last else int(chunk.begins[-1])
            own = chunk.start[chunk.begins] - chunk.text[chunk.begins] * APART
            first_text = pc.equal(table.column("_text"), border[0]).to_numpy()[chunk.begins]
            rest = chunk.odd | (first_text & (own < border[1]))
            rest[-1] |= last
            rest[0] |= adrift
            adrift = adrift and len(rest) == 1
            rest = rest[chunk.island]
            rest_rows, sure = rest.copy(), ~rest
            rest_rows[cut:], sure[cut:] = False, False
            if rest_rows.any():
                yield from given(table.filter(pa.array(rest_rows)), True)
            if sure.any():
                yield from given(decide(chunk.part(sure)), False)
            left = table[cut:]
            if len(left) > GATHERED:
                # Only the rows that reach furthest are needed to see where the island ends.
                ends = left.column("end").cast(pa.int64()).fill_null(-APART // 4)
                far = pc.equal(ends, pc.max(ends)).to_numpy()
                keep = np.zeros(len(left), bool)
                keep[np.flatnonzero(far)[0]] = True
                yield from given(left.filter(pa.array(~keep)), True)
                left, adrift = left.filter(pa.array(keep)), True
            yield left

        kinds = None
        for batch in batches:
            if kinds is None:
                types = {f.name: f.type for f in batch.schema} | {"members": pa.int64(), "_rest": pa.bool_()}
                kinds = [types[f.name] for f in out]
            pending.append(batch)
            if sum(map(len, pending)) < (len(held) if held is not None else 1):
                continue
            table = pa.Table.from_batches(pending)
            if not len(table):
                continue
            table = table if held is None or not len(held) else pa.concat_tables([held, table])
            pending = []
            for got in settle(table.combine_chunks(), False):
                if isinstance(got, pa.Table):
                    held = got
                else:
                    yield got
        tables = [t for t in [held, pa.Table.from_batches(pending) if pending else None] if t is not None and len(t)]
        if tables:
            for got in settle(pa.concat_tables(tables).combine_chunks(), True):
                if not isinstance(got, pa.Table):
                    yield got

    return pin(parts.select(*columns, F.to_json(F.struct(*keys)).alias("_text")).mapInArrow(work, out))


def resolve_table(spans: DataFrame, keys: list[str], few: int = FEW, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``spans`` that are kept: none overlaps another.

    ``spans`` has ``keys, start, end, priority, rule``. Of equal rows one is kept.
    """
    def decide(chunk: Chunk) -> pa.Table:
        return chunk.rows.filter(pa.array(chunk.best_first()[1]))

    walked = _walk(spans, keys, decide, spans.schema)
    done, rest = walked.where(~F.col("_rest")).select(*spans.columns), walked.where("_rest").select(*spans.columns)
    return done.unionByName(_resolve_over_parts(rest, keys, few, rounds))


def _resolve_over_parts(spans: DataFrame, keys: list[str], few: int, rounds: int) -> DataFrame:
    """Islands wherever they lie: small ones as arrays, larger ones in rounds."""
    payload = [c for c in spans.columns if c not in keys]
    rows = pin(spans.withColumn("id", F.monotonically_increasing_id()))
    placed = pin(numbered_islands(rows.select(*keys, "id", "start", "end", "priority", "rule"), keys))
    sizes = placed.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n"))
    one = F.struct(
        "start", "end", F.lit("").alias("value"), F.lit("").alias("entity_type"), F.col("id").cast("string").alias("source"), "priority",
        F.col("rule").cast("int").alias("rule"),
    )
    small = placed.join(sizes.where(F.col("n") <= few), [*keys, "island"], "left_semi")
    arrays = small.groupBy(*keys, "island").agg(F.sort_array(F.collect_list(F.struct("id", one.alias("s")))).alias("s"))
    arrays = arrays.select(F.transform("s", lambda x: x["s"]).cast(SPANS).alias("s"))
    done = [arrays.select(F.explode(greedy(F.col("s"))).alias("s")).select(F.col("s.source").cast("bigint").alias("id"))]
    large = placed.join(sizes.where(F.col("n") > few), [*keys, "island"], "left_semi")
    alive = pin(large.withColumn("rank", _rank()).select(*keys, "id", "start", "end", "rank"))
    for _ in range(rounds):
        if alive.isEmpty():
            break
        levels = _levels(alive)
        best = _covered(alive, keys, levels, "rank").groupBy(*keys, "k", "i").agg(F.min("rank").alias("best"))
        ends = pin(_ends(alive, keys, levels))
        over = lookup_join(ends, best, [*keys, "k", "i"]).groupBy("id").agg(F.min("best").alias("best"), F.first("rank").alias("rank"))
        winners = pin(over.where(F.col("best") == F.col("rank")).select("id"))
        hidden = _covered(alive.join(winners, "id", "left_semi"), keys, levels).distinct().withColumn("hit", F.lit(True))
        gone = lookup_join(ends, hidden, [*keys, "k", "i"]).where("hit").select("id").distinct()
        done.append(winners)
        alive = pin(alive.join(gone, "id", "left_anti"))
    else:
        left = alive.select(*keys, "id", "start", "end", "rank.a", "rank.b", "rank.c", "rank.d")
        done.append(left.groupBy(*keys).applyInPandas(_one_by_one, "id bigint"))
    kept = done[0]
    for more in done[1:]:
        kept = kept.unionByName(more)
    return rows.join(kept, "id", "left_semi").select(*keys, *payload)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _letters(value: pd.Series, begin: pd.Series, end: pd.Series) -> pd.Series:
    """How many letters and digits each stretch of a value has."""
    out = []
    for text, firsts, lasts in zip(value, begin, end):
        runs = [(m.start(), m.end()) for m in LETTERS.finditer(text)]
        counts, k = [], 0
        for a, b in zip(firsts, lasts):  # in order, and disjoint
            while k < len(runs) and runs[k][1] <= a:
                k += 1
            n, j = 0, k
            while j < len(runs) and runs[j][0] < b:
                n += min(b, runs[j][1]) - max(a, runs[j][0])
                j += 1
            k = max(k, j - 1)
            counts.append(n)
        out.append(counts)
    return pd.Series(out)


def still_visible(spans: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``spans``, with ``visible``: how many of their letters and digits no kept span covers.

    Between the places where spans begin and end, a text is either covered or not; of each
    stretch that is not, letters are counted once, in the span that reaches furthest over it. Sums up to a
    span's two ends then give its count, so no span is compared with another.
    """
    numbered = pin(spans.withColumn("id", F.monotonically_increasing_id()))
    nothing, bare_from = F.lit(None).cast("struct<end:int,id:bigint>").alias("over"), F.lit(None).cast("int").alias("hidden")
    points = numbered.select(*keys, F.col("start").alias("p"), F.struct("end", "id").alias("over"), bare_from)
    for more in (
        numbered.select(*keys, F.col("end").alias("p"), nothing, bare_from),
        kept.select(*keys, F.col("start").alias("p"), nothing, F.col("end").alias("hidden")),
        kept.select(*keys, F.col("end").alias("p"), nothing, bare_from),
    ):
        points = points.unionByName(more)
    points = points.groupBy(*keys, "p").agg(F.max("over").alias("over"), F.max("hidden").alias("hidden"))
    walked = pin(sweep(points, keys, "p", ["over", "hidden"]))
    bare = walked.where(F.col("next").isNotNull() & (F.col("over.end") > F.col("p")) & (F.coalesce("hidden", F.lit(-1)) <= F.col("p")))
    asked = bare.groupBy(F.col("over.id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("p", "next"))).alias("s"))
    read = numbered.select(*keys, "id", "start", "value").join(asked, "id")
    counts = _letters("value", F.transform("s", lambda x: x["p"] - F.col("start")), F.transform("s", lambda x: x["next"] - F.col("start")))
    counted = read.select(*keys, F.explode(F.arrays_zip(F.col("s.p").alias("p"), counts.alias("n"))).alias("x")).select(*keys, "x.p", "x.n")
    steps = walked.select(*keys, "p").join(counted, [*keys, "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = pin(running_total(steps, keys, ["p"], "n", "upto").select(*keys, "p", (F.col("upto") - F.col("n")).alias("before")))
    at = lambda name, out: total.select(*keys, F.col("p").alias(name), F.col("before").alias(out))
    return (
        numbered.join(at("start", "_from"), [*keys, "start"]).join(at("end", "_to"), [*keys, "end"])
        .withColumn("visible", F.col("_to") - F.col("_from")).select(*spans.columns, "visible")
    )


def _showing(chunk: Chunk, lost: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Which of the spans ``lost`` have a letter or digit that no kept span covers.

    As in ``still_visible``: each stretch between two ends is read once.
    """
    places = np.unique(np.concatenate((chunk.start[lost], chunk.end[lost], chunk.start[kept], chunk.end[kept])))
    at = lambda x: np.searchsorted(places, x)
    hidden = np.zeros(len(places), np.int64)
    np.add.at(hidden, at(chunk.start[kept]), 1)
    np.add.at(hidden, at(chunk.end[kept]), -1)
    by_end = lost[np.argsort(chunk.end[lost], kind="stable")]
    over = np.full(len(places), -1)
    np.maximum.at(over, at(chunk.start[by_end]), np.arange(len(by_end)))
    over = np.maximum.accumulate(over)
    owner = by_end[over]
    bare = np.flatnonzero((over[:-1] >= 0) & (chunk.end[owner[:-1]] > places[:-1]) & (np.cumsum(hidden)[:-1] == 0))
    values = chunk.rows.column("value").take(pa.array(owner[bare])).to_pylist()
    begin = places[bare] - chunk.start[owner[bare]]
    seen = np.zeros(len(places) + 1, np.int64)
    for k, value, a, size in zip(bare.tolist(), values, begin.tolist(), (places[bare + 1] - places[bare]).tolist()):
        seen[k + 1] = LETTERS.search(value, a, a + size) is not None
    upto = np.cumsum(seen)
    return upto[at(chunk.end[lost])] > upto[at(chunk.start[lost])]


def _merged(chunk: Chunk, keys: list[str]) -> pa.Table:
    """Kept spans, and groups of those that show something, of whole islands."""
    order, kept = chunk.best_first()
    # Equal rows are one span.
    same = np.ones(len(order), bool)
    for x in (chunk.start, chunk.end, chunk.priority, chunk.rule):
        same[1:] &= x[order][1:] == x[order][:-1]
    same[0] = False
    group = np.cumsum(~same) - 1
    lost = order[np.bincount(group, kept[order])[group] == 0]
    held, lost = np.flatnonzero(kept), np.sort(lost)
    both = kept.copy()
    if len(lost):
        both[lost[_showing(chunk, lost, held)]] = True
    of = np.flatnonzero(both)
    reach = np.maximum.accumulate(chunk.end[of])
    fresh = np.append(True, chunk.start[of][1:] >= reach[:-1])
    group, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    n_held, n_all = np.bincount(group, kept[of]).astype(np.int64), np.bincount(group)
    alone = of[(n_held == n_all)[group]]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    best = order[np.minimum.reduceat(np.where(kept[of], place[of], len(order)), first)]
    mixed = np.flatnonzero(n_held < n_all)
    plain = chunk.rows.take(pa.array(alone))
    plain = plain.append_column("members", pa.array(np.zeros(len(alone), np.int64)))
    leader, begin = best[mixed], of[first[mixed]]
    end = reach[np.append(first[1:], len(of))[mixed] - 1] - chunk.text[begin] * APART
    rows = chunk.rows
    merged = {k: rows.column(k).take(pa.array(leader)) for k in (*keys, "entity_type", "priority", "rule")}
    merged["start"] = rows.column("start").take(pa.array(begin))
    merged["end"] = pa.chunked_array([pa.array(end)]).cast(rows.schema.field("end").type)
    merged["source"] = pa.chunked_array([pa.array(["merged"] * len(mixed), pa.string())])
    merged["members"] = pa.chunked_array([pa.array(n_held[mixed])])
    wanted = {n: c for n, c in zip(plain.column_names, plain.columns)}
    columns = [pa.chunked_array([*wanted[n].chunks, *merged[n].cast(wanted[n].type).chunks], wanted[n].type) for n in merged]
    return pa.table(columns, names=list(merged))


def merge_partial_table(spans: DataFrame, keys: list[str], few: int = FEW) -> DataFrame:
    """``keys, start, end, entity_type, priority, rule, source, members``: spans that hide every letter of ``spans``.

    Kept spans as they are (``members`` 0), but where a span that was not kept
    shows a letter or digit, it and all it touches become one merged span with the best
    one's type; ``members`` counts the kept spans that it replaces.
    """
    names = [*keys, "start", "end", "entity_type", "priority", "rule", "source", "members"]
    members = T.StructField("members", T.LongType())
    walked = _walk(spans, keys, lambda chunk: _merged(chunk, keys), T.StructType([*spans.schema, members]))
    done, rest = walked.where(~F.col("_rest")).select(*names), walked.where("_rest").select(*spans.columns)
    return done.unionByName(_merge_over_parts(rest, keys, few).select(*names))


def _merge_over_parts(spans: DataFrame, keys: list[str], few: int) -> DataFrame:
    kept = pin(_resolve_over_parts(spans, keys, few, ROUNDS))
    lost = spans.join(kept.select(*keys, "start", "end", "priority", "rule"), [*keys, "start", "end", "priority", "rule"], "left_anti")
    partial = still_visible(lost, kept, keys).where("visible > 0").select(*spans.columns)
    both = pin(kept.withColumn("held", F.lit(True)).unionByName(partial.withColumn("held", F.lit(False))).withColumn("id", F.monotonically_increasing_id()))
    grouped = pin(numbered_islands(both, keys))
    mixed = grouped.groupBy(*keys, "island").agg(
        F.min("start").alias("_start"), F.max("end").alias("_end"), F.bool_and("held").alias("alone"),
        F.min_by(F.struct("entity_type", "priority", "rule"), F.when(F.col("held"), _rank())).alias("best"),
        F.sum(F.col("held").cast("bigint")).alias("n"),
    )
    merged = mixed.where(~F.col("alone")).select(
        *keys, F.col("_start").alias("start"), F.col("_end").alias("end"), "best.entity_type", "best.priority", "best.rule",
        F.lit("merged").alias("source"), F.col("n").alias("members"),
    )
    plain = grouped.join(mixed.where("alone"), [*keys, "island"], "left_semi").select(
        *keys, "start", "end", "entity_type", "priority", "rule", "source", F.lit(0).cast("bigint").alias("members")
    )
    return plain.unionByName(merged)
