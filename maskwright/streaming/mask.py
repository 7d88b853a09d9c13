"""Streams: masking with a vault that grows, restoring piece by piece.

Every micro-batch is one version of a log of tables (``sources.store``): what it
adds to the vault and what it masked are seen together or not at all. The
batch's number is kept with the version, so a batch that comes again is known.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed as X
from ..operators import vault as V
from ..operators.restore import restore
from ..plans.masking import KEYS, mask_sessions
from ..plans.runtime import pin
from ..sources.store import State, TableLog

# What opens a placeholder, what may stand in it, and how long it may be.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STRICT = UPPER + "0123456789_"
LOOSE = STRICT + UPPER.lower() + " \t-"
LOOSE_OPENERS = "[［【"
STRICT_LENGTH, LOOSE_LENGTH = 75, 64


def may_grow(tail: str, tolerant: bool) -> bool:
    """Whether more text could make ``tail``, from its first character on, a placeholder."""
    inner = tail[1:]
    if tail[0] == "[" and len(tail) <= STRICT_LENGTH and inner[:1] in UPPER and not inner.strip(STRICT):
        return True
    if not tolerant:
        return False
    if tail[0] == "\\":
        if inner[:1] not in ("", "["):
            return False
        inner = inner[1:].removesuffix("\\")
    elif tail[0] not in LOOSE_OPENERS:
        return False
    return len(inner) < LOOSE_LENGTH and not inner.strip(LOOSE)


def settled(text: str, before: str, tolerant: bool, final: bool) -> int:
    """How much of ``text`` no later piece can change (``before``: one character).

    Everything before the first bracket that is still open, and so near the end
    that it may yet become a placeholder.
    """
    if final:
        return len(text)
    for at in range(max(0, len(text) - STRICT_LENGTH - 2), len(text)):
        if may_grow(text[at:], tolerant):
            return at
    return len(text)


READY = "stream_id string, seq bigint, before string, text string, is_final boolean"
#: The held-back end (under 76 characters), one character before it, the next numbers in and out,
#: and pieces that came early; a piece that is next in its own batch never becomes state.
TAIL = (
    "pending string, before string, expected bigint, number bigint, "
    "early_seq array<bigint>, early_piece array<string>, early_final array<boolean>"
)


def settle_stream(
    pieces: DataFrame, tolerant: bool = True, ttl_days: float | None = None
) -> DataFrame:
    """Regroup a stream of pieces so that no placeholder is split over two rows.

    ``pieces`` has stream_id, seq, piece, is_final. Each row out can be
    restored by itself with the batch operators. Pieces may come in any order;
    a stream of which nothing came for ``ttl_days`` is given up.
    """
    ttl = None if ttl_days is None else int(ttl_days * 86_400_000)

    def pass_on(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pending, before, expected, number, *early = state.get if state.exists else ("", "", 0, 0, [], [], [])
        come = {int(seq): (piece, bool(last)) for seq, piece, last in zip(*early)}
        for batch in batches:
            for seq, piece, last in zip(batch["seq"], batch["piece"], batch["is_final"]):
                if seq >= expected:
                    come[int(seq)] = (piece or "", bool(last))
        ready, finished = [], False
        while expected in come:
            piece, last = come.pop(expected)
            ready.append(piece)
            finished |= last
            expected += 1
        out = []
        if ready:
            pending += "".join(ready)
            n = settled(pending, before, tolerant, finished)
            if n or finished:
                out.append((key[0], number, before, pending[:n], finished))
                number += 1
                before = pending[n - 1 : n] or before
                pending = pending[n:]
        state.update((
            pending, before, expected, number, list(come), [piece for piece, _ in come.values()], [last for _, last in come.values()],
        ))
        if ttl:
            state.setTimeoutDuration(ttl)
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "seq", "before", "text", "is_final"])

    narrow = pieces.select("stream_id", "seq", "piece", "is_final")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout
    return narrow.groupBy("stream_id").applyInPandasWithState(pass_on, READY, TAIL, "Append", timeout)


def mask_batch(log: TableLog, rows: DataFrame, batch_id: int, *, writer: str = "mask", text: str = "text", **options) -> int | None:
    """Mask one micro-batch of ``session, seq, section`` and a text, and commit it.

    Only the buckets of the batch's sessions are read. Numbers continue from
    theirs by a distributed running total, so no session has to fit in a task.
    Tables: ``values``, ``remembered``, ``merged``, ``uses`` (when a session was
    last used) and ``masked``, which holds no original text.
    """
    rows = pin(rows.select(*KEYS, F.col(text).alias("text")))
    sessions = rows.select("session").distinct()

    def make(state: State) -> dict[str, DataFrame]:
        held = log.read(sessions=sessions, state=state)
        out = mask_sessions(rows, held.get("values"), remembered=held.get("remembered"), merged=held.get("merged"), **options)
        return {
            **out.added, "masked": out.masked.select(*KEYS, "masked"),
            "uses": sessions.withColumn("last_used", F.current_timestamp()),
        }

    return log.once(writer, batch_id, make)


def mask_stream(
    sections: DataFrame, path: str, checkpoint: str, *, writer: str = "mask", ttl_days: float | None = None, **options
) -> StreamingQuery:
    """Start masking a stream of sections into the log at ``path``, until its source is read.

    A session's rows must come in reading order; joined, all batches then hold
    what one batch over all rows would. With ``ttl_days`` sessions not used
    for so long are forgotten after each batch, and their numbers begin anew.
    """
    low, high, _ = X.RETENTION_DAYS
    if ttl_days is not None and not low <= ttl_days <= high:
        raise ValueError(f"retention must be {low} to {high} days")
    log = TableLog(sections.sparkSession, path)

    def each(rows: DataFrame, batch_id: int) -> None:
        mask_batch(log, rows, batch_id, writer=writer, **options)
        if ttl_days is not None:
            expire(log, ttl_days)

    return sections.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expire(log: TableLog, ttl_days: float, now=None) -> int | None:
    """Forget sessions unused for longer than the interval, in every table but what was masked."""
    held = log.read()
    if "uses" not in held:
        return None
    sessions = held["uses"].groupBy("session").agg(F.max("last_used").alias("last_used"))
    moment = held["uses"].select(F.current_timestamp()).first() if now is None else [now]
    if moment is None:
        return None
    gone = pin(V.purge({}, sessions, ttl_days, moment[0])["purged"])
    return None if gone.isEmpty() else log.remove(gone, keep=("masked",))


def restore_batch(settled_rows: DataFrame, vault: DataFrame, tolerant: bool = True) -> DataFrame:
    """Restore settled rows, which name their ``session``, inside a micro-batch."""
    rows = settled_rows.withColumn("_body", F.concat("before", "text"))
    out = restore(rows, vault, ["session", "stream_id", "seq"], text="_body", tolerant=tolerant)
    return out.withColumn(
        "restored", F.substr("restored", F.length("before") + 1)
    ).drop("_body")


def restore_stream(
    pieces: DataFrame, vault_path: str, path: str, checkpoint: str, *, session: Column, writer: str = "restore", tolerant: bool = True,
) -> StreamingQuery:
    """Start restoring a stream of pieces (stream_id, seq, piece, is_final) into the log at ``path``.

    Pieces are settled first; each micro-batch is then restored from the
    newest vault, of which only its sessions' buckets are read. ``session``
    tells the vault's session of a ``stream_id``. The table ``restored`` has
    ``session, stream_id, seq, restored, is_final``: a stream's rows in the order
    of ``seq`` are the reply, each one settled when it was written.
    """
    spark = pieces.sparkSession
    log, vaults = TableLog(spark, path), TableLog(spark, vault_path)

    def each(rows: DataFrame, batch_id: int) -> None:
        rows = pin(rows.withColumn("session", session))

        def make(state: State) -> dict[str, DataFrame]:
            held = vaults.read(sessions=rows.select("session"))
            return {"restored": restore_batch(rows, held["values"], tolerant).select("session", "stream_id", "seq", "restored", "is_final")}

        log.once(writer, batch_id, make)

    ready = settle_stream(pieces, tolerant)
    return ready.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replies(restored: DataFrame) -> DataFrame:
    """``session, stream_id, text``: the rows of each reply joined in order."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "restored"))), lambda t: t["restored"]), "")
    return restored.groupBy("session", "stream_id").agg(whole.alias("text"))
