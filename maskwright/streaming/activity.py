"""Activity: probes, per-session totals, late rows, support totals."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed as X
from ..functions import placeholders as P
from ..plans.runtime import pin
from ..sources.store import State, TableLog


def session_ref(session: Column, salt: str) -> Column:
    """Keyed hash of a session id (HMAC-SHA-256), so reports hold no id."""
    key = bytearray(salt.encode().ljust(64, b"\0"))
    if len(key) > 64:
        raise ValueError("salt must be at most 64 bytes")
    inner, outer = (F.lit(bytes(b ^ c for b in key)) for c in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(session, "UTF-8")), 256))
    return F.substr(F.sha2(F.concat(outer, first), 256), F.lit(1), F.lit(32))


def occurrences(requests: DataFrame, vault: DataFrame | None = None, text: str = "masked_text") -> DataFrame:
    """Placeholders in each request by type: unknown types count as CUSTOM,
    literals do not count. With a vault, only placeholders in it count."""
    names = [c for c in requests.columns if c != text]
    found = requests.select(
        *names, F.explode(F.regexp_extract_all(text, F.lit(X.EXACT), F.lit(0))).alias("placeholder")
    )
    if vault is not None:
        found = found.join(vault.select("session", "placeholder"), ["session", "placeholder"], "left_semi")
    kind = P.placeholder_type(F.col("placeholder"))
    named = F.when(kind.isin(*X.ACTIVITY_TYPES), kind).otherwise("CUSTOM")
    return found.where(kind != X.LITERAL).withColumn("entity_type", named).drop("placeholder")


def activity_summary(
    requests: DataFrame, salt: str, now=None, vault: DataFrame | None = None,
    ttl_seconds: int = X.ACTIVITY_TTL_SECONDS, newest: int | None = None,
) -> DataFrame:
    """All sessions, one row each, without values or ids; only the ``newest`` so many if asked.

    ``requests``: session, request_id, ts, forwarded, completed, masked_text.
    """
    live = requests
    if now is not None:
        ages = requests.groupBy("session").agg(F.max("ts").alias("_last"))
        fresh = ages.where(F.col("_last") >= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(float(ttl_seconds))))
        live = requests.join(fresh.select("session"), "session", "left_semi")
    totals = live.groupBy("session").agg(*_sums())
    shown = live.where("forwarded")
    if newest is not None:
        totals = pin(totals.orderBy(F.desc("last_request_at"), "session").limit(newest))
        shown = shown.join(totals.select("session"), "session", "left_semi")
    found = occurrences(shown.select("session", "masked_text"), vault)
    return _with_counts(totals, found.groupBy("session", "entity_type").agg(F.count(F.lit(1)).alias("n")), salt)


def split_late(batch: DataFrame, high_water, allowed: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows for the late sink; without a high-water mark all are in time."""
    if high_water is None:
        return batch, batch.where(F.lit(False))
    in_time = F.col("ts") >= F.lit(high_water).cast("timestamp") - F.expr(f"INTERVAL {allowed}")
    return batch.where(in_time), batch.where(~in_time)


def count_batch(log: TableLog, requests: DataFrame, batch_id: int, *, late: str = "10 minutes", writer: str = "activity") -> int | None:
    """Add one micro-batch of requests to the totals in a log, and commit it.

    Rows older than the newest seen in earlier batches by more than ``late`` go to the
    table ``late`` as they are; no row is lost. ``totals`` and ``occurrences`` get one row
    per session (and type) and batch, to be summed by ``activity_totals``. The
    high-water mark is kept with the version, so a repeated batch is split as before.
    """
    requests = pin(requests)
    newest = requests.agg(F.max("ts").cast("string")).first()[0]

    def make(state: State) -> dict[str, DataFrame]:
        live, old = split_late(requests, state.notes.get(f"{writer}:newest"), late)
        found = occurrences(live.where("forwarded").select("session", "masked_text"))
        return {
            "totals": live.groupBy("session").agg(*_sums()), "late": old,
            "occurrences": found.groupBy("session", "entity_type").agg(F.count(F.lit(1)).alias("n")),
        }

    def notes(state: State) -> dict[str, str]:
        seen = [x for x in (newest, state.notes.get(f"{writer}:newest")) if x is not None]
        return {f"{writer}:newest": max(seen)} if seen else {}

    return log.once(writer, batch_id, make, notes)


def _sums() -> list[Column]:
    n = lambda c: F.sum(c.cast("bigint"))
    return [
        F.count(F.lit(1)).alias("requests"), n(F.col("forwarded")).alias("forwarded"),
        n(F.col("completed")).alias("completed"), n(~F.col("completed")).alias("failed"),
        F.max("ts").alias("last_request_at"),
    ]


def activity_stream(requests: DataFrame, path: str, checkpoint: str, *, late: str = "10 minutes", writer: str = "activity") -> StreamingQuery:
    """Start counting a stream of requests into the log at ``path``, until its source is read."""
    log = TableLog(requests.sparkSession, path)

    def each(rows: DataFrame, batch_id: int) -> None:
        count_batch(log, rows, batch_id, late=late, writer=writer)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_totals(log: TableLog, salt: str) -> DataFrame:
    """What ``activity_summary`` gives, from the log's totals; late rows are not in it."""
    held = log.read()
    names = ("requests", "forwarded", "completed", "failed")
    totals = held["totals"].groupBy("session").agg(*[F.sum(c).alias(c) for c in names], F.max("last_request_at").alias("last_request_at"))
    counts = held["occurrences"].groupBy("session", "entity_type").agg(F.sum("n").alias("n"))
    return _with_counts(totals, counts, salt)


def _with_counts(totals: DataFrame, counts: DataFrame, salt: str) -> DataFrame:
    counts = counts.groupBy("session").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("placeholder_occurrences")
    )
    return totals.join(counts, "session", "left").select(
        session_ref(F.col("session"), salt).alias("session_ref"),
        "requests", "forwarded", "completed", "failed", "last_request_at",
        F.coalesce("placeholder_occurrences", F.expr("cast(map() as map<string,bigint>)")).alias("placeholder_occurrences"),
    )


def verify_probes(probes: DataFrame, requests: DataFrame) -> DataFrame:
    """One row a probe: verified, incomplete, expired or pending.

    ``probes``: token, created. ``requests``: token, ts, masked, forwarded,
    restored, completed. A probe is used once, by its first request within
    600 seconds; a second request with its token does not count.
    """
    once = requests.groupBy("token").agg(
        F.min_by(F.struct("ts", "masked", "forwarded", "restored", "completed"), "ts").alias("r")
    ).select("token", "r.*")
    return probes.join(once, "token", "left").select("token", "created", _state().alias("state"))


def verify_probes_stream(probes: DataFrame, requests: DataFrame, late: str = "1 minute", keep: str = "1 hour") -> DataFrame:
    """The same as a stream, in append mode: an outer join of probes and their requests by interval.

    A probe whose request comes is settled at once, as expired if that is after
    600 seconds. One that stays without a request for ``keep`` comes out as pending when the
    watermark has passed; those younger than that are given by ``open_probes``.
    """
    p = probes.withWatermark("created", late)
    r = requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["token"]).withColumnRenamed("token", "r_token")
    on = (F.col("token") == F.col("r_token")) & (F.col("ts") >= F.col("created") - F.expr(f"INTERVAL {keep}")) & (
        F.col("ts") <= F.col("created") + F.expr(f"INTERVAL {keep}")
    )
    return p.join(r, on, "left_outer").select("token", "created", _state().alias("state"))


def _state() -> Column:
    within = (F.col("ts") >= F.col("created")) & (
        F.col("ts") <= F.col("created") + F.make_dt_interval(secs=F.lit(float(X.PROBE_TTL_SECONDS)))
    )
    good = F.col("masked") & F.col("forwarded") & F.col("restored") & F.col("completed")
    return F.when(F.col("ts").isNull(), "pending").when(~within, "expired").when(good, "verified").otherwise("incomplete")


def open_probes(probes: DataFrame, settled: DataFrame) -> DataFrame:
    """Probes that a stream has not settled yet."""
    return probes.join(settled.select("token"), "token", "left_anti").select("token", "created", F.lit("pending").alias("state"))


def support_totals(summary: DataFrame) -> DataFrame:
    """Allow-listed totals over all sessions; counts that are negative or missing are ignored."""
    names = ("requests", "forwarded", "completed", "failed")
    return summary.agg(
        F.count(F.lit(1)).alias("sessions"),
        *[F.coalesce(F.sum(F.when(F.col(c) >= 0, F.col(c))), F.lit(0)).alias(c) for c in names],
    )
