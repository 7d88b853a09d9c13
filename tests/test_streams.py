"""Micro-batches against one batch over all rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from maskwright.plans.masking import mask_sessions
from maskwright.sources.store import Conflict, TableLog
from maskwright.streaming.mask import expire, mask_batch, mask_stream

ROWS = [
    (f"s{i % 3}", i, 0, f"mail u{(i * 7) % 5}@a.io or v{i}@b.org, phone 212-555-01{(i % 4) + 10}; u{i % 2}@a.io") for i in range(18)
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "session string, seq bigint, section int, text string")


@pytest.fixture(scope="module")
def whole(rows):
    out = mask_sessions(rows)
    return masked_of(out.masked), vault_of(out.vault)


def masked_of(table):
    return sorted(tuple(r) for r in table.select("session", "seq", "masked").collect())


def vault_of(table):
    return sorted(tuple(r) for r in table.select("session", "placeholder", "value", "entity_type", "number").collect())


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_any_split_gives_what_one_batch_gives(spark, rows, whole, tmp_path, parts):
    log = TableLog(spark, str(tmp_path / "log"))
    for k in range(parts):
        batch = rows.where(F.floor(F.col("seq") * parts / len(ROWS)) == k)
        assert mask_batch(log, batch, k) == k
    assert mask_batch(log, rows.where("seq = 0"), parts - 1) is None  # the last batch once more
    held = log.read()
    assert (masked_of(held["masked"]), vault_of(held["values"])) == whole
    assert "text" not in held["masked"].columns


def test_a_batch_starts_over_when_another_writer_was_first(spark, rows, whole, tmp_path, monkeypatch):
    log, other = TableLog(spark, str(tmp_path / "log")), TableLog(spark, str(tmp_path / "log"))
    first, append = rows.where("seq < 9"), log.append

    def late(*args, **how):
        monkeypatch.setattr(log, "append", append)
        mask_batch(other, first, 0, writer="other")
        with pytest.raises(Conflict):
            append(*args, **how)
        raise Conflict

    monkeypatch.setattr(log, "append", late)
    assert mask_batch(log, rows.where("seq >= 9"), 0) == 1
    held = log.read()
    assert (masked_of(held["masked"]), vault_of(held["values"])) == whole


def test_unused_sessions_expire(spark, rows, tmp_path):
    log = TableLog(spark, str(tmp_path / "log"))
    mask_batch(log, rows.where("session <> 's1'"), 0)
    assert expire(log, 1) is None
    later = datetime.datetime.now() + datetime.timedelta(days=2)
    with_s1 = log.append({"uses": spark.createDataFrame([("s0", later)], log.read()["uses"].schema)})
    assert expire(log, 1, now=later) == with_s1 + 1
    assert {r.session for r in log.read()["values"].collect()} == {"s0"}
    mask_batch(log, rows.where("session = 's2'"), 1)
    again = log.read(session="s2")["values"]
    assert again.agg(F.min("number")).first()[0] == 1  # numbers begin anew


def test_stream_from_files(spark, rows, whole, tmp_path):
    for k in range(3):
        rows.where(F.floor(F.col("seq") / 6) == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    mask_stream(stream, str(tmp_path / "log"), str(tmp_path / "checkpoint"), ttl_days=30).awaitTermination()
    held = TableLog(spark, str(tmp_path / "log")).read()
    assert (masked_of(held["masked"]), vault_of(held["values"])) == whole
    with pytest.raises(ValueError, match="retention"):
        mask_stream(stream, "", "", ttl_days=0)
