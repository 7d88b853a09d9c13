"""Work is spread whatever the files look like, and nothing is broadcast by a guess."""

from pyspark.sql import functions as F

from maskwright.operators import known
from maskwright.plans import catalog, runtime


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_a_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    rows = [(i, 0, "user", f"text {i} of a turn") for i in range(6)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns.repartition(2).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(tuple(r) for r in catalog.stream_settled(spark, str(tmp_path)).collect())
    want = turns.select(F.concat_ws("-", "conv_id", "turn"), F.md5(F.concat(F.lit("[PERSON_1] "), "text")))
    assert got == sorted(tuple(r) for r in want.collect())


def test_customers_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    rows = spark.range(100).select(
        F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"), F.lit("BUILDING").alias("c_mktsegment"),
        F.lit(1).alias("c_nationkey"), F.lit(0.0).alias("c_acctbal"),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    cores = spark.sparkContext.defaultParallelism
    for df in (catalog.customers(spark, str(tmp_path)), catalog._json_rows(spark, str(tmp_path))):
        assert df.rdd.getNumPartitions() == 4 * cores
        assert df.count() == 100


def test_ranges_arrive_in_batches_of_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_ROWS", 20)
    rows = spark.range(200).withColumn("half", F.col("id") % 2)
    seen = []
    stream = catalog._arriving(spark, rows, "half", 2, str(tmp_path / "in"))
    keep = lambda batch, _: seen.append((batch.count(), {r.half for r in batch.select("half").distinct().collect()}))
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [(100, {0}), (100, {1})]
    assert len(list((tmp_path / "in/000").glob("part-*.parquet"))) > 1


def test_tables_that_only_look_small_are_not_broadcast(spark):
    left, right = spark.range(10).withColumn("n", F.lit(1)), spark.range(10).withColumn("x", F.lit(2))
    assert "Broadcast" not in plan(runtime.lookup_join(left, right, ["id"]), "sparkPlan")
    text = spark.createDataFrame([("s", 0, 0, "ref ABabcdefghij")], "session string, seq int, section int, text string")
    entity = spark.createDataFrame(
        [("s", 0, 0, 4, 8, "ABab", "NAME", "merged", [("AB", "NAME")])],
        "session string, seq int, section int, start int, end int, value string, entity_type string, source string, "
        "members array<struct<value:string,entity_type:string>>",
    )
    vault = spark.createDataFrame([("s", "abcdefghij", "TOKEN", "[TOKEN_1]")], "session string, value string, entity_type string, placeholder string")
    out = known.cut_leaks(entity, text, vault)
    assert out.collect() == [("s", 0, 0, "abcdefghij", "TOKEN", "[TOKEN_1]")]
    # Only the sessions and the values, both counted, are.
    assert plan(out, "sparkPlan").count("BroadcastHashJoin") <= 3


def test_keys_of_values_are_worked_out_once(spark):
    from pyspark.sql import types as T

    from maskwright.operators.normalize import assign_normalized

    calls = spark.sparkContext.accumulator(0)

    @F.udf(T.StringType())
    def lower(value):
        calls.add(1)
        return value and value.lower()

    rows = [("s", k, 0, k, k + 3, f"{'AB'[k % 2]}{'xX'[k // 2 % 2]}{k // 4}", "WORD", "regex", None) for k in range(40)]
    entities = spark.createDataFrame(
        rows, "session string, seq long, section int, start int, end int, value string, entity_type string, source string, members array<string>"
    )
    new, aliases = assign_normalized(entities, normalizers={"WORD": lower})
    assert new.count() == 20 and aliases.count() == 20
    assert calls.value == 40


def test_running_sums_of_few_and_many(spark):
    from maskwright.functions.spans import FEW, running

    sizes = [None, 0, 1, 2, FEW, FEW + 1, 100]
    lists = [None if n is None else [(k * 7) % 5 for k in range(n)] for n in sizes]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>")
    got = {r.i: r.sums for r in df.select("i", running(F.col("x")).alias("sums")).collect()}
    assert got == {i: [sum(x[:k]) for k in range(len(x))] if x else [] for i, x in enumerate(lists)}


def test_pieces_are_not_made_again_for_each_of_them(spark, tmp_path, monkeypatch):
    from maskwright.streaming import mask

    turns = spark.createDataFrame([(1, 0, "user", "text of a turn")], "conv_id bigint, turn bigint, role string, text string")
    made = []
    monkeypatch.setattr(mask, "settle_stream", lambda pieces: made.append(pieces) or pieces.withColumnRenamed("piece", "text"))
    monkeypatch.setattr(catalog, "_stream", lambda spark, sf, name, shape, label: shape(turns))
    catalog.stream_settled(spark, str(tmp_path))
    assert plan(made[0]).count("sequence(") == 1
    assert [tuple(r) for r in made[0].collect()] == [("1-0", 0, "[PERSON", False), ("1-0", 1, "_1] tex", False), ("1-0", 2, "t of a ", False), ("1-0", 3, "turn", True)]


def test_blocks_of_queries_are_not_broadcast(spark, tmp_path):
    from maskwright.llm import topk

    # Written first: the optimizer guesses from a file's bytes, which say little of blocks dealt to every hand.
    rows = spark.range(200).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 7, F.col("id") % 5, F.lit(1)).cast("array<float>").alias("embedding"))
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = topk.nearest(spark.read.parquet(str(tmp_path / "embeddings.parquet")), F.col("vec_id") % 50 == 0)
    assert "Broadcast" not in plan(found, "sparkPlan")
    assert found.count() == 20
