"""What the optimizer leaves of a plan."""

from pyspark.sql import functions as F

from maskwright.functions.spans import fence
from maskwright.plans.masking import mask_rows


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fenced_expression_stands_once(spark):
    made = spark.range(10).withColumn("words", fence(F.split(F.concat_ws(" ", "id", "id"), "fenced-mark")))
    used = made.withColumn("n", F.size("words")).where("n > 0").select("id", F.explode("words").alias("w"), "n").where("w <> ''")
    plan = optimized(used)
    assert plan.count("fenced-mark") == 1, plan
    assert "SPARK_PARTITION_ID" in plan.upper()
    copied = spark.range(10).withColumn("words", F.split(F.concat_ws(" ", "id", "id"), "fenced-mark"))
    copied = copied.withColumn("n", F.size("words")).where("n > 0").select("id", F.explode("words").alias("w"), "n").where("w <> ''")
    assert optimized(copied).count("fenced-mark") > 1  # else this test proves nothing


def test_masking_is_one_narrow_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = optimized(mask_rows(docs).where("size(warnings) = 0").select("doc_id", "masked"))
    assert "SPARK_PARTITION_ID" in plan.upper()
    physical = mask_rows(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in physical and "Python" not in physical


