"""The fused wide plan (shared per-order aggregate, fused client aggregates) equals
the one-source-at-a-time plan, column for column."""

from riskweave.functions.scalar import round_doubles
from riskweave.plans import features as fx

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is None, repr(v)) for v in t))


def test_fused_wide_equals_separate_sources(spark):
    fused = fx.wide_features(spark, SF, fused=True)
    separate = fx.wide_features(spark, SF, fused=False)
    assert fused.columns == separate.columns
    assert _rows(round_doubles(fused)) == _rows(round_doubles(separate))


def test_client_aggregates_shuffle_rows_not_buffers(spark):
    """Order and line rows come together by client before their wide aggregates; no exchange follows on the client."""
    import re

    for df in (fx.order_chains(spark, SF), fx.installments_payments(spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        found = re.findall(r"Exchange hashpartitioning\(SK_ID_CURR#\d+L?, \d+\), (\w+)", plan)
        assert found == ["REPARTITION_BY_COL"], plan


def test_rows_of_hot_keys_are_spread(spark):
    from pyspark.sql import functions as F

    from riskweave.operators.aggregate import hot_keys, together
    df = spark.range(9000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 700 + 1).alias("k"), "id", (F.col("id") * 0.5).alias("v"))
    counts = df.groupBy("k").agg(F.count("*").alias("n"))
    assert hot_keys(counts, "k", rows=1000, share=0.1) == [0]
    assert hot_keys(counts, "k", rows=1000, share=0.5) == [] and hot_keys(counts, "k") == []
    assert hot_keys(counts.where("n < 0"), "k", rows=0) == []
    tasks = together(df, "k", [0], ("id",)).withColumn("p", F.spark_partition_id()).groupBy("k").agg(F.count_distinct("p").alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = {r["k"]: r["t"] for r in tasks.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spread.pop(0) > 1 and set(spread.values()) == {1}
    want = {tuple(r) for r in df.groupBy("k").agg(F.count("*"), F.sum("v"), F.max("v")).collect()}
    for hot in ([], [0]):
        got = together(df, "k", hot, ("id",)).groupBy("k").agg(F.count("*"), F.sum("v"), F.max("v"))
        assert {tuple(r) for r in got.collect()} == want
