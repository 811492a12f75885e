"""One-hot and shares of columns with any number of levels."""

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from riskweave.operators.encode import OneHotSpec, SparseOneHot, category_shares


def test_sparse_codes_equal_the_dense_columns(spark):
    rows = [(1, "a", "x"), (2, "b", None), (3, None, "y"), (4, "a", "y"), (5, "é", "x_1")]
    df = spark.createDataFrame(rows, "k long, s string, t string")
    for nan in (True, False):
        dense, sparse = OneHotSpec.fit(df, ["s", "t"], nan_column=nan), SparseOneHot.fit(df, ["s", "t"], nan_column=nan)
        names = [r["name"] for r in sparse.names().orderBy("code").collect()]
        assert names == dense.new_columns and sparse.size == len(names)
        want = {r["k"]: [i for i, n in enumerate(names) if r[n] == 1.0] for r in dense.transform(df).collect()}
        assert {r["k"]: r["codes"] for r in sparse.transform(df, "k").collect()} == want
    new = spark.createDataFrame([(9, "unseen", None)], "k long, s string, t string")
    assert [r["codes"] for r in SparseOneHot.fit(df, ["s", "t"]).transform(new, "k").collect()] == [[7]]


def test_fifty_thousand_levels(spark):
    df = spark.range(60_000).select(F.col("id").alias("k"), F.when(F.col("id") < 20_000, "hot").otherwise(
        F.concat(F.lit("v"), (F.col("id") % 50_000).cast("string"))).alias("s"))
    spec = SparseOneHot.fit(df, ["s"])
    levels = df.select("s").distinct().count()
    assert spec.size == levels + 1 > 40_000
    coded = spec.transform(df, "k")
    assert coded.where(F.size("codes") == 1).count() == 60_000
    top = coded.groupBy(F.col("codes")[0].alias("c")).count().orderBy(F.desc("count")).first()
    assert top["count"] == 20_000
    assert spec.vectors(coded.limit(1)).first()["features"].size == spec.size


def test_vectors_feed_a_learner(spark):
    df = spark.createDataFrame([(i, "good" if i % 2 else f"bad{i % 3}", float(i % 2)) for i in range(60)], "k long, s string, y double")
    spec = SparseOneHot.fit(df, ["s"])
    x = spec.vectors(spec.transform(df, "k")).join(df, "k")
    model = LogisticRegression(labelCol="y").fit(x)
    assert model.transform(x).where("prediction <> y").count() == 0


def test_shares_count_missing_values_below_the_line(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, None), (None, "a"), (1, "b")], "g long, s string")
    got = {(r["g"], r["value"]): (r["n"], r["share"]) for r in category_shares(df, "g", "s").collect()}
    assert got == {(1, "a"): (2, 0.5), (1, "b"): (1, 0.25)}
    assert category_shares(df.limit(0), "g", "s").collect() == []
