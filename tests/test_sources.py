"""Rows in the order of their files, the first rows of each file, rejects of a checked CSV scan, cut values by selection."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from riskweave.operators.split import label_cuts, rank_in_label, stratified_split
from riskweave.sources import tables as S


def folder():
    return tempfile.mkdtemp(prefix="rw-src-")


def file_rows(path, suffix):
    """The keys of every file, in the order of the names."""
    import pyarrow.parquet as pq
    out = []
    for f in sorted(os.listdir(path)):
        if f.endswith(suffix):
            if suffix == ".parquet":
                out.append(pq.read_table(os.path.join(path, f))["k"].to_pylist())
            else:
                out.append([int(x.split(",")[0]) for x in open(os.path.join(path, f)).read().splitlines()[1:]])
    return out


def written(spark, fmt, n=500, files=4):
    keys = list(range(n))
    random.Random(1).shuffle(keys)
    path = os.path.join(folder(), "t")
    df = spark.createDataFrame([(k, f"name {k}") for k in keys], "k long, s string").repartition(files)
    (df.write.parquet(path) if fmt == "parquet" else df.write.option("header", True).csv(path))
    return path, file_rows(path, f".{fmt}")


def test_positions_follow_the_files(spark):
    for fmt in ("parquet", "csv"):
        path, files = written(spark, fmt)
        want = {k: i + 1 for i, k in enumerate(k for f in files for k in f)}
        got = S.with_file_position(spark, path, fmt=fmt, schema="k long, s string")
        assert got.columns == ["k", "s", "POSITION"]
        assert {r["k"]: r["POSITION"] for r in got.collect()} == want
        assert {r["k"]: r["POSITION"] for r in got.select("k", "POSITION").collect()} == want


def test_blocks_of_a_file_follow_each_other(spark):
    path, files = written(spark, "csv", 5000, 2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = S.with_file_position(spark, path, fmt="csv", schema="k long, s string")
        assert got.rdd.getNumPartitions() > 4
        assert {r["k"]: r["POSITION"] for r in got.collect()} == {k: i + 1 for i, k in enumerate(k for f in files for k in f)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_exactly_the_first_rows_of_each_file(spark):
    for fmt in ("parquet", "csv"):
        path, files = written(spark, fmt)
        for n in (0, 3, 10_000, None):
            got = S.head_of_files(spark, path, n, fmt, "k long, s string")
            assert sorted(r["k"] for r in got.collect()) == sorted(k for f in files for k in f[:n])


def test_broken_lines_are_rejects(spark):
    path = folder()
    lines = ["1,a,2.5", "2,b", "3,c,1,9", "x,d,1.0", "5,,", "6,f,7.0", "7,\"q,r\",1.0", "8,g,abc"]
    with open(os.path.join(path, "p.csv"), "w") as f:
        f.write("k,s,v\n" + "\n".join(lines) + "\n")
    good, bad = S.read_csv_checked(spark, path, "k long, s string, v double")
    assert sorted((r["k"], r["s"], r["v"]) for r in good.collect()) == [(1, "a", 2.5), (5, None, None), (6, "f", 7.0), (7, "q,r", 1.0)]
    assert sorted(r["_line"] for r in bad.collect()) == sorted(["2,b", "3,c,1,9", "x,d,1.0", "8,g,abc"])
    assert good.select("k").count() == 4 and bad.count() == 4


def test_selection_equals_ranks_and_moves_no_row(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([0, 0, 0, 1, None])) for k in range(700)] + [(1000, 7)]
    df = spark.createDataFrame(rows, "k long, y int").withColumn("wide", F.lit("x"))
    got = stratified_split(df, "k", "y", (0.6, 0.2, 0.2), seed=42)
    ranked = rank_in_label(df, "k", "y", 42).withColumn("want", F.when(F.col("rank") <= F.floor(F.col("n_label") * 0.6), "train")
                                                       .when(F.col("rank") <= F.floor(F.col("n_label") * F.lit(0.6 + 0.2)), "val").otherwise("test"))
    want = {r["k"]: r["want"] for r in ranked.collect()}
    assert {r["k"]: r["split"] for r in got.collect()} == want and got.columns == ["k", "y", "wide", "split"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    assert label_cuts(df, "k", "y", [0.5]).count() == 4
    assert stratified_split(df.limit(0), "k", "y").collect() == []


def test_keys_with_one_hash_are_cut_by_key(spark, monkeypatch):
    from riskweave.operators import split
    monkeypatch.setattr(split, "hash_unit", lambda key, seed: (F.pmod(F.col(key), F.lit(3)) / 4.0))
    df = spark.createDataFrame([(k, 1) for k in range(100)], "k long, y int")
    got = {r["k"]: r["split"] for r in stratified_split(df, "k", "y", (0.5, 0.25, 0.25)).collect()}
    order = sorted(range(100), key=lambda k: (k % 3, k))
    assert [got[k] for k in order] == ["train"] * 50 + ["val"] * 25 + ["test"] * 25
