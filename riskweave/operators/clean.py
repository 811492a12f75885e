"""Row-level cleaning and table-shape operators (PRJ2, PRJ7-PRJ12, SET1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.session import cut_lineage

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


_INT_BOUND, _FLOAT_BOUND = (1 << 31) - 1, 3.4028234663852886e38  # fixed values: largest int and float


def narrow_types(df: DataFrame, key_marker: str = "SK_ID") -> DataFrame:
    """Type normalisation, rules evaluated in order per column:

    1. key columns (name contains ``key_marker``): NULL -> 0, then int
    2. strings stay strings (parquet dictionary-encodes them)
    3. numeric columns holding exactly the values {0, 1} (both present, no NULL) -> boolean
    4. double -> float
    5. long/int -> int

    A column is narrowed only if all its values fit: the values' bounds come from the same
    one-row aggregate as rule 3. Otherwise it stays long or double."""
    fields = [f for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    row = None
    if fields:
        checks = []
        for k, f in enumerate(fields):
            x = F.col(f"`{f.name}`")
            checks.append(((F.count_if(x.isNull() | ~x.isin(0, 1)) == 0)
                           & (F.count_if(x == 1) > 0) & (F.count_if(x == 0) > 0)).alias(f"b{k}"))
            wide = F.abs(x.cast("double"))
            checks.append((F.coalesce(F.max(F.when(~F.isnan(wide) & (wide < float("inf")), wide)), F.lit(0.0))).alias(f"m{k}"))
        row = df.agg(*checks).first()
    bounds = {f.name: (row[f"b{k}"], row[f"m{k}"]) for k, f in enumerate(fields)}
    out = []
    for f in df.schema.fields:
        x = F.col(f"`{f.name}`")
        binary, most = bounds.get(f.name, (False, 0.0))
        whole = isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
        if key_marker in f.name:
            x = F.coalesce(x, F.lit(0).cast(f.dataType))
            out.append((x.try_cast("int") if most <= _INT_BOUND else x.cast("long") if whole else x).alias(f.name))
        elif isinstance(f.dataType, T.StringType) or f.name not in bounds:
            out.append(x)
        elif binary:
            out.append((x == 1).alias(f.name))
        elif whole:
            out.append(x.cast("int").alias(f.name) if most <= _INT_BOUND else x)
        else:
            out.append(x.cast("float").alias(f.name) if most <= _FLOAT_BOUND else x)
    return df.select(*out)


def with_position(df: DataFrame, order_col: str, name: str = "POSITION",
                  num_partitions: int | None = None) -> DataFrame:
    """1-based position in ``order_col`` order, computed without a global window.

    Rows are range-partitioned and sorted once, the result is checkpointed (so the
    two passes below read the same partitions), per-partition counts (one row per
    partition) give offsets, and ``monotonically_increasing_id`` supplies the index
    inside each partition."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, order_col).sortWithinPartitions(order_col))
    tagged = ranged.withColumn("_mid", F.monotonically_increasing_id())
    pid = F.shiftright(F.col("_mid"), 33)
    counts = sorted((r["pid"], r["n"]) for r in tagged.groupBy(pid.alias("pid"))
                    .agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, acc = {}, 0
    for p, c in counts:
        offsets[p] = acc
        acc += c
    if not offsets:
        return tagged.drop("_mid").withColumn(name, F.lit(None).cast("long"))
    held = F.lit([offsets.get(p, 0) for p in range(max(offsets) + 1)])  # indexed by partition
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.withColumn(name, (F.get(held, pid.cast("int")) + local + 1).cast("long")).drop("_mid")


def label_split(df: DataFrame, label: str = "TARGET", key: str = "SK_ID_CURR"):
    """PRJ11-12: labelled part -> (features without key/label, int label); and the
    unlabelled part without the label column."""
    train = df.where(F.col(label).isNotNull())
    test = df.where(F.col(label).isNull()).drop(label)
    features = train.drop(key, label)
    return features, train.select(F.col(label).cast("int").alias(label)), train, test


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET1: stack two tables; columns missing on one side become NULL."""
    return a.unionByName(b, allowMissingColumns=True)
