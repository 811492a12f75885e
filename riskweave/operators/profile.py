"""Table profiling and the missing-rate cut (AGG12-AGG14, SEL1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_report(df: DataFrame, exclude=()) -> DataFrame:
    """Long table (feature, n_missing, pct_missing): ONE aggregate over the table,
    then an unpivot of its single row."""
    cols = [c for c in df.columns if c not in set(exclude)]
    counts = df.agg(F.count(F.lit(1)).alias("__n"),
                    *[(F.count(F.lit(1)) - F.count(F.col(f"`{c}`"))).alias(c) for c in cols])
    long = counts.unpivot(["__n"], cols, "feature", "n_missing")
    return long.select("feature", "n_missing",
                       (F.lit(100.0) * F.col("n_missing") / F.col("__n")).alias("pct_missing"))


def missing_cut(df: DataFrame, threshold: float = 90.0, protect=()) -> tuple[DataFrame, list[str]]:
    """Drop columns whose missing percentage is strictly above ``threshold``.
    Only the column names (metadata) reach the driver."""
    rep = missing_report(df, exclude=protect)
    drop = [r["feature"] for r in rep.where(F.col("pct_missing") > threshold).select("feature").collect()]
    return df.drop(*drop), drop


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Row and column counts per table, as one job (a union of one-row aggregates)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def label_distribution(df: DataFrame, label: str = "TARGET") -> DataFrame:
    """Value counts of the label over labelled rows."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
