"""Config-driven group-by aggregates (AGG1-AGG11).

A spec is ``{column: [agg, ...]}`` as in the reference's dictionaries; output names
are ``{prefix}{column}_{AGG}``. All aggregates of one table, including the subset
(Active/Closed, Approved/Refused) variants, are emitted by ONE ``groupBy``: Spark
runs partial aggregation map-side, so a hot key costs one row per map task. A wide aggregate over keys with a few rows
each goes through ``together`` first: the narrow rows are shuffled, not a wide buffer for about every row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot above both: HOT_ROWS rows, and HOT_SHARE of all rows. So at most 1 / HOT_SHARE keys are.
HOT_ROWS, HOT_SHARE = 1_000_000, 0.001
SPREAD = 1 << 16  # groups that the rows of a hot key are dealt to

AGG_NAMES = ("min", "max", "mean", "sum", "var", "size", "nunique")


def _agg_expr(fn: str, x: Column, flag: Column | None) -> Column:
    """One aggregate with pandas semantics (NULLs skipped).

    * sum of an all-NULL group is 0, not NULL
    * var is the sample variance (NULL for one row)
    * with a subset ``flag``: a group with no flagged row is NULL in every column"""
    v = x if flag is None else F.when(flag, x)
    if fn == "min":
        return F.min(v)
    if fn == "max":
        return F.max(v)
    if fn == "mean":
        return F.avg(v)
    if fn == "var":
        return F.var_samp(v)
    if fn == "nunique":
        return F.count_distinct(v)
    if fn == "sum":
        s = F.coalesce(F.sum(v), F.lit(0))
        return s if flag is None else F.when(F.count_if(flag) > 0, s)
    if fn == "size":
        return F.count(F.lit(1)) if flag is None else F.when(F.count_if(flag) > 0, F.count_if(flag))
    raise ValueError(f"unknown aggregate {fn!r}")


def agg_exprs(spec: dict[str, list[str]], prefix: str = "", flag: Column | None = None) -> list[Column]:
    """Aggregate columns for a ``{col: [aggs]}`` spec, named ``prefix+col_AGG``."""
    out = []
    for col, fns in spec.items():
        x = F.col(f"`{col}`")
        for fn in fns:
            out.append(_agg_expr(fn, x, flag).alias(f"{prefix}{col}_{fn.upper()}"))
    return out


def category_share_exprs(col: str, values, prefix: str = "", nan_column: bool = True) -> list[Column]:
    """AGG8 fused with one-hot: share of each category over ALL rows of the group
    (NULL rows count in the denominator). No dummy columns are materialised."""
    c = F.col(f"`{col}`")
    out = [F.avg(c.eqNullSafe(F.lit(v)).cast("double")).alias(f"{prefix}{col}_{v}_MEAN") for v in values]
    if nan_column:
        out.append(F.avg(c.isNull().cast("double")).alias(f"{prefix}{col}_nan_MEAN"))
    return out


def hot_keys(counts: DataFrame, key: str, n: str = "n", rows: int = HOT_ROWS, share: float = HOT_SHARE) -> list:
    """The hot keys of a (key, number of rows) table, at most 1 / ``share``."""
    total = counts.agg(F.sum(n).alias("t"))
    hot = counts.where(F.col(n) > rows).crossJoin(F.broadcast(total)).where(F.col(n) > F.lit(share) * F.col("t"))
    return sorted(r[key] for r in hot.select(key).collect())


def together(df: DataFrame, key: str, hot: list = (), row: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a key in one task, so that the aggregate by ``key`` after it needs no shuffle of its wide
    buffers. Rows of ``hot`` keys are spread by a hash of the ``row`` columns; the aggregate then adds up a buffer per
    key and, for these, per task."""
    if not hot:
        return df.repartition(key)
    spread = F.when(F.col(key).isin(list(hot)), F.pmod(F.xxhash64(*row), F.lit(SPREAD))).otherwise(F.lit(0))
    return df.repartition(F.col(key), spread)


@dataclass(frozen=True)
class Subset:
    """A named row subset aggregated beside the total (AGG6)."""

    prefix: str
    flag: Column


def grouped(df: DataFrame, key: str, spec: dict[str, list[str]], prefix: str = "",
            extra: list[Column] | None = None, subsets: list[Subset] | None = None,
            subset_spec: dict[str, list[str]] | None = None) -> DataFrame:
    """groupBy(key) with the total aggregates, optional extra columns and the subset
    aggregates in the same pass (one shuffle instead of three plus two joins)."""
    cols = agg_exprs(spec, prefix) + list(extra or [])
    for s in subsets or []:
        cols += agg_exprs(subset_spec if subset_spec is not None else spec, s.prefix, s.flag)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*cols)


def all_columns_spec(df: DataFrame, exclude, fns=("min", "max", "mean", "sum", "var")) -> dict[str, list[str]]:
    """AGG11: every remaining column x every aggregate."""
    return {c: list(fns) for c in df.columns if c not in set(exclude)}
