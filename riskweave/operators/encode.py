"""Categorical encoders (ENC1-ENC4).

Categories are fitted once with a distributed ``distinct`` whose result is bounded
(``max_levels`` per column, checked before anything reaches the driver). The fitted
spec is frozen, so the output schema is stable across runs, and is applied as plain
column expressions: no join, no broadcast.

Columns of any width take the sparse form: ``SparseOneHot`` numbers the (column, value) pairs in a table that
never passes the driver, and gives each row the list of its codes, or a sparse vector for a learner."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators.clean import with_position


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def fit_categories(df: DataFrame, cols: list[str], max_levels: int = 1000) -> dict[str, list[str]]:
    """Distinct non-null values per column, sorted (one job over ``df``).

    The (column, value) pairs are de-duplicated by a shuffle; at most
    ``len(cols) * max_levels + 1`` rows are collected, so a high-cardinality
    column raises instead of flooding the driver."""
    if not cols:
        return {}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols
    ])).alias("p")).select("p.c", "p.v").where(F.col("v").isNotNull()).distinct()
    cap = len(cols) * max_levels + 1
    rows = pairs.limit(cap).collect()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[r["c"]].append(r["v"])
    for c, vals in out.items():
        if len(vals) > max_levels or len(rows) >= cap:
            raise ValueError(f"column {c!r} has more than {max_levels} categories; "
                             "not a one-hot candidate")
        vals.sort()
    return out


@dataclass(frozen=True)
class OneHotSpec:
    """Fitted one-hot encoding. ``nan_column`` adds ``<col>_nan`` (always present)."""

    categories: dict[str, tuple[str, ...]]
    nan_column: bool = True
    dtype: str = "double"

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str] | None = None, nan_column: bool = True,
            max_levels: int = 1000) -> "OneHotSpec":
        cols = string_columns(df) if cols is None else list(cols)
        cats = fit_categories(df, cols, max_levels)
        return cls({c: tuple(v) for c, v in cats.items()}, nan_column)

    def indicator(self, col: str, value: str | None) -> Column:
        c = F.col(f"`{col}`")
        cond = c.isNull() if value is None else c.eqNullSafe(F.lit(value))
        return cond.cast(self.dtype)

    def items(self) -> list[tuple[str, str, str | None]]:
        """(output name, source column, value or None for the NULL indicator)."""
        out = []
        for c, vals in self.categories.items():
            out += [(f"{c}_{v}", c, v) for v in vals]
            if self.nan_column:
                out.append((f"{c}_nan", c, None))
        return out

    @property
    def new_columns(self) -> list[str]:
        """ENC4: names of the generated columns."""
        return [n for n, _, _ in self.items()]

    def transform(self, df: DataFrame, keep_source: bool = False) -> DataFrame:
        keep = [F.col(f"`{c}`") for c in df.columns if keep_source or c not in self.categories]
        return df.select(*keep, *[self.indicator(c, v).alias(n) for n, c, v in self.items()])


@dataclass(frozen=True)
class FactorizeSpec:
    """Ordinal codes in order of first appearance (by an explicit order key); NULL -> -1.
    A column of at most ``max_levels`` values is coded by a literal map; a wider one by a
    left join with its code table, which never passes the driver."""

    codes: dict[str, dict[str, int]] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str], order_col: str, max_levels: int = 1000) -> "FactorizeSpec":
        codes, tables = {}, {}
        for c in cols:
            firsts = (df.where(F.col(c).isNotNull())
                      .groupBy(F.col(c).cast("string").alias("v"))
                      .agg(F.min(order_col).alias("first_seen")))
            # at most max_levels + 1 (value, first position) rows reach the driver
            rows = firsts.limit(max_levels + 1).collect()
            if len(rows) > max_levels:
                placed = with_position(firsts.withColumn("_o", F.struct("first_seen", "v")), "_o", "_code")
                tables[c] = placed.select("v", (F.col("_code") - 1).cast("int").alias("_code"))
                continue
            ordered = sorted(rows, key=lambda r: (r["first_seen"], r["v"]))
            codes[c] = {r["v"]: k for k, r in enumerate(ordered)}
        return cls(codes, tables)

    def expr(self, col: str) -> Column:
        m = self.codes[col]
        if not m:
            return F.lit(-1).cast("int")
        lit_map = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])
        return F.coalesce(lit_map[F.col(col).cast("string")], F.lit(-1)).cast("int")

    def transform(self, df: DataFrame) -> DataFrame:
        columns = df.columns
        for k, (c, table) in enumerate(self.tables.items()):
            own = table.select(F.col("v").alias(f"_v{k}"), F.col("_code").alias(f"_c{k}"))
            df = df.join(own, F.col(f"`{c}`").cast("string") == F.col(f"_v{k}"), "left")
        wide = {c: F.coalesce(F.col(f"_c{k}"), F.lit(-1)) for k, c in enumerate(self.tables)}
        return df.select(*[self.expr(c).alias(c) if c in self.codes else wide.get(c, F.col(f"`{c}`")).alias(c)
                           for c in columns])


@dataclass(frozen=True)
class SparseOneHot:
    """One-hot encoding with any number of levels. ``table``: (column, value, code), codes from 0 by column (in the
    given order), then value, a column's NULL indicator after its values; ``size`` codes in all."""

    columns: tuple[str, ...]
    table: DataFrame
    size: int

    @staticmethod
    def _pairs(df: DataFrame, cols: list[str], key: str | None = None) -> DataFrame:
        """([_key,] _place, _value): a row per row and column."""
        own = [] if key is None else [F.col(f"`{key}`").alias("_key")]
        cells = F.array(*[F.struct(F.lit(i).alias("_place"), F.col(f"`{c}`").cast("string").alias("_value")) for i, c in enumerate(cols)])
        return df.select(*own, F.explode(cells).alias("_p")).select(*(["_key"] if own else []), "_p._place", "_p._value")

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str], nan_column: bool = True) -> "SparseOneHot":
        """Values are de-duplicated map-side first, so a value that holds most rows is one row a task."""
        cols = list(cols)
        levels = cls._pairs(df, cols).where(F.col("_value").isNotNull()).distinct()
        if nan_column:  # always present, as in the dense form
            levels = levels.unionByName(df.sparkSession.createDataFrame([(i, None) for i in range(len(cols))], "_place int, _value string"))
        order = F.struct("_place", F.col("_value").isNull().alias("_last"), "_value")
        placed = with_position(levels.withColumn("_order", order), "_order", "_code")
        names = F.array(*[F.lit(c) for c in cols])
        table = placed.select(names[F.col("_place")].alias("column"), F.col("_value").alias("value"),
                              (F.col("_code") - 1).cast("int").alias("code"), F.col("_place").alias("_place"))
        return cls(tuple(cols), table, table.count())

    def names(self) -> DataFrame:
        """ENC4: (code, name) of the generated columns."""
        return self.table.select("code", F.concat_ws("_", "column", F.coalesce("value", F.lit("nan"))).alias("name"))

    def transform(self, df: DataFrame, key: str, out: str = "codes") -> DataFrame:
        """(key, codes): the ascending codes of each row of ``df``, whose ``key`` is unique; at most one a column. A value
        not seen in the fit, and NULL without an indicator, have none. The code table is joined by value: a
        value that holds most rows is split by AQE."""
        pairs = self._pairs(df, list(self.columns), key)
        own = self.table.select(F.col("_place").alias("_at"), F.col("value").alias("_level"), "code")
        found = pairs.join(own, (F.col("_place") == F.col("_at")) & F.col("_value").eqNullSafe(F.col("_level")), "left")
        return found.groupBy(F.col("_key").alias(key)).agg(F.sort_array(F.collect_list("code")).alias(out))

    def vectors(self, coded: DataFrame, codes: str = "codes", out: str = "features") -> DataFrame:
        """``coded`` with a sparse vector of ``size`` places for Spark ML."""
        from pyspark.ml.linalg import SparseVector, VectorUDT
        size = self.size
        made = F.udf(lambda c: SparseVector(size, c, [1.0] * len(c)), VectorUDT())
        return coded.withColumn(out, made(codes))


def category_shares(df: DataFrame, group: str, col: str) -> DataFrame:
    """AGG8 for any number of categories, long: (group, value, n, share), the share of a group's rows (those
    with NULL count below the line) that hold the value. (group, value) pairs are counted map-side
    first; groups and values may be hot. NULL groups are dropped, as in the wide form."""
    rows = df.where(F.col(group).isNotNull())
    per = rows.groupBy(F.col(group), F.col(f"`{col}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    whole = per.groupBy(F.col(group).alias("_of")).agg(F.sum("n").alias("_whole"))  # pairs, not rows
    return per.where(F.col("value").isNotNull()).join(whole, F.col(group) == F.col("_of")).select(
        group, "value", "n", (F.col("n") / F.col("_whole")).alias("share"))
