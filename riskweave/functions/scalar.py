"""Column-expression helpers. Everything here is a built-in Spark expression:
no Python runs per row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The character rule for model-safe column names.
BAD_NAME_CHARS = r"[^A-Za-z0-9_]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_safe_ne(col, value) -> Column:
    """``col != value`` that keeps NULL rows (pandas semantics of ``!=``)."""
    return ~_c(col).eqNullSafe(F.lit(value))


def sentinel_to_null(col, sentinel) -> Column:
    """Replace an 'unknown' marker value by NULL."""
    return F.nullif(_c(col), F.lit(sentinel))


def ratio(num, den, ieee: bool = False) -> Column:
    """Ratio feature. Default policy: a zero denominator gives NULL.

    ``ieee=True`` reproduces floating-point division (±inf / NaN) instead."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    return _ieee_div(n, d) if ieee else F.try_divide(n, d)


def _ieee_div(n: Column, d: Column) -> Column:
    return (F.when(d != 0, n / F.when(d != 0, d))
            .when(n > 0, F.lit(float("inf")))
            .when(n < 0, F.lit(float("-inf")))
            .when(n == 0, F.lit(float("nan"))))


def positive_part(col) -> Column:
    """``x if x > 0 else 0`` — NULL becomes 0 (the comparison is false)."""
    x = _c(col)
    return F.when(x > 0, x).otherwise(F.lit(0))


def days_between(ts, ref_date: str) -> Column:
    """Signed day count from ``ref_date`` to ``ts`` (negative = before)."""
    return F.datediff(F.to_date(_c(ts)), F.to_date(F.lit(ref_date)))


def hash_unit(key, seed: int = 42) -> Column:
    """Deterministic pseudo-uniform number in [0, 1) from a key and a seed.

    ``md5(key || ':' || seed)`` -> first 8 hex digits -> integer / 2^32. The same
    expression exists in DuckDB, so samples are checkable by SQL."""
    s = F.concat(_c(key).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


# Fixed value: offset of the rounding grid (see round_fixed).
GRID_OFFSET = 0.3767


def round_fixed(col, digits: int = 6) -> Column:
    """``round(x * 10^d - c) / 10^d`` — same bits as the identical SQL expression.

    Results are compared across engines whose float sums differ in the last bit.
    Amounts here are short decimals, so their means often sit exactly on a
    half-way point of the plain decimal grid, where a one-ulp difference flips the
    rounding. Shifting the grid by ``c`` moves the cut points off short decimals."""
    scale = float(10 ** digits)
    return F.round(_c(col) * F.lit(scale) - F.lit(GRID_OFFSET)) / F.lit(scale)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column (presentation step of registered queries)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round_fixed(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def sanitize_name(name: str) -> str:
    return re.sub(BAD_NAME_CHARS, "_", str(name))


def find_bad_names(names) -> list[str]:
    """Names that still contain characters outside ``[A-Za-z0-9_]``."""
    return [n for n in names if re.search(BAD_NAME_CHARS, str(n))]


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Rename columns to ``[A-Za-z0-9_]``; raises on a collision."""
    new = [sanitize_name(c) for c in df.columns]
    if len(set(new)) != len(new):
        dup = sorted({n for n in new if new.count(n) > 1})
        raise ValueError(f"column names collide after sanitising: {dup}")
    return df.toDF(*new)
