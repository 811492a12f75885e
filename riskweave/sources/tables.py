"""Scans and sinks (SRC1-SRC6).

Parquet is the default format: column pruning and filter pushdown reach the scan.
CSV reads always take a declared schema (schema inference is a full extra pass)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_RELATIONS: dict[tuple, DataFrame] = {}


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN in float and double columns becomes NULL, as in a frame where NaN means missing:
    aggregates skip it and the missing report counts it. A projection, so unused columns are still pruned."""
    reals = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in reals}) if reals else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one given table (SRC3), NaN as NULL. The relation (file listing,
    footer schema) is resolved once per application and path; DataFrames are immutable,
    so every plan can start from the same one. ``forget()`` after a folder is rewritten."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _RELATIONS:
        _RELATIONS[key] = nan_as_null(spark.read.parquet(table_path(sf_dir, name)))
    return _RELATIONS[key]


def forget() -> None:
    _RELATIONS.clear()


def head_rows(df: DataFrame, n: int | None) -> DataFrame:
    """Any ``n`` rows of a table; ``None`` means the whole table. ``head_of_files`` takes the first of each file."""
    return df if n is None else df.limit(n)


def in_file_order(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """The table with ``_file`` and ``_row``, a row's 0-based place in its file. Parquet files know it; in CSV
    files rows are counted in blocks of a file (a row a block is aggregated and joined back), so
    nothing is sorted."""
    if fmt == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = read_csv(spark, path, schema).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"))  # ascending within a block
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(F.col("_file").alias("_f"), F.col("_block").alias("_b")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    blocks = blocks.select("_f", "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = rows.join(blocks, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return placed.withColumn("_row", F.col("_id") + F.col("_shift")).drop("_block", "_id", "_f", "_b", "_shift")


def head_of_files(spark: SparkSession, path: str, n: int | None, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """SRC2: the first ``n`` rows of each file of a table (``None``: all), by a filter on the row's place."""
    rows = in_file_order(spark, path, fmt, schema)
    return (rows if n is None else rows.where(F.col("_row") < n)).drop("_file", "_row")


def with_file_position(spark: SparkSession, path: str, name: str = "POSITION", fmt: str = "parquet",
                       schema: T.StructType | str | None = None) -> DataFrame:
    """PRJ2 / JN5: the table with each row's 1-based position in its files, read in the order of their names.
    Offsets come from one count a file; rows are neither sorted nor moved."""
    rows = in_file_order(spark, path, fmt, schema)
    before = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sizes = rows.groupBy(F.col("_file").alias("_f")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_f", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = rows.join(sizes, F.col("_file") == F.col("_f"))
    return out.withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_f", "_before")


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> str:
    """Parquet sink (SRC4). The writer creates missing folders (SRC6)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV sink with a header row."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV scan with header (SRC1). Declared schema unless none is given."""
    r = spark.read.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    return r.csv(path)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """SRC1 with a declared schema: (rows that fit it, rejects). A line with too few or too many fields, or with a
    value that its type cannot take, is a reject (_file, _line), never a row of NULLs."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    broken = "_line"
    while broken in fields.names:
        broken = f"_{broken}"
    rows = (spark.read.option("header", header).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", broken).schema(T.StructType([*fields.fields, T.StructField(broken, T.StringType())])).csv(path))
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"))
    # reads all declared columns and holds always: Spark parses (and checks) only columns that are read
    seen = F.length(F.concat_ws("", *[F.col(f"`{f}`").cast("string") for f in fields.names])) >= 0
    good = rows.where(F.col(broken).isNull() & seen).select(*[F.col(f"`{f}`") for f in fields.names])
    return good, rows.where(F.col(broken).isNotNull() & seen).select("_file", F.col(broken).alias("_line"))
