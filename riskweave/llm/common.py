"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import scratch_path, ship_package

# Fixed value: bytes of one Arrow batch sent to a Python worker; long texts make small batches.
ARROW_BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Whole-table scan of one given table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this package on the workers and byte-bounded Arrow batches, so
    that a worker's memory follows bytes and not the length of the texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    return spark


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written`` and the folder of the table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: cuts the lineage, survives the
    loss of executors and is computed once however often it is read."""
    return written_at(df, name)[0]


def discarded(spark: SparkSession, path: str) -> None:
    """Deletes the folder of a table that ``written_at`` made and that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(col: str):
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str = "rank",
           weight: str | None = None) -> DataFrame:
    """``name``: 0-based position of each row inside its group (null groups are one
    group), or with ``weight`` the sum of the weights before it. A group of any size is
    spread over sqrt(n) hash buckets of about sqrt(n) rows, so no task ranks a whole
    group; the order is by bucket, then ``order``. Ties in ``order`` take any order.
    ``df`` should be a written table: it is read three times."""
    from pyspark.sql import Window

    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    sizes = df.groupBy(*groups).agg(F.ceil(F.sqrt(F.count(F.lit(1)).cast("double"))).cast("long").alias("_nb"))
    big = sizes.where("_nb > 1").select(*[F.col(g).alias(f"_s_{g}") for g in groups], "_nb")
    cond = [F.col(g).eqNullSafe(F.col(f"_s_{g}")) for g in groups]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    keyed = df.join(big, on, "left").drop(*[f"_s_{g}" for g in groups])
    keyed = keyed.withColumn("_b", F.pmod(F.xxhash64(*order), F.coalesce("_nb", F.lit(1)))).drop("_nb")
    per = keyed.groupBy(*groups, "_b").agg(F.sum(w).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_b")
                                         .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offs = per.select(*[F.col(g).alias(f"_o_{g}") for g in groups], F.col("_b").alias("_ob"), before.alias("_before"))
    win = Window.partitionBy(*groups, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("_local", F.coalesce(F.sum(w).over(win), F.lit(0)))
    on = F.col("_b") == F.col("_ob")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    out = local.join(offs, on, "inner").withColumn(name, F.col("_before") + F.col("_local"))
    return out.drop("_b", "_ob", "_before", "_local", *[f"_o_{g}" for g in groups])


def sorted_runs(batches, group: list[str], size: int):
    """Arrow batches sorted by ``group`` -> (table, [(from, to), ...]): the rows of each group
    that has more than one, in windows of at most ``size`` rows that overlap by half. At
    most about two windows and one batch are held, however large a group is."""
    import numpy as np
    import pyarrow as pa

    step = max(1, size // 2)

    def windows(lo: int, hi: int) -> list[tuple[int, int]]:
        if hi - lo <= size:
            return [(lo, hi)]
        return [(at, min(at + size, hi)) for at in range(lo, hi - size + step, step)]

    def cuts(t) -> list[int]:
        new = np.zeros(len(t), dtype=bool)
        for c in group:
            v = t[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return [0, *np.nonzero(new)[0].tolist(), len(t)]

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        at = cuts(held)
        spans = [w for lo, hi in zip(at[:-2], at[1:-1]) if hi - lo > 1 for w in windows(lo, hi)]
        if spans:
            yield held, spans
        held = held.slice(at[-2])
        while len(held) >= size + step:
            yield held, [(0, size)]
            held = held.slice(step)
    if held is not None and len(held) > 1:
        yield held.combine_chunks(), windows(0, len(held))


def fixed_bytes(column, width: int):
    """A binary column whose values all have ``width`` bytes, as a (rows, width) array."""
    import numpy as np
    import pyarrow as pa

    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(c):
        return np.zeros((0, width), dtype=np.uint8)
    if isinstance(c, pa.ChunkedArray):
        c = c.chunk(0)
    offsets = np.frombuffer(c.buffers()[1], dtype=np.int32, count=len(c) + 1, offset=4 * c.offset)
    return np.frombuffer(c.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]].reshape(len(c), width)
