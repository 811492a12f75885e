"""Correlation and feature selection (SEL2-SEL7, SET3-SET4).

Pairwise-complete Pearson correlation (pandas ``DataFrame.corr`` semantics: each pair
uses the rows where both values are present) for any number of columns, from tiles of
``TILE`` columns:

* a task folds its Arrow batches, CELLS values at a time, for one strip of columns against all later ones, into the sums
  n, sx, sy, sxx, syy, sxy (relative to the means of its first rows, for accuracy), so it
  holds TILE x p numbers of each and copies of CELLS values, whatever the rows and the size of a batch; a strip is one scan of its own and later columns
* each pair of tiles leaves as ONE packed row; packed rows are added ``FAN_IN`` at a time, level by
  level, moved exactly to the first one's means, until one is left per pair of tiles
* the pair table is unpacked from those and r comes from the sums

The scan is read by a number of tasks that follows the cluster's cores and not the table, so neither the
packed rows nor the shuffle grow with the rows. Zero variance
(constant column, or constant on the common rows) gives NULL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.session import cut_lineage, ship_package  # noqa: E402

_NUM = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
        T.DecimalType, T.BooleanType)

TILE, FAN_IN = 256, 16
CELLS = 1 << 18  # values that a task turns into numbers at a time
TASKS_A_CORE = 2
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
PACKED = "i int, j int, part int, a binary, b binary, sums binary"


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUM) and f.name not in set(exclude)]


def _strip(tile_i: int, p: int, tile: int):
    """One strip of a task: the columns of tile ``tile_i`` against themselves and all later ones; the input
    holds exactly those columns. Emits a packed row per pair of tiles."""
    w = min(tile, p - tile_i * tile)

    def slices(batches):
        for pdf in batches:
            step = max(1, CELLS // pdf.shape[1])
            for lo in range(0, len(pdf), step):
                yield pdf.iloc[lo:lo + step].to_numpy(dtype=np.float64, na_value=np.nan)

    def fold(batches):
        from pyspark import TaskContext
        part, shift, acc = TaskContext.get().partitionId(), None, None
        for X in slices(batches):
            M = ~np.isnan(X)
            if shift is None:
                cnt = M.sum(axis=0)
                shift = np.where(cnt > 0, np.where(M, X, 0.0).sum(axis=0) / np.maximum(cnt, 1), 0.0)
                acc = np.zeros((len(SUMS), w, X.shape[1]))
            X, M = np.where(M, X - shift, 0.0), M.astype(np.float64)
            Xi, Mi = X[:, :w], M[:, :w]
            for k, (left, right) in enumerate(((Mi, M), (Xi, M), (Mi, X), (Xi * Xi, M), (Mi, X * X), (Xi, X))):
                if k in (2, 4):  # of the tile with itself these are the transposes
                    acc[k, :, w:] += left.T @ right[:, w:]
                else:
                    acc[k] += left.T @ right
        if shift is None:
            return
        for k in (2, 4):
            acc[k, :, :w] = acc[k - 1, :, :w].T
        for lo in range(0, acc.shape[2], tile):
            hi = min(lo + tile, acc.shape[2])
            yield pd.DataFrame({"i": [tile_i], "j": [tile_i + lo // tile], "part": [part], "a": [shift[:w].tobytes()],
                                "b": [shift[lo:hi].tobytes()], "sums": [np.ascontiguousarray(acc[:, :, lo:hi]).tobytes()]})
    return fold


def _unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = np.frombuffer(row.a), np.frombuffer(row.b)
    return a, b, np.frombuffer(row.sums).reshape(len(SUMS), len(a), len(b))


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """The sum of at most FAN_IN packed rows of one pair of tiles, about the first one's means:
    sum(x-c) = sum(x-a) + n(a-c),  sum((x-c)^2) = sum((x-a)^2) + 2(a-c)sum(x-a) + n(a-c)^2,
    sum((x-c)(y-d)) = sum((x-a)(y-b)) + (a-c)sum(y-b) + (b-d)sum(x-a) + n(a-c)(b-d)."""
    rows = rows.sort_values("part")
    first, total = None, None
    for row in rows.itertuples():
        a, b, (n, sx, sy, sxx, syy, sxy) = _unpacked(row)
        if first is None:
            first, total = (a, b), np.zeros((len(SUMS), len(a), len(b)))
        da, db = (a - first[0])[:, None], (b - first[1])[None, :]
        for k, v in enumerate((n, sx + n * da, sy + n * db, sxx + 2.0 * da * sx + n * da * da,
                               syy + 2.0 * db * sy + n * db * db, sxy + da * sy + db * sx + n * da * db)):
            total[k] += v
    head = rows.iloc[0]
    return pd.DataFrame({"i": [head.i], "j": [head.j], "part": [head.part], "a": [head.a], "b": [head.b], "sums": [total.tobytes()]})


def _pairs(tile: int):
    """Packed rows to one row per pair of columns."""
    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                _, _, sums = _unpacked(row)
                i, j = np.triu_indices(sums.shape[1], 0, sums.shape[2]) if row.i == row.j else np.indices(sums.shape[1:]).reshape(2, -1)
                yield pd.DataFrame({"i": (i + row.i * tile).astype(np.int32), "j": (j + row.j * tile).astype(np.int32),
                                    **{name: sums[k, i, j] for k, name in enumerate(SUMS)}})
    return run


def packed_sums(df: DataFrame, cols: list[str], tasks: int | None = None, tile: int = TILE, fan_in: int = FAN_IN) -> DataFrame:
    """(i, j, part, a, b, sums): one packed row per pair of column tiles i <= j."""
    p, spark = len(cols), df.sparkSession
    ship_package(spark)
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    most = tasks or TASKS_A_CORE * spark.sparkContext.defaultParallelism
    parts, strips = None, -(-p // tile)
    for i in range(strips):
        strip = x.select(*[f"c{k}" for k in range(i * tile, p)]).coalesce(most).mapInPandas(_strip(i, p, tile), PACKED)
        parts = strip if parts is None else parts.unionByName(strip)
    width = 1
    while width < most * strips:  # partitions are numbered over all strips; a level reads at most ``fan_in`` packed rows of a pair of tiles at a time
        width *= fan_in
        parts = parts.groupBy("i", "j", F.floor(F.col("part") / F.lit(width)).alias("_g")).applyInPandas(_added, PACKED)
    return parts


def pairwise_corr(df: DataFrame, cols: list[str] | None = None, tasks: int | None = None,
                  include_diagonal: bool = False, materialize: bool = True, tile: int = TILE, fan_in: int = FAN_IN) -> DataFrame:
    """Long table (pos_i, pos_j, col_i, col_j, n, r) for pos_i < pos_j (or <=).
    ``tasks`` bounds the tasks that read the rows (coalesce, no shuffle); default: ``TASKS_A_CORE`` for every
    core of the cluster. With ``materialize`` the pair table (p^2/2 rows) is checkpointed."""
    cols = numeric_columns(df) if cols is None else list(cols)
    sums = packed_sums(df, cols, tasks, tile, fan_in).mapInPandas(_pairs(tile), "i int, j int, " + ", ".join(f"{c} double" for c in SUMS))
    vx = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    ok = (F.col("n") >= 2) & (vx > F.lit(1e-12) * F.col("n") * F.col("sxx")) \
        & (vy > F.lit(1e-12) * F.col("n") * F.col("syy"))
    r = F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cov / F.sqrt(vx * vy))))
    names = F.array(*[F.lit(c) for c in cols])
    keep = (F.col("i") <= F.col("j")) if include_diagonal else (F.col("i") < F.col("j"))
    out = sums.where(keep).select(
        F.col("i").alias("pos_i"), F.col("j").alias("pos_j"),
        names[F.col("i")].alias("col_i"), names[F.col("j")].alias("col_j"),
        F.col("n").cast("long").alias("n"), r.alias("r"))
    return cut_lineage(out) if materialize else out


def split_label(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pair table of [label] + features as (pairs between features, positions as
    without the label; correlation of each feature with the label)."""
    between = pairs.where(F.col("pos_i") > 0).withColumns({"pos_i": F.col("pos_i") - 1, "pos_j": F.col("pos_j") - 1})
    with_label = pairs.where(F.col("pos_i") == 0).select(
        F.col("col_j").alias("feature"), (F.col("pos_j") - 1).alias("pos"), "r")
    return between, with_label


def target_corr(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """(feature, pos, r) correlation of every column with the target (pairwise
    complete). Uses the Gram operator over [target] + cols."""
    pc = pairwise_corr(df, [target] + [c for c in cols if c != target])
    return split_label(pc)[1]


def top_bottom(corr_df: DataFrame, k: int = 10, round_digits: int | None = 6) -> DataFrame:
    """SEL3: k highest (NULLs last) and k lowest (after dropping NULL) correlations.
    Ranking uses the rounded r and the name as tie-break, so equal values order
    deterministically. Windows run over one row per feature (metadata sized)."""
    from riskweave.functions.scalar import round_fixed
    rr = round_fixed("r", round_digits) if round_digits is not None else F.col("r")
    c = corr_df.select("feature", rr.alias("r"))
    top = c.select("*", F.row_number().over(Window.orderBy(F.col("r").desc_nulls_last(), "feature")).alias("rank"))
    bot = c.where(F.col("r").isNotNull()).select(
        "*", F.row_number().over(Window.orderBy(F.col("r").asc(), F.col("feature").desc())).alias("rank"))
    return (top.where(F.col("rank") <= k).withColumn("side", F.lit("top"))
            .unionByName(bot.where(F.col("rank") <= k).withColumn("side", F.lit("bottom"))))


def collinear_drop(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """SEL4: column j is removed iff some column EARLIER in column order has signed
    r > threshold with it (removed columns still remove others). One filter and a
    distinct on the pair table; no driver loop."""
    return (pairs.where((F.col("r") > threshold) & (F.col("pos_i") < F.col("pos_j")))
            .groupBy(F.col("col_j").alias("feature"), F.col("pos_j").alias("pos"))
            .agg(F.min("pos_i").alias("first_partner")).select("feature", "pos"))


def collinear_cut(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.8,
                  protect=()) -> tuple[DataFrame, list[str]]:
    """SEL4-SEL6: drop the collinear columns from ``df`` (names collected: metadata)."""
    cols = numeric_columns(df) if cols is None else cols
    pairs = pairwise_corr(df, cols)  # protected columns still remove others
    drop = [r["feature"] for r in collinear_drop(pairs, threshold).collect() if r["feature"] not in set(protect)]
    return df.drop(*drop), drop


def topk_features(corr_df: DataFrame, k: int) -> DataFrame:
    """SEL7/SET3: k most positive and k most negative features, as a set; features
    without a correlation are dropped before both lists."""
    return top_bottom(corr_df.where(F.col("r").isNotNull()), k).select("feature").distinct()


def pairwise_corr_agg(df: DataFrame, cols: list[str]) -> DataFrame:
    """Same contract as ``pairwise_corr`` for a few dozen columns, with built-in
    aggregates only (one aggregate row holding an array of per-pair sums)."""
    p = len(cols)
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    mrow = df.agg(*[F.avg(x[k]).alias(f"m{k}") for k in range(p)]).first()
    m = [0.0 if mrow[f"m{k}"] is None else mrow[f"m{k}"] for k in range(p)]
    structs = []
    for i in range(p):
        for j in range(i + 1, p):
            both = x[i].isNotNull() & x[j].isNotNull()
            xi, xj = F.when(both, x[i] - F.lit(m[i])), F.when(both, x[j] - F.lit(m[j]))
            structs.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                                    F.count_if(both).cast("double").alias("n"),
                                    F.coalesce(F.sum(xi), F.lit(0.0)).alias("sx"),
                                    F.coalesce(F.sum(xj), F.lit(0.0)).alias("sy"),
                                    F.coalesce(F.sum(xi * xi), F.lit(0.0)).alias("sxx"),
                                    F.coalesce(F.sum(xj * xj), F.lit(0.0)).alias("syy"),
                                    F.coalesce(F.sum(xi * xj), F.lit(0.0)).alias("sxy")))
    sums = df.agg(F.array(*structs).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    vx = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    ok = (F.col("n") >= 2) & (vx > F.lit(1e-12) * F.col("n") * F.col("sxx")) \
        & (vy > F.lit(1e-12) * F.col("n") * F.col("syy"))
    r = F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cov / F.sqrt(vx * vy))))
    names = F.array(*[F.lit(c) for c in cols])
    return sums.select(F.col("i").alias("pos_i"), F.col("j").alias("pos_j"),
                       names[F.col("i")].alias("col_i"), names[F.col("j")].alias("col_j"),
                       F.col("n").cast("long").alias("n"), r.alias("r"))
