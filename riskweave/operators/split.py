"""Deterministic sampling, stratified splits and folds (SMP1-SMP3).

Every row gets a pseudo-uniform number ``u = hash_unit(key, seed)``. Sampling is a
threshold on u (no shuffle). A stratified split needs two cut values a label, which are found by
radix selection: histograms of the upper, then the lower 16 bits of u, then the keys at the cut. Rows are then
split by a filter and never moved. Folds need each row's rank inside its
label by u. A window partitioned by the label alone would put a 2-valued label into
two tasks, so ranks are computed in (label, u-bucket) groups: bucket counts
(sqrt of the rows at most) give per-bucket offsets, and the window runs per bucket.
A label holding almost all rows is therefore spread over all buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.scalar import hash_unit
from riskweave.session import cut_lineage


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """SMP1: keep rows with hash_unit(key, seed) < fraction (same rows every run)."""
    return df.where(hash_unit(key, seed) < F.lit(float(fraction)))


def rank_in_label(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Adds ``u``, ``rank`` (1-based within label, by u then key) and ``n_label``. A label
    of n rows is ranked in ceil(sqrt(n)) ranges of u, so no task holds a whole label;
    NULL labels are a label of their own."""
    n_label = F.count(F.lit(1))
    sizes = df.groupBy(F.col(label).alias("_sl")).agg(
        n_label.alias("n_label"), F.ceil(F.sqrt(n_label.cast("double"))).cast("int").alias("_nb"))
    x = df.withColumn("u", hash_unit(key, seed)).join(sizes, F.col(label).eqNullSafe(F.col("_sl"))).drop("_sl")
    x = x.withColumn("_b", F.floor(F.col("u") * F.col("_nb")).cast("int")).drop("_nb")
    before = Window.partitionBy("_ol").orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)
    offs = x.groupBy(F.col(label).alias("_ol"), F.col("_b").alias("_ob")).agg(F.count(F.lit(1)).alias("_c")).select(
        "_ol", "_ob", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    ranked = x.join(offs, F.col(label).eqNullSafe(F.col("_ol")) & (F.col("_b") == F.col("_ob"))).drop("_ol", "_ob")
    wb = Window.partitionBy(label, "_b").orderBy("u", key)
    return ranked.withColumn("rank", F.col("_off") + F.row_number().over(wb)).drop("_b", "_off")


def selected(rows: DataFrame, part, cuts: DataFrame) -> DataFrame:
    """One radix step: ``cuts`` (_l, _j, _need, ...) with ``_part``, the smallest ``part`` up to which at least _need of
    their ``rows`` (_l, _j, _need, ...) lie, and _need less the rows before that."""
    upto = Window.partitionBy("_l", "_j").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = rows.groupBy("_l", "_j", "_need", part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_cum", F.sum("_c").over(upto)).where((F.col("_cum") >= F.col("_need")) & (F.col("_cum") - F.col("_c") < F.col("_need")))
    at = counts.select(F.col("_l").alias("_al"), F.col("_j").alias("_aj"), "_part", (F.col("_need") - F.col("_cum") + F.col("_c")).alias("_left"))
    found = cuts.join(at, F.col("_l").eqNullSafe(F.col("_al")) & (F.col("_j") == F.col("_aj")))
    return found.withColumn("_need", F.col("_left")).drop("_al", "_aj", "_left")


def label_cuts(df: DataFrame, key: str, label: str, fractions: list[float], seed: int = 42) -> DataFrame:
    """(_label, _cuts): per label the (hash, key) of the floor(f * n)-th row by hash, then key, for each fraction f
    (null where that is 0). Three passes over (key, label); what is shuffled are histograms of at most 65,536
    places a label, and the keys that share a cut's 32-bit hash."""
    # hashes are whole numbers below 2^32; a null key has none and comes first
    h = F.coalesce((hash_unit(key, seed) * F.lit(float(1 << 32))).cast("long"), F.lit(-1).cast("long"))
    x = df.select(F.col(label).alias("_x"), F.col(key).alias("_key"), h.alias("_h"))
    sizes = cut_lineage(x.groupBy(F.col("_x").alias("_l")).agg(F.count(F.lit(1)).alias("_n")))
    wanted = F.array(*[F.floor(F.col("_n") * F.lit(float(f))) for f in fractions])
    cuts = sizes.select("_l", F.posexplode(wanted).alias("_j", "_need")).where("_need > 0")

    def step(cuts: DataFrame, on, part) -> DataFrame:
        # a row per label and cut
        rows = x.join(F.broadcast(cuts), F.col("_x").eqNullSafe(F.col("_l")) & on)
        return cut_lineage(selected(rows, part, cuts))

    cuts = step(cuts, F.lit(True), F.shiftright("_h", 16)).withColumnRenamed("_part", "_top")
    low = F.col("_h").bitwiseAND(F.lit(0xFFFF))
    cuts = step(cuts, F.shiftright("_h", 16) == F.col("_top"), low)
    cuts = cuts.withColumn("_cut", F.shiftleft("_top", 16).bitwiseOR(F.col("_part"))).drop("_top", "_part")
    cuts = step(cuts, F.col("_h") == F.col("_cut"), F.col("_key"))
    at = cuts.groupBy(F.col("_l").alias("_label")).agg(F.map_from_entries(F.collect_list(F.struct("_j", F.struct(
        F.col("_cut").alias("h"), F.col("_part").alias("key"))))).alias("_m"))
    full = sizes.select(F.col("_l").alias("_every")).join(at, F.col("_every").eqNullSafe(F.col("_label")), "left")
    return full.select(F.col("_every").alias("_label"), F.array(*[F.try_element_at("_m", F.lit(j)) for j in range(len(fractions))]).alias("_cuts"))


def stratified_split(df: DataFrame, key: str, label: str, fractions=(0.6, 0.2, 0.2),
                     names=("train", "val", "test"), seed: int = 42) -> DataFrame:
    """SMP2: exact per-label proportions: with n rows in a label, the first
    floor(f1*n) rows by (hash, key) go to the first part, up to floor((f1+f2)*n) to the second,
    the rest to the third. Rows that repeat a key stay together. A filter against the labels' cut values
    (a row per label is broadcast): no row is shuffled."""
    cuts = cut_lineage(label_cuts(df, key, label, [fractions[0], fractions[0] + fractions[1]], seed))
    h = F.coalesce((hash_unit(key, seed) * F.lit(float(1 << 32))).cast("long"), F.lit(-1).cast("long"))
    x = df.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_label")))
    own = F.struct(h.alias("h"), F.col(key).alias("key"))
    upto = lambda j: F.coalesce(own <= F.col("_cuts")[j], F.lit(False))
    return x.withColumn("split", F.when(upto(0), F.lit(names[0])).when(upto(1), F.lit(names[1])).otherwise(F.lit(names[2]))).drop("_label", "_cuts")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """SMP3: fold = (rank in label - 1) mod k -> label shares equal per fold (±1 row)."""
    r = rank_in_label(df, key, label, seed)
    return r.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("u", "rank", "n_label")
