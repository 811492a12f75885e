"""Mixing sources to target weights by Pfair scheduling (operator 1, DataFrame and SQL functions only).

Each source's documents, in a fixed pseudo-random order, form blocks of ``block_rows``.
The target weights are rounded to shares a of a frame of P slots (at least one each, off
by (number of sources) / P at most). The k-th block of a
source (from 0) is released at slot floor(k P / a) and due by slot ceil((k + 1) P / a); every
slot takes the released block with the earliest deadline. All shares add up to the frame, so no
deadline is missed: after any number of slots a source is less than one block off its share.
The schedule repeats after P slots, so only one frame is computed, by a fold over P
slots whose state is a count per source, and every block finds its slot by arithmetic.

The stream is as long as it takes until every document has come once; sources that end
earlier begin anew (epoch). Nothing is dropped. Without given weights the target is
the 3/4 power of the source's size, which lifts small sources mildly: the stream holds
at most (number of sources)^(1/4) times the documents, rounding aside.

A source of any size is ranked in hash-prefix buckets with offsets, rows that repeat a
(source, doc_id) are one row with a count until their places are known, and only the source
table (a row a source) carries the schedule.

The registered query's SQL fixes the frame, so its error against the target grows with the stream.
The pipeline's stage (``mixed``) has no frame: it nests the sources in a tree and stays within two
blocks of the target weights over any length.

Defined results: a null source is a source of its own; a null doc_id comes first; rows
that repeat an id get consecutive places; an empty table gives no rows; sources without a given
weight take part with the smallest share; texts are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import fresh, written

BLOCK_ROWS = 16
FRAME = 1000  # slots of a frame, or twice the sources if that is more

# One frame: a fold over its slots. State: blocks done per source, and the sources picked.
PICK = """array_min(filter(transform(x.done, (d, i) -> IF(d * p DIV shares[i] <= t,
          named_struct('due', ((d + 1) * p + shares[i] - 1) DIV shares[i], 'i', i), NULL)), c -> c IS NOT NULL)).i"""
FOLD = f"""aggregate(sequence(0L, p - 1),
    named_struct('done', transform(shares, a -> 0L), 'picked', cast(array() AS array<int>)),
    (x, t) -> transform(array({PICK}), w -> named_struct(
        'done', transform(x.done, (d, i) -> IF(i = w, d + 1, d)), 'picked', concat(x.picked, array(w))))[0],
    x -> x.picked)"""


def source_table(sizes: DataFrame, weights: dict[str, float] | None, block_rows: int, frame: int) -> DataFrame:
    """One row per source: source, n, share, p, blocks, frames, slots (its slots in a
    frame), last (the stream's last slot)."""
    everyone = Window.partitionBy()
    if weights is None:
        root = F.sqrt(F.col("n").cast("double"))
        weight = root * F.sqrt(root)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    s = sizes.withColumn("_w", weight)
    s = s.withColumn("_w", F.when(F.sum("_w").over(everyone) > 0, F.col("_w")).otherwise(F.lit(1.0)))
    s = s.withColumn("_sources", F.count(F.lit(1)).over(everyone))
    s = s.withColumn("p", F.greatest(F.lit(frame).cast("long"), 2 * F.col("_sources")))
    s = s.withColumn("_q", F.col("_w") / F.sum("_w").over(everyone) * (F.col("p") - F.col("_sources")))
    s = s.withColumn("_base", F.floor("_q").cast("long"))
    by_rest = Window.orderBy((F.col("_q") - F.col("_base")).desc(), F.col("source").asc_nulls_first())
    left = F.col("p") - F.col("_sources") - F.sum("_base").over(everyone)
    s = s.withColumn("share", 1 + F.col("_base") + (F.row_number().over(by_rest) <= left).cast("long"))
    s = s.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first())) - 1)
    s = s.withColumn("blocks", F.ceil(F.col("n") / F.lit(float(block_rows))).cast("long"))
    s = s.withColumn("frames", F.max(F.ceil(F.col("blocks") / F.col("share"))).over(everyone).cast("long"))
    s = written(s.select("source", "n", "share", "p", "blocks", "frames", "i"), "sources")
    picked = (s.agg(F.max("p").alias("p"), F.array_sort(F.collect_list(F.struct("i", "share"))).alias("a"))
              .withColumn("shares", F.expr("transform(a, x -> x.share)")).where("p is not null")
              .select(F.posexplode(F.expr(FOLD)).alias("slot", "i")))
    slots = picked.groupBy("i").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    last = F.floor((F.col("blocks") - 1) / F.col("share")) * F.col("p") + F.element_at(
        "slots", ((F.col("blocks") - 1) % F.col("share") + 1).cast("int"))
    return s.join(slots, "i").drop("i").withColumn("last", F.max(last).over(everyone))


def ranked_rows(docs: DataFrame, id_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """((source, doc_id, first rank, copies), sizes): the order in a source is by md5 of the id."""
    key = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"))
                   .groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
                   .withColumn("_md5", key).withColumn("_b", F.substring("_md5", 1, 3)), "mix")
    per = rows.groupBy("source", "_b").agg(F.sum("copies").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_b")
                                         .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offs = per.select(F.col("source").alias("_s"), F.col("_b").alias("_ob"), before.alias("_before"))
    inside = Window.partitionBy("source", "_b").orderBy("_md5", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_in", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(
        offs, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_ob")))
    return (out.select("source", "doc_id", (F.col("_before") + F.col("_in")).alias("rank"), "copies"),
            per.groupBy("source").agg(F.sum("_n").alias("n")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, frame: int = FRAME,
        id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, source, copy, epoch, slot, position): one row per place in the stream. ``slot`` is
    the block's place, ``position`` the document's; positions grow with the slots."""
    rows, sizes = ranked_rows(docs, id_col, source_col)
    own = source_table(sizes, weights, block_rows, frame).withColumnRenamed("source", "_source")
    placed = (rows.join(own, F.col("source").eqNullSafe(F.col("_source")))
              .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
              .withColumn("rank", F.col("rank") + F.col("copy"))
              .withColumn("block", F.floor(F.col("rank") / F.lit(block_rows)).cast("long"))
              .withColumn("k", F.explode(F.sequence(F.col("block"), F.col("frames") * F.col("share") - 1, F.col("blocks")))))
    inside = F.element_at("slots", (F.col("k") % F.col("share") + 1).cast("int"))
    slot = F.floor(F.col("k") / F.col("share")) * F.col("p") + inside
    return placed.where(slot <= F.col("last")).select("doc_id", "source", "copy", F.floor(F.col("k") / F.col("blocks")).cast("long").alias("epoch"),
                         slot.cast("long").alias("slot"), (slot * block_rows + F.col("rank") % block_rows).cast("long").alias("position"))


# A leaf's k-th block, counted up its path: the m-th block of a child is the n-th of its parent.
CLIMB = """aggregate(path, k, (m, s) -> IF(s.left,
    (cast(s.w AS decimal(15,0)) * cast(2 * m + 1 AS decimal(20,0)) + 2 * s.a - 1) DIV cast(2 * s.a AS decimal(16,0)) - 1,
    cast(s.w AS decimal(15,0)) * cast(2 * m + 1 AS decimal(20,0)) DIV cast(2 * s.a AS decimal(16,0))))"""
UNIT = 1 << 40  # weights are whole numbers of this part


def climbed(path: list[tuple[bool, int, int]], k: int) -> int:
    for left, a, w in path:
        k = (w * (2 * k + 1) + 2 * a - 1) // (2 * a) - 1 if left else w * (2 * k + 1) // (2 * a)
    return k


def nested_rows(sizes: list[tuple], weights: dict[str, float] | None, block_rows: int) -> list[tuple]:
    """(source, blocks, path, base, until, upto) of every (source, n): a Huffman tree of the weights.
    A node deals its slots to its two children by rounding, so each is half a block off at
    most; an inner node has at most 2/3 of its parent's weight, so a source is less than
    1/2 + 3/2 blocks off its target at every slot, however long the stream is. Sources of
    weight 0 follow the stream (base), once."""
    import heapq

    target = [max(0.0, float(weights.get(s, 0.0))) if weights is not None else n ** 0.75 for s, n in sizes]
    if not any(target):
        target = [1.0] * len(sizes)
    whole = sum(target)
    units = [max(1, round(t / whole * UNIT)) if t > 0 else 0 for t in target]
    blocks = [-(-n // block_rows) for _, n in sizes]
    heap = [(u, i, i) for i, u in enumerate(units) if u]
    heapq.heapify(heap)
    up, free = {}, len(sizes)
    while len(heap) > 1:
        (b, _, right), (a, _, left) = heapq.heappop(heap), heapq.heappop(heap)
        up[left], up[right] = (free, True, a, a + b), (free, False, b, a + b)
        heapq.heappush(heap, (a + b, free, free))
        free += 1

    def path(i: int) -> list[tuple[bool, int, int]]:
        out = []
        while i in up:
            i, *step = up[i]
            out.append(tuple(step))
        return out

    paths = [path(i) for i in range(len(sizes))]
    last = max((climbed(p, b - 1) for p, b, u in zip(paths, blocks, units) if u), default=-1)
    rows, after = [], last + 1
    for (source, _), p, b, u in zip(sizes, paths, blocks, units):
        if u:
            rows.append((source, b, p, 0, last, (last + 1) * u // sum(units) + 3))
        else:
            rows.append((source, b, [], after, after + b - 1, b - 1))
            after += b
    return rows


def places(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, source, copy, slot, position) of a stream that follows the target weights themselves,
    without a frame; only the source table (a row a source) is computed on the driver."""
    rows, sizes = ranked_rows(docs, "doc_id", "source")
    known = sorted(((r["source"], r["n"]) for r in sizes.collect()), key=lambda r: (r[0] is not None, r[0] or ""))
    own = docs.sparkSession.createDataFrame(
        nested_rows(known, weights, block_rows),
        "_source string, blocks long, path array<struct<left: boolean, a: long, w: long>>, base long, until long, upto long")
    placed = (rows.join(own, F.col("source").eqNullSafe(F.col("_source")))
              .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
              .withColumn("rank", F.col("rank") + F.col("copy"))
              .withColumn("block", F.floor(F.col("rank") / F.lit(block_rows)).cast("long"))
              .withColumn("k", F.explode(F.sequence(F.col("block"), F.col("upto"), F.col("blocks"))))
              .withColumn("slot", F.col("base") + F.expr(CLIMB)).where("slot <= until"))
    return placed.select("doc_id", "source", "copy", "slot", (F.col("slot") * block_rows + F.col("rank") % block_rows).alias("position"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The mixed stream of whole rows in its order (pipeline stage): a document comes as often as
    its source's target asks, at least once. Rows that repeat (source, doc_id) each come as often as the first."""
    key, of, place = fresh(docs, "id", "of", "place")
    at = places(docs, weights).where("copy = 0").select(
        F.col("doc_id").alias(key), F.col("source").alias(of), F.col("position").alias(place))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = docs.join(at, F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(of)))
    return stream.repartitionByRange(n, place).sortWithinPartitions(place).select(*[F.col(f"`{c}`") for c in docs.columns])
