"""Embedding near-duplicates by randomised-rotation binary codes (operator 10).

1. Equal vectors are one class (smallest id, size), so copies are never compared.
2. Each class falls into one bucket in each of L tables: b sign bits of a random
   rotation. At the linking angle two vectors agree in a bit with p = 1 - angle / pi; b grows
   with the logarithm of the number of classes and L is chosen so that a pair just at the
   threshold is missed by all tables with probability ``MISS`` at most.
3. Inside a bucket, codes decide: the sign code s of the rotated unit vector z with its
   stored correction <s, z> gives the unbiased estimate <s, w> / <s, z> of <z, w>, with a
   confidence bound of EPS standard errors. Pairs whose bound stays below the threshold
   are dropped; all others are recomputed exactly in double precision.
4. A bucket of more than ``BLOCK`` classes is dealt out as pairs of blocks. Tasks return
   per class the sizes linked to it (a pair counts in the first table in which it meets)
   and the edges of a spanning forest, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components have no links; vectors of different lengths have none with each other; rows
that share id and vector count as links of each other; very large and very small vectors are compared like others; a null id keeps its row, counts in its class, and
its own component is null when no id is in it; an empty table gives no rows."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import prepared, written
from riskweave.llm.components import components, spanning

THRESHOLD = 0.95
MISS = 1e-6
EPS = 5.0
BLOCK = 2048  # classes compared at once in a task
PER_BUCKET = 64  # unrelated classes that a bucket holds on average


def tables_for(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits of a bucket, number of tables) for ``n`` classes."""
    bits = min(48, max(4, math.ceil(math.log2(max(2, n / PER_BUCKET)))))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-p))


@lru_cache(maxsize=256)
def rotation(dim: int, number: int) -> np.ndarray:
    """The ``number``-th random rotation of ``dim`` dimensions, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([7, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def bucket_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) bucket numbers of unit vectors: consecutive sign bits of as many rotations as needed."""
    dim = x.shape[1]
    rotations = -(-bits * tables // dim)
    signs = np.concatenate([x @ rotation(dim, 1 + k).T > 0 for k in range(rotations)], axis=1)[:, :bits * tables]
    weights = (1 << np.arange(bits, dtype=np.int64))
    return signs.reshape(len(x), tables, bits).astype(np.int64) @ weights


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their largest components lie between 1/2 and 1: exact, and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rotated vectors, sign codes, corrections, error bounds) of unit vectors."""
    dim = x.shape[1]
    z = (x @ rotation(dim, 0).T).astype(np.float32)
    s = np.where(z > 0, 1, -1).astype(np.float32) / np.float32(math.sqrt(dim))
    c = np.einsum("ij,ij->i", s, z).astype(np.float64)
    return z, s, c, EPS * np.sqrt(np.maximum(1 - c * c, 0)) / c / math.sqrt(max(dim - 1, 1))


def linked_pairs(x: np.ndarray, bits: int, table: int, threshold: float, split: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) with exact cosine at the threshold, met in no earlier table. ``split``:
    compare only rows before it with rows from it on; None: all i < j."""
    x = scaled(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    z, s, c, bound = codes(unit)
    found = []
    for lo in range(0, split or len(x), 512):
        hi = min(lo + 512, split or len(x))
        may = (s[lo:hi] @ z.T) / c[lo:hi, None] + bound[lo:hi, None] >= threshold
        if split is None:
            may &= np.arange(len(x))[None, :] > np.arange(lo, hi)[:, None]
        else:
            may[:, :split] = False
        i, j = np.nonzero(may)
        i += lo
        for at in range(0, len(i), 1 << 16):
            a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            ok = np.einsum("ij,ij->i", x[a], x[b]) / np.sqrt(np.einsum("ij,ij->i", x[a], x[a]) * np.einsum("ij,ij->i", x[b], x[b])) >= threshold
            a, b = a[ok], b[ok]
            if table and len(a):
                rows = np.unique(np.concatenate([a, b]))
                keys = bucket_keys(unit[rows], bits, table)
                first = ~(keys[np.searchsorted(rows, a)] == keys[np.searchsorted(rows, b)]).any(axis=1)
                a, b = a[first], b[first]
            found.append((a, b))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, int),) * 2


def classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their vector's key, classes of equal usable vectors)."""
    v = F.col(vec_col).cast("array<double>")
    usable = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                        & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, v).alias("vec"))
    rows = written(rows.withColumn("key", F.when(F.col("vec").isNotNull(), F.sha2(F.concat_ws(",", "vec"), 256))), "vectors")
    return rows, rows.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("keep"), F.count(F.lit(1)).alias("n"), F.any_value("vec").alias("vec"))


def near_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
               threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    prepared(vectors.sparkSession)
    rows, found = classes(vectors, id_col, vec_col)
    found = written(found.withColumn("class", F.monotonically_increasing_id()), "classes")
    bits, tables = tables_for(found.count(), threshold)

    def deal(batches):
        import pyarrow as pa
        for batch in batches:
            vec = batch.column(1)
            lengths = np.diff(vec.offsets.to_numpy())
            flat = vec.flatten().to_numpy(zero_copy_only=False)
            out = [[], [], [], []]
            for dim in np.unique(lengths):
                own = np.nonzero(lengths == dim)[0]
                x = flat[(vec.offsets.to_numpy()[own] - vec.offsets[0].as_py())[:, None] + np.arange(dim)]
                x = scaled(x)
                keys = bucket_keys(x / np.linalg.norm(x, axis=1, keepdims=True), bits, tables)
                out[0].append(np.repeat(batch.column(0).to_numpy()[own], tables))
                out[1].append(np.tile(np.arange(tables, dtype=np.int32), len(own)))
                out[2].append(keys.ravel())
                out[3].append(np.full(len(own) * tables, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["class", "t", "b", "dim"])

    dealt = written(found.select("class", "vec").mapInArrow(deal, "class long, t int, b long, dim int"), "buckets")
    sizes = dealt.groupBy("t", "b", "dim").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    placed = dealt.join(sizes, ["t", "b", "dim"]).withColumn("blocks", F.ceil(F.col("m") / F.lit(float(block))).cast("int"))
    own = F.pmod(F.xxhash64("class"), "blocks").cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("t", "b", "dim", "class", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                           (F.col("own") > F.col("other")).alias("second"))
    packed = found.select("class", F.col("n").alias("size"), "vec")
    unit = ["t", "b", "dim", "lo", "hi"]
    groups = placed.join(packed, "class").repartition(*unit).sortWithinPartitions(*unit, "second")

    def compare(batches):
        import pyarrow as pa

        def result(g: dict, lo: int, hi: int):
            """Links of the bucket (or pair of blocks) in rows lo to hi."""
            x = g["flat"][g["at"][lo]:g["at"][hi]].reshape(hi - lo, -1)
            cls, size = g["class"][lo:hi], g["size"][lo:hi]
            split = None if g["lo"][lo] == g["hi"][lo] else int((~g["second"][lo:hi]).sum())
            a, b = linked_pairs(x, bits, int(g["t"][lo]), threshold, split)
            add = np.bincount(a, size[b], len(x)) + np.bincount(b, size[a], len(x))
            some, edges = np.nonzero(add)[0], spanning(a, b, len(x))
            return (np.concatenate([cls[some], cls[[e[0] for e in edges]]]) if edges else cls[some],
                    [None] * len(some) + [int(cls[e[1]]) for e in edges],
                    np.concatenate([add[some], np.zeros(len(edges))]).astype(np.int64))

        def arrays(t) -> dict:
            t = t.combine_chunks()
            g = {c: t[c].to_numpy() for c in (*unit, "class", "size", "second")}
            vec = t["vec"].chunk(0)
            first = vec.offsets[0].as_py()
            return g | {"flat": vec.flatten().to_numpy(zero_copy_only=False), "at": vec.offsets.to_numpy() - first}

        def links(t):
            g = arrays(t)
            new = np.zeros(len(t), dtype=bool)
            for c in unit:
                new[1:] |= g[c][1:] != g[c][:-1]
            cuts = [0, *np.nonzero(new)[0].tolist(), len(t)]
            out = [result(g, lo, hi) for lo, hi in zip(cuts, cuts[1:]) if hi - lo > 1]
            out = [o for o in out if len(o[0])]
            if out:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([o[0] for o in out])), pa.array(sum((o[1] for o in out), []), pa.int64()),
                    pa.array(np.concatenate([o[2] for o in out]))], names=["a", "b", "links"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            last = [held[c][len(held) - 1] for c in unit]
            if [held[c][0] for c in unit] == last:
                continue  # one bucket so far; a bucket has at most two blocks
            g = [held[c].to_numpy() == v.as_py() for c, v in zip(unit, last)]
            start = int(np.argmax(np.logical_and.reduce(g)))
            yield from links(held.slice(0, start))
            held = held.slice(start)
        if held is not None:
            yield from links(held)

    out = written(groups.select(*unit, "second", "class", "size", "vec").mapInArrow(compare, "a long, b long, links long"), "links")
    links = out.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    member = components(out.where("b is not null").select("a", "b"))
    per = found.join(links, found["class"] == links["a"], "left").join(member, found["class"] == member["node"], "left").select(
        "key", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class").alias("component"))
    smallest = found.join(per.select("key", "component"), "key").groupBy("component").agg(F.min("keep").alias("component_id"))
    per = per.join(smallest, "component").select("key", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id")
    return rows.join(per, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")), F.lit(True)).alias("kept"))
