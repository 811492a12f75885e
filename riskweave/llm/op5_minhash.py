"""MinHash near-duplicates by an LSH forest (operator 5).

1. Every document becomes its set of 64-bit shingle hashes, the set's 128-bit key and ``HASHES``
   minima. Equal sets are one class (smallest id), so copies are never compared.
2. Forest: ``TREES`` sorted orders of the classes, each starting at other minima. The orders are
   range-partitioned, so a dense region lies over as many tasks as it needs. Neighbours whose
   common prefix is at least ``DEPTH`` minima are candidates. Two sets at the
   threshold share a region in some order with probability 1 - (1 - 0.8^3)^14 > 0.9999.
   Signatures are compared (estimate at least ``LEAST``, over 3.3 standard errors
   below the threshold) and a spanning forest is passed on, not pairs. A region of more than
   ``REGION`` classes is first read in windows of sorted neighbours; then ``across`` compares
   all its classes that the windows left in different components.
3. The forest's components are verified on full sets, rebuilt from the texts of their
   members alone. A component is one unit; one of more than ``UNIT`` members is first read in
   windows of sorted orders, then ``across`` compares all its members that are not
   linked yet. In a window pairs go by falling estimate and are skipped when
   already connected, so a dense group costs about one check a member. What is not
   connected costs a comparison a pair, by pairs of blocks spread over all tasks.
4. The components of the confirmed links are the result.

Defined results: null text and texts without words have an empty set and link with
nothing; rows that share an id are one node; a null id has no component of its own (null, kept)
but takes that of an equal set; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import fixed_bytes, fresh, prepared, sorted_runs, text_bytes, written
from riskweave.llm.components import components, spanning

SHINGLE, PERCENT = 4, 80  # the query's contract
HASHES, TREES, DEPTH = 112, 14, 3
CHAINS = 4  # orders read in windows before the members of a big component are compared across
LEAST = 0.66
REGION, UNIT = 1024, 2048
CACHED_WORDS = 200_000

_SEEDS = np.random.default_rng(5).integers(1, 1 << 32, (2, HASHES), dtype=np.uint64)
_FLIP, _ODD = _SEEDS[0].astype(np.uint32), (_SEEDS[1] | 1).astype(np.uint32)


class Shingler:
    """Texts (bytes) to sorted arrays of the 64-bit hashes of their shingles."""

    def __init__(self, words: int):
        import xxhash

        class Hashes(dict):
            def __missing__(self, word):
                value = xxhash.xxh3_64_intdigest(word)
                if len(self) < CACHED_WORDS and len(word) <= 64:
                    self[word] = value
                return value

        self.words, self.hashes = words, Hashes()

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        w = np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.words, len(w))
        h = np.full(len(w) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - k + 1 + i]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(h ^ (h >> np.uint64(32)))


def minima(shingles: np.ndarray) -> np.ndarray:
    """``HASHES`` minima (16 bits of each) of a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        part = x[at:at + 2048]
        for k in range(0, HASHES, 16):
            m = (part[:, None] ^ _FLIP[k:k + 16]) * _ODD[k:k + 16]
            np.minimum(low[k:k + 16], m.min(axis=0), out=low[k:k + 16])
    return (low * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.uint16)


def order_keys(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, TREES) region numbers (the first DEPTH minima of each order) and the next minima of that order."""
    at = (DEPTH * np.arange(TREES)[:, None] + np.arange(2 * DEPTH)) % HASHES
    v = signatures[:, at].astype(np.int64)
    fold = lambda x: (x << (16 * np.arange(DEPTH)[::-1])).sum(axis=2)
    return fold(v[:, :, :DEPTH]), fold(v[:, :, DEPTH:])


def alike(signatures: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, estimate) of all pairs i < j of signatures (bytes) whose estimate is at least ``least``."""
    n, found = len(signatures), []
    need = int(np.ceil(least * HASHES))
    for lo in range(0, n, 32):
        part = signatures[lo:lo + 32]
        agree = np.empty((len(part), n - lo), dtype=np.int16)
        for k, row in enumerate(part):
            agree[k] = (signatures[lo:] == row).sum(axis=1, dtype=np.int16)
        i, j = np.nonzero(agree >= need)
        keep = j > i
        found.append((i[keep] + lo, j[keep] + lo, agree[i[keep], j[keep]]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int),) * 3


def confirmed(sets: list[np.ndarray], signatures: np.ndarray, least: float, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose full sets reach the threshold."""
    i, j, est = alike(signatures, least)
    size = np.array([len(s) for s in sets])
    fits = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
    i, j, est = i[fits], j[fits], est[fits]
    order = np.argsort(-est, kind="stable")
    i, j = i[order], j[order]
    label, links = np.arange(len(sets)), []
    for at in range(0, len(i), 4096):
        a, b = i[at:at + 4096], j[at:at + 4096]
        open_ = label[a] != label[b]
        for x, y in zip(a[open_].tolist(), b[open_].tolist()):
            if label[x] == label[y]:
                continue
            small, large = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
            both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
            if 100 * both >= percent * (len(small) + len(large) - both):
                links.append((x, y))
                label[label == label[y]] = label[x]
    return links


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, minima) per row; key and minima are null for empty sets."""
    prepared(docs.sparkSession)

    def run(batches):
        import hashlib

        import pyarrow as pa
        shingles = Shingler(shingle)
        for batch in batches:
            out = ([], [], [])
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                out[0].append(len(s))
                out[1].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out[2].append(minima(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()),
                                              pa.array(out[2], pa.binary())], names=["doc_id", "n_shingles", "set_key", "minima"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, minima binary")


def alike_across(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of signatures with different labels whose estimate is at least ``least``."""
    need, found = int(np.ceil(least * HASHES)), [(np.zeros(0, int),) * 2]
    for lo in range(0, len(a), 32):
        agree = np.stack([(b == row).sum(axis=1, dtype=np.int16) for row in a[lo:lo + 32]])
        i, j = np.nonzero((agree >= need) & (la[lo:lo + 32, None] != lb))
        found.append((i + lo, j))
    return tuple(np.concatenate(c) for c in zip(*found))


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``. Elements that
    many sets share are counted by a matrix product, the others by a join."""
    na, nb = len(a), len(b)
    _, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    split = sum(map(len, a))
    own = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (a, b)]
    at = (at[:split], at[split:])
    n = max((int(x.max()) + 1 for x in at if len(x)), default=0)
    ca, cb = (np.bincount(x, minlength=n) for x in at)
    both = np.zeros(na * nb, dtype=np.int64)
    heavy = np.nonzero(ca * cb > 64)[0]
    place = np.full(n, -1)
    place[heavy] = np.arange(len(heavy))
    for lo in range(0, len(heavy), 2048):
        sides = []
        for x, o, rows in ((at[0], own[0], na), (at[1], own[1], nb)):
            col = place[x] - lo
            inside = (col >= 0) & (col < 2048) & (place[x] >= 0)
            m = np.zeros((rows, 2048), dtype=np.float32)
            m[o[inside], col[inside]] = 1
            sides.append(m)
        both += np.rint(sides[0] @ sides[1].T).astype(np.int64).ravel()
    light = (ca * cb > 0) & (place < 0)
    x, ox = at[0][light[at[0]]], own[0][light[at[0]]]
    y, oy = at[1][light[at[1]]], own[1][light[at[1]]]
    order = np.argsort(y, kind="stable")
    start = np.searchsorted(y[order], x)
    times = cb[x]
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    j = oy[order][np.repeat(start, times) + step]
    return (both + np.bincount(np.repeat(ox, times) * nb + j, minlength=na * nb)).reshape(na, nb)


def confirmed_across(a: list[np.ndarray], b: list[np.ndarray], la: np.ndarray, lb: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of full sets with different labels that reach the threshold."""
    both, size = overlaps(a, b), [np.array([len(s) for s in x]) for x in (a, b)]
    return np.nonzero((100 * both >= percent * (size[0][:, None] + size[1] - both)) & (la[:, None] != lb))


def across(rows: DataFrame, group: list[str], size: int, compare) -> DataFrame:
    """Edges (a, b) that connect the pairs which ``compare`` finds among rows of one group with
    different labels; no pair is left out. ``rows``: group, doc_id, label, payload. Rows of
    one large label form blocks of their own, smaller labels share blocks (about ``size``
    rows, fewer long ones); a block is packed once and every pair of blocks is one row, but
    for those inside one label. ``compare(payloads, payloads, labels, labels)`` gives (i, j)."""
    from pyspark.sql import Window

    rows = rows.withColumn("w", F.ceil((F.length("payload") + 1) / F.lit(4096)).cast("long"))
    per = written(rows.groupBy(*group, "label").agg(F.sum("w").alias("n")), "labels")
    # blocks are numbered within the group: the pooled ones first, then those of each large label
    room = lambda n: F.ceil(n / F.lit(size)).cast("long")
    pool = per.groupBy(*group).agg(F.count(F.lit(1)).alias("labels"), room(F.sum(F.when(F.col("n") <= size, F.col("n")).otherwise(0))).alias("pooled"),
                                   F.sum(F.when(F.col("n") > size, room(F.col("n"))).otherwise(0)).alias("own")).where("labels > 1").select(
        *group, "pooled", (F.col("pooled") + F.col("own")).alias("blocks"))
    before = F.coalesce(F.sum("parts").over(Window.partitionBy(*group).orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = per.where(F.col("n") > size).select(*group, "label", room(F.col("n")).alias("parts")).withColumn("before", before)
    keyed = rows.join(pool, group).join(large, [*group, "label"], "left")
    first = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.col("pooled") + F.col("before")).cast("long")
    block = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("label"), F.col("pooled"))).otherwise(first + F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    # the first block that a block is compared with: itself, or what follows its label's blocks
    upto = F.when(F.col("parts").isNull(), F.col("block")).otherwise(first + F.col("parts"))
    blocks = written(keyed.withColumn("block", block).withColumn("upto", upto).groupBy(*group, "block").agg(
        F.min("upto").alias("upto"), F.max("blocks").alias("blocks"), F.collect_list(F.struct("doc_id", "label", "payload")).alias("rows")), "blocks")
    many = blocks.where("upto < blocks").select(*group, F.col("block").alias("x"), F.explode(F.sequence("upto", F.col("blocks") - 1)).alias("y"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = many.repartition(n, *group, "x", "y")

    def side(mark: str) -> DataFrame:
        return blocks.select(*group, F.col("block").alias(mark), F.col("rows").alias(f"{mark}rows"))

    def run(batches):
        import pyarrow as pa

        def read(cell):
            ids, labels, payloads = cell.values.flatten()
            return ids.to_numpy(), labels.to_numpy(), payloads

        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                (ia, la, a), (ib, lb, b) = read(left), read(right)
                i, j = compare(a, b, la, lb)
                if len(i):
                    e, ids = np.array(spanning(i, j + len(ia), len(ia) + len(ib))), np.concatenate([ia, ib])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[e[:, 0]]), pa.array(ids[e[:, 1]])], names=["a", "b"])

    return (pairs.join(side("x"), [*group, "x"]).join(side("y"), [*group, "y"]).select("xrows", "yrows").mapInArrow(run, "a long, b long"))


def labelled(rows: DataFrame, member: DataFrame) -> DataFrame:
    """``rows`` with the component of doc_id in ``member`` (node, component) as label, or its own id."""
    m = member.select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    return rows.join(m, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


ORDER_ROW = "tree int, k1 long, k2 long, doc_id long, sig binary"


def candidates(found: DataFrame, least: float, region: int) -> DataFrame:
    """Edges (a, b) that connect the alike classes of every region of the sorted orders."""

    def deal(batches):
        import pyarrow as pa
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                m = fixed_bytes(part.column(1), 2 * HASHES).copy().view(np.uint16)
                k1, k2 = order_keys(m)
                sig = pa.array([r.tobytes() for r in m.astype(np.uint8)], pa.binary())
                each = np.repeat(np.arange(len(m)), TREES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(m))), pa.array(k1.ravel()), pa.array(k2.ravel()),
                     part.column(0).take(pa.array(each)), sig.take(pa.array(each))], names=["tree", "k1", "k2", "doc_id", "sig"])

    def neighbours(batches):
        import pyarrow as pa
        for t, spans in sorted_runs(batches, ["tree", "k1"], region):
            sig, ids = fixed_bytes(t["sig"], HASHES), t["doc_id"].to_numpy()
            out = []
            for lo, hi in spans:
                i, j, _ = alike(sig[lo:hi], least)
                out += [(lo + x, lo + y) for x, y in spanning(i, j, hi - lo)]
            if out:
                e = np.array(out)
                yield pa.RecordBatch.from_arrays([pa.array(ids[e[:, 0]]), pa.array(ids[e[:, 1]])], names=["a", "b"])

    spark = found.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = found.select("doc_id", "minima").mapInArrow(deal, ORDER_ROW)
    large = written(rows.groupBy("tree", "k1").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > region).select("tree", "k1"), "regions")
    found_in = lambda d, keys: (d.repartitionByRange(n, *keys).sortWithinPartitions("tree", "k1", "k2", "tie", "doc_id")
                                .mapInArrow(neighbours, "a long, b long"))
    # equal keys are never split, so no border cuts a region of at most one window
    tied = rows.withColumn("tie", F.xxhash64("tree", "doc_id"))
    near = found_in(tied.join(large, ["tree", "k1"], "left_anti"), ["tree", "k1"])
    if large.isEmpty():
        return near
    # borders may cut a large region, anywhere in its ties, which each tree orders anew
    dense = written(tied.join(large, ["tree", "k1"]), "dense")
    near = written(near.unionByName(found_in(dense, ["tree", "k1", "k2", "tie"])), "neighbours")

    def compare(a, b, la, lb):
        return alike_across(fixed_bytes(a, HASHES), fixed_bytes(b, HASHES), la, lb, least)

    classes = dense.select("tree", "k1", "doc_id", F.col("sig").alias("payload"))
    return near.unionByName(across(labelled(classes, components(near)), ["tree", "k1"], region, compare))


def verified(docs: DataFrame, member: DataFrame, id_col: str, text_col: str, shingle: int, percent: int,
             least: float, unit: int) -> DataFrame:
    """Edges (a, b) of a forest of the confirmed links. ``member``: (node, component)."""
    import zstandard

    large = member.groupBy("component").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > unit).select(
        F.col("component").alias("big"))
    member = member.join(large, F.col("component") == F.col("big"), "left")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), text_bytes(text_col).alias("text"))

    def pack(batches):
        import pyarrow as pa
        squeeze = zstandard.ZstdCompressor(3)
        for batch in batches:
            packed = pa.array([squeeze.compress(t) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["node", "packed"])

    def sign(batches):
        import pyarrow as pa
        shingles, unpack = Shingler(shingle), zstandard.ZstdDecompressor()
        for batch in batches:
            m = [minima(shingles(unpack.decompress(p))).tobytes() for p in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m, pa.binary())],
                                             names=["doc_id", "component", "big", "packed", "minima"])

    # texts are shuffled packed; the join is a merge at every size, as it must be at a large one
    rows = written(texts.mapInArrow(pack, "node long, packed binary").join(member.hint("merge"), "node")
                   .select("node", "component", F.col("big").isNotNull().alias("big"), "packed")
                   .mapInArrow(sign, "doc_id long, component long, big boolean, packed binary, minima binary"), "members")

    def deal(batches):
        import pyarrow as pa
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                k1, k2 = order_keys(fixed_bytes(part.column(2), 2 * HASHES).copy().view(np.uint16))
                for tree in range(CHAINS):
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(np.full(len(k1), tree, dtype=np.int32)), pa.array(k1[:, tree]), pa.array(k2[:, tree])],
                        names=["doc_id", "component", "minima", "packed", "tree", "k1", "k2"])

    def confirm(group: list[str]):
        def run(batches):
            import pyarrow as pa
            shingles, unpack = Shingler(shingle), zstandard.ZstdDecompressor()
            for t, spans in sorted_runs(batches, group, unit):
                ids, packed = t["doc_id"].to_numpy(), t["packed"]
                sig = fixed_bytes(t["minima"], 2 * HASHES).copy().view(np.uint16).astype(np.uint8)
                for lo, hi in spans:
                    sets = [shingles(unpack.decompress(p.as_py())) for p in packed.slice(lo, hi - lo)]
                    links = confirmed(sets, sig[lo:hi], least, percent)
                    if links:
                        e = np.array(links) + lo
                        yield pa.RecordBatch.from_arrays([pa.array(ids[e[:, 0]]), pa.array(ids[e[:, 1]])], names=["a", "b"])
        return run

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = (rows.where("not big").select("doc_id", "component", "minima", "packed")
             .repartition("component").sortWithinPartitions("component", "doc_id"))
    small = whole.mapInArrow(confirm(["component"]), "a long, b long")
    big = rows.where("big").select("doc_id", "component", "minima", "packed")
    if big.isEmpty():
        return small
    keys = ["component", "tree", "k1", "k2", "tie"]
    parts = (big.mapInArrow(deal, "doc_id long, component long, minima binary, packed binary, tree int, k1 long, k2 long")
             .withColumn("tie", F.xxhash64("tree", "doc_id"))
             .repartitionByRange(n, *keys).sortWithinPartitions(*keys, "doc_id"))
    chained = written(parts.mapInArrow(confirm(["component", "tree"]), "a long, b long"), "chained")

    def compare(a, b, la, lb):
        shingles, unpack = Shingler(shingle), zstandard.ZstdDecompressor()
        one, other = ([shingles(unpack.decompress(p.as_py())) for p in side] for side in (a, b))
        return confirmed_across(one, other, la, lb, percent)

    members = big.select("component", "doc_id", F.col("packed").alias("payload"))
    rest = across(labelled(members, components(chained)), ["component"], max(1, unit // 2), compare)
    return small.unionByName(chained).unionByName(rest)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               percent: int = PERCENT, least: float = LEAST, region: int = REGION, unit: int = UNIT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = written(sketches(docs, id_col, text_col, shingle), "sketches")
    found = written(rows.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("keep"), F.any_value("minima").alias("minima")), "sets")
    forest = candidates(found.where("keep is not null").select(F.col("keep").alias("doc_id"), "minima"), least, region)
    member = written(components(forest), "candidates")
    links = components(verified(docs, member, id_col, text_col, shingle, percent, least, unit))
    sets = found.select("set_key", "keep").join(links, F.col("keep") == F.col("node"), "left").select(
        "set_key", F.coalesce("component", "keep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(sets, "set_key", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns (pipeline stage)."""
    name, = fresh(docs, "gone")
    gone = near_dedup(docs, shingle=shingle).where(~F.col("kept")).select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
