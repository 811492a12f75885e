"""Vector code compression by active-entry Lloyd (operator 12).

Components become integers floor(1024 x), vectors are cut into ``PARTS`` equal parts, and every part position
has a codebook of up to ``ENTRIES`` entries, at first the parts of the smallest ids. A round
assigns every part to its nearest entry (ties to the lower index) and moves the entries to the
floored means of their parts.

Each row keeps its codes and their exact distances. A part whose entry did not move since
is compared with the moved entries only, against the stored distance: the others lost before and
are where they were. A part whose entry moved rescans its whole codebook.

All arithmetic is exact: in doubles below 2^53 (products of integers) while the largest component
allows it, else in Python's integers; the choice is made once for the table from its largest component
and changes no result. Rows stay where they are; a round moves only the partial sums of each task's entries
(PARTS x ENTRIES rows), and the driver holds the codebooks. A round's rows are a written table that
replaces the one before.

Defined results: rows whose vector is null, empty, holds null or non-finite components, cannot be cut
into equal parts, or differs in length from the smallest usable id's are left out; null ids come last in
the order of ids, equal ids are ordered by their vectors; with fewer rows than entries the codebooks are that
short; sums beyond a long are returned as the largest long; an empty table gives no rows; further columns
are ignored."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import discarded, prepared, written_at

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4  # the query's contract
LONGEST = (1 << 63) - 1
BATCH = 4096


def integers(x: np.ndarray, wide: bool) -> np.ndarray:
    """floor(SCALE * x): longs, or Python's integers where they may be larger."""
    if not wide:
        return np.floor(x * SCALE).astype(np.int64)
    whole = [math.floor(v * SCALE) if abs(v) < 1 << 52 else int(v) * SCALE for v in x.ravel().tolist()]
    return np.array([*whole, None], dtype=object)[:-1].reshape(x.shape)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all entries."""
    if x.dtype == object:
        return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)
    a, b = x.astype(np.float64), entries.astype(np.float64)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of the nearest entry of every row; ties go to the lower index."""
    d = distances(x, entries)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(x)), code]


def reassigned(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` from the codes and distances to the entries before ``moved`` ones moved."""
    code, dist = code.copy(), dist.copy()
    lost = moved[code]
    if lost.any():
        code[lost], dist[lost] = nearest(x[lost], entries)
    active, kept = np.nonzero(moved)[0], np.nonzero(~lost)[0]
    if len(active) and len(kept):
        at, d = nearest(x[kept], entries[active])
        at = active[at]
        better = (d < dist[kept]) | ((d == dist[kept]) & (at < code[kept]))
        code[kept[better]], dist[kept[better]] = at[better], d[better]
    return code, dist


class Numbers:
    """Distances as bytes of a fixed width."""

    def __init__(self, wide: bool):
        self.wide, self.width = wide, 288 if wide else 8

    def read(self, cells: list[bytes]) -> np.ndarray:
        if not self.wide:
            return np.frombuffer(b"".join(cells), dtype="<i8").reshape(len(cells), PARTS)
        w = self.width
        flat = [int.from_bytes(c[w * p:w * p + w], "little") for c in cells for p in range(PARTS)]
        return np.array([*flat, None], dtype=object)[:-1].reshape(len(cells), PARTS)

    def write(self, rows: np.ndarray) -> list[bytes]:
        if not self.wide:
            return [r.tobytes() for r in np.ascontiguousarray(rows, dtype="<i8")]
        return [b"".join(v.to_bytes(self.width, "little") for v in r) for r in rows.tolist()]


def vectors(column) -> np.ndarray:
    """An Arrow list column of equal lengths as (rows, length)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


STATE = "id long, label {label}, v array<{item}>, codes binary, dists binary"


def usable(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v) of the rows whose vector is whole, finite and can be cut."""
    fine = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # NaN is above all numbers
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    return rows.where((F.size("v") > 0) & (F.size("v") % PARTS == 0) & fine)


def starters(rows: DataFrame, entries: int) -> list[np.ndarray]:
    """Vectors of the first ``entries`` rows by id; at most that many reach the driver."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries)
    return [np.array(r["v"], dtype=np.float64) for r in first.select("v").collect()]


def codebook_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for e in b.tolist() for c in e).encode()).hexdigest()


def fit(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
        entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, list[np.ndarray], Numbers]:
    """(rows with codes and distances to the final entries, codebooks, form of the distances);
    None instead of rows when no vector is usable."""
    spark = prepared(embeddings.sparkSession)
    rows = usable(embeddings, id_col, vector_col, label_col)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    if first is None:
        return None, [], Numbers(False)
    rows = rows.where(F.size("v") == first["n"])
    largest = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("m")).first()["m"]
    width = first["n"] // PARTS
    # |a|^2 + 2ab + |b|^2 stays below 2^53, and a sum over 2^32 rows below 2^63
    wide = not (4 * width * (largest * SCALE + 1) ** 2 < 2 ** 53 and largest * SCALE < 2 ** 30)
    numbers = Numbers(wide)
    cut = lambda x: integers(x, wide).reshape(len(x), PARTS, width)
    start = cut(np.stack(starters(rows, entries)))
    books = [start[:, p] for p in range(PARTS)]
    fields = {f.name: f.dataType for f in rows.schema}
    schema = STATE.format(label=fields["label"].simpleString(), item=fields["v"].elementType.simpleString())

    def assigned(books: list[np.ndarray], moved: list[np.ndarray] | None):
        def run(batches):
            import pyarrow as pa
            for batch in batches:
                for lo in range(0, batch.num_rows, BATCH):
                    part = batch.slice(lo, BATCH)
                    x = cut(vectors(part.column(2)))
                    if moved is None:
                        found = [nearest(x[:, p], books[p]) for p in range(PARTS)]
                    else:
                        code = np.frombuffer(b"".join(part.column(3).to_pylist()), dtype=np.uint8).reshape(len(x), PARTS)
                        dist = numbers.read(part.column(4).to_pylist())
                        found = [reassigned(x[:, p], books[p], moved[p], code[:, p].astype(np.int64), dist[:, p]) for p in range(PARTS)]
                    codes = [r.tobytes() for r in np.stack([c for c, _ in found], axis=1).astype(np.uint8)]
                    dists = numbers.write(np.stack([d for _, d in found], axis=1))
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(codes, pa.binary()), pa.array(dists, pa.binary())],
                                                     names=["id", "label", "v", "codes", "dists"])
        return run

    def sums(batches):
        """What one task adds to each entry."""
        import pyarrow as pa
        total, count = None, np.zeros((PARTS, entries), dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                x = cut(vectors(part.column(0)))
                code = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint8).reshape(len(x), PARTS)
                if total is None:
                    total = np.zeros((PARTS, entries, width), dtype=x.dtype)
                for p in range(PARTS):
                    np.add.at(total[p], code[:, p], x[:, p])
                    count[p] += np.bincount(code[:, p], minlength=entries)
        if total is not None:
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]),
                 pa.array([[str(v) for v in total[i, j].tolist()] for i, j in zip(p, e)], pa.list_(pa.string()))], names=["part", "entry", "n", "total"])

    def added(key, tasks):
        import pandas as pd
        total = [str(sum(map(int, c))) for c in zip(*tasks["total"])]
        return pd.DataFrame({"part": [key[0]], "entry": [key[1]], "n": [tasks["n"].sum()], "total": [total]})

    state = rows
    moved: list[np.ndarray] | None = None
    last = ""
    for turn in range(rounds + 1):
        state, path = written_at(state.mapInArrow(assigned(books, moved), schema), f"codes-{turn}")
        if moved is not None:
            discarded(spark, last)
        last = path
        if turn == rounds:
            return state, books, numbers
        means = state.select("v", "codes").mapInArrow(sums, "part int, entry int, n long, total array<string>").groupBy("part", "entry").applyInPandas(
            added, "part int, entry int, n long, total array<string>").collect()  # a row per used entry
        new = [b.copy() for b in books]
        for r in means:
            new[r["part"]][r["entry"]] = [int(t) // r["n"] for t in r["total"]]
        moved = [(a != b).any(axis=1) for a, b in zip(new, books)]
        books = new
    raise AssertionError("unreachable")


def compress(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256."""
    state, books, numbers = fit(embeddings, id_col, vector_col, label_col, entries, rounds)
    if state is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")

    def totals(batches):
        import pyarrow as pa
        for batch in batches:
            error = [min(LONGEST, int(e)) for e in numbers.read(batch.column(3).to_pylist()).sum(axis=1)]
            code = [c.hex() for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                                             names=["vec_id", "label", "code", "error"])

    kind = state.schema["label"].dataType.simpleString()
    rows = state.select("id", "label", "codes", "dists").mapInArrow(totals, f"vec_id long, label {kind}, code string, error long")
    # decimals hold the sum of any number of longs
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)"))
    per = rows.groupBy(F.col("label").alias("_of")).agg(whole.cast("long").alias("label_error"))
    return rows.join(per, F.col("label").eqNullSafe(F.col("_of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
