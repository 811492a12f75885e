"""Language-model scoring by relational stupid backoff (operator 7).

The model holds the counts of all n-grams up to ``order`` over the whole corpus. A document
is scored against the rest of the corpus: its own n-grams are taken off the counts.
S(w | context) = c(context w) / c(context) if that n-gram occurs elsewhere, else ALPHA
times the score with a shorter context; a single word has max(c, 1) / N. The document's score is the
mean natural logarithm over its words.

1. Documents are stored in units (rows of packed texts of about ``unit_bytes``), the exploded
   side of the join.
2. Every unit lists its distinct n-grams (64-bit hashes) with their counts, one row per range of
   the hash: pre-aggregated, so the most frequent n-gram is one entry per unit.
3. In a range the lists are added up to that part of the count tables and joined back: each
   list is answered with the corpus counts of its n-grams.
4. The answers meet their unit by its number, and every document's log scores are summed there.

Ranges hold n-grams by hash, so none is hot. Their number follows the words counted while the units are
written: a worker holds one range at a time, of about ``PART_GRAMS`` entries at most, however large the
corpus is. As it grows the ranges get narrower, until a row holds one n-gram of a unit, the plain relational form.

Defined results: a null or empty text has n_tokens 0 and a null score; every row, repeated ones
too, is a document of its own; words are maximal runs without ASCII white space, as
they are; an empty table gives no rows."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import prepared, text_bytes, written

ORDER = 2
ALPHA = 0.4
UNIT_BYTES = 8 << 20  # raw text of a unit
PART_GRAMS = 4_000_000  # n-grams of a range of the hash, counted before equal ones of a unit are put together
CACHED_WORDS = 200_000
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def packed_units(docs: DataFrame, id_col: str, text_col: str, unit_bytes: int) -> DataFrame:
    """(unit, ids, texts, tokens): documents in rows of about ``unit_bytes`` of text, zstd-packed, and their words."""
    import zstandard

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        ids, texts, size = [], [], 0

        def unit():
            lengths = np.array([len(t) for t in texts], dtype="<u4").tobytes()
            blob = zstandard.ZstdCompressor(3).compress(len(texts).to_bytes(4, "little") + lengths + b"".join(texts))
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([blob], pa.binary()),
                pa.array([words_in(b" ".join(texts))], pa.int64())], names=["unit", "ids", "texts", "tokens"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(text)
                size += len(text) + 16
                if size >= unit_bytes:
                    yield unit()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield unit()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(
        run, "unit long, ids array<long>, texts binary, tokens long")


def words_in(text: bytes) -> int:
    """The number of runs without white space."""
    blank = BLANK[np.frombuffer(text, dtype=np.uint8)]
    return int(np.count_nonzero(blank[:-1] & ~blank[1:]) + (len(blank) > 0 and not blank[0]))


def unpacked(blob: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, dtype="<u4", count=n, offset=4).astype(np.int64)) + 4 + 4 * n
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


class Grams:
    """Texts to the 64-bit hashes of the n-grams that end at each word."""

    def __init__(self, order: int):
        import xxhash

        class Hashes(dict):
            def __missing__(self, word):
                value = xxhash.xxh3_64_intdigest(word)
                if len(self) < CACHED_WORDS and len(word) <= 64:
                    self[word] = value
                return value

        self.order, self.hashes = order, Hashes()

    def __call__(self, text: bytes) -> list[np.ndarray]:
        """Per n: the hash of the n-gram ending at each word from the n-th on."""
        words = text.split()
        w = np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        out, h = [w], w
        for n in range(2, self.order + 1):
            h = (h[:-1] ^ (h[:-1] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w[n - 1:] if len(w) >= n else w[:0]
            out.append((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n))
        return out


def unit_grams(texts: list[bytes], grams: Grams) -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """(sorted distinct hashes, their counts, per document and n the positions in them)."""
    per = [grams(t) for t in texts]
    every = np.concatenate([g for doc in per for g in doc]) if per else np.zeros(0, np.uint64)
    known, where, counts = np.unique(every, return_inverse=True, return_counts=True)
    places, at = [], 0
    for doc in per:
        own = []
        for g in doc:
            own.append(where[at:at + len(g)])
            at += len(g)
        places.append(own)
    return known, counts, places


@lru_cache
def codec():
    """This worker's compressor and decompressor: rows may be small, so they are made once."""
    import zstandard

    return zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def squeezed(values: np.ndarray) -> bytes:
    """Integers as zstd over their bytes by significance."""
    return codec()[0].compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def spread(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(codec()[1].decompress(blob), dtype=np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


@lru_cache
def bounds_of(parts: int) -> np.ndarray:
    return np.array([(k << 64) // parts for k in range(parts)], dtype=np.uint64)


def parts_of(known: np.ndarray, parts: int) -> np.ndarray:
    """Where each range of the sorted hashes begins, and the end."""
    return np.concatenate([np.searchsorted(known, bounds_of(parts)), [len(known)]])


def scores(texts: list[bytes], counts: np.ndarray, places: list[list[np.ndarray]], total: int, alpha: float) -> list[float | None]:
    """Mean log stupid-backoff score of each document against the other documents."""
    out: list[float | None] = []
    for doc in places:
        n = len(doc[0])
        if not n:
            out.append(None)
            continue
        rest = []
        for where in doc:  # corpus counts less the document's own
            own, at, c = np.unique(where, return_inverse=True, return_counts=True)
            rest.append((counts[own] - c)[at].astype(np.float64))
        log = np.log(np.maximum(rest[0], 1.0)) - np.log(float(max(total - n, 1)))
        for k in range(1, len(doc)):
            if len(doc[k]):
                seen, context = rest[k], rest[k - 1][:len(rest[k])]
                with np.errstate(divide="ignore", invalid="ignore"):
                    log = np.concatenate([log[:k], np.where(seen > 0, np.log(seen) - np.log(context), np.log(alpha) + log[k:])])
        out.append(float(log.sum() / n))
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA,
          unit_bytes: int = UNIT_BYTES, part_grams: int = PART_GRAMS) -> DataFrame:
    """One row per document: doc_id, n_tokens, score (6 digits)."""
    spark = prepared(docs.sparkSession)
    units = written(packed_units(docs, id_col, text_col, unit_bytes), "units")
    total = int(units.agg(F.sum("tokens")).first()[0] or 0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * order // part_grams))

    def ask(batches):
        import pyarrow as pa
        grams = Grams(order)
        for batch in batches:
            for unit, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts = unpacked(blob.as_py())
                known, counts, _ = unit_grams(texts, grams)
                cut = parts_of(known, parts)
                some = np.flatnonzero(cut[:-1] < cut[1:]).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([unit] * len(some), pa.int64()), pa.array(some, pa.int32()),
                    pa.array([squeezed(known[cut[p]:cut[p + 1]]) for p in some], pa.binary()),
                    pa.array([squeezed(counts[cut[p]:cut[p + 1]].astype("<u4")) for p in some], pa.binary())],
                    names=["unit", "part", "grams", "counts"])

    def answer(batches):
        import pyarrow as pa

        def part(rows: list[tuple]):
            lists = [spread(r[2], "<u8") for r in rows]
            known, where = np.unique(np.concatenate(lists), return_inverse=True)
            counts = np.bincount(where, np.concatenate([spread(r[3], "<u4") for r in rows]), len(known)).astype("<u8")
            ends = np.cumsum([len(x) for x in lists])
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                pa.array([squeezed(counts[w]) for w in np.split(where, ends[:-1])], pa.binary())], names=["unit", "part", "counts"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][1] != row[1]:
                    yield part(held)
                    held = []
                held.append(row)
        if held:
            yield part(held)

    asked = units.select("unit", "texts").mapInArrow(ask, "unit long, part int, grams binary, counts binary")
    answers = written(asked.repartition("part").sortWithinPartitions("part").mapInArrow(
        answer, "unit long, part int, counts binary"), "answers")
    gathered = answers.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("part", "counts"))).alias("answers"))

    def add_up(batches):
        import pyarrow as pa
        grams = Grams(order)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("ids", "texts", "answers")}
                texts = unpacked(row["texts"])
                _, _, places = unit_grams(texts, grams)
                counts = [spread(a["counts"], "<u8").astype(np.int64) for a in row["answers"] or []]
                got = scores(texts, np.concatenate(counts) if counts else np.zeros(0, np.int64), places, total, alpha)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array([len(p[0]) for p in places], pa.int64()),
                                                  pa.array(got, pa.float64())], names=["doc_id", "n_tokens", "score"])

    raw = units.join(gathered, "unit", "left").select("ids", "texts", "answers").mapInArrow(
        add_up, "doc_id long, n_tokens long, score double")
    # rounded on a shifted grid, so that sums in another order round alike
    return raw.select("doc_id", "n_tokens", (F.round(F.col("score") * 1e6 - 0.3767) / 1e6).alias("score"))
