"""Fill-in-the-middle transformation by secondary-sort assembly (operator 11).

1. Each text is cut into units (white space with the word after it; white space at the end is a
   unit of its own). Two draws from the document's hash cut the units into prefix,
   middle and suffix, a third and a fourth choose the form.
2. The sections leave as pieces of at most ``PIECE_UNITS`` units and ``PIECE_BYTES`` bytes, keyed by the row
   and by their position in the output. A section's mark leads its first piece.
3. One shuffle by row, sorted by (row, position) within partitions, lets every row's output
   stream past in order: into an incremental digest, or joined to the output text.
4. Restoration reads that stream: a mark opens a section, the form gives the section's place, and
   a second sort inside the same partitions (no shuffle) streams the pieces in text order.

Only a row's current piece and digest are held, so a very long text needs no more memory than
a batch of pieces.

Defined results: null text is empty; empty texts and texts that hold a mark are plain; a null id draws
from ``<seed>:`` alone; rows that share an id each give a row; an empty table gives no rows;
further columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import prepared, text_bytes

SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80  # the query's contract
PIECE_UNITS, PIECE_BYTES = 1024, 1 << 16

MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PLACES = {MARKS["prefix"]: 0, MARKS["middle"]: 1, MARKS["suffix"]: 2}  # in the text

PIECE = "key long, position int, payload binary, doc_id long, n long, form string, prefix_chars long, middle_chars long"
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def unit_ends(text: bytes) -> np.ndarray:
    """Offsets (bytes) of the ends of a text's units."""
    b = np.frombuffer(text, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.int64)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    last = np.append(space[1:], True) & ~space
    last[-1] = True
    return np.nonzero(last)[0] + 1


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The first four 8-digit groups of the document's hash."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4)]


def chars(part: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int((np.frombuffer(part, dtype=np.uint8) & 0xC0 != 0x80).sum())


def sections(text: bytes, ends: np.ndarray, hashes: list[int], fim_percent: int = FIM_PERCENT,
             spm_percent: int = SPM_PERCENT) -> tuple[str, list[tuple[bytes, int, int]], int | None, int | None]:
    """(form, [(mark, from unit, to unit)] in output order, code points of prefix and middle)."""
    n, (h1, h2, h3, h4) = len(ends), hashes
    if not text or any(m in text for m in MARKS.values()) or h3 % 100 >= fim_percent:
        return "plain", [(b"", 0, n)], None, None
    form = "spm" if h4 % 100 < spm_percent else "psm"
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    spans = {"prefix": (0, one), "middle": (one, two), "suffix": (two, n)}
    at = [int(ends[k - 1]) if k else 0 for k in (one, two)]
    return form, [(MARKS[s], *spans[s]) for s in ORDERS[form]], chars(text[:at[0]]), chars(text[at[0]:at[1]])


def chunks(text: bytes, ends: np.ndarray, lo: int, hi: int):
    """The bytes of the units from ``lo`` to ``hi`` in pieces."""
    start = int(ends[lo - 1]) if lo else 0
    for unit in range(lo, hi, PIECE_UNITS):
        end = int(ends[min(unit + PIECE_UNITS, hi) - 1])
        for at in range(start, end, PIECE_BYTES):
            yield text[at:min(at + PIECE_BYTES, end)]
        start = end


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
           fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """The pieces of every row's output; what belongs to the whole row stands at its first piece."""
    prepared(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("key", pa.int64()), ("position", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()),
                            ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key, position, ends = key + 1, 0, unit_ends(text)
                form, parts, prefix, middle = sections(text, ends, draws(doc_id, seed), fim_percent, spm_percent)
                first = (doc_id, len(ends), form, prefix, middle)
                for mark, lo, hi in parts:
                    for payload in chunks(text, ends, lo, hi) if hi > lo else (b"",):
                        rows.append((key, position, mark + payload, *first))
                        size += len(payload) + 64
                        mark, first, position = b"", (None,) * 5, position + 1
                        if size > PIECE_BYTES * 16:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(run, PIECE)


def in_order(rows: DataFrame) -> DataFrame:
    """All pieces of a row in one partition, in the order of the output."""
    return rows.repartition("key").sortWithinPartitions("key", "position")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
              fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per document with the output text: doc_id, n, form, prefix_chars, middle_chars, output."""

    def run(batches):
        import pyarrow as pa
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        held, parts = None, []

        def rows(done):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

        for batch in batches:
            done = []
            for position, payload, *first in zip(*(batch.column(i).to_pylist() for i in range(1, 8))):
                if position == 0:
                    if held:
                        done.append((*held, b"".join(parts).decode()))
                    held, parts = first, []
                parts.append(payload)
            if done:
                yield rows(done)
        if held:
            yield rows([(*held, b"".join(parts).decode())])

    return in_order(pieces(docs, id_col, text_col, seed, fim_percent, spm_percent)).mapInArrow(run, f"{RESULT}, output string")


def restored(output: str, form: str) -> str:
    """The text of one output."""
    if form == "plain":
        return output
    at = sorted((output.index(m.decode()), m) for m in PLACES)
    spans = [(PLACES[m], output[lo + len(m):hi]) for (lo, m), hi in zip(at, [*(p for p, _ in at[1:]), len(output)])]
    return "".join(s for _, s in sorted(spans))


def restore(outputs: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "text") -> DataFrame:
    """``outputs`` with the text that each output was made from, as ``text_col``."""
    prepared(outputs.sparkSession)

    @F.pandas_udf("string")
    def back(output, form):
        import pandas as pd
        return pd.Series([None if o is None else restored(o, f) for o, f in zip(output, form)], dtype=object)

    return outputs.withColumn(text_col, back(output_col, form_col))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
            fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    ends_at = 1 << 30  # place of the row that carries what is known at the end of the output, before all pieces

    def outputs(batches):
        """Output order: digest of the output; each piece gets its place in the text."""
        import pyarrow as pa
        schema = pa.schema([("key", pa.int64()), ("place", pa.int32()), ("position", pa.int32()), ("payload", pa.binary()),
                            ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                            ("middle_chars", pa.int64()), ("output_sha256", pa.string())])
        held, digest, place = None, None, 0

        def summary():
            return (held[0], -1, ends_at, None, *held[1], digest.hexdigest())

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            out = []
            for key, position, payload, *first in zip(*(c.to_pylist() for c in batch.columns)):
                if position == 0:
                    if held:
                        out.append(summary())
                    held, digest, place = (key, first), hashlib.sha256(), 0
                digest.update(payload)
                if held[1][2] != "plain" and payload[:3] in PLACES:
                    place, payload = PLACES[payload[:3]], payload[3:]
                out.append((key, place, position, payload, *(None,) * 6))
            if out:
                yield table(out)
        if held:
            yield table([summary()])

    def texts(batches):
        """Text order: digest of the restored text."""
        import pyarrow as pa
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        held, digest = None, None

        def rows(done):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

        for batch in batches:
            done = []
            for place, payload, *first in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4, 5, 6, 7, 8, 9))):
                if place < 0:
                    if held:
                        done.append((*held, digest.hexdigest()))
                    held, digest = first, hashlib.sha256()
                else:
                    digest.update(payload)
            if done:
                yield rows(done)
        if held:
            yield rows([(*held, digest.hexdigest())])

    stream = in_order(pieces(docs, id_col, text_col, seed, fim_percent, spm_percent)).mapInArrow(
        outputs, f"key long, place int, position int, payload binary, {RESULT}, output_sha256 string")
    return stream.sortWithinPartitions("key", "place", "position").mapInArrow(
        texts, f"{RESULT}, output_sha256 string, restored_sha256 string")
