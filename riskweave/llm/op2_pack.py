"""Best-fit packing of tokenised documents (operator 2).

Documents are tokenised once into pieces of at most ``capacity`` tokens. Packing only
depends on the lengths, so the whole instance is its histogram: at most ``capacity``
rows whatever the corpus. The driver solves that histogram and the pieces take their
places by their rank inside their length.

* Martello-Toth dominance: for the longest pieces, sets of at most three pieces that
  dominate every other set with that piece are fixed for good (alone if nothing fits
  beside it; with its exact complement; with the longest fitting piece if no two others
  fit, or if no fitting pair is longer and no three fit), with all their copies at once.
* The rest is packed best fit, longest first, again by counts.

Defined results: a null or empty text is one piece holding only the end id; documents of
any length are cut every ``capacity`` tokens; repeated rows are packed as often as they
occur; an empty table gives no rows; only the id and text columns are read."""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import prepared, ranked, text_bytes, written

CAPACITY = 2048
CACHED_WORDS = 300_000  # words a worker remembers the ids of, in each of two generations


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


# Fixed value: an ASCII sign, apostrophe aside, right after a letter always begins a new token.
SIGN_AFTER_LETTER = re.compile(rb"(?<=[a-z])[!-&(-/:-@\[-`{-~]")


def words_of(text: bytes) -> list[bytes]:
    """Parts of a text that the tokenizer encodes independently: it drops white space and
    never joins ids over it, folds case, and ends a word before a sign. A text that may hold
    the tokenizer's special strings is only split at white space."""
    if b"<|" in text:
        return text.split()
    return SIGN_AFTER_LETTER.sub(rb" \g<0>", text.lower()).split()


@lru_cache(maxsize=1)
def word_ids(path: str) -> "WordIds":
    """One for each Python worker, which serves many tasks."""
    return WordIds(path)


class WordIds:
    """Ids of words as bytes; frequent words are remembered."""

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.ids: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # the generation before; what is met again moves on
        self.long: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Encodes the words not known yet. Words of letters alone are encoded together, one
        token word each; if that does not hold, and all others, one by one."""
        if len(self.ids) > CACHED_WORDS:
            self.older, self.ids = self.ids, {}
        self.long = {}
        letters, others = [], []
        for w in words:
            if w in self.ids:
                continue
            if w in self.older:
                self.ids[w] = self.older[w]
                continue
            (letters if len(w) <= 64 and w.decode("utf-8", "replace").isalpha() else others).append(w)
        for at in range(0, len(letters), 10_000):
            part = letters[at:at + 10_000]
            e = self.tok.encode(" ".join(w.decode() for w in part), add_special_tokens=False)
            word, ids = np.asarray(e.word_ids), np.asarray(e.ids, dtype="<u4")
            cuts = [0, *(np.nonzero(np.diff(word))[0] + 1).tolist(), len(ids)]
            if len(cuts) != len(part) + 1:
                others += part
                continue
            raw = ids.tobytes()
            self.ids.update(zip(part, [raw[4 * a:4 * b] for a, b in zip(cuts, cuts[1:])]))
        for w, e in zip(others, self.tok.encode_batch([w.decode("utf-8", "replace") for w in others], add_special_tokens=False)):
            (self.ids if len(w) <= 64 else self.long)[w] = np.asarray(e.ids, dtype="<u4").tobytes()

    def of(self, words: list[bytes]) -> bytes:
        try:
            return b"".join(map(self.ids.__getitem__, words))
        except KeyError:
            return b"".join([self.ids[w] if w in self.ids else self.long[w] for w in words])


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every document."""
    prepared(docs.sparkSession)
    path = path or tokenizer_path()

    def run(batches):
        import zlib

        import pyarrow as pa

        known = word_ids(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = [words_of(t) for t in part.column(1).to_pylist()]
                known.learn(set().union(*lists))
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, words in zip(part.column(0).to_pylist(), lists):
                    ids = known.of(words) + b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at:at + 4 * capacity]
                        for col, v in zip(out, (doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own))):
                            col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Lengths:
    """Counts of pieces by length, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.n)

    def take(self, length: int, k: int) -> None:
        self.n[length] -= k
        if not self.n[length]:
            del self.n[length]
            self.order.remove(length)

    def smallest_beside(self, length: int, k: int) -> list[int]:
        """The k smallest pieces when one of ``length`` is set aside."""
        out: list[int] = []
        for x in self.order:
            out += [x] * min(k - len(out), self.n[x] - (x == length))
            if len(out) == k:
                break
        return out

    def largest_beside(self, length: int, room: int) -> int | None:
        at = bisect_right(self.order, room) - 1
        if at >= 0 and self.order[at] == length and self.n[length] == 1:
            at -= 1
        return self.order[at] if at >= 0 else None

    def best_pair_beside(self, length: int, room: int) -> int:
        """The largest sum of two pieces that fits into ``room`` beside one of ``length``."""
        left = lambda x: self.n[x] - (x == length)
        fits = [x for x in self.order[:bisect_right(self.order, room)] if left(x)]
        best, lo, hi = 0, 0, len(fits) - 1
        while lo <= hi:
            pair = fits[lo] + fits[hi]
            if pair <= room:
                if lo < hi or left(fits[lo]) > 1:
                    best = max(best, pair)
                lo += 1
            else:
                hi -= 1
        return best


def dominated_sets(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello-Toth reduction: (fixed sets with their number, what remains)."""
    left, fixed = _Lengths(counts), []
    changed = True
    while changed:
        changed = False
        for length in list(reversed(left.order)):
            while left.n.get(length):
                room, n = capacity - length, left.n[length]
                other = None
                if room in left.n and (room != length or n > 1):
                    other = room
                else:
                    small = left.smallest_beside(length, 3)
                    if not small or small[0] > room:
                        fixed.append(((length,), n))
                        left.take(length, n)
                        changed = True
                        break
                    largest = left.largest_beside(length, room)
                    if len(small) < 2 or small[0] + small[1] > room:
                        other = largest
                    elif (len(small) < 3 or sum(small) > room) and largest >= left.best_pair_beside(length, room):
                        other = largest
                if other is None:
                    break
                k = n // 2 if other == length else min(n, left.n[other])
                fixed.append(((length, other), k))
                if other == length:
                    left.take(length, 2 * k)
                else:
                    left.take(length, k)
                    left.take(other, k)
                changed = True
    return fixed, dict(left.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: equal sequences are held as one group. A piece
    goes where the least room remains, so a sequence takes copies of one length as long as they fit."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((lengths, n))

    for length in sorted(counts, reverse=True):
        c = counts[length]
        for room in [r for r in rooms if r >= length]:
            m = room // length
            waiting = groups.pop(room)
            rooms.remove(room)
            for lengths, n in waiting:
                full = min(n, c // m)
                rest = min(c - full * m, m) if full < n else 0
                put(room - m * length, lengths + (length,) * m, full)
                put(room - rest * length, lengths + (length,) * rest, 1 if rest else 0)
                put(room, lengths, n - full - (1 if rest else 0))
                c -= full * m + rest
        if c:
            m = capacity // length
            put(capacity - m * length, (length,) * m, c // m)
            put(capacity - (c % m) * length, (length,) * (c % m), 1 if c % m else 0)
    return [g for room in rooms for g in groups[room]]


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, copies per sequence, first sequence, first offset) of every
    place of every set, sorted: piece ``rank`` of ``length`` goes by its last row not
    above it to sequence first + (rank - first rank) // copies."""
    fixed, rest = dominated_sets(counts, capacity)
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for lengths, n in fixed + best_fit(rest, capacity):
        offset = 0
        for length in dict.fromkeys(lengths):
            m = lengths.count(length)
            rows.append((length, used[length], m, sequence, offset))
            used[length] += m * n
            offset += m * length
        sequence += n
    return sorted(rows)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    sizes = {r["length"]: r["n"] for r in
             pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = plan_sequences(sizes, capacity)

    def run(frames):
        rows = np.array(plan, dtype=np.int64).reshape(-1, 5)
        starts = (rows[:, 0] << 48) | rows[:, 1]
        for f in frames:
            length, rank = f["length"].to_numpy(), f["rank"].to_numpy()
            own = rows[np.searchsorted(starts, (length << 48) | rank, side="right") - 1]
            k = rank - own[:, 1]
            f["sequence_id"] = own[:, 3] + k // own[:, 2]
            f["offset"] = own[:, 4] + (k % own[:, 2]) * length
            yield f.drop(columns=["rank"])

    placed = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32"])
    return placed.select(*pieces.columns, "rank").mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and its place there."""
    return pack(written(token_pieces(docs, path, capacity, id_col, text_col), "pieces"), capacity)
