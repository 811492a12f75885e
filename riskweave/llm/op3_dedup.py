"""Exact deduplication by Patricia-trie owners (operator 3).

1. Every input partition inserts the full bytes of its normalised texts into a
   compressed radix trie whose terminal nodes hold the smallest (id, row) and the number
   of rows. A trie above its memory budget gives up its largest subtree: those terminals
   are passed on early and the same text later opens a new terminal. This is the
   pre-aggregation: a text that fills a third of all rows leaves a task as one row.
2. The passed-on texts are partitioned by length and content hash and sorted; the owner
   trie of each (length, hash) run decides by the full bytes which terminals are one text.
3. Every row carries the number of its first terminal (which holds its task's partition),
   so the way back is a narrow join in which even the hottest text has one key per task.

Texts are equal when identical after every run of ASCII white space became one space.
Defined results: null counts as empty; of rows that agree in text and id one stays (the
first read); a null id is larger than any id; any further columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import fresh, prepared, text_bytes, written

# Fixed value: a run of ASCII white space that is not already a single space.
WIDE_SPACE = rb"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
TRIE_BYTES = 48 << 20  # label bytes a map-side trie holds before it gives up a subtree


class RadixTrie:
    """Compressed trie over byte strings. A node is [label, children by first byte, terminal]."""

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.held = 0

    def terminal(self, key: bytes) -> list:
        """The terminal of ``key`` (a list the caller fills; empty when new)."""
        node, i = self.root, 0
        while i < len(key):
            child = node[1].get(key[i])
            if child is None:
                child = [key[i:], {}, None]
                node[1][key[i]] = child
                self.held += len(child[0]) + 300  # about what a node takes itself
            elif not key.startswith(child[0], i):
                label, j = child[0], _common(child[0], key, i)
                node[1][key[i]] = [label[:j], {label[j]: child}, None]
                child[0] = label[j:]
                child = node[1][key[i]]
                self.held += 300
            node, i = child, i + len(child[0])
        if node[2] is None:
            node[2] = []
        return node[2]

    def release(self, node: list | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """(key, terminal) of all terminals below a node."""
        stack = [(node or self.root, prefix)]
        while stack:
            (label, children, terminal), above = stack.pop()
            if terminal is not None:
                yield above + label, terminal
            stack += [(child, above + label) for child in children.values()]

    def largest_subtree(self) -> Iterator[tuple[bytes, list]]:
        """Cuts the subtree with the most bytes below the first branching and releases it."""
        node, prefix = self.root, b""
        while len(node[1]) == 1 and node[2] is None:
            node, prefix = next(iter(node[1].values())), prefix + node[0]
        if not node[1]:
            self.root, self.held = [b"", {}, None], 0
            yield from self.release(node, prefix)
            return
        first, size = max(((k, _size(c)) for k, c in node[1].items()), key=lambda x: x[1])
        child = node[1].pop(first)
        self.held -= size
        yield from self.release(child, prefix + node[0])


def _size(node: list) -> int:
    total, stack = 0, [node]
    while stack:
        x = stack.pop()
        total += len(x[0]) + 300
        stack += x[1].values()
    return total


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``."""
    lo, hi = 1, min(len(label), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if key.startswith(label[:mid], at):
            lo = mid
        else:
            hi = mid - 1
    return lo


def local_tries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                budget: int = TRIE_BYTES) -> DataFrame:
    """Step 1: one row per document (text null) and one per released terminal (text set)."""
    prepared(docs.sparkSession)

    def run(batches):
        import hashlib
        import re

        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        wide, trie, terminals, rows = re.compile(WIDE_SPACE), RadixTrie(), 0, 0
        names = ["doc_id", "row", "terminal", "sha", "n", "text"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def table(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        def passed_on(found):
            out, size = [], 0
            for key, (doc_id, row, n, terminal, sha) in found:
                out.append((doc_id, row, terminal, sha, n, key))
                size += len(key)
                if size > 4 << 20:
                    yield table(out)
                    out, size = [], 0
            if out:
                yield table(out)

        for batch in batches:
            members = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key, row = wide.sub(b" ", text), base + rows
                rows += 1
                t = trie.terminal(key)
                if not t:
                    t += [doc_id, row, 0, base + terminals, hashlib.sha256(key).hexdigest()]
                    terminals += 1
                t[2] += 1
                if doc_id is not None and (t[0] is None or doc_id < t[0]):
                    t[:2] = doc_id, row
                members.append((doc_id, row, t[3], t[4], None, None))
                while trie.held > budget:
                    yield from passed_on(trie.largest_subtree())
            if members:
                yield table(members)
        yield from passed_on(trie.release())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(
        run, "doc_id long, row long, terminal long, sha string, n long, text binary")


def owners(released: DataFrame) -> DataFrame:
    """Step 2: (terminal, keep_id, keep_row, group_size) for every released terminal."""

    def run(batches):
        import pyarrow as pa

        run_key, trie = None, RadixTrie()

        def rows(done: RadixTrie):
            out = [(terminal, keep_id, keep_row, n) for _, (keep_id, keep_row, n, members) in done.release()
                   for terminal in members]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                              names=["terminal", "keep_id", "keep_row", "group_size"])

        for batch in batches:
            for doc_id, row, terminal, sha, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                if run_key != (len(text), sha):
                    if run_key:
                        yield rows(trie)
                    run_key, trie = (len(text), sha), RadixTrie()
                t = trie.terminal(text)
                if not t:
                    t += [doc_id, row, 0, []]
                t[2] += n
                t[3].append(terminal)
                if doc_id is not None and (t[0] is None or (doc_id, row) < (t[0], t[1])):
                    t[:2] = doc_id, row
        if run_key:
            yield rows(trie)

    parts = released.repartition(F.octet_length("text"), "sha").sortWithinPartitions(F.octet_length("text"), "sha")
    return parts.select("doc_id", "row", "terminal", "sha", "n", "text").mapInArrow(
        run, "terminal long, keep_id long, keep_row long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                budget: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    both = written(local_tries(docs, id_col, text_col, budget), "tries")
    own = owners(both.where(F.col("text").isNotNull()))
    rows = both.where(F.col("n").isNull()).select("doc_id", "row", "terminal", "sha")
    return rows.join(own, "terminal").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, budget: int = TRIE_BYTES) -> DataFrame:
    """The rows that stay, with all their columns (pipeline stage). The row that stays is
    found again by id and text hash; of fully equal pairs of those, one row stays."""
    name, = fresh(docs, "key")
    key = lambda sha: F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), sha)
    kept = exact_dedup(docs, budget=budget).where("kept").select(key(F.col("text_sha256")).alias(name))
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)
    # one key, so that the join's partitioning serves the last step too: the texts move once
    return docs.withColumn(name, key(sha)).join(kept, name, "left_semi").dropDuplicates([name]).select(*[F.col(f"`{c}`") for c in docs.columns])
