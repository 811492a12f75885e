import math
from collections import Counter

import numpy as np

from riskweave.llm import op7_lm as op
from riskweave.llm import registry, sql

from .helpers import SMALL, docs, same


def test_whole_table_equals_sql(spark):
    same(registry.queries()["op7_backoff_score"](spark, SMALL), sql.OP7)


def brute(rows, order):
    words = [(t or "").encode().split() for _, t in rows]
    grams = lambda w: Counter(tuple(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    every = sum((grams(w) for w in words), Counter())
    total = sum(map(len, words))
    out = []
    for (i, _), w in zip(rows, words):
        c = Counter(every)
        c.subtract(grams(w))
        s = 0.0
        for k in range(len(w)):
            factor = 1.0
            for n in range(min(order, k + 1), 0, -1):
                g = tuple(w[k - n + 1:k + 1])
                if n == 1:
                    s += math.log(factor * max(c[g], 1) / max(total - len(w), 1))
                elif c[g] > 0:
                    s += math.log(factor * c[g] / c[g[:-1]])
                    break
                factor *= op.ALPHA
        out.append((i, len(w), round(s / len(w), 4) if w else None))
    return sorted(out, key=repr)


def test_awkward_rows_and_higher_order(spark):
    rows = [(1, "a b c a b"), (2, "a b c"), (2, "a b c"), (3, None), (4, " "), (5, "a"), (6, "z z z z"), (7, "b c " * 3000), (None, "c a b x")]
    for order in (1, 2, 3):
        got = op.score(docs(spark, rows).repartition(3), order=order, unit_bytes=20).collect()
        assert sorted(((r[0], r[1], None if r[2] is None else round(r[2], 4)) for r in got), key=repr) == brute(rows, order)


def test_narrow_ranges_of_the_hash_change_nothing(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 23}" for k in range(i % 40))) for i in range(120)]
    want = brute(rows, 3)
    for grams in (1, 50, 10**6):  # thousands of ranges down to the shuffle setting
        got = op.score(docs(spark, rows).repartition(3), order=3, unit_bytes=300, part_grams=grams).collect()
        assert sorted(((r[0], r[1], None if r[2] is None else round(r[2], 4)) for r in got), key=repr) == want


def test_words_are_counted_as_they_are_split():
    for text in (b"", b" ", b"a", b" a", b"a ", b"a b\tc\x0bd\x0c\r\n e", "é\u00a0x\u2003y \x1c z".encode(), b"\x85 \x1f"):
        assert op.words_in(text) == len(text.split())


def test_empty(spark):
    assert op.score(docs(spark, [])).collect() == []


def test_packing_of_numbers_is_exact():
    v = np.random.default_rng(0).integers(0, (1 << 64) - 1, 1000, dtype=np.uint64)
    assert (op.spread(op.squeezed(v), "<u8") == v).all()
    cut = op.parts_of(np.sort(v), 7)
    assert cut[0] == 0 and cut[-1] == 1000 and (np.diff(cut) > 90).all()
