import hashlib
import math

import numpy as np

from riskweave.llm import op12_codes as op
from riskweave.llm import registry, sql

from .helpers import SMALL, same

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, id string, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", -1, "y", 0) for i, v, y in rows], SCHEMA)


def brute(rows, entries=256, rounds=4):
    """Plain Lloyd in Python's integers; every part always rescans its whole codebook."""
    fine = [(i, v, y) for i, v, y in rows if v and len(v) % 4 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fine = [r for r in fine if len(r[1]) == len(fine[0][1])]
    if not fine:
        return []
    w = len(fine[0][1]) // 4
    q = [[math.floor(x * 1024) if abs(x) < 2 ** 52 else int(x) * 1024 for x in v] for _, v, _ in fine]
    parts = [[tuple(v[p * w:p * w + w]) for v in q] for p in range(4)]
    books = [xs[:entries] for xs in parts]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book)) for x in xs] for xs, book in zip(parts, books)]

    for _ in range(rounds):
        best = assign()
        for p in range(4):
            for k in range(len(books[p])):
                own = [x for x, (_, c) in zip(parts[p], best[p]) if c == k]
                if own:
                    books[p][k] = tuple(sum(c) // len(own) for c in zip(*own))
    best = assign()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [min(op.LONGEST, sum(best[p][k][0] for p in range(4))) for k in range(len(fine))]
    of = {}
    for (_, _, y), e in zip(fine, error):
        of[y] = of.get(y, 0) + e
    return [(i, "".join(f"{best[p][k][1]:02x}" for p in range(4)), error[k], min(op.LONGEST, of[y]), digest) for k, (i, _, y) in enumerate(fine)]


def check(spark, rows, **more):
    got = sorted(map(tuple, op.compress(table(spark, rows), **more).collect()), key=repr)
    assert got == sorted(brute(rows, **more), key=repr)
    return got


def test_whole_table_equals_sql(spark):
    same(registry.queries()["op12_active_lloyd"](spark, SMALL), sql.OP12)


def test_equals_plain_lloyd(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(0, 0.1, 8).tolist(), int(i % 3)) for i in rng.permutation(500)]
    check(spark, rows, entries=16)


def test_ties_repeats_and_awkward_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-2, 3, 8) / 512).tolist(), None if i % 4 == 0 else i % 2) for i in range(300)]
    rows += [(i, list(rows[i][1]), 5) for i in range(40)]  # ids again
    rows += [(900, None, 1), (-5, [0.5, None] * 4, 1), (901, [float("nan")] * 8, 1), (902, [float("inf")] * 8, 2), (903, [], 1),
             (904, [1.0] * 6, 1), (905, [1.0] * 12, 1), (None, [0.25] * 8, 7), (906, [0.0] * 8, None), (907, [-0.0] * 8, None)]
    got = check(spark, rows, entries=32)
    assert not {-5, 900, 901, 902, 903, 904, 905} & {r[0] for r in got}


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 1, 4) * 10.0 ** rng.integers(-3, 30)).tolist(), i % 2) for i in range(60)] + [(99, [1e308, -1e308, 5e-324, 1.0], 0)]
    got = check(spark, rows, entries=8)
    assert max(r[2] for r in got) == op.LONGEST
    check(spark, [(i, (rng.normal(0, 1, 4) * 3e6).tolist(), 0) for i in range(60)], entries=8)


def test_few_rows_and_empty(spark):
    check(spark, [(3, [0.1, 0.2, 0.3, 0.4], 1)])
    assert check(spark, []) == [] and check(spark, [(1, None, 1)]) == []


def test_reassigned_equals_a_whole_scan():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x, old = rng.integers(-4, 5, (200, 3)), rng.integers(-4, 5, (20, 3))
        moved = rng.random(20) < rng.random()
        new = np.where(moved[:, None], rng.integers(-4, 5, (20, 3)), old)
        want, got = op.nearest(x, new), op.reassigned(x, new, moved, *op.nearest(x, old))
        assert (want[0] == got[0]).all() and (want[1] == got[1]).all()
