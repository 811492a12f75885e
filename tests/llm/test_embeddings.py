import numpy as np

from riskweave.llm import op10_embed as op
from riskweave.llm import registry, sql

from .helpers import SMALL, partition, same


def test_whole_table_equals_sql(spark):
    same(registry.queries()["op10_embed_dedup"](spark, SMALL), sql.OP10)


def brute(rows):
    ok = {i: np.array(v, dtype=np.float64) for i, v in rows
          if v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)}
    pairs = [(a, b) for a in ok for b in ok if a != b and len(ok[a]) == len(ok[b])
             and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.95]
    low = partition(pairs, [i for i, _ in rows])
    return sorted((i, sum(a == i for a, _ in pairs), low[i], low[i] == i) for i, _ in rows)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, class int, n int")


def test_large_clusters_in_blocks(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((4, 24))
    rows = [(i, (centre[i % 4] + 0.22 * rng.standard_normal(24)).tolist()) for i in range(300)]
    rows += [(1000 + i, rng.standard_normal(24).tolist()) for i in range(100)] + [(2000 + i, rows[5][1]) for i in range(40)]
    got = op.near_links(vectors(spark, rows), block=16).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_awkward_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, float("nan")]), (5, [1.0, None]), (6, [1.0, 2.0]), (7, [2.0, 4.0]),
            (8, [1.0, 2.0]), (9, [1.0, 2.0, 0.0]), (10, [float("inf"), 1.0]), (11, [-1.0, -2.0]), (12, [3.0]), (13, [5.0]), (14, [-5.0])]
    assert sorted(map(tuple, op.near_links(vectors(spark, rows)).collect())) == brute(rows)


def test_very_large_and_very_small_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal(16)
    rows = [(i, (base * 10.0 ** e).tolist()) for i, e in enumerate((200, -200, 0, 307, -300), start=1)]
    rows += [(10 + i, (rng.standard_normal(16) * 10.0 ** e).tolist()) for i, e in enumerate((200, -200, 0))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in op.near_links(vectors(spark, rows)).collect()}
    assert all(got[i] == (4, 1) for i in range(1, 6)) and all(got[i] == (0, i) for i in (10, 11, 12))


def test_scaling_is_exact():
    x = np.random.default_rng(1).standard_normal((50, 8))
    y = op.scaled(x)
    assert (np.abs(y).max(axis=1) < 1).all() and (np.abs(y).max(axis=1) >= 0.5).all()
    assert (x @ x.T / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1))) == y @ y.T / np.sqrt(np.outer((y * y).sum(1), (y * y).sum(1)))).all()


def test_empty(spark):
    assert op.near_links(vectors(spark, [])).collect() == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64))
    x[200:] = x[:200] + 0.3 * x[200:]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z, s, c, bound = op.codes(x)
    true, est = x @ x.T, (s @ z.T) / c[:, None]
    assert np.abs((est - true)[np.triu_indices(400, 1)].mean()) < 0.01
    assert (np.abs(est - true) <= bound[:, None] + 1e-6).mean() > 0.9999
