import random

import numpy as np

from riskweave.llm import op5_minhash as op
from riskweave.llm import registry, sql
from riskweave.llm.components import components, spanning

from .helpers import SMALL, docs, partition, same


def test_whole_table_equals_sql(spark):
    same(registry.queries()["op5_minhash_forest"](spark, SMALL), sql.OP5)


def shingles(text, k=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    pairs = [(a, b) for (a, _), s in zip(rows, sets) for (b, _), u in zip(rows, sets)
             if a is not None and b is not None and s and u and 100 * len(s & u) >= 80 * len(s | u)]
    low = partition(pairs, [i for i, _ in rows if i is not None])
    return sorted((i, len(s), low[i], low[i] == i) for (i, _), s in zip(rows, sets) if i is not None)


def groups(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for g in range(6):
        base = [word() for _ in range(60 + 40 * g)]
        for k in range(50 if g == 0 else 6):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = word()
            rows.append((1000 * g + k, " ".join(t)))
    shared = " ".join(word() for _ in range(60))
    rows += [(9000 + k, shared + " " + " ".join(word() for _ in range(40))) for k in range(60)]
    return rows


def test_groups_equal_brute_force_also_in_small_windows(spark):
    rows = groups()
    for region, unit in ((op.REGION, op.UNIT), (24, 40)):
        got = op.near_dedup(docs(spark, rows), region=region, unit=unit).collect()
        assert sorted(map(tuple, got)) == brute(rows)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two three"), (7, "ONE\ttwo  three"), (8, "one two three four"),
            (9, "one two three four"), (9, "one two three four"), (10, "x " * 50_000), (11, "x " * 40_000), (12, "É a b c"), (13, "é a b c")]
    got = op.near_dedup(docs(spark, rows + [(None, "one")])).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == brute(rows)


def test_empty_and_stage(spark):
    assert op.near_dedup(docs(spark, [])).collect() == []
    d = docs(spark, groups()[:60] + [(99_999, None)])
    out = op.keep_one(d)
    assert out.columns == d.columns
    assert 99_999 in {r["doc_id"] for r in out.collect()}


def test_estimates_are_unbiased():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        common, rest = rng.integers(0, 1 << 63, 160, dtype=np.uint64), rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        a, b = op.minima(np.concatenate([common, rest[:20]])), op.minima(np.concatenate([common, rest[20:]]))
        errors.append((a == b).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.055


def test_components_and_spanning(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = partition(edges, {x for e in edges if e[0] != e[1] for x in e})
    assert got == low
    a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    forest = spanning(a, b, 131)
    assert partition(forest, range(131)) == partition(edges, range(131))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def family(members, seed=7):
    """Texts of one template (pairs below the threshold, mostly above ``LEAST``), every text with one partner that links with it."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared, texts = [word() for _ in range(88)], []
    for _ in range(members // 2):
        a = shared + [word() for _ in range(16)]
        texts += [a, a[:-4] + [word() for _ in range(4)]]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_partners_in_a_large_family_meet_whatever_the_partitions(spark):
    rows = family(600)
    want = brute(rows)
    assert 250 < sum(r[3] for r in want) < 350
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert sorted(map(tuple, op.near_dedup(docs(spark, rows), region=24, unit=40).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_overlaps_equal_python_sets():
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.choice(m, k)).astype(np.uint64) for m, k in [(20, 30), (40, 30), (5000, 60), (1, 0)] * r] for r in (9, 7))
    assert op.overlaps(a, b).tolist() == [[len(set(x) & set(y)) for y in map(np.ndarray.tolist, b)] for x in map(np.ndarray.tolist, a)]
    assert op.overlaps([a[3]], [b[3]]).tolist() == [[0]]
