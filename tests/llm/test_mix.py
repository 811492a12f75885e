from collections import Counter

from riskweave.llm import op1_mix as op
from riskweave.llm import registry, sql

from .helpers import SMALL, same


def test_whole_table_equals_sql(spark):
    same(registry.queries()["op1_pfair_mix"](spark, SMALL), sql.OP1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, rank int, share string")


def test_every_source_stays_within_one_block_of_its_share(spark):
    rows = [(i, f"s{min(i % 13, 6)}") for i in range(900)]
    weights = {"s0": 0.5, "s1": 0.2, "s2": 0.11, "s3": 0.09, "s4": 0.05, "s5": 0.04, "s6": 0.01}
    got = op.mix(frame(spark, rows), weights, block_rows=1, frame=100).collect()
    assert {r["doc_id"] for r in got} == set(range(900))
    by_slot = {r["slot"]: r["source"] for r in got}
    assert sorted(by_slot) == list(range(len(got)))  # one block a slot, none empty
    share = {k: v / 100 for k, v in Counter(by_slot[s] for s in range(100)).items()}  # one frame
    assert all(abs(share[k] - w) <= len(weights) / 100 for k, w in weights.items())
    done = Counter()
    for slot in range(len(got)):
        done[by_slot[slot]] += 1
        for k, w in share.items():
            assert abs(w * (slot + 1) - done[k]) < 1


def test_awkward_rows(spark):
    rows = [(1, None), (2, None), (None, "a"), (3, "a"), (3, "a"), (3, "a"), (3, "b"), (4, "")] + [(i, "big") for i in range(100, 200)]
    got = op.mix(frame(spark, rows), block_rows=4, frame=20).collect()
    once = Counter((r["doc_id"], r["source"]) for r in got if r["epoch"] == 0)
    assert once == Counter(rows)
    assert len({r["position"] for r in got}) == len(got)


def test_stage_keeps_columns_order_and_every_row(spark):
    d = spark.createDataFrame([(i, f"t{i}", f"s{i % 3 if i < 40 else 0}") for i in range(80)], "doc_id long, text string, source string")
    out = op.mixed(d)
    assert out.columns == d.columns and {r["doc_id"] for r in out.collect()} == set(range(80))


def test_empty(spark):
    assert op.mix(frame(spark, [])).collect() == []


def test_native(spark):
    plan = registry.queries()["op1_pfair_mix"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_stage_follows_the_target_not_a_frame(spark):
    sizes = {f"s{k}": 1 for k in range(599)} | {"big": 6000}
    d = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    got = Counter(r["source"] for r in op.mixed(d).collect())
    root = {s: n ** 0.75 for s, n in sizes.items()}
    slots = op.nested_rows(list(sizes.items()), None, op.BLOCK_ROWS)[0][4] + 1
    assert abs(got["big"] / op.BLOCK_ROWS - slots * root["big"] / sum(root.values())) < 2 + 1


def test_places_stay_within_two_blocks_of_the_target(spark):
    sizes = {"a": 3000, "b": 700, "c": 40, "d": 3, "e": 1, None: 5}
    d = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    for weights, never in ((None, set()), ({"a": 0.9, "b": 0.0895, "c": 0.01, "d": 0.0005}, {"e", None})):
        got = op.places(d, weights, block_rows=1).collect()
        assert {r["doc_id"] for r in got} == set(range(sum(sizes.values())))
        by_slot = {r["slot"]: r["source"] for r in got}
        assert sorted(by_slot) == list(range(len(got)))  # one block a slot, none empty
        target = weights or {s: n ** 0.75 for s, n in sizes.items()}
        stream, done = len(got) - sum(sizes[s] for s in never), Counter()
        assert all(by_slot[slot] in never for slot in range(stream, len(got)))
        for slot in range(stream):
            done[by_slot[slot]] += 1
            for s, w in target.items():
                assert abs(w / sum(target.values()) * (slot + 1) - done[s]) < 2
