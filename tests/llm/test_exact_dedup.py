import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import op3_dedup as op
from riskweave.llm import registry, sql

from .helpers import SMALL, docs, same

ODD = [(5, "a  b"), (3, "a b"), (9, "a\tb"), (9, "a\tb"), (1, None), (2, ""), (7, " "), (8, "\n\n "), (11, "a b "), (None, "a b"),
       (None, "only"), (12, "a b"), (13, "x" * 200_000), (14, "x" * 200_000), (15, "x" * 199_999 + "y"), (16, "a b c"), (17, "a")]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), t in zip(rows, norm):
        ids = [j for (j, _), u in zip(rows, norm) if u == t]
        real = [j for j in ids if j is not None]
        out.append((i, min(real) if real else None, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_whole_table_equals_sql(spark):
    same(registry.queries()["op3_trie_dedup"](spark, SMALL), sql.OP3)


def test_awkward_rows(spark):
    for budget in (op.TRIE_BYTES, 2000):
        got = op.exact_dedup(docs(spark, ODD).repartition(3), budget=budget).collect()
        assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=repr) == brute(ODD)
        per = {}
        for r in got:
            per[r["text_sha256"]] = per.get(r["text_sha256"], 0) + r["kept"]
        assert set(per.values()) == {1}


def test_stage_keeps_one_row_of_each_text_with_its_columns(spark):
    d = docs(spark, ODD)
    out = op.keep_first(d)
    assert out.columns == d.columns
    assert out.count() == len({w[3] for w in brute(ODD)})


def test_empty(spark):
    assert op.exact_dedup(docs(spark, [])).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=30), st.integers(0, 29))
def test_trie_holds_every_key_once_and_gives_up_subtrees(keys, cut):
    trie, got = op.RadixTrie(), []
    for k, key in enumerate(keys):
        t = trie.terminal(key)
        t[:] = [key, (t[1] if t else 0) + 1]
        if k == cut:
            got += [(key, t[1]) for key, t in trie.largest_subtree()]
    got += [(key, t[1]) for key, t in trie.release()]
    total = {}
    for key, n in got:
        total[key] = total.get(key, 0) + n
    assert total == {k: keys.count(k) for k in keys}
