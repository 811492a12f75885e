import random
import zlib
from functools import cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import op2_pack as op

from .helpers import docs, table_rows


@cache
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(op.tokenizer_path())


def whole_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_ids_equal_the_tokenizer_on_whole_texts(spark):
    texts = [(r["doc_id"], r["text"]) for r in table_rows("documents")]
    odd = ["", None, "a" * 5000, "x <|endoftext|> y", "it's  I'll we\x1cre é ́ ẛ̣", "日本語 テキスト", " a\x85b", "1234 5.6!?",
           "Wait... (THE <|ENDOFTEXT|> END), o'clock 'tis y'all've. x\u20ac. A\u0301. \u0130stanbul. \ufb01ne, \u01c5. a'.b %.%",
           "<|endoftext|>The End.", "mother-in-law's 3.5 x. y, Z!? .a ,b.c"]
    texts += [(10_000 + i, t) for i, t in enumerate(odd)] + [(10_003, odd[3])]
    got = op.pack_documents(docs(spark, texts), capacity=512).collect()
    want = []
    for i, t in texts:
        ids = whole_ids(t)
        for p, at in enumerate(range(0, len(ids), 512)):
            own = np.array(ids[at:at + 512], dtype="<u4").tobytes()
            want.append((i, p, at, len(own) // 4, zlib.crc32(own)))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    total = sum(r["length"] for r in got)
    n = check_packing(got, 512)
    assert n <= 1.02 * total / 512 + 2


def test_empty_table(spark):
    assert op.pack_documents(docs(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 7), max_size=12), st.integers(30, 40))
def test_plan_places_every_piece_once(counts, capacity):
    rows = op.plan_sequences(counts, capacity)
    out = []
    for length, c in counts.items():
        own = [r for r in rows if r[0] == length]
        for rank in range(c):
            _, first, m, seq, off = [r for r in own if r[1] <= rank][-1]
            k = rank - first
            out.append({"sequence_id": seq + k // m, "offset": off + k % m * length, "length": length})
    n = check_packing(out, capacity)
    total = sum(k * v for k, v in counts.items())
    assert -(-total // capacity) <= n <= max(1, 1.25 * first_fit(counts, capacity) + 1) or not counts


def first_fit(counts, capacity):
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            i = next((i for i, r in enumerate(bins) if r >= length), None)
            if i is None:
                bins.append(capacity - length)
            else:
                bins[i] -= length
    return len(bins)


def optimum(items, capacity, used=()):
    if not items:
        return len(used)
    best = None
    for i, r in enumerate(used):
        if r >= items[0] and r not in used[:i]:
            n = optimum(items[1:], capacity, used[:i] + (r - items[0],) + used[i + 1:])
            best = n if best is None else min(best, n)
    n = optimum(items[1:], capacity, used + (capacity - items[0],))
    return n if best is None else min(best, n)


def test_dominated_sets_belong_to_an_optimal_packing():
    rng = random.Random(5)
    for _ in range(150):
        items = sorted((rng.randint(2, 10) for _ in range(rng.randint(1, 7))), reverse=True)
        counts = {x: items.count(x) for x in items}
        fixed, rest = op.dominated_sets(counts, 12)
        left = sorted((x for x, n in rest.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + optimum(left, 12) == optimum(items, 12)
