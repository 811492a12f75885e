import random
import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import op8_pii as op
from riskweave.llm import registry

from .helpers import SMALL, docs, table_rows

CARD = "4929348385146306"  # passes Luhn


def plain(text):
    """The contract's patterns as they stand."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.@-+ %()0123459é_", max_size=40))
def test_base_spans_equal_the_plain_patterns(text):
    assert op.base_spans(text) == plain(text)


def said(spans):
    return ",".join(f"{op.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_whole_table_keeps_every_base_span(spark):
    got = {r["doc_id"]: r for r in registry.queries()["op8_personal_data"](spark, SMALL).collect()}
    rows = table_rows("documents")
    assert len(got) == len(rows)
    for r in rows:
        base, g = plain(r["text"] or ""), got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(said(base).encode()).hexdigest()
        assert [g[f"n_{k}"] for k in op.KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        every = g["spans"].split(",") if g["spans"] else []
        assert set(said(base).split(",")) - {""} <= set(every)
        if not re.search(r"[0-9@]", r["text"] or ""):
            assert not every


def test_trees_add_cards_of_merged_runs_and_leave_clean_texts(spark):
    bad = CARD[:-1] + str((int(CARD[-1]) + 1) % 10)
    rows = [(i, f"some words é {CARD} and more words {i % 7}") for i in range(60)]
    rows += [(100 + i, f"some words {bad} and more words") for i in range(60)]
    rows += [(300, f"two at once {CARD} 4845168114407329 here"), (301, "clean words only"), (302, None), (303, ""), (304, "token = \"04dbebab91ab85687d33eeaaf9ac699e\"")]
    rows += [(305, "5" * 100_000), (305, "a@b.co, 1.2.3.4 +1 (017) 555-7713")]
    got = {}
    for r in op.find(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[0][0]["spans"] == "card:13:29" and got[100][0]["spans"] == ""
    assert "card:12:28" in got[300][0]["spans"] and got[300][0]["n_card"] == 0
    assert all(got[i][0]["spans"] == "" for i in (301, 302, 303, 304))
    assert sorted(r["spans"] for r in got[305]) == ["", "email:0:6,ip:8:15,phone:16:33"]


def test_empty_and_without_labels(spark):
    assert op.find(docs(spark, [])).collect() == []
    assert [r["spans"] for r in op.find(docs(spark, [(1, "no data"), (1, "no data")])).collect()] == ["", ""]


HARD = ["ISBN 978 030 640 615 7 is a book", "scores 100 200 300 were seen", "version 1.2.3.4.5.6 came", "ref 2024 0115 1230 00 was", "order 555 123 4567"]


def test_other_numbers_are_negatives_and_labels_are_no_features():
    for text in HARD:
        for s, k, e in op.proposals(text):
            assert op.label(text, s, k, e, False) == 0, (text, text[s:e])
    text = "call 555 123 4567 now, or visa 4111 1111 1111 1111"
    assert {op.label(text, s, k, e, False) for s, k, e in op.proposals(text) if text[s:e] in ("555 123 4567", "4111 1111 1111 1111") and k == (3 if s < 20 else 2)} == {1}
    # two candidates of one shape, one passing Luhn: the trees see no difference
    a, b = "x 4111 1111 1111 1111 y", "x 4111 1111 1111 1112 y"
    assert op.features(a, 2, 2, 21) == op.features(b, 2, 2, 21) and op.possible(2, a[2:21]) != op.possible(2, b[2:21])


def test_hard_negatives_are_not_added(spark):
    from .helpers import docs
    good = ["call 555 123 4567 today", "phone 030 1234 5678 9 works", "mail bob(at)example.org soon", "host 10.2.3.4 is up", "visa 4111 1111 1111 1111 paid"]
    rows = [(i, (good + HARD)[i % 10] + f" line {'abcdefghij'[i % 7]}") for i in range(600)]
    out = {r["doc_id"]: r["spans"] for r in op.find(docs(spark, rows)).collect()}
    kinds = {4: "card"}
    for i, text in rows:
        if i % 10 >= 5:
            assert not [x for x in out[i].split(",") if x and not x.startswith(tuple(f"{op.KINDS[k]}:{s}:{e}" for s, k, e in op.base_spans(text)))], text


def test_placed_equals_all_pairs():
    rng = random.Random(6)
    for _ in range(60):
        spans = [(s, rng.randrange(4), s + rng.randint(1, 12)) for s in (rng.randrange(200) for _ in range(40))]
        base, added = spans[:8], spans[8:]
        taken, want = list(base), []
        for x in added:
            if all(x[2] <= s or x[0] >= e for s, _, e in taken):
                taken.append(x)
                want.append(x)
        assert op.placed(base, added) == want


def test_trees_learn_from_every_labelled_candidate(spark):
    """More labelled candidates than the old bound of 20,000: all of them reach the trees and the threshold."""
    from pyspark.sql import functions as F

    from riskweave.llm import op8_pii as op
    rows = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.lit(3).alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(9).cast("long").alias("end"),
        (F.col("id") % 2).cast("int").alias("y"), F.array((F.col("id") % 2).cast("double"), F.lit(1.0)).alias("x"))
    model, threshold = op.fit(rows)
    held = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(4)) == 0
    assert model.trees[0]._call_java("rootNode").impurityStats().count() == rows.where(~held).count() > 20_000
    assert threshold > 0.5
    few, _ = op.fit(rows, train_rows=2000)
    assert few.trees[0]._call_java("rootNode").impurityStats().count() < 2000
