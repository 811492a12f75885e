import re

import corpus_pipeline
from riskweave.llm import op4_langid
from riskweave.llm.common import table

from .helpers import SMALL
from .test_minhash import partition, shingles
from .test_pack import check_packing, whole_ids


def stages(spark):
    docs, out = table(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        out[name] = (docs.columns, docs.collect())
    return out


def test_stages_equal_brute_force(spark):
    columns, docs = table(spark, SMALL, "documents").columns, table(spark, SMALL, "documents").collect()
    out = stages(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "pack"]
    assert all(out[n][0] == columns for n in ("language", "exact", "near", "mix"))

    pred = {r["doc_id"]: r for r in op4_langid.identify(table(spark, SMALL, "documents")).collect()}
    least = op4_langid.reject_below(table(spark, SMALL, "documents"), op4_langid.fit(table(spark, SMALL, "documents")))
    assert 0 < least < 0.5
    kept = {r["doc_id"]: r["text"] for r in docs if pred[r["doc_id"]]["lang_pred"] != "und" and (len(r["text"] or "") < op4_langid.JUDGED_CHARS or pred[r["doc_id"]]["score"] >= least)}
    assert {r["doc_id"] for r in out["language"][1]} == set(kept)

    first = {}
    for i, t in sorted(kept.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t), i)
    assert sorted(r["doc_id"] for r in out["exact"][1]) == sorted(first.values())

    sets = {i: shingles(kept[i], 5) for i in first.values()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    low = partition(pairs, sets)
    assert sorted(r["doc_id"] for r in out["near"][1]) == sorted(i for i in sets if low[i] == i)

    mixed = [r["doc_id"] for r in out["mix"][1]]
    assert set(mixed) == {r["doc_id"] for r in out["near"][1]}
    pieces = out["pack"][1]
    assert sorted(r["doc_id"] for r in pieces if r["piece"] == 0) == sorted(mixed)
    assert sum(r["length"] for r in pieces) == sum(len(whole_ids(kept[i])) for i in mixed)
    check_packing(pieces, 2048)


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, SMALL)
    want = stages(spark)["pack"][1]
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want))


def test_stages_take_columns_with_any_name(spark):
    from pyspark.sql import functions as F
    names = ["key", "_key", "_id", "id", "gone", "of", "place", "_source", "_position", "row", "kept", "rank", "position", "copy", "slot", "KEY1"]
    docs = table(spark, SMALL, "documents").withColumns({n: F.lit(n) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == n for r in rows for n in names), name
