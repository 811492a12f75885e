import zlib

import numpy as np

from riskweave.llm import op4_langid as op
from riskweave.llm.common import table

from .helpers import docs

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    d = table(spark, SF, "documents")
    got = {r["doc_id"]: r for r in op.identify(d).collect()}
    rows = d.select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    held = [r for r in rows if got[r["doc_id"]]["held_out"] and r["lang"]]
    assert sorted(r["doc_id"] for r in held) == sorted(r["doc_id"] for r in rows if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.985
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_awkward_rows(spark):
    d = docs(spark, [(1, None), (2, ""), (3, "12 !? 5"), (4, "a"), (None, "the one"), (5, "日本語" * 50), (6, "the cat " * 20_000), (6, "the cat " * 20_000)])
    got = op.identify(d).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in got) == [
        (0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en"), (6, "en"), (6, "en")]
    assert {r["score"] for r in got if r["lang_pred"] == "und"} == {0.0}


def test_no_labels_and_empty(spark):
    d = docs(spark, [(i, "words here") for i in range(20)]).withColumnRenamed("lang", "l").selectExpr("*", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in op.identify(d).collect()} == {"und"}
    assert op.identify(docs(spark, [])).collect() == []


def test_bundles_equal_the_sum_of_bound_trigrams():
    unit, some = op.Bundler().bundles(["Ab c", "--"])
    total = np.zeros(op.DIMENSIONS)
    for a, b, c in (" ab", "ab ", "b c", " c "):
        total += np.roll(op.letter(ord(a)), 2) * np.roll(op.letter(ord(b)), 1) * op.letter(ord(c))
    assert np.allclose(unit[0], total / np.linalg.norm(total), atol=1e-5) and list(some) == [True, False]


def test_stage_drops_only_texts_without_a_language(spark):
    d = table(spark, SF, "documents")
    out = op.keep_identified(d)
    assert out.columns == d.columns
    gone = {r["doc_id"] for r in d.collect()} - {r["doc_id"] for r in out.collect()}
    assert len(gone) <= 5


def test_stage_rejects_languages_never_learned(spark):
    d = table(spark, SF, "documents")
    other = ["これは日本語で書かれた文章であり、学習されたことのない言語です。" * 8, "Это текст на языке, которого модель никогда не видела. " * 8]
    rows = [(10_000_000 + i, t, None, "s", len(t)) for i, t in enumerate(other)] + [(10_000_100, "日本語", None, "s", 3)]
    out = {r["doc_id"] for r in op.keep_identified(d.unionByName(spark.createDataFrame(rows, d.schema))).select("doc_id").collect()}
    assert out & {r[0] for r in rows} == {10_000_100}  # too short to judge
    held = [r["doc_id"] for r in d.select("doc_id", "lang").collect() if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(i not in out for i in held) <= 0.005 * len(held)


def test_models_and_rejection_learn_from_every_training_row(spark):
    """More training rows a language than the old bound of 3,000: the prototypes and the least score cover them all."""
    from pyspark.sql import functions as F

    from riskweave.llm import op4_langid as op
    docs = spark.range(8000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "aa").otherwise("bb").alias("lang"),
        F.concat(F.when(F.col("id") % 2 == 0, "the quick brown fox runs over hills and rivers every single day "
                        ).otherwise("zwölf große boxer jagen viktor quer über den breiten sylter deich "), F.md5(F.col("id").cast("string"))).alias("text"))
    langs, protos, centre = op.fit(docs)
    some = op.fit(docs, train_rows=3000)
    assert langs == ["aa", "bb"] and abs(protos - some[1]).max() > 0
    assert abs(centre - op.fit(docs, train_rows=10 ** 9)[2]).max() == 0
    scored = op.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("not held_out and lang = lang_pred")
    scores = sorted(r["score"] for r in scored.select("score").collect())
    want = op.REJECT_FACTOR * scores[max(1, -(-len(scores) // 1000)) - 1]
    assert len(scores) > 6000 and abs(op.reject_below(docs, (langs, protos, centre)) - want) < 1e-6


def test_least_reached_is_the_rank(spark):
    from riskweave.llm import op4_langid as op
    for values in ([0.25], [0.0, 1.0], [1.0] * 5, [k / 997 for k in range(997)], [0.5] * 50 + [0.5 + 1e-12] * 50 + [0.9]):
        df = spark.createDataFrame([(v,) for v in values], "score double")
        for share in (0.001, 0.3, 0.75, 1.0):
            want = sorted(values)[max(1, -int(-(share * len(values)) // 1)) - 1]
            assert abs(op.least_reached(df, share) - want) < 1e-13
    assert op.least_reached(spark.createDataFrame([], "score double"), 0.5) is None
