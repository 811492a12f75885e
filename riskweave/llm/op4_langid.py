"""Language ID by hyperdimensional profiles (operator 4).

Every letter has a random vector of signs. A trigram binds its letters' vectors, permuted
(rotated) by their place, with an element-wise product; a document is the bundle (sum) of its
trigrams; a language's prototype is the bundle of its documents' unit bundles. All are
centred on the mean prototype, and a document takes the language with the largest cosine.

The prototypes are fitted on all documents with a language whose crc32(doc_id) mod 5 is not 0 (a
caller may bound them to about ``train_rows`` a language, chosen by a hash of their id); each
partition sends one partial bundle a language. Prediction reads only the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties take
the first language by name; with no labelled rows every document is ``und``; a null
doc_id counts as held out; the score is the cosine, negative ones as 0; every row gives one row."""

from __future__ import annotations

from functools import lru_cache
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import prepared, written

DIMENSIONS = 1024
KEPT_GRAMS = 24_000  # trigram vectors that a worker remembers
# The pipeline stage rejects texts of at least JUDGED_CHARS characters that score below REJECT_FACTOR times the score
# that all but REJECT_SHARE of the rightly predicted training texts of that length reach.
REJECT_SHARE, REJECT_FACTOR, JUDGED_CHARS = 0.001, 0.7, 80


@lru_cache(maxsize=4096)
def letter(code: int) -> np.ndarray:
    return np.random.default_rng([11, code]).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1


class Bundler:
    """Bundles texts; remembers the vectors of frequent trigrams."""

    def __init__(self):
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((0, DIMENSIONS), dtype=np.int8)

    @staticmethod
    def grams(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """(codes, counts, any letter) of a text's trigrams of letters, each word between spaces."""
        cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        known, where = np.unique(cps, return_inverse=True)
        letters = np.array([chr(c).isalpha() for c in known], dtype=bool)
        cps = np.where(letters, known, 32)[where]
        cps = np.concatenate([[32], cps, [32]])
        cps = cps[np.concatenate([[True], (cps[1:] != 32) | (cps[:-1] != 32)])]
        codes, counts = np.unique((cps[:-2] << 42) | (cps[1:-1] << 21) | cps[2:], return_counts=True)
        return codes, counts, bool(letters.any())

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Rows in ``vectors`` of the trigrams."""
        new = [c for c in codes.tolist() if c not in self.row]
        if len(self.row) + len(new) > KEPT_GRAMS:
            self.row, self.vectors, new = {}, self.vectors[:0], codes.tolist()
        if new:
            a, b, c = (np.stack([letter((g >> s) & 0x1FFFFF) for g in new]) for s in (42, 21, 0))
            bound = np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c
            self.row |= {g: len(self.vectors) + k for k, g in enumerate(new)}
            self.vectors = np.concatenate([self.vectors, bound])
        return np.array([self.row[c] for c in codes.tolist()], dtype=np.int64)

    def bundles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(unit bundles, which texts have a letter)."""
        found = [self.grams(t) for t in texts]
        codes = np.unique(np.concatenate([f[0] for f in found]))
        counts = np.zeros((len(texts), len(codes)), dtype=np.float32)
        for k, f in enumerate(found):
            counts[k, np.searchsorted(codes, f[0])] = f[1]
        total = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
        for lo in range(0, len(codes), KEPT_GRAMS // 4):  # bounded however many trigrams meet
            part = codes[lo:lo + KEPT_GRAMS // 4]
            rows = self.rows(part)
            total += counts[:, lo:lo + len(part)] @ self.vectors[rows].astype(np.float32)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        return total / np.where(norm > 0, norm, 1), np.array([f[2] for f in found])


def usable(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
    lang = [F.col(lang_col).cast("string").alias("lang")] if lang_col else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), *lang,
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        train_rows: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, centred unit prototypes, centre)."""
    prepared(docs.sparkSession)
    rows = usable(docs, id_col, text_col, lang_col).where("not held_out and lang is not null")
    if train_rows is not None:
        per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
        share = F.lit(0.0)
        for lang, n in sorted(per.items()):
            share = F.when(F.col("lang") == lang, F.lit(min(1.0, train_rows / n))).otherwise(share)
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    chosen = rows.select("lang", "text")

    def run(batches):
        import pyarrow as pa
        bundler, sums = Bundler(), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                unit, some = bundler.bundles(part.column(1).to_pylist())
                for lang, v, ok in zip(part.column(0).to_pylist(), unit, some):
                    if ok:
                        sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)),
                                              pa.array(v)], names=["lang", "i", "v"])

    sums: dict[str, np.ndarray] = {}
    for r in chosen.mapInArrow(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["i"]] = round(r["v"], 6)  # the order of partial sums leaves no trace
    langs = sorted(sums)
    if not langs:
        return [], np.zeros((0, DIMENSIONS)), np.zeros(DIMENSIONS)
    protos = np.stack([sums[k] / max(np.linalg.norm(sums[k]), 1e-12) for k in langs])
    centre = protos.mean(axis=0) if len(langs) > 1 else np.zeros(DIMENSIONS)
    protos = protos - centre
    return langs, protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12), centre


def predictor(model: tuple[list[str], np.ndarray, np.ndarray]):
    """texts -> (languages, scores); one for each task."""
    langs, protos, centre = model
    bundler = Bundler()

    def predict(texts: list[str]) -> tuple[list[str], list[float]]:
        if not langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        unit, some = bundler.bundles(texts)
        unit = unit.astype(np.float64) - centre
        cos = unit @ protos.T / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
        best = cos.argmax(axis=1)
        return ([langs[b] if ok else "und" for b, ok in zip(best, some)],
                [float(min(1.0, max(0.0, c[b]))) if ok else 0.0 for c, b, ok in zip(cos, best, some)])
    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             train_rows: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = fit(docs, id_col, text_col, lang_col, train_rows)

    def run(batches):
        import pyarrow as pa
        predict = predictor(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                langs, scores = predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores)],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    return usable(docs, id_col, text_col, None).select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")


def least_reached(scores: DataFrame, share: float) -> float | None:
    """The score (0 to 1) at rank ceil(share x rows) from below, to 2^-48: three counts of 16 bits each, in the bucket
    that holds the rank. None without rows."""
    lo, width, rank = 0.0, 1.0, None
    for _ in range(3):
        at = F.least(F.floor((F.col("score") - F.lit(lo)) / F.lit(width) * 65536), F.lit(65535))
        inside = scores.where((F.col("score") >= lo) & ((F.col("score") < lo + width) | F.lit(lo + width >= 1.0)))
        counts = sorted((r["b"], r["n"]) for r in inside.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())  # at most 65,536 rows
        if not counts:
            return None
        rank = max(1, ceil(share * sum(n for _, n in counts))) if rank is None else rank
        for bucket, n in counts:
            if n >= rank:
                break
            rank -= n
        lo, width = lo + bucket * width / 65536, width / 65536
    return lo


def reject_below(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> float:
    """The calibrated least score, of all labelled training rows; 0 without rightly predicted training texts."""
    if not model[0]:
        return 0.0
    chosen = usable(docs, "doc_id", "text", "lang").where(
        (~F.col("held_out")) & F.col("lang").isNotNull() & (F.length("text") >= JUDGED_CHARS)).select("lang", "text")

    def run(batches):
        import pyarrow as pa
        predict = predictor(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                langs, scores = predict(part.column(1).to_pylist())
                right = [s for k, own, s in zip(langs, part.column(0).to_pylist(), scores) if k == own]
                yield pa.RecordBatch.from_arrays([pa.array(right, pa.float64())], names=["score"])

    scores = written(chosen.mapInArrow(run, "score double"), "language-scores")  # one number a training text
    return REJECT_FACTOR * (least_reached(scores, REJECT_SHARE) or 0.0)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is known (pipeline stage). Texts without a letter ('und') go, and texts
    long enough to judge that score below what texts of the learned languages do, as those of a language never
    learned mostly do. Rows keep all their columns."""
    model = fit(docs)
    least = reject_below(docs, model)

    def run(batches):
        import pyarrow as pa
        predict = predictor(model)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts = [t or "" for t in part.column(at).to_pylist()]
                langs, scores = predict(texts)
                yield part.filter(pa.array([k != "und" and (s >= least or len(t) < JUDGED_CHARS) for k, s, t in zip(langs, scores, texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
