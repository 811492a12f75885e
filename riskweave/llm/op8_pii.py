"""Personal data by candidate gradient boosting (operator 8).

Fixed base patterns give spans that always stay. Beside them, generators of high recall
propose overlapping candidates (card numbers inside longer runs of digits, phone numbers without
a plus, address quads, addresses with a spelled-out at). Format checks (Luhn, octets, numbers of digits)
belong to the generators: what fails them is never added, and the trees are not told. Boosted trees
(Spark's) score each candidate from its shape and context. They learn from weak labels: base spans, and candidates
after a word for their kind, are one; candidates that fail their format check, or stand after a word for another
number (ISBN, version, order, score), or inside a longer chain, are not.
On the labels of held-out documents the smallest threshold with the wanted precision is taken; candidates
at or above it that overlap no base span are added, the best of overlapping ones.

The trees are fitted on all labelled candidates of three quarters of the documents, the threshold is taken from all
of the others; a caller may bound them to about ``train_rows`` chosen by a hash.

Defined results: null and empty texts have no spans; without both labels nothing is
added; rows that repeat an id each give a row; an empty table gives no rows; offsets are code points."""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import prepared, written

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.995

# The base patterns. The email pattern is matched at the start of the run before
# each @, and the look-behinds only skip starts inside a run of digits, which cannot match.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Generators of further candidates.
RUN = re.compile(r"(?<![0-9A-Za-z])[0-9]{12,19}(?![0-9A-Za-z])")
FOURS = re.compile(r"(?=(?<![0-9])([0-9]{4}(?:[ .-][0-9]{4}){2,3}(?:[ .-][0-9]{1,3})?)(?![0-9]))")
QUAD = re.compile(r"(?=(?<![0-9])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]))")
CALL = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,3}(?![0-9A-Za-z])")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+", re.I)


# Words before a number that say what it is: a kind of personal data, or something else.
CUES = {0: "mail email contact", 1: "ip host server addr", 2: "card visa mastercard amex credit karte carte tarjeta",
        3: "tel phone call mobile fax cell telefon téléphone teléfono"}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
OTHER = frozenset("""isbn issn version ver v order ref reference id no nr num score scores build page pages chapter release sha serial
invoice item part figure fig table section line lines rev revision model bestellung seite commande pedido""".split())
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def octets(span: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))


def emails(text: str):
    """EMAIL's leftmost matches; a failing start fails for the whole run before its @."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if octets(m[0])]
        for m in CARD.finditer(text):
            if len(m[0]) >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Candidates beyond the base spans, overlapping ones too."""
    out = []
    if DIGIT.search(text):
        for kind, pattern, group in ((2, RUN, 0), (2, FOURS, 1), (1, QUAD, 1), (3, CALL, 0)):
            out += [(m.start(group), kind, m.end(group)) for m in pattern.finditer(text)]
    if "at)" in text.lower() or "at]" in text.lower():
        out += [(m.start(), 0, m.end()) for m in SPELLED.finditer(text)]
    return out


def possible(kind: int, span: str) -> bool:
    """The format check of the kind."""
    digits = "".join(DIGIT.findall(span))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == 1:
        return octets(span)
    return kind == 0 or 9 <= len(digits) <= 15


def said_before(text: str, start: int) -> frozenset[str]:
    """The last two words shortly before a span."""
    return frozenset(w.lower() for w in WORD.findall(text[max(0, start - 24):start])[-2:])


def label(text: str, start: int, kind: int, end: int, base: bool) -> int | None:
    """1: base span or announced as its kind; 0: cannot be of its kind or is said or seen to be something else; None: unknown."""
    if base:
        return 1
    words, span = said_before(text, start), text[start:end]
    chained = bool(re.search(r"[0-9][.-]\Z", text[max(0, start - 2):start]) or re.match(r"[.-][0-9]", text[end:end + 2]))
    digits = "".join(DIGIT.findall(span))
    if not possible(kind, span) or words & OTHER or chained and kind != 2 or len(digits) == 13 and digits[:3] in ("978", "979"):
        return 0
    return 1 if words & CUES[kind] else None


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Shape and context of a candidate: neither whether a base pattern matched nor whether its format check holds."""
    span, before, after = text[start:end], text[max(0, start - 24):start], text[end:end + 24]
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    near, words = before + after, said_before(text, start)
    return [float(x) for x in (
        kind, len(span), len(groups), max(groups), min(groups), len(set(groups)),
        sum(c in " .-" for c in span), "(" in span, span.count("."), span.count(" "),
        bool(before) and before[-1].isalnum(), bool(after) and after[0].isalnum(),
        bool(before) and before[-1] in "=\"'/#:", bool(after) and after[0] in "=\"'/#:.",
        sum(c.isalpha() for c in near) / max(1, len(near)), sum(c.isdigit() for c in near) / max(1, len(near)),
        bool(words & CUES[kind]), bool(words & OTHER), bool(before) and before[-1] == "\n", bool(after) and after[0] == "\n")]


def placed(base: list[tuple[int, int, int]], added: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans (start, kind, end) of ``added``, best first, that overlap neither a base span nor a better one."""
    from bisect import bisect_left, insort
    taken: list[tuple[int, int]] = []  # disjoint
    for start, _, end in sorted(base):
        if taken and start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(end, taken[-1][1]))
        else:
            taken.append((start, end))
    out = []
    for start, kind, end in added:
        at = bisect_left(taken, (start, end))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
            insort(taken, (start, end))
            out.append((start, kind, end))
    return out


def candidate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per candidate, and one with kind null per document."""
    prepared(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        key, schema = TaskContext.get().partitionId() << 33, pa.schema(
            [("row", pa.int64()), ("doc_id", pa.int64()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
             ("base", pa.bool_()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])
        for batch in batches:
            out = ([], [], [], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key += 1
                base = base_spans(text)
                rows = [(key, doc_id, None, None, None, None, None, None)]
                own = set(base)
                for s, k, e in [*base, *sorted(set(proposals(text)) - own)]:
                    is_base = (s, k, e) in own
                    rows.append((key, doc_id, k, s, e, is_base, label(text, s, k, e, is_base), features(text, s, k, e)))
                for col, values in zip(out, zip(*rows)):
                    col.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        run, "row long, doc_id long, kind int, start long, end long, base boolean, y int, x array<double>")


def fit(rows: DataFrame, train_rows: int | None = None, precision: float = PRECISION):
    """(boosted trees, calibrated threshold), or None without labels of both kinds."""
    known = rows.where("y is not null").withColumn("_h", F.pmod(F.xxhash64("doc_id", "start", "end", "kind"), F.lit(1 << 30)))
    known = known.withColumn("_held", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(4)) == 0)  # whole documents
    if train_rows is not None:
        per = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(per) < 2:
            return None
        share = F.when(F.col("y") == 1, min(1.0, train_rows / 2 / per[1])).otherwise(min(1.0, train_rows / 2 / per[0]))
        known = known.where(F.col("_h") < share * (1 << 30))
    chosen = known.select(F.col("y").cast("double").alias("label"), array_to_vector("x").alias("features"), F.col("_held").alias("held"))
    fitting = chosen.where("not held")
    if fitting.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=10, maxDepth=4, seed=7, labelCol="label", featuresCol="features").fit(fitting)
    scored = model.transform(chosen.where("held")).select(
        "label", F.round(vector_to_array("probability")[1], 2).alias("p"))
    counts = sorted(((r["p"], r["y1"], r["n"]) for r in scored.groupBy("p").agg(
        F.sum("label").alias("y1"), F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # at most 101 rows
    threshold, good, seen = 1.01, 0.0, 0
    for p, y1, n in counts:
        good, seen = good + y1, seen + n
        if p < 0.5 or good < precision * seen:
            break
        threshold = p
    return model, threshold


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int | None = None) -> DataFrame:
    """One row per document: the counts and digest of the base spans, and all spans."""
    rows = written(candidate_rows(docs, id_col, text_col), "candidates")
    spans = rows.where("base").select("row", "kind", "start", "end", "base", F.lit(1.0).alias("p"))
    fitted = fit(rows, train_rows)
    if fitted:
        model, threshold = fitted
        scored = model.transform(rows.where("not base and coalesce(y, 1) = 1").withColumn("features", array_to_vector("x")))
        p = F.round(vector_to_array("probability")[1], 2)
        spans = spans.unionByName(scored.select("row", "kind", "start", "end", "base", p.alias("p")).where(F.col("p") >= threshold))
    listed = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        (~F.col("base")).alias("added"), (-F.col("p")).alias("rank"), "start", "kind", "end"))).alias("s"))

    def run(batches):
        import hashlib

        import pyarrow as pa
        schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
        for batch in batches:
            out = []
            for doc_id, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = sorted((f["start"], f["kind"], f["end"]) for f in found or [] if not f["added"])
                every = base + placed(base, [(f["start"], f["kind"], f["end"]) for f in found or [] if f["added"]])
                said = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(x)) for x in (base, every)]
                out.append({"doc_id": doc_id, **{f"n_{name}": sum(k == i for _, k, _ in base) for i, name in enumerate(KINDS)},
                            "base_sha256": hashlib.sha256(said[0].encode()).hexdigest(), "spans": said[1]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.where("kind is null").select("row", "doc_id").join(listed, "row", "left").select("doc_id", "s").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
