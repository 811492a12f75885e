import hashlib
import random
import re

from pyspark.sql import functions as F

from riskweave.llm import op11_fim as op
from riskweave.llm import registry, sql

from .helpers import SMALL, docs, same, table_rows

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_whole_table_equals_sql(spark):
    same(registry.queries()["op11_fim_assembly"](spark, SMALL), sql.OP11)


def awkward():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé漢😀<PS>M") for _ in range(rng.randint(1, 6)))
    rows = [(i, t) for i, t in enumerate([None, "", " ", "\t\n", "a", " a", "a ", " a ", "a  b\x0bc d e", "<P>", "x<S>y", "<M", "<<P", "é" * 3])]
    rows += [(100 + i, "".join(word() + rng.choice([" ", "\n", " \t "]) for _ in range(rng.randint(1, 60)))) for i in range(120)]
    rows += [(300 + i, t) for i, t in enumerate(["w " * 5000, "long" * 50_000, "ä" * 70_000 + " b", "a b " * 60_000, " " * 70_000 + "z"] * 4)]
    return rows + [(None, "null id here"), (7, "a repeated id"), (7, "a repeated id")]


def test_awkward_rows_and_restoration(spark):
    rows = awkward()
    want = sorted((brute(i, t) for i, t in rows), key=repr)
    d = docs(spark, rows)
    out = op.transform(d)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    back = op.restore(out).groupBy("text").count()
    assert {r["text"]: r["count"] for r in back.collect()} == {
        r["t"]: r["n"] for r in d.groupBy(F.coalesce("text", F.lit("")).alias("t")).agg(F.count("*").alias("n")).collect()}
    assert {r[2] for r in want} == {"plain", "spm", "psm"}
    got = sorted(map(tuple, op.digests(d).collect()), key=repr)
    assert got == sorted(((*w[:5], sha(w[5]), sha(op.restored(w[5], w[2]))) for w in want), key=repr)
    assert sorted(g[-1] for g in got) == sorted(sha(t or "") for _, t in rows)


def test_empty_table_and_other_parameters(spark):
    assert op.digests(docs(spark, [])).collect() == []
    got = op.transform(docs(spark, [(i, "one two three four") for i in range(40)]), seed=7, fim_percent=100, spm_percent=0).collect()
    assert {r["form"] for r in got} == {"psm"}
    assert all(op.restored(r["output"], "psm") == "one two three four" for r in got)


def test_one_shuffle_and_pieces_are_bounded(spark):
    d = docs(spark, [(1, "long" * 100_000 + " b " * 9000)])
    sizes = [len(r["payload"]) for r in op.pieces(d, fim_percent=0).collect()]
    assert max(sizes) <= op.PIECE_BYTES + 3 and sum(sizes) == 427_000
    plan = op.digests(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_units_equal_the_pattern():
    for r in table_rows("documents")[:150]:
        text = (r["text"] or "")[:3000]
        at, want = 0, []
        for u in UNIT.findall(text):
            at += len(u.encode())
            want.append(at)
        assert op.unit_ends(text.encode()).tolist() == want
