import gzip
import hashlib
import os

from riskweave.llm import op9_warc as op
from riskweave.llm import registry, sql
from riskweave.llm.common import table

from .helpers import SMALL, same


def test_round_trip_equals_sql(spark):
    same(registry.queries()["op9_warc"](spark, SMALL), sql.OP9)


def pages(spark):
    big, rows = "é" * 700, []
    rows += [(i, f"http://h/{i}?q=a b\n", big, "x") for i in (4, 9, 2)] + [(3, "u", "short", "x"), (5, None, "short", "x")]
    rows += [(6, "u", None, "x"), (None, "u", big, "x"), (9, "u", big, "x"), (7, "u", "z" * 300_000, "x"), (-8, "u", "y" * 1000, "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, shard string")


def test_awkward_rows_and_many_shards(spark):
    p = pages(spark)
    uri = op.write_archive(p, shard_bytes=2000, roll_bytes=500)
    got = op.read_archive(spark, uri).collect()
    want = []
    for r in p.collect():
        b = (r["html"] or "").encode()
        ids = [q["page_id"] for q in p.collect() if q["html"] == r["html"] and q["page_id"] is not None]
        refers = max(ids) if len(b) >= 1000 and max(ids) != r["page_id"] else None
        want.append((r["page_id"], len(b), hashlib.sha1(b).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert sorted((tuple(r)[:1] + tuple(r)[2:6] for r in got), key=repr) == sorted(want, key=repr)
    by_id = {r["page_id"]: r["html"] for r in p.collect()}
    assert all(r["payload"].decode() == (by_id[r["page_id"]] or "") for r in got if r["record_type"] == "response")


def test_same_table_gives_the_same_files(spark):
    p = table(spark, SMALL, "pages")
    seen = []
    for parts in (1, 5):
        folder = op.store(op.write_archive(p.repartition(parts), shard_bytes=50_000, roll_bytes=20_000))[1]
        files = {f: hashlib.sha256(open(f"{folder}/{f}", "rb").read()).hexdigest() for f in os.listdir(folder) if f.endswith(".gz")}
        assert not [f for f in os.listdir(folder) if f.startswith("_shard")]
        seen.append(files)
    assert seen[0] == seen[1] and len(seen[0]) > 3


def test_record_layout():
    raw = op.record_bytes(7, "http://a/b c", b"body", None)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\nbody\r\n\r\n")
    assert gzip.decompress(gzip.compress(raw, mtime=0)) == raw


def test_empty(spark):
    assert op.round_trip(pages(spark).limit(0)).collect() == []
