"""Deterministic sharded WARC writer and reader (operator 9).

Records are range-sorted by id into shards of about ``shard_bytes`` of payload. The
bounds come from a hash-chosen sample of the ids, so the same table always gives the same
shards. A shard's task writes gzip members into files that roll over at ``roll_bytes``
of compressed size, regenerating headers and digests; a file is written under a
name of its attempt and renamed when it is complete. The tasks return a manifest row per
file, and Spark's commit of the manifest table commits the archive: a
failed or repeated attempt leaves nothing that a reader takes. Readers start from the manifest.

Files go to the shared folder through ``pyarrow.fs``, so any store it opens will do.

Duplicates: of records with equal payloads of at least ``revisit_bytes`` the one with the
largest id is the response and the others revisit it. Payloads are equal when
length, SHA-1 and SHA-256 agree. The largest id is found by a partial aggregate over digests, so a payload
in a third of all rows is one row per task there, and the join back, of ids and digests, can be
split by AQE. The payloads are shuffled once, to their shards.

Defined results: a null html is the empty payload, a null url an empty target; a null id
sorts first and is written as such; rows that repeat an id with an equal payload are all responses when that id is the
largest; an empty table gives an archive without files."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import prepared
from riskweave.session import scratch_path

REVISIT_BYTES = 1000
SHARD_BYTES = 32 << 20
ROLL_BYTES = 16 << 20
SAMPLE_IDS = 100_000  # about so many ids choose the bounds of the shards
MAX_SHARDS = 10_000  # larger archives get larger shards, not more bounds; files roll over inside a shard
DATE = "2000-01-01T00:00:00Z"  # a fixed date: the archive depends on its records alone
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string"


def keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, payload, sha): the payload as bytes with its length and both digests as one string."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    return p.withColumn("sha", F.concat_ws("-", F.octet_length("payload").cast("string"), F.sha1("payload"), F.sha2("payload", 256)))


def revisits(rows: DataFrame, revisit_bytes: int) -> DataFrame:
    """(page_id, sha, refers_to) of the records that revisit another; no payload is shuffled for it."""
    long = rows.where(F.octet_length("payload") >= revisit_bytes).select("page_id", "sha")
    last = long.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    own = long.join(last.drop("_n"), "sha")
    return own.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to").distinct()


def shard_bounds(pages: DataFrame, id_col: str, html_col: str, shard_bytes: int) -> list[int]:
    """Upper bounds of all shards but the last: quantiles of a hash-chosen sample of ids."""
    size = pages.agg(F.sum(F.octet_length(html_col)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    shards = min(-(-int(size["b"] or 0) // shard_bytes), MAX_SHARDS)
    if shards < 2:
        return []
    every = max(1, int(size["n"]) // SAMPLE_IDS)
    ids = sorted({r[0] for r in pages.select(F.col(id_col).cast("long").alias("i"))
                  .where(F.col("i").isNotNull() & (F.pmod(F.xxhash64("i"), F.lit(every)) == 0)).collect()})
    return sorted({ids[len(ids) * k // shards] for k in range(1, shards)}) if ids else []


def head(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit has the headers of its payload and no block."""
    import hashlib
    import urllib.parse

    digest = hashlib.sha1(payload).hexdigest()
    block = payload if refers_to is None else b""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
              ("WARC-Target-URI", urllib.parse.quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))),
              ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    return head([*fields, ("Content-Type", "text/html"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def store(uri: str):
    """(file system, path) of a folder in any store that pyarrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else f"file://{uri}")


def store_uri(path: str) -> str:
    """Hadoop writes ``file:/a``, pyarrow wants ``file:///a``."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


class _Shard:
    """Writes the files of one shard; each appears under its name only when complete."""

    def __init__(self, uri: str, shard: int, attempt: str, roll_bytes: int):
        self.files, self.folder = store(uri)
        self.shard, self.attempt, self.roll, self.number, self.out = shard, attempt, roll_bytes, 0, None

    def add(self, record: bytes) -> dict | None:
        import gzip
        import hashlib

        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.folder}/_{self.name}.{self.attempt}"
            self.out = self.files.open_output_stream(self.temporary, compression=None)
            self.records, self.bytes, self.sha = 0, 0, hashlib.sha256()
        member = gzip.compress(record, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.records += 1
        self.bytes += len(member)
        return self.close() if self.bytes >= self.roll else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        self.files.move(self.temporary, f"{self.folder}/{self.name}")  # equal bytes if another attempt was first
        self.number += 1
        return {"file": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest()}


def write_archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
                  revisit_bytes: int = REVISIT_BYTES) -> str:
    """Writes the archive and returns its folder."""
    spark = prepared(pages.sparkSession)
    uri = store_uri(folder or scratch_path(spark, "warc"))
    files, path = store(uri)
    files.create_dir(path, recursive=True)
    bounds = shard_bounds(pages, id_col, html_col, shard_bytes)

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        own = pd.to_numeric(ids, errors="coerce").astype("Int64")  # null ids: the first shard
        return pd.Series(np.searchsorted(bounds, own.fillna(-2**63).astype("int64"), side="right"), dtype="int32")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        attempt, writer, done, note = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}", None, [], None
        for batch in batches:
            for number, page_id, sha, payload, url, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if payload is None:  # the note that the records sorted after it are revisits
                    note = (page_id, sha, refers_to)
                    continue
                if writer is None or writer.shard != number:
                    done += [writer.close()] if writer else []
                    writer = _Shard(uri, number, attempt, roll_bytes)
                own = note[2] if note and note[:2] == (page_id, sha) else None
                done.append(writer.add(record_bytes(page_id, url, payload, own)))
        done += [writer.close()] if writer else []
        yield pa.RecordBatch.from_pylist([x for x in done if x], schema=pa.schema(
            [("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    # the one shuffle of payloads: notes of revisits meet their records in the shard, sorted just before them
    rows = keyed(pages, id_col, url_col, html_col)
    both = rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(
        revisits(rows, revisit_bytes), allowMissingColumns=True)
    dealt = (both.withColumn("shard", shard("page_id") if bounds else F.lit(0)).repartitionById(len(bounds) + 1, "shard")
             .sortWithinPartitions("shard", "page_id", "sha", F.col("payload").isNotNull(), "url"))
    manifest = dealt.select("shard", "page_id", "sha", "payload", "url", "refers_to").mapInArrow(run, MANIFEST)
    # committed by Spark's own output commit: the manifest exists whole or not at all
    manifest.write.parquet(f"{uri}/manifest")
    return uri


def read_archive(spark, uri: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of the archive."""
    prepared(spark)
    names = spark.read.schema(MANIFEST).parquet(f"{uri}/manifest").select("file", "records", "sha256")

    def run(batches):
        import gzip
        import hashlib
        import io

        import pyarrow as pa

        files, folder = store(uri)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("payload", pa.binary())])

        def page(urn: str | None) -> int | None:
            number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
            return int(number) if number else None

        for batch in batches:
            for name, n, sha in zip(*(c.to_pylist() for c in batch.columns)):
                with files.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    raw = f.read()
                if hashlib.sha256(raw).hexdigest() != sha:
                    raise ValueError(f"{name}: its bytes are not those of the manifest")
                stream, out = gzip.GzipFile(fileobj=io.BytesIO(raw)), []
                while line := stream.readline():
                    if line != b"WARC/1.1\r\n":
                        raise ValueError(f"{name}: no record where one should start")
                    fields = {}
                    while (line := stream.readline()) not in (b"\r\n", b""):
                        k, _, v = line.decode().partition(": ")
                        fields[k] = v.rstrip("\r\n")
                    block = stream.read(int(fields["Content-Length"]))
                    stream.read(4)
                    digest, response = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
                    if response and hashlib.sha1(block).hexdigest() != digest:
                        raise ValueError(f"{name}: a payload does not match its digest")
                    out.append({"page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"],
                                "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest,
                                "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")),
                                "payload": block if response else None})
                    if len(out) >= 256:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        n, out = n - len(out), []
                if len(out) != n:
                    raise ValueError(f"{name}: the manifest has another number of records")
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    tasks = min(names.count(), 10 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return names.repartition(max(1, tasks), "file").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
             "refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archive and reads it back: one row per page."""
    return read_archive(pages.sparkSession, write_archive(pages)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
