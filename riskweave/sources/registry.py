"""Versioned publishing in a shared folder (SRC7, ML15), safe with several writers.

Everything is first written under ``versions/<id>``, a folder of its own; then one small pointer file with the
next free number is created, which the file system gives to one writer only. Readers see what a pointer
names, so an attempt that fails before its pointer leaves nothing to see, and no reader
meets a half-written version."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

POINTER = re.compile(r"[0-9]{9}\Z")


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, folder) of every published version, ascending. A pointer that its writer did not finish names nothing."""
    folder, fs = _files(spark, os.path.join(root, "pointers"))
    if not fs.exists(folder):
        return []
    out = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if POINTER.match(name) and status.getLen() == 32:
            stream = fs.open(status.getPath())
            try:
                version = "".join(chr(stream.read()) for _ in range(32))
            finally:
                stream.close()
            out.append((int(name), os.path.join(root, "versions", version)))
    return sorted(out)


def _last_claimed(spark: SparkSession, root: str) -> int:
    folder, fs = _files(spark, os.path.join(root, "pointers"))
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return max((int(n) for n in names if POINTER.match(n)), default=0)


def _claimed(spark: SparkSession, pointer: str, version: str) -> bool:
    """Creates the pointer file unless another writer has it. Shared stores create a file for one writer only; Hadoop's
    local file system looks before it creates, so there the operating system's exclusive creation is used."""
    target, fs = _files(spark, pointer)
    if fs.getUri().getScheme() == "file":
        name = target.toUri().getPath()
        os.makedirs(os.path.dirname(name), exist_ok=True)
        try:
            with open(name, "x", encoding="ascii") as out:
                out.write(version)
        except FileExistsError:
            return False
        return True
    try:
        stream = fs.create(target, False)
    except Py4JJavaError as taken:
        if "AlreadyExists" in str(taken.java_exception.getClass().getName()) or fs.exists(target):
            return False
        raise
    try:
        stream.writeBytes(version)
    finally:
        stream.close()
    return True


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> tuple[int, str]:
    """Lets ``write`` fill a new folder and commits it under the next number: (number, folder)."""
    version = uuid.uuid4().hex
    path = os.path.join(root, "versions", version)
    write(path)
    while True:
        number = _last_claimed(spark, root) + 1
        if _claimed(spark, os.path.join(root, "pointers", f"{number:09d}"), version):
            return number, path


def latest(spark: SparkSession, root: str) -> str:
    """Folder of the version published last."""
    found = committed(spark, root)
    if not found:
        raise FileNotFoundError(f"nothing is published in {root!r}")
    return found[-1][1]


def append_rows(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Publishes ``rows`` as one more part of a table and returns the table of all published parts, with
    each row's ``version`` number. Parts may lack columns that others have."""
    publish(spark, root, lambda path: rows.write.parquet(path))
    return read_rows(spark, root)


def read_rows(spark: SparkSession, root: str) -> DataFrame:
    from functools import reduce

    from pyspark.sql import functions as F
    parts = [spark.read.parquet(path).withColumn("version", F.lit(number)) for number, path in committed(spark, root)]
    if not parts:
        raise FileNotFoundError(f"nothing is published in {root!r}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
