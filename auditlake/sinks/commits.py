"""Numbered commits beside data (K4, K9): many publishers, no lock, readers see whole snapshots only."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file if there is none of its name; false if there is. Of several who try at once one succeeds.

    On a plain file system the name is linked to a finished file, which fails where it is taken; elsewhere a finished
    file is renamed without leave to replace, which the store must do in one step (HDFS does).
    """
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        target = parsed.path
        os.makedirs(os.path.dirname(target), exist_ok=True)
        draft = f"{target}.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    jvm, place, files = _files(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(draft, place, options)
    except Exception as e:  # noqa: BLE001  (the gateway's own error type carries the Java one)
        files.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits of a place, in order."""
    _, place, files = _files(spark, f"{path}/_commits")
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(n) for n in names if n.isdigit())


def commit(spark: SparkSession, path: str, pointer: str) -> int:
    """Give pointer the next free number. Another publisher may take a number first: then the one after it is tried."""
    number = max(numbers(spark, path), default=0) + 1
    while not create_once(spark, f"{path}/_commits/{number}", pointer):
        number += 1
    return number


def pointer(spark: SparkSession, path: str, number: int | None = None) -> str | None:
    """What a commit points to, the last one where no number is given; None where there is none."""
    taken = numbers(spark, path)
    if not taken or (number is not None and number not in taken):
        return None
    return spark.read.text(f"{path}/_commits/{taken[-1] if number is None else number}", wholetext=True).first()[0]


def publish(spark: SparkSession, current: DataFrame, path: str) -> int:
    """K4, K9: write a snapshot and commit it; its number. A job that ends before the commit leaves no trace that a
    reader sees."""
    name = f"data-{uuid.uuid4().hex}"
    current.write.parquet(f"{path}/{name}")
    return commit(spark, path, name)


def snapshot(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """K4, K9: a committed snapshot, the last one where no number is given."""
    name = pointer(spark, path, number)
    return None if name is None else spark.read.parquet(f"{path}/{name}")
