"""Small files and folders by Hadoop's file systems, which reach whatever Spark reads."""

from __future__ import annotations

import hashlib
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def state(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files' paths, sizes and times of change; one listing for each folder."""
    found, wanted = [], set(paths)
    for folder in sorted({p.rsplit("/", 1)[0] for p in wanted}):
        fs, p = _path(spark, folder)
        found += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(p) if s.isFile()]
    return hashlib.sha256("\n".join(sorted(found + sorted(wanted))).encode()).hexdigest()


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names of what lies in a folder; none if there is no such folder."""
    fs, p = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that wasn't there; false, and nothing changed, if it was. Readers see the whole file or none.

    Needs a file system whose rename is atomic and refuses a taken name (HDFS, a shared POSIX folder).
    """
    fs, p = _path(spark, path)
    fs.mkdirs(p.getParent())
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if fs.getScheme() == "file":  # a hard link is made or refused in one step
            local = lambda x: unquote(urlparse(x.toUri().toString()).path)
            os.link(local(draft), local(p))
            return True
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, p, options)
        return True
    except FileExistsError:
        return False
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    finally:
        fs.delete(draft, False)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all that lies in it."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.mkdirs(p)
