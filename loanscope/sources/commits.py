"""Folders whose content changes as a whole: a log of small commit files.

Data is written beside what is there, then one numbered file in ``_commits``
makes it count.  Creating that file is the only step that readers can see, and
it fails if another writer took the number first (on stores that create files
exclusively, such as HDFS or a local disk).  A job that dies before it leaves
the last committed state as it was.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class ConcurrentCommit(RuntimeError):
    """Another writer committed in the meantime; nothing was changed."""


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote and nobody reads any more."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder; an error if the store refuses."""
    p, fs = _path(spark, old)
    if not fs.rename(p, _path(spark, new)[0]):
        raise OSError(f"cannot rename {old} to {new}")


def entries(spark: SparkSession, path: str) -> list[dict]:
    """The committed entries, oldest first."""
    folder, fs = _path(spark, f"{path}/_commits")
    if not fs.exists(folder):
        return []
    out = []
    for f in sorted(str(s.getPath()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()):
        stream = fs.open(_path(spark, f)[0])
        try:
            out.append(json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()
    return out


def add(spark: SparkSession, path: str, number: int, entry: dict) -> None:
    """Commit ``entry`` as number ``number`` (the count of entries the writer
    has seen, from 0 on)."""
    # written under a name that readers skip, so that they never see half a file
    target, fs = _path(spark, f"{path}/_commits/{number:08d}")
    claim, _ = _path(spark, f"{path}/_commits/{number:08d}.claim")
    try:
        stream = fs.create(claim, False)
    except Exception as e:
        raise ConcurrentCommit(f"commit {number} of {path} was taken by another writer") from e
    stream.write(bytearray(json.dumps(entry).encode()))
    stream.close()
    if not fs.rename(claim, target):
        raise ConcurrentCommit(f"commit {number} of {path} was taken by another writer")
