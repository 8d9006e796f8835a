"""Tables derived from files, kept under a fingerprint of these files: built once, renamed into place, dropped when stale."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def files_fingerprint(spark: SparkSession, paths: Sequence[str], *parameters: object) -> str:
    """A digest of the files at and below ``paths`` (name, length, time of change) and of parameters.

    A file added, removed or written again changes it; hidden files (``.`` or ``_`` first) don't count. It lists
    files and reads none.
    """
    sha = hashlib.sha256(repr([str(p) for p in parameters]).encode())
    for name in sorted(paths):
        path, files = _path(spark, name)
        found, listed = files.listFiles(path, True), []
        while found.hasNext():
            f = found.next()
            if f.getPath().getName()[0] not in "._":
                listed.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        sha.update(repr((name, sorted(listed))).encode())
    return sha.hexdigest()


def derived_folder(spark: SparkSession, root: str, fingerprint: str, build: Callable[[str], None], keep: int = 1, half_age: float = 86_400) -> str:
    """The folder ``root/fingerprint``; if it is not there, ``build`` fills another one, which is renamed to it when it is whole.

    Of two builders at once one renames first, and both then have its folder. After a build, all but the ``keep``
    newest other folders under ``root`` go, and so do those that builders began more than ``half_age`` seconds ago and left half done.
    """
    goal, files = _path(spark, f"{root}/{fingerprint}")
    if files.exists(goal):
        return f"{root}/{fingerprint}"
    half = f"{root}/_half-{uuid.uuid4().hex}"
    build(half)
    if not files.rename(_path(spark, half)[0], goal) and not files.exists(goal):
        raise OSError(f"{half} could not be renamed to {fingerprint}")
    # a rename onto a folder that came meanwhile puts the new one below it
    below, _ = _path(spark, f"{root}/{fingerprint}/{half.rpartition('/')[2]}")
    files.delete(below, True)
    others = [f for f in files.listStatus(goal.getParent()) if f.getPath().getName() != fingerprint]
    whole = sorted((f for f in others if not f.getPath().getName().startswith("_")), key=lambda f: -f.getModificationTime())
    since = (time.time() - half_age) * 1000
    for f in [*whole[keep:], *(f for f in others if f.getPath().getName().startswith("_") and f.getModificationTime() <= since)]:
        files.delete(f.getPath(), True)
    return f"{root}/{fingerprint}"


def derived(spark: SparkSession, root: str, fingerprint: str, build: Callable[[], DataFrame], keep: int = 1) -> DataFrame:
    """The table that ``build`` gives, written once for each fingerprint."""
    return spark.read.parquet(derived_folder(spark, root, fingerprint, lambda path: build().write.parquet(path), keep))
