"""Stored tables with versions: a new one is written beside the old, and one small file, renamed last, makes it current."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the same version first."""


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, in order."""
    fs, folder = _path(spark, f"{path}/_commits")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What a version, the newest unless one is named, is made of; None where nothing was ever committed."""
    known = versions(spark, path)
    if not known:
        return None
    fs, file = _path(spark, f"{path}/_commits/{version or known[-1]:08d}.json")
    stream = fs.open(file)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def fresh_folder(path: str, kind: str) -> str:
    """A folder under path that no one has written to, and that nothing refers to until it is in a manifest."""
    return f"{path.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str, contents: dict, after: int) -> int:
    """Make contents the version that follows `after`; Conflict if that number is taken. Returns the number.

    The manifest is written under another name and renamed, so a reader sees all of it or nothing.
    """
    number = after + 1
    fs, draft = _path(spark, f"{path}/_commits/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(contents | {"version": number}).encode()))
    out.close()
    _, final = _path(spark, f"{path}/_commits/{number:08d}.json")
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"version {number} of {path} exists")
    return number


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete what the newest `keep` versions do not refer to, drafts and stopped writes included; returns the deleted folders.

    For times when no one writes: the folder of a write that is not committed yet is not referred to either.
    """
    known = versions(spark, path)
    used = {f for v in known[-keep:] for f in manifest(spark, path, v)["folders"]}
    gone = []
    for old in known[:-keep]:
        fs, file = _path(spark, f"{path}/_commits/{old:08d}.json")
        fs.delete(file, False)
    fs, top = _path(spark, path)
    for kind in [s.getPath() for s in fs.listStatus(top) if s.isDirectory() and s.getPath().getName() != "_commits"]:
        for folder in [s.getPath() for s in fs.listStatus(kind)]:
            name = f"{kind.getName()}/{folder.getName()}"
            if name not in used:
                fs.delete(folder, True)
                gone.append(name)
    return sorted(gone)
