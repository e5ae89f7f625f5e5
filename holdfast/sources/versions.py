"""Tables that change together: versions below a root, and a manifest that switches all of them at once.

A commit writes every changed table to a new folder and then one small manifest that names the folder of each table.  Readers
take the newest manifest, so they see all tables before the commit or all after it; what a failed commit left behind is never
named.  Manifests are numbered, and one that exists already is not replaced: of two commits that started from the same version
one fails with `Conflict` and can be tried again.

It works on every file system that Spark writes to and that renames a file as one step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_manifests"


class Conflict(RuntimeError):
    """Another commit has taken the version number."""


def _files(spark: SparkSession, root: str):
    """(file system, path factory) of the root."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    fs, path = _files(spark, root)
    folder = path(f"{root}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[str, dict]:
    """{table: {path, schema}} of a version, by default the newest; empty before the first commit."""
    known = versions(spark, root)
    if not known:
        return {}
    if version is not None and version not in known:
        raise KeyError(f"version {version} of {root}")
    number = known[-1] if version is None else version
    return json.loads(spark.read.text(f"{root}/{MANIFESTS}/{number:012d}.json", wholetext=True).first()[0])


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    from pyspark.sql.types import StructType

    entry = manifest(spark, root, version)[table]
    return spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{root}/{entry['path']}")


def commit(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], base: int | None = None) -> int:
    """Write `tables` and make them the newest version, together with the unchanged tables; returns its number.

    `base` is the version that the new rows were made from, by default the newest.
    """
    known = versions(spark, root)
    base = (known[-1] if known else 0) if base is None else base
    entries = manifest(spark, root, base) if base else {}
    for name, df in tables.items():
        path = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/{path}")
        entries[name] = {"path": path, "schema": df.schema.jsonValue()}
    publish(spark, root, entries, base + 1)
    return base + 1


def publish(spark: SparkSession, root: str, entries: Mapping[str, dict], number: int) -> None:
    """The manifest `number`, there whole or not at all."""
    fs, path = _files(spark, root)
    draft, final = path(f"{root}/{MANIFESTS}/.{uuid.uuid4().hex}"), path(f"{root}/{MANIFESTS}/{number:012d}.json")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(entries, sort_keys=True).encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"version {number} of {root} exists")


def drop_old(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete versions but the newest `keep`, and every table folder that none of these names; returns the folders deleted.

    Only when no commit is on its way: what it has written is not named yet.
    """
    fs, path = _files(spark, root)
    known = versions(spark, root)
    named = {e["path"] for v in known[-keep:] for e in manifest(spark, root, v).values()}
    for v in known[:-keep]:
        fs.delete(path(f"{root}/{MANIFESTS}/{v:012d}.json"), False)
    gone = []
    for table in fs.listStatus(path(root)):
        name = table.getPath().getName()
        if name == MANIFESTS or not table.isDirectory():
            continue
        for folder in fs.listStatus(table.getPath()):
            at = f"{name}/{folder.getPath().getName()}"
            if at not in named:
                fs.delete(folder.getPath(), True)
                gone.append(at)
    return sorted(gone)
