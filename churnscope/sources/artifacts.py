"""Published sets of artifacts (S10, S11, M16): many files that readers take together or not at all.

A run writes everything into a version folder of its own. Its manifest, which names every file with
its size, is written last, under a temporary name, and moved to its place. Readers take the newest
version that has a manifest, so a killed run leaves the set before it readable and two runs never
mix. Only file names pass through the driver, one row a file of a fitted model or a report table.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _files(spark: SparkSession, folder: str) -> dict:
    """Size of every file below ``folder``, by its path within it."""
    fs, p = _fs(spark, folder)
    base, out = fs.makeQualified(p).toString().rstrip("/") + "/", {}
    it = fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        out[f.getPath().toString().removeprefix(base)] = f.getLen()
    return out


def publish(spark: SparkSession, root: str, write: Callable[[str], object], info: dict | None = None) -> str:
    """``write(folder)`` into a fresh version folder, then the manifest; returns the folder."""
    root = root.rstrip("/")
    version = f"{_dt.datetime.now(_dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    folder = f"{root}/versions/{version}"
    write(folder)
    manifest = json.dumps({"version": version, "files": _files(spark, folder), **(info or {})}, sort_keys=True)
    fs, part = _fs(spark, f"{root}/manifests/_{version}.part")
    out = fs.create(part, False)
    out.write(bytearray(manifest.encode()))
    out.close()
    if not fs.rename(part, _fs(spark, f"{root}/manifests/{version}.json")[1]):
        raise OSError(f"manifest of {folder} could not be put in place")
    return folder


def versions(spark: SparkSession, root: str) -> list:
    """Published versions, oldest first."""
    fs, p = _fs(spark, f"{root.rstrip('/')}/manifests")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith("_"))


def published(spark: SparkSession, root: str, version: str | None = None) -> tuple:
    """(folder, manifest) of the newest published version or the named one. Every file of the manifest must
    still be there with its size."""
    known = versions(spark, root)
    version = version or (known[-1] if known else None)
    if version not in known:
        raise FileNotFoundError(f"no published version {version or ''} in {root}")
    root = root.rstrip("/")
    text = spark.read.text(f"{root}/manifests/{version}.json", wholetext=True).first().value
    manifest, folder = json.loads(text), f"{root}/versions/{version}"
    have = _files(spark, folder)
    wrong = sorted(f for f, size in manifest["files"].items() if have.get(f) != size)
    if wrong:
        raise FileNotFoundError(f"{folder} lacks or has other contents in: {', '.join(wrong[:5])}")
    return folder, manifest
