"""A folder that driver and executors share, for tables that queries build once and probe often."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_own: list[str] = []
_built: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder if all runs in one JVM, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="evidentia-"))
    return _own[0]


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of names, lengths and times of the files below a path: another one means other data."""
    at, fs = _path(spark, path)
    files, seen = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def built(spark: SparkSession, name: str, source: str | tuple[str, ...], make: Callable[[str], None]) -> str:
    """The path of what make(path) wrote for this source, made once for each state of its files in this application. Of
    several sources, the states of all count."""
    sources = (source,) if isinstance(source, str) else source
    key = (spark.sparkContext.applicationId, name, sources, tuple(state_of(spark, s) for s in sources))
    if key not in _built:
        path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        at, fs = _path(spark, path)
        fs.deleteOnExit(at)
        make(path)
        _built[key] = path
    return _built[key]
