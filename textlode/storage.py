"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_MARKED: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode without one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="textlode-")
        spark.sparkContext.setCheckpointDir(_LOCAL_ROOTS[app])
    return _LOCAL_ROOTS[app]


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of the path, the path)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder name that nothing has used; all such folders lie in one, which goes when the application ends."""
    root = f"{scratch_root(spark)}/textlode-{spark.sparkContext.applicationId}"
    if root not in _MARKED:
        fs, p = file_system(spark, root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _MARKED.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no unread DataFrame needs."""
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def arrow_files(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """(Arrow's file system of a path or URI, the path in it), for processes without a session."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
