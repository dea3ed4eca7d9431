"""The package itself as a file that executors fetch, for sessions whose workers can't import it by path."""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .storage import scratch_root

_SHIPPED: set[str] = set()


def _zipped() -> bytes:
    root = Path(__file__).parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{root.name}/{path.relative_to(root)}"), path.read_bytes())
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once; it lies in the folder that all executors share."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    data = _zipped()
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/textlode-{hashlib.sha256(data).hexdigest()[:16]}-{context.applicationId}.zip")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(data))
    out.close()
    context.addPyFile(target.toString())
    _SHIPPED.add(context.applicationId)
