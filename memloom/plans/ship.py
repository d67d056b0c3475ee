"""Sends this package to executors whose Python may not have it installed."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .iterate import shared_root

_sent: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Once for each application, by way of the shared folder; called before any Python runs on executors."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    top = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    root = shared_root(spark)
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/memloom/package-{uuid.uuid4().hex[:12]}/{top.name}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    _sent.add(sc.applicationId)
