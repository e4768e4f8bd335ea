"""The folder that executors share, and shipping this package to them."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


#: The folder of each application.
_homes: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``):
    in a folder of this application, which is deleted when it ends.

    Only a local session without that setting gets a temporary folder of this
    machine; a cluster without it is an error."""
    own = spark.sparkContext.applicationId
    if own not in _homes:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        home = f"{base.rstrip('/')}/palimpsest-{own}"
        p = spark._jvm.org.apache.hadoop.fs.Path(home)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _homes[own] = home
    return f"{_homes[own]}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back; lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python unless they find it already."""
    context = spark.sparkContext
    near = [os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if str(ROOT) in near or context.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="palimpsest-")) / "palimpsest.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in (ROOT / "palimpsest").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
