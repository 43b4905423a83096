"""Session helpers: semantic settings, the shared checkpoint folder, shipping the package."""

from __future__ import annotations

import os
import site
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What results depend on; everything else (master, memory, partitions) is the cluster's or the caller's.
SEMANTIC = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "streamlearn", **conf: str) -> SparkSession:
    """Create (or reuse) a session: only the semantic settings are set, and what the caller names.

    ``conf`` takes further settings with ``__`` for the dots (``spark__driver__memory="8g"``).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in SEMANTIC.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    It must be set to a file system that all executors share.  Only in local mode, where driver and
    executors are one process, a fresh temporary folder stands in for it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="streamlearn-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Used where a result is read by several later jobs (global positions,
    per-epoch model state) so that a lost executor re-reads files instead of
    recomputing a long lineage.  ``spark.cleaner.referenceTracking.cleanCheckpoints``
    removes the files of frames that are no longer referenced.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: like ``reliable_checkpoint``, but
    columnar, so later readers fetch only the columns they use."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, unless it is installed or on their PYTHONPATH; once per application."""
    package = Path(__file__).resolve().parent
    root = str(package.parent)
    app = spark.sparkContext.applicationId
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + site.getsitepackages()
    if app in _SHIPPED or root in known:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="streamlearn-zip-"), "streamlearn.zip")     # the driver serves it
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
