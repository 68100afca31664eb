"""Session helpers: shared work folder, written intermediate tables, worker cache."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession


_MADE: set[str] = set()


def workspace(spark: SparkSession) -> str:
    """The application's own folder below that which ``spark.checkpoint.dir`` names, shared by driver and executors.

    It is deleted when the driver's JVM ends.  Only where the setting is absent
    (local tests) a temporary folder is made, and it is recorded in the setting
    so that later calls agree.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    own = f"{folder.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"
    if own not in _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MADE.add(own)
    return own


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of executors without
    recomputing ``df``, and branches that share ``df`` compute it once.
    """
    path = f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(*written: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Deletes what ``materialize`` wrote, or a folder, where nothing reads it any more."""
    for item in written:
        session = spark or item.sparkSession
        paths = [item] if isinstance(item, str) else {path.rsplit("/", 1)[0] for path in item.inputFiles()}
        for path in paths:
            if path.startswith(workspace(session)) or isinstance(item, str):
                where = session._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(session._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application wrote for itself; results that still read from it can't be read any more."""
    folder = workspace(spark)
    remove(folder, spark=spark)
    _MADE.discard(folder)


def worker_cache() -> dict:
    """Dictionary that lives as long as the Python worker process."""
    module = sys.modules.setdefault("_tessera_worker_cache", types.ModuleType("_tessera_worker_cache"))
    return module.__dict__.setdefault("cache", {})
