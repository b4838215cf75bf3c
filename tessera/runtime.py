"""Makes the package importable on executors, and names folders that they share with the driver."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Adds this package to the application's Python files, once per application, so that functions
    that run on executors find it there without an installation.

    Where the session has Spark's own limit for Arrow batches, 64 MB, it gets 8 MB: a batch is held a
    few times over, outside the JVM's heap and in the Python worker of each core.
    """
    if spark.conf.get(_BATCH_BYTES) == "67108864b":
        spark.conf.set(_BATCH_BYTES, "8m")
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the one that the session names for checkpoints. Where none is named, local mode
    gets a folder of this machine; a cluster gets an error, as its executors could not see that."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that they share with the driver")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tessera/{tag}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out if the scan has fewer tasks than there are cores, as with a small file of one row
    group; a large table has more tasks than that and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
