"""Session helpers shared by every query: shipping the package, cutting lineage."""

from __future__ import annotations

import gc
import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of a batch that goes to a Python worker, where the caller names none: texts are long, and both sides hold batches
#: outside the heap.
BATCH, DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        blob = io.BytesIO()
        with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith((".py", ".json")):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("tessera", os.path.relpath(path, root)))
        target = os.path.join(tempfile.mkdtemp(), "tessera.zip")
        with open(target, "wb") as f:
            f.write(blob.getvalue())
        sc.addPyFile(target)
        _shipped.add(sc.applicationId)
        if not sc.getConf().contains(BATCH) and spark.conf.get(BATCH) == DEFAULT:
            spark.conf.set(BATCH, str(BATCH_BYTES))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows go to the shared folder the cluster names in spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    kept = df.checkpoint(eager=True)
    sweep(df.sparkSession)
    return kept


def sweep(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and broadcasts of plans that nothing refers to any more.

    Spark does so when the driver's JVM collects garbage; a driver with memory to spare does not for long, while
    each finished step's files, one of each task and a block of disk at least, stay.
    """
    gc.collect()  # Python's references to plans go first
    spark.sparkContext._jvm.System.gc()
