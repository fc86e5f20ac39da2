"""Cutting lineage in the folder that the cluster shares.

Results are written as Parquet and read back, not checkpointed as RDDs: a checkpoint keeps the estimated
size of the plan it replaces, and in loops of joins the estimates multiply without bound.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode, as in
    tests; on a cluster, where executors would not share it, an error."""
    sc = spark.sparkContext
    found = spark.conf.get(_KEY, None) or sc.getConf().get(_KEY, None) or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, read back; deleted when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/scenes-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the session may have ended
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
