"""Tables written to the folder that driver and executors share.

A table written here cuts lineage: a lost executor costs a re-read, not a recomputation, and what
was computed once (row numbers, tokens, sketches) stays as it was. Tables that later ones have taken
up are deleted by :func:`discard`; all others of a session when the driver's Python ends.
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
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clear() -> None:
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark, path)


def new_path(spark: SparkSession, tag: str) -> str:
    """A folder for a table of this session."""
    path = f"{shared_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def store(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and returns a DataFrame that reads it.

    An empty ``df`` keeps its schema. Columns must have distinct names.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing still unread depends on."""
    for df in tables:
        path = df.__dict__.pop("_stored", None)
        if path is not None and _written.pop(path, None) is not None:
            _delete(df.sparkSession, path)
