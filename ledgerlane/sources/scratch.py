"""Tables between steps: written once in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_scratch: list[str] = []
_own: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local session that sets none gets a temporary folder of its own; on a cluster an unset
    folder is an error, since a machine's own folder would not be seen by the others.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not _local_scratch:
        folder = tempfile.mkdtemp(prefix="ledgerlane-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_scratch.append(f"file://{folder}")
    return _local_scratch[0]


def folder(spark: SparkSession) -> str:
    """This program's own folder in the shared one; it goes when the program ends."""
    path = f"{scratch(spark)}/ledgerlane/{spark.sparkContext.applicationId}"
    if path not in _own:
        fs, p = _at(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _own.add(path)
    return path


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: lineage ends here, and a
    lost executor loses nothing that was written. The table stays until the program ends or clear_scratch()."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes this program's tables in the shared folder; results that are read from them must have been
    saved before."""
    fs, p = _at(spark, folder(spark))
    fs.delete(p, True)
    _own.clear()
