"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or a temporary one where that is unset (tests, a single machine)."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="nearfield-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark).rstrip('/')}/nearfield/{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns a reader of it: lineage ends there and lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Deletes a stashed table that nothing reads any more."""
    path = getattr(df, "_stash_path", None)
    if path:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session may have gone
            return
