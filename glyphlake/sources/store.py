"""Tables written to the folder that all executors share, and read again."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that aren't deleted yet, with their sessions.
_OPEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, local mode gets a temporary folder and a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="glyphlake-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, kind: str = "table") -> str:
    """A new folder name in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/glyphlake-{kind}-{uuid.uuid4().hex}"
    _OPEN[path] = spark
    return path


def holder(path: str) -> SparkSession | None:
    """The session of a folder that isn't deleted yet."""
    return _OPEN.get(path)


def delete(spark: SparkSession, path: str) -> None:
    _OPEN.pop(path, None)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_OPEN.items()):
        try:
            delete(spark, path)
        except Exception:  # the session has ended; its shared folder is the cluster's to clear
            return


def stored(df: DataFrame) -> DataFrame:
    """The table, written and read again: a lost executor costs a reread, and both readers of it see the same rows."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
