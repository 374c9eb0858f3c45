"""Files that every machine of a cluster can see, and tables written there.

The folder is the one named by ``spark.checkpoint.dir``. Only a session on a
local master, as in tests, gets a temporary one.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a path or URI without a slash at its end."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="memspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark itself would resolve it: the same place for tasks that open files on their own."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, with its scheme; nothing is there yet."""
    path = qualified(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, it is computed once."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete what this process has written but for the first ``keep`` of made(); results that still read it become unusable."""
    while len(_made) > keep:
        _delete(spark, _made.pop())


def made() -> int:
    """How many folders have been made and not deleted."""
    return len(_made)


def drop(spark: SparkSession, first: int, last: int) -> None:
    """Delete the folders that were made from the first to before the last count of made()."""
    old = _made[first:last]
    _made[first:last] = []
    for folder in old:
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            release(spark)
        except Exception:  # noqa: BLE001  the session may be gone already
            _made.clear()
