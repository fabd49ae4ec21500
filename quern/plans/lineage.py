"""Cutting lineage in the folder that the cluster shares.

The folder is `spark.checkpoint.dir`. Where it is unset and the master is local (tests, a laptop) a temporary folder of
this process is set once; on a cluster, whose executors have other disks, that is an error. Executor-local checkpoints
are never used: their only copy goes with the executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI or path; sets a temporary one only where none is set and one machine does all."""
    folder = spark.sparkContext.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/quern/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, written to the shared folder, read back from there.

    The columns get new identities, so that the result joins freely with frames that it was made from.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    made = df.checkpoint(eager=True)
    return made.toDF(*made.columns)


def written(df: DataFrame) -> DataFrame:
    """A table in the shared folder in place of a plan; unlike a checkpoint it carries no constraints of the old plan."""
    folder = fresh_dir(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored(df: DataFrame, compression: str = "zstd") -> tuple[DataFrame, str]:
    """`written` with a denser codec, and the folder, for `clear` when no plan reads it any more."""
    folder = fresh_dir(df.sparkSession, "table")
    df.write.option("compression", compression).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What a job shuffles within goes when its result is written; else it stays until the driver happens to collect its garbage."""
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def clear(spark: SparkSession, folder: str) -> bool:
    """Removes one folder that `fresh_dir` named, and nothing else; call it when nothing reads it any more."""
    if not folder.startswith(f"{shared_dir(spark)}/quern/"):
        raise ValueError(f"{folder} isn't a folder of this library")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
