"""Tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one of our own, but only if driver and executors are one process; a cluster without it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir is not set; on {master} tables in between need a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="lograil-"))
    return _own_dir[0]


def written(df: DataFrame, name: str) -> str:
    """Writes a table to the shared folder and returns its path."""
    path = own_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes a table to the shared folder and reads it back, so that lost executors cost no recomputation. See clear."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for what is not written by written. clear deletes it too."""
    path = f"{shared_dir(spark).rstrip('/')}/lograil/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of this process in the shared folder."""
    for path in paths:
        delete(spark, path)
        _made.remove(path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables and paths that this process made in the shared folder. For when its results have been written elsewhere: results not yet read still need them."""
    remove(spark, *list(_made))
