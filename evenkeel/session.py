"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

GROUP_ROWS_KEY = "evenkeel.group.rows"
GROUP_ROWS_DEFAULT = 1_000_000

BROADCAST_ROWS_KEY = "evenkeel.broadcast.rows"
BROADCAST_ROWS_DEFAULT = 200_000

_LOCAL_DIR: dict[str, str] = {}


def group_rows_limit(spark: SparkSession) -> int:
    """Largest group that one task may sort; larger groups are split over many tasks."""
    return int(spark.conf.get(GROUP_ROWS_KEY, str(GROUP_ROWS_DEFAULT)))


def broadcast_rows_limit(spark: SparkSession) -> int:
    """Largest measured row count that may be sent to every executor."""
    return int(spark.conf.get(BROADCAST_ROWS_KEY, str(BROADCAST_ROWS_DEFAULT)))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Place rows by ``keys`` over the full number of shuffle partitions.

    For rows that are few and small now but will be multiplied or computed on inside the stage:
    with an explicit count, adaptive execution does not merge them into one task by their size.
    """
    return df.repartition(shuffle_parts(df.sparkSession), *keys)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_DIR:
        _LOCAL_DIR[sc.applicationId] = tempfile.mkdtemp(prefix="evenkeel-")
    return _LOCAL_DIR[sc.applicationId]


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` as parquet to the shared folder and reading it back.

    The copy outlives lost executors, and every later branch sees the same rows in the
    same run, which a re-executed range partitioning would not guarantee.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/evenkeel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    copy.materialized_at = path
    return copy


def discard(*copies: DataFrame) -> None:
    """Delete copies made by :func:`materialize` that no later plan reads any more."""
    for df in copies:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.materialized_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
