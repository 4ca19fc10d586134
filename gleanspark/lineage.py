"""Intermediate tables in the folder that driver and executors share, so that a lost executor costs at most a stage.

And rows dealt evenly, so that work which is long for its bytes has as many tasks as a shuffle.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of each local application that was started without spark.checkpoint.dir.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the context's checkpoint folder.

    Where neither is set and the master is local (tests, a laptop) a temporary one is made once for the application. On a
    cluster it must be set, as its machines share no folder otherwise.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="gleanspark-")
        found = _LOCAL[context.applicationId]
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, removed with all it holds when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a fresh table in the shared folder and read it back. This cuts the lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt evenly over spark.sql.shuffle.partitions.

    For rows of few bytes that take long: a file of them is read by a few tasks, whatever work follows.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
