"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) has this remainder by FOLDS are held out of every fit.
FOLDS, HELD_OUT = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a dataset directory; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where the document is held out; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


#: The folder of each local application that was started without spark.checkpoint.dir.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or the context's checkpoint folder.

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
    """Write `df` to a fresh table in the shared folder and read it back.

    This cuts the lineage: later stages reread files that every executor sees, whichever executor is lost. The table is
    removed when the application ends.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Arrow batches of fewer rows for what runs inside, so that whole texts don't fill a worker's and the JVM's buffers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_prefix(df: DataFrame) -> str:
    """A prefix of underscores that no column of `df` begins with, for columns that come and go within an operator."""
    longest = max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0)
    return "_" * (longest + 1)


def columns(df: DataFrame, *but: str) -> list[Column]:
    """The columns of `df`, whatever their names hold, without those named in `but` (in any case of letters)."""
    left_out = {c.lower() for c in but}
    return [quoted(c) for c in df.columns if c.lower() not in left_out]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
