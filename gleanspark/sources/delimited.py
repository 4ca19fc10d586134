"""Delimited files of unknown delimiter as wide tables of strings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_LINES, HEAD_CHARS = 50, 2000


def delimiter(spark: SparkSession, path: str) -> str:
    """A tab if the first characters hold more of them than commas, else a comma."""
    lines = spark.read.text(path).select(F.substring("value", 1, HEAD_CHARS).alias("line")).limit(HEAD_LINES).collect()
    head = "\n".join(r.line for r in lines)[:HEAD_CHARS]
    return "\t" if head.count("\t") > head.count(",") else ","


def read_delimited(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(pos, one string column a header): the rows of a file with a header line, or of a folder of such files.

    Rows without any filled cell are left out; short rows end in nulls; pos grows in the order of the file. Headers are
    trimmed, a nameless one becomes column_n. Without `multi_line` a file is split among tasks, so no quoted cell may
    hold a line break. An empty file gives no rows and no columns but pos.
    """
    read = spark.read.options(sep=delimiter(spark, path), header=True, quote='"', escape='"', multiLine=multi_line).csv(path)
    names = [f"column_{i}" if c == f"_c{i - 1}" or not c.strip() else c.strip() for i, c in enumerate(read.columns, 1)]
    wide = read.toDF(*names)
    if not names:
        return wide.select(F.lit(0).cast("long").alias("pos")).limit(0)
    filled = reduce(or_, (F.coalesce(F.trim(wide[f"`{c}`"]), F.lit("")) != "" for c in names))
    return wide.where(filled).select(F.monotonically_increasing_id().alias("pos"), "*")
