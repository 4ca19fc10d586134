"""Flagship: revenue per year as chart-ready observations (window filter, typed values, one point per series and period)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.sources.tables import table


def revenue_per_year(spark: SparkSession, sf_dir: str, first: int = 1995, last: int = 1998) -> DataFrame:
    """Sum of extendedprice * (1 - discount) by ship year and return flag, for years that overlap the window."""
    items = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_returnflag", "l_extendedprice", "l_discount")
    inside = items.where((F.col("l_shipdate") >= f"{first}-01-01") & (F.col("l_shipdate") < f"{last + 1}-01-01"))
    return (
        inside.groupBy(F.year("l_shipdate").cast("string").alias("period"), F.col("l_returnflag").alias("series"))
        .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n_rows"))
    )


QUERIES = {"revenue_per_year": revenue_per_year}
ORACLE = {
    "revenue_per_year": """
SELECT CAST(year(l_shipdate) AS VARCHAR) AS period, l_returnflag AS series,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_rows
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'
GROUP BY 1, 2""",
}
