"""Scored observations as what users read: tidy cells or raw ones, provenance, exports, and the counts beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.operators.tables import build_table, columns_for, export
from gleanspark.sources.tables import table

# The columns that tell where a row comes from, and the order of a snapshot's parts.
PROVENANCE = ("source_url", "data_period", "time_inferred", "temporal_confidence", "tier", "score", "published_at", "modified_at", "fetched_at")
STATUSES = ("accepted", "partial", "rejected")


def values(normalized: Column, fields: Column) -> Column:
    """A row's tidy fields where scoring made some, else its raw ones."""
    return F.when(F.size(F.coalesce(normalized, F.array().cast("array<struct<name:string,value:string>>"))) > 0, normalized).otherwise(fields)


def snapshot(rows: DataFrame, include: tuple[str, ...] = STATUSES) -> DataFrame:
    """Rows of these statuses, one status after the other, each in its own order (pos); others and nulls are left out."""
    order = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return rows.where(F.col("status").isin(*include)).orderBy(order, "pos")


def cells(rows: DataFrame) -> DataFrame:
    """(pos, at, name, value): the cells of rows with pos, normalized and fields, as `tables.columns_for` and `build_table` take them."""
    return rows.select("pos", F.posexplode(values(F.col("normalized"), F.col("fields"))).alias("at", "c")).select("pos", "at", "c.*")


def with_provenance(wide: DataFrame, rows: DataFrame) -> DataFrame:
    """A built table with the PROVENANCE of its rows as text; what is missing is empty."""
    told = rows.select("pos", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in PROVENANCE])
    return wide.join(told, "pos")


def export_rows(rows: DataFrame, path: str, kind: str = "csv", measures: list[str] | None = None, include_partial: bool = False, provenance: bool = False) -> list[str]:
    """Write accepted rows (and partial ones) as a wide csv, jsonl or parquet table, and return its columns.

    Period and series come first, then the measures that were asked for, then others as they first appear. Rows without any
    cell are left out. Spark writes one file a partition.
    """
    wanted = rows.where(F.col("status").isin(*(STATUSES[:2] if include_partial else STATUSES[:1])))
    long = cells(wanted)
    names = columns_for(long, measures)
    wide = build_table(long, names)
    told = with_provenance(wide, wanted) if provenance else wide
    own = [*names, *(PROVENANCE if provenance else ())]
    export(told.select(*[F.col(f"`{c}`") for c in own]), path, kind)
    return own


def tallies(rows: DataFrame) -> DataFrame:
    """One row: rows by status and by tier (maps), explicit and inferred periods, distinct ones, first and last day, mean score of
    accepted rows, and their sources."""
    accepted = F.col("status") == "accepted"
    dated = accepted & F.col("data_period").isNotNull()
    counted = rows.groupBy("status", "tier").agg(F.count("*").alias("n"))
    by = lambda c: counted.groupBy(c).agg(F.sum("n").alias("n")).where(F.col(c).isNotNull()).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(c))
    one = rows.agg(
        F.count_if(dated & ~F.col("time_inferred")).alias("explicit_periods"), F.count_if(dated & F.col("time_inferred")).alias("inferred_periods"),
        F.count_distinct(F.when(dated, F.col("data_period"))).alias("distinct_periods"), F.min(F.when(dated, F.col("data_period"))).alias("period_min"), F.max(F.when(dated, F.col("data_period"))).alias("period_max"),
        F.round(F.avg(F.when(accepted, F.col("score"))), 3).alias("mean_score"),
    )
    sources = rows.where(accepted).select("source_url").distinct().agg(F.count("source_url").alias("source_count"))
    found = one.withColumn("k", F.lit(1))
    for side in (by("status"), by("tier"), sources):  # a row each
        found = found.join(side.withColumn("k", F.lit(1)), "k")
    return found.drop("k")


# --- queries


def rows_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scored observations: a third without tidy fields, periods of some inferred."""
    o = table(spark, sf_dir, "orders")
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    k = F.col("o_orderkey")
    raw = F.array(pair("Total Price", F.floor("o_totalprice").cast("string")), pair("state", F.col("o_orderstatus")))
    tidy = F.when(k % 3 > 0, F.array(pair("period", F.date_format("o_orderdate", "yyyy")), pair("price", F.concat(F.lit("$"), F.floor("o_totalprice").cast("string")))))
    return o.select(
        k.alias("pos"), F.when(k % 4 < 2, "accepted").when(k % 4 == 2, "partial").otherwise("rejected").alias("status"),
        F.when(k % 4 == 0, "high").when(k % 4 == 1, "usable").when(k % 4 == 2, "partial").otherwise("low").alias("tier"),
        F.round(F.col("o_custkey") % 100 / 100, 2).alias("score"), raw.alias("fields"), tidy.alias("normalized"),
        F.concat(F.lit("https://x.org/"), (F.col("o_custkey") % 50).cast("string")).alias("source_url"), F.when(k % 5 > 0, F.date_format("o_orderdate", "yyyy")).alias("data_period"),
        (k % 2 == 0).alias("time_inferred"), F.when(k % 5 > 0, 0.5).alias("temporal_confidence"), F.col("o_orderdate").cast("date").alias("published_at"),
        F.lit(None).cast("date").alias("modified_at"), F.lit(None).cast("date").alias("fetched_at"),
    )


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of_orders(spark, sf_dir).where("status <> 'rejected'")
    long = cells(rows)
    return with_provenance(build_table(long, columns_for(long, ["price"])), rows)


def _tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = tallies(rows_of_orders(spark, sf_dir))
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ";").alias(c)
    return told.select(flat("status"), flat("tier"), *[c for c in told.columns if c not in ("status", "tier")])


QUERIES = {"exported_rows": _exported, "row_tallies": _tallies}
_R = """WITH r AS (SELECT o_orderkey AS pos, o_orderkey % 4 AS q, o_orderkey % 3 AS t, strftime(o_orderdate, '%Y') AS y, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS p, o_orderstatus AS s, o_orderdate::DATE AS d,
  round((o_custkey % 100) / 100.0::DOUBLE, 2) AS score, 'https://x.org/' || (o_custkey % 50) AS source_url, o_orderkey % 5 > 0 AS dated, o_orderkey % 2 = 0 AS inferred,
  ['high', 'usable', 'partial', 'low'][o_orderkey % 4 + 1] AS tier, ['accepted', 'accepted', 'partial', 'rejected'][o_orderkey % 4 + 1] AS status FROM orders)"""
ORACLE = {
    "exported_rows": f"""{_R} SELECT pos, CASE WHEN t > 0 THEN y ELSE '' END AS period, CASE WHEN t > 0 THEN '$' || p ELSE '' END AS price, CASE WHEN t = 0 THEN p ELSE '' END AS "Total Price", CASE WHEN t = 0 THEN s ELSE '' END AS state,
  source_url, CASE WHEN dated THEN y ELSE '' END AS data_period, inferred::VARCHAR AS time_inferred, CASE WHEN dated THEN '0.5' ELSE '' END AS temporal_confidence, tier, score::VARCHAR AS score, d::VARCHAR AS published_at, '' AS modified_at, '' AS fetched_at
FROM r WHERE status <> 'rejected'""",
    "row_tallies": f"""{_R}, a AS (SELECT * FROM r WHERE status = 'accepted')
SELECT (SELECT string_agg(status || '=' || n, ';' ORDER BY status) FROM (SELECT status, count(*) AS n FROM r GROUP BY 1)) AS status, (SELECT string_agg(tier || '=' || n, ';' ORDER BY tier) FROM (SELECT tier, count(*) AS n FROM r GROUP BY 1)) AS tier,
  count(*) FILTER (dated AND NOT inferred) AS explicit_periods, count(*) FILTER (dated AND inferred) AS inferred_periods, count(DISTINCT y) FILTER (dated) AS distinct_periods, min(y) FILTER (dated) AS period_min, max(y) FILTER (dated) AS period_max,
  round(avg(score), 3) AS mean_score, count(DISTINCT source_url) AS source_count FROM a""",
}
