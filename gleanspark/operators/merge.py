"""Merging results across runs: one bucket per row, changed rows only, unseen rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.sources.tables import table

BUCKETS = ("accepted", "partial", "rejected")


def merge_buckets(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row per id from rows with status and pos: accepted before partial before rejected, then the first to arrive."""
    rank = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("status"))
    body = F.struct(*[F.col(c) for c in rows.columns if c != key])
    first = rows.groupBy(key).agg(F.min_by(body, F.struct(rank, F.col("pos"))).alias("row"))
    return first.select(key, "row.*").select(*rows.columns)


def in_dataset_order(rows: DataFrame) -> DataFrame:
    """Accepted rows by period (none last), domain and falling score; equal ones in order of arrival."""
    return rows.orderBy(F.coalesce(F.nullif("period_start", F.lit("")), F.lit("9999")), "source_domain", F.desc("score"), "pos")


def newest(rows: DataFrame, keep: int = 5000) -> DataFrame:
    """The rows read last, `keep` of them, to be scored again."""
    return rows.orderBy(F.desc("fetched_at"), "pos").limit(keep)


def with_digest(df: DataFrame, columns: list[str], out: str = "digest") -> DataFrame:
    """SHA-1 over the columns, separated by a character that texts don't hold; nulls differ from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return df.withColumn(out, F.sha1(F.concat_ws("\x1f", *parts)))


def changed_rows(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of `new` that `old` lacks or holds otherwise. Only keys and digests of the old ones are read."""
    before = with_digest(old, columns).select(F.col(key).alias("_key"), F.col("digest").alias("_before"))
    after = with_digest(new, columns)
    return after.join(before, after[key] == before["_key"], "left").where(~F.col("digest").eqNullSafe(F.col("_before"))).drop("_key", "_before", "digest")


def unseen(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose id isn't known yet."""
    return new.join(known.select(key), key, "left_anti")


def append_rows(stored: DataFrame, new: DataFrame, key: str, row_id: str, order: str) -> DataFrame:
    """Rows to append per key: ids not stored yet, with positions after the largest stored one."""
    more = new.join(stored.select(key, row_id), [key, row_id], "left_anti")
    last = stored.groupBy(key).agg(F.max("position").alias("_last"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order, row_id))
    return more.withColumn("_n", nth).join(last, key, "left").withColumn("position", (F.coalesce("_last", F.lit(-1)) + F.col("_n")).cast("long")).drop("_n", "_last")


def recount_sources(rows: DataFrame) -> DataFrame:
    """Rows per source and status, and the status of the source that follows."""
    counts = rows.groupBy("source_url").agg(F.count("*").alias("raw"), *[F.coalesce(F.sum((F.col("status") == b).cast("long")), F.lit(0)).alias(b) for b in BUCKETS])
    return counts.withColumn("outcome", F.when(F.col("accepted") > 0, "used").when(F.col("partial") > 0, "partial").otherwise("no_data"))


# --- queries


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    part = lambda status, cond, off: o.where(cond).select("id", F.lit(status).alias("status"), (F.col("id") + off).alias("pos"), "score")
    return part("accepted", "id % 3 = 0", 0).union(part("partial", "id % 2 = 0", 7)).union(part("rejected", "id % 5 <> 1", 3)).union(part("partial", "id % 4 = 0", 1))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    new = p.withColumn("p_size", F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return changed_rows(new, p.where("p_partkey % 7 <> 0"), "p_partkey", ["p_name", "p_size"])


def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("row_id"), "l_partkey")
    stored = li.where("row_id <= 2").withColumn("position", F.col("row_id") - 1)
    return append_rows(stored, li, "key", "row_id", "l_partkey").select("key", "row_id", "position")


def _recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "partial").otherwise("rejected")
    return recount_sources(o.select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("source_url"), status.alias("status")))


QUERIES = {
    "merge_dedupe_buckets": lambda s, d: merge_buckets(_buckets(s, d)),
    "digest_changed_rows": _changed,
    "incremental_new_ids": lambda s, d: unseen(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "orders").where("o_orderdate < '1997-01-01'"), "o_orderkey"),
    "append_unseen_rows": _append,
    "recount_sources": _recount,
}
ORACLE = {
    "merge_dedupe_buckets": """WITH u AS (SELECT o_orderkey AS id, 'accepted' AS status, o_orderkey AS pos, o_totalprice AS score, 1 AS r FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'partial', o_orderkey + 7, o_totalprice, 2 FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'rejected', o_orderkey + 3, o_totalprice, 3 FROM orders WHERE o_orderkey % 5 <> 1
UNION ALL SELECT o_orderkey, 'partial', o_orderkey + 1, o_totalprice, 2 FROM orders WHERE o_orderkey % 4 = 0)
SELECT id, status, pos, score FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY r, pos) = 1""",
    "digest_changed_rows": """SELECT p_partkey, p_name, CASE WHEN p_partkey % 10 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 7 = 0""",
    "incremental_new_ids": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT o_orderdate < TIMESTAMP '1997-01-01'",
    "append_unseen_rows": """SELECT l_orderkey AS key, l_linenumber AS row_id,
  coalesce((SELECT max(s.l_linenumber) - 1 FROM lineitem s WHERE s.l_orderkey = l.l_orderkey AND s.l_linenumber <= 2), -1) + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS position
FROM lineitem l WHERE l_linenumber > 2""",
    "recount_sources": """SELECT *, CASE WHEN accepted > 0 THEN 'used' WHEN partial > 0 THEN 'partial' ELSE 'no_data' END AS outcome FROM (
  SELECT 'u' || o_custkey AS source_url, count(*) AS raw, count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) FILTER (o_orderstatus = 'O') AS partial,
    count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS rejected FROM orders GROUP BY 1)""",
}
