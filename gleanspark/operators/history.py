"""Relations over the history of source reads: reputation, signals for ranking, retention, and tracks with counts.

A history has the columns id, instance_id, url, domain, status, accepted, fetched_at. "Now" is always a parameter.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.sources.tables import table

FINISHED = ("succeeded", "failed", "cancelled")


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def reputation(history: DataFrame, limit: int = 200) -> DataFrame:
    """Outcomes per domain over all tracks, the most accepted rows first; a top-`limit` report."""
    found = history.groupBy("domain").agg(
        F.count("*").alias("attempts"),
        _count_if(F.col("accepted") > 0).alias("productive"),
        F.sum("accepted").alias("accepted_rows"),
        _count_if(F.col("status") == "blocked").alias("blocked"),
        _count_if(F.col("status") == "failed").alias("failed"),
        F.max(F.when(F.col("status") == "blocked", F.col("fetched_at"))).alias("last_blocked_at"),
        F.max("fetched_at").alias("last_seen_at"),
    )
    return found.orderBy(F.desc("accepted_rows"), F.desc("attempts"), "domain").limit(limit)


def site_knowledge(history: DataFrame) -> DataFrame:
    """Reads, useful reads, accepted rows and blocked reads per named domain, in lower case."""
    return (
        history.where("domain <> ''")
        .groupBy(F.lower("domain").alias("domain"))
        .agg(F.count("*").alias("reads"), _count_if(F.col("accepted") > 0).alias("useful_reads"), F.coalesce(F.sum("accepted"), F.lit(0)).alias("accepted_rows"), _count_if(F.col("status") == "blocked").alias("blocked_reads"))
    )


def merge_knowledge(*parts: DataFrame) -> DataFrame:
    """Knowledge of several installations, summed per domain."""
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    return both.groupBy("domain").agg(*[F.sum(c).alias(c) for c in ("reads", "useful_reads", "accepted_rows", "blocked_reads")])


def latest_reads(history: DataFrame, *keys: str) -> DataFrame:
    """The row of largest id per key. An aggregate, so rows are combined before the shuffle."""
    row = F.struct(*[F.col(c) for c in history.columns if c not in keys])
    last = history.groupBy(*keys).agg(F.max_by(row, "id").alias("row"))
    return last.select(*keys, "row.*").select(*history.columns)


def proven_domains(history: DataFrame) -> DataFrame:
    """Accepted rows per track and domain over the latest read of each page, where there are any."""
    latest = latest_reads(history, "instance_id", "url")
    return latest.groupBy("instance_id", "domain").agg(F.sum("accepted").alias("rows")).where("rows > 0")


def blocked_domains(history: DataFrame, as_of: datetime, cooldown_days: int = 7) -> DataFrame:
    """Domains that any track saw blocked within the cooldown, and when last."""
    since = as_of - timedelta(days=cooldown_days)
    return history.where((F.col("status") == "blocked") & (F.col("fetched_at") >= F.lit(since).cast("timestamp_ntz"))).groupBy("domain").agg(F.max("fetched_at").alias("blocked_at"))


def keep_history(history: DataFrame, as_of: datetime, days: int = 180) -> DataFrame:
    """History without reads older than `days`, except the latest read of every page of a track."""
    latest = history.groupBy("instance_id", "url").agg(F.max("id").alias("id"))
    recent = history.where(F.col("fetched_at") >= F.lit(as_of - timedelta(days=days)).cast("timestamp_ntz"))
    old = history.where(F.col("fetched_at") < F.lit(as_of - timedelta(days=days)).cast("timestamp_ntz"))
    return recent.unionByName(old.join(latest.select("id"), "id", "left_semi").select(*history.columns))


def keep_runs(runs: DataFrame, as_of: datetime, days: int = 90, newest: int = 20) -> DataFrame:
    """Runs without finished ones older than `days` beyond the newest `newest` of their track."""
    order = Window.partitionBy("instance_id").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = runs.withColumn("_n", F.row_number().over(order))
    gone = (F.col("_n") > newest) & (F.col("created_at") < F.lit(as_of - timedelta(days=days)).cast("timestamp_ntz")) & F.col("status").isin(*FINISHED)
    return ranked.where(~gone).drop("_n")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key no parent has."""
    return rows.join(parents.select(key).distinct(), key, "left_anti")


def fresh(reads: DataFrame, as_of: datetime, minutes: int) -> DataFrame:
    """Reads that are young enough to be used again."""
    return reads.where(F.col("fetched_at") >= F.lit(as_of - timedelta(minutes=minutes)).cast("timestamp_ntz"))


def tracks_with_counts(tracks: DataFrame, rows: DataFrame, key: str, row_key: str) -> DataFrame:
    """Tracks with the number of their dataset's rows, 0 without a dataset."""
    counted = rows.groupBy(F.col(row_key).alias(key)).agg(F.count("*").alias("dataset_row_count"))
    return tracks.join(counted, key, "left").withColumn("dataset_row_count", F.coalesce("dataset_row_count", F.lit(0)))


def status_changes(events: DataFrame, key: str, order: list[str], watched: list[str]) -> DataFrame:
    """Events at which the watched columns differ from the event before, the first of each key included."""
    by_time = Window.partitionBy(key).orderBy(*order)
    state = F.struct(*watched)
    return events.withColumn("_before", F.lag(state).over(by_time)).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(state)).drop("_before")


# --- queries over `events` read as a history


def history_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    site = F.concat(F.lit("S"), (F.col("user_id") % 40).cast("string"), F.lit(".example"))
    return e.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 7).alias("instance_id"),
        F.concat(F.lit("https://"), F.lower(site), F.lit("/p"), (F.col("event_id") % 23).cast("string")).alias("url"),
        site.alias("domain"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "blocked").otherwise("read").alias("status"),
        F.when(F.col("event_type").isin("purchase", "view"), F.floor("value")).otherwise(0).cast("long").alias("accepted"),
        F.col("ts").alias("fetched_at"),
    )


def runs_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("succeeded")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("instance_id"), status.alias("status"), F.col("ts").alias("created_at"))


def _now(df: DataFrame, column: str) -> datetime:
    return df.agg(F.max(column)).first()[0]


H = """WITH h AS (SELECT event_id AS id, user_id % 7 AS instance_id, 'https://s' || (user_id % 40) || '.example/p' || (event_id % 23) AS url,
  'S' || (user_id % 40) || '.example' AS domain,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'blocked' ELSE 'read' END AS status,
  CASE WHEN event_type IN ('purchase', 'view') THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS accepted, ts AS fetched_at FROM events)"""
_SUMS = """count(*) AS reads, CAST(sum(CASE WHEN accepted > 0 THEN 1 ELSE 0 END) AS BIGINT) AS useful_reads,
  CAST(sum(accepted) AS BIGINT) AS accepted_rows, CAST(sum(CASE WHEN status = 'blocked' THEN 1 ELSE 0 END) AS BIGINT) AS blocked_reads"""


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history_of_events(spark, sf_dir)
    return blocked_domains(h, _now(h, "fetched_at"))


def _purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history_of_events(spark, sf_dir)
    return keep_history(h, _now(h, "fetched_at"), days=10).select("id", "instance_id", "url")


def _purge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs_of_events(spark, sf_dir)
    return keep_runs(r, _now(r, "created_at"), days=5, newest=20).select("id", "instance_id", "status")


def _knowledge_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history_of_events(spark, sf_dir)
    return merge_knowledge(site_knowledge(h.where("instance_id < 3")), site_knowledge(h.where("instance_id >= 3")))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return tracks_with_counts(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey", "k")


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history_of_events(spark, sf_dir)
    return fresh(latest_reads(h, "url"), _now(h, "fetched_at"), 24 * 60).select("url", "id", "accepted")


QUERIES = {
    "source_reputation": lambda s, d: reputation(history_of_events(s, d)),
    "site_knowledge": lambda s, d: site_knowledge(history_of_events(s, d)),
    "merged_knowledge": _knowledge_sum,
    "latest_read_per_page": lambda s, d: latest_reads(history_of_events(s, d), "instance_id", "url").select("instance_id", "url", "id", "accepted"),
    "proven_domains": lambda s, d: proven_domains(history_of_events(s, d)),
    "blocked_within_cooldown": _blocked,
    "purge_history": _purge,
    "purge_runs": _purge_runs,
    "fresh_reads": _fresh,
    "tracks_with_counts": _tracks,
    "orphan_documents": lambda s, d: orphans(table(s, d, "documents").select("doc_id", "n_chars"), table(s, d, "labels"), "doc_id"),
    "status_changes": _changes,
}
ORACLE = {
    "source_reputation": f"""{H} SELECT domain, count(*) AS attempts, CAST(sum(CASE WHEN accepted > 0 THEN 1 ELSE 0 END) AS BIGINT) AS productive,
  CAST(sum(accepted) AS BIGINT) AS accepted_rows, CAST(sum(CASE WHEN status = 'blocked' THEN 1 ELSE 0 END) AS BIGINT) AS blocked,
  CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  max(CASE WHEN status = 'blocked' THEN fetched_at END) AS last_blocked_at, max(fetched_at) AS last_seen_at
FROM h GROUP BY domain ORDER BY accepted_rows DESC, attempts DESC, domain LIMIT 200""",
    "site_knowledge": f"{H} SELECT lower(domain) AS domain, {_SUMS} FROM h WHERE domain <> '' GROUP BY 1",
    "merged_knowledge": f"{H} SELECT lower(domain) AS domain, {_SUMS} FROM h WHERE domain <> '' GROUP BY 1",
    "latest_read_per_page": f"{H} SELECT instance_id, url, id, accepted FROM h WHERE id IN (SELECT max(id) FROM h GROUP BY instance_id, url)",
    "proven_domains": f"""{H} SELECT instance_id, domain, CAST(sum(accepted) AS BIGINT) AS rows FROM h
WHERE id IN (SELECT max(id) FROM h GROUP BY instance_id, url) GROUP BY 1, 2 HAVING sum(accepted) > 0""",
    "blocked_within_cooldown": f"""{H} SELECT domain, max(fetched_at) AS blocked_at FROM h
WHERE status = 'blocked' AND fetched_at >= (SELECT max(fetched_at) FROM h) - INTERVAL 7 DAY GROUP BY 1""",
    "purge_history": f"""{H} SELECT id, instance_id, url FROM h
WHERE fetched_at >= (SELECT max(fetched_at) FROM h) - INTERVAL 10 DAY OR id IN (SELECT max(id) FROM h GROUP BY instance_id, url)""",
    "purge_runs": """WITH r AS (SELECT event_id AS id, user_id AS instance_id, CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status,
  ts AS created_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT id, instance_id, status FROM r WHERE NOT (n > 20 AND created_at < (SELECT max(ts) FROM events) - INTERVAL 5 DAY AND status IN ('succeeded', 'failed', 'cancelled'))""",
    "fresh_reads": f"""{H} SELECT url, id, accepted FROM h WHERE id IN (SELECT max(id) FROM h GROUP BY url)
AND fetched_at >= (SELECT max(fetched_at) FROM h) - INTERVAL 1440 MINUTE""",
    "tracks_with_counts": """SELECT c_custkey, c_name, coalesce(n, 0) AS dataset_row_count FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
    "orphan_documents": "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "status_changes": """SELECT event_id, user_id, event_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type""",
}
