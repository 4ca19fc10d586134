"""Live operation: counts over windows, sessions, incremental reads, upserts by micro-batch, and a rate limiter with rests.

Batch and stream share the same functions; a stream passes a streaming DataFrame. Event windows and sessions are
additions of this engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanspark.sources.tables import table

REST_S, LONGEST_REST_S, HOURLY = 15 * 60, 4 * 3600, 30  # fixed values: first rest, longest rest, actions an hour


def event_counts(events: DataFrame, every: str = "1 hour", late: str | None = None, ts: str = "ts", by: str = "event_type") -> DataFrame:
    """Events and their values per tumbling window and type. `late` sets a watermark, for streams."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if late else timed
    return timed.groupBy(F.window("_ts", every).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, ts: str = "ts", by: str = "user_id") -> DataFrame:
    """Runs of events of one user with no pause of `gap` or more."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if late else timed
    return timed.groupBy(F.session_window("_ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def new_ids(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Rows whose id the stream hasn't shown within the watermark."""
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([key]).drop("_ts")


def replace_by_source(batch: DataFrame, stored: DataFrame, source: str = "source_url") -> DataFrame:
    """The dataset after a read: rows of sources that were read again give way to the new ones."""
    return stored.join(batch.select(source).distinct(), source, "left_anti").unionByName(batch)


def run_upserts(stream: DataFrame, path: str, checkpoint: str, source: str = "source_url", then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Each micro-batch replaces the rows of its sources: version n of the table at `path`/n is n - 1 with the batch.

    A version is written whole before it is read, so a batch that runs again after a failure writes the same version.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        after = batch if n == 0 else replace_by_source(batch, spark.read.parquet(f"{path}/{n - 1}"), source)
        after.write.mode("overwrite").parquet(f"{path}/{n}")
        if then:
            then(spark.read.parquet(f"{path}/{n}"), n)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _limit(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Allow an action unless its host rests or has had HOURLY of them within the hour; each refusal doubles the rest."""
    strikes, until, recent = state.get if state.exists else (0, 0.0, [])
    recent = list(recent)
    for part in rows:
        part = part.sort_values(["seconds", "event_id"])
        allowed = []
        for t, blocked in zip(part["seconds"], part["blocked"], strict=True):
            recent = [x for x in recent if x > t - 3600]
            ok = t >= until and len(recent) < HOURLY
            if ok:
                recent.append(t)
                if blocked:
                    until, strikes = t + min(REST_S * 2**strikes, LONGEST_REST_S), strikes + 1
                else:
                    strikes = 0
            allowed.append(ok)
        yield part.assign(allowed=allowed)[["event_id", "host", "allowed"]]
    state.update((strikes, until, recent))


def rate_limited(actions: DataFrame) -> DataFrame:
    """(event_id, host, allowed) of a stream of actions (event_id, host, seconds, blocked), with state per host.

    The state holds the actions of the last hour, HOURLY at most. Actions of one micro-batch are taken in order of time.
    """
    return actions.groupBy("host").applyInPandasWithState(_limit, "event_id long, host string, allowed boolean", "strikes int, until double, recent array<double>", "append", "NoTimeout")


def running_totals(events: DataFrame) -> DataFrame:
    """Each event with its user's running count and value so far."""
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.select("event_id", "user_id", F.count("*").over(so_far).alias("n"), F.round(F.sum("value").over(so_far), 2).alias("total"))


def _reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_url"), "o_orderkey", "o_orderstatus")
    return replace_by_source(o.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("N")), o)


QUERIES = {
    "live_event_counts": lambda s, d: event_counts(table(s, d, "events")),
    "sessions": lambda s, d: sessions(table(s, d, "events")),
    "replace_on_reread": _reread,
    "running_totals": lambda s, d: running_totals(table(s, d, "events")).drop("total"),
}
ORACLE = {
    "live_event_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "sessions": """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
    "replace_on_reread": """WITH o AS (SELECT o_custkey AS source_url, o_orderkey, o_orderstatus FROM orders)
SELECT * FROM o WHERE source_url NOT IN (SELECT source_url FROM o WHERE o_orderkey % 10 = 0)
UNION ALL SELECT source_url, o_orderkey, 'N' FROM o WHERE o_orderkey % 10 = 0""",
    "running_totals": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events",
}
