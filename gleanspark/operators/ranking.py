"""Candidate sources: additive scores, a share for each domain, and fair interleaving of result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.functions.strings import tokens
from gleanspark.functions.urls import domain_of, host_suffixes, path_of
from gleanspark.operators.history import H as HISTORY_SQL
from gleanspark.operators.history import history_of_events, latest_reads, proven_domains
from gleanspark.sources.tables import table

# What each signal adds to a candidate's score.
PREFERRED, PROVEN, SUGGESTED, UNREAD, UNPRODUCTIVE, READ_RECENTLY, BLOCKED = 100.0, 40.0, 25.0, 20.0, -40.0, -150.0, -60.0
SITE_NAME, CODE_HOST, KNOWN_GOOD, KNOWN_BLOCKING, RANK_STEP = 80.0, -150.0, 12.0, -25.0, 1.5
DATA_WORDS = ("data", "dataset", "statistic", "table", "chart", "database", "series", "index", "report", "figure", "survey", "census", "list", "annual", "monthly")
AUTHORITY_LABELS = ("gov", "gouv", "gob", "govt", "edu", "ac", "int", "mil")
CODE_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "pypi.org", "npmjs.com", "sourceforge.net", "githubusercontent.com", "huggingface.co", "kaggle.com")
DATA_CAP, DATA_STEP, AUTHORITY, TOPIC_CAP, TOPIC_STEP = 15.0, 4.0, 5.0, 10.0, 4.0


def match_site(candidates: DataFrame, sites: DataFrame, site: str, order: str, out: str, host: str = "domain") -> DataFrame:
    """Candidates with the first site (by `order`) that their host is or lies under, as column `out`, or null.

    The host's suffixes are exploded, so the suffix test is an equi-join that Spark can broadcast or shuffle.
    """
    ends = candidates.select(F.col(host).alias("_host")).distinct().withColumn("_site", F.explode(host_suffixes(F.col("_host"))))
    named = sites.select(F.col(site).alias("_site"), F.col(order).alias("_order"))
    best = ends.join(named, "_site").groupBy("_host").agg(F.min_by("_site", "_order").alias(out))
    return candidates.join(best, candidates[host] == best["_host"], "left").drop("_host")


def data_score(text: Column, host: Column) -> Column:
    """Points for words of data pages and for official or academic hosts."""
    hits = F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, DATA_WORDS))))
    labels = F.split(host, r"\.")
    official = F.arrays_overlap(F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), F.array(*map(F.lit, AUTHORITY_LABELS)))
    return F.least(F.lit(DATA_CAP), DATA_STEP * hits + F.when(official, AUTHORITY).otherwise(0.0))


def topic_score(text: Column, terms: Column) -> Column:
    return F.least(F.lit(TOPIC_CAP), TOPIC_STEP * F.size(F.array_intersect(tokens(text), terms)))


def visit_score(accepted: Column, hours: Column, revisit_hours: float = 24.0) -> Column:
    """Unread pages first; useful ones again after a while. Nulls: never read."""
    return F.when(accepted.isNull(), UNREAD).when(accepted == 0, UNPRODUCTIVE).when(hours < revisit_hours, READ_RECENTLY).otherwise(0.0)


def rank_with_quota(candidates: DataFrame, allowance: Column, domain: str = "domain", score: str = "score", tie: str = "rank") -> DataFrame:
    """Candidates with `place` within their domain and `first`: each domain's allowance comes before the rest."""
    order = Window.partitionBy(domain).orderBy(F.desc(score), tie)
    placed = candidates.withColumn("place", F.row_number().over(order).cast("long"))
    return placed.withColumn("first", F.col("place") <= allowance)


def interleave(results: DataFrame, limit: int, query: str = "query", position: str = "position", url: str = "url") -> DataFrame:
    """Result lists dealt in turn, an address once, at its first turn."""
    first = results.groupBy(url).agg(F.min(F.struct(F.col(position), F.col(query))).alias("turn"))
    return first.select(url, F.col(f"turn.{position}").alias(position), F.col(f"turn.{query}").alias(query)).orderBy(position, query).limit(limit)


def vote(resolved: DataFrame) -> DataFrame:
    """Hosts by votes, then by the sum of 10 less the rank of each."""
    return resolved.groupBy("host").agg(F.count("*").alias("votes"), F.sum(10 - F.col("rank")).alias("points"))


# --- queries


def candidates_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", domain_of(F.col("url")).alias("domain"), path_of(F.col("url")).alias("path"), (F.col("page_id") % 20).alias("rank"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates_of_pages(spark, sf_dir)
    sites = spark.createDataFrame([("example.org", 1), ("example.com", 2), ("net", 3)], "site string, nth int")
    known = match_site(c, sites, "site", "nth", "preferred")
    score = F.when(F.col("preferred").isNotNull(), PREFERRED).otherwise(0.0) + F.when(F.col("path").contains("/en/"), TOPIC_STEP).otherwise(0.0) - RANK_STEP * F.col("rank")
    return known.withColumn("score", F.round(score, 2))


def _quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.regexp_extract(F.col("domain"), r"([^.]+\.[^.]+)$", 1)
    c = _scored(spark, sf_dir).withColumn("site", site)
    allowance = F.when(F.col("preferred") == "example.org", 8).otherwise(F.lit(1) + F.col("preferred").isNotNull().cast("int"))
    return rank_with_quota(c, allowance, "site", "score", "page_id").select("page_id", "site", "score", "place", "first")


def _interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    turn = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    return interleave(o.select(F.col("o_custkey").alias("url"), F.col("o_orderpriority").alias("query"), turn.cast("long").alias("position")), 200)


def _vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote(candidates_of_pages(spark, sf_dir).select(F.col("domain").alias("host"), "rank"))


_C = """WITH c AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS domain,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, page_id % 20 AS rank FROM pages),
s AS (SELECT *, CASE WHEN domain = 'example.org' OR ends_with(domain, '.example.org') THEN 'example.org' WHEN domain = 'example.com' OR ends_with(domain, '.example.com') THEN 'example.com'
  WHEN domain = 'net' OR ends_with(domain, '.net') THEN 'net' END AS preferred FROM c),
t AS (SELECT *, round(CASE WHEN preferred IS NOT NULL THEN 100.0 ELSE 0.0 END::DOUBLE + CASE WHEN contains(path, '/en/') THEN 4.0 ELSE 0.0 END - 1.5 * rank, 2)::DOUBLE AS score FROM s)"""
QUERIES = {
    "candidate_scores": lambda s, d: _scored(s, d).select("page_id", "domain", "preferred", "score"),
    "rank_with_domain_quota": _quota,
    "interleave_round_robin": _interleave,
    "host_votes": _vote,
    "proven_candidates": lambda s, d: proven_domains(history_of_events(s, d)).join(latest_reads(history_of_events(s, d), "instance_id", "url"), ["instance_id", "domain"]).select("instance_id", "url", "rows"),
}
ORACLE = {
    "proven_candidates": f"""{HISTORY_SQL}, l AS (SELECT * FROM h WHERE id IN (SELECT max(id) FROM h GROUP BY instance_id, url)),
p AS (SELECT instance_id, domain, CAST(sum(accepted) AS BIGINT) AS rows FROM l GROUP BY 1, 2 HAVING sum(accepted) > 0)
SELECT instance_id, l.url, p.rows FROM l JOIN p USING (instance_id, domain)""",
    "candidate_scores": f"{_C} SELECT page_id, domain, preferred, score FROM t",
    "rank_with_domain_quota": f"""{_C}, q AS (SELECT page_id, regexp_extract(domain, '([^.]+\\.[^.]+)$', 1) AS site, score, preferred FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, page_id) AS place FROM q)
SELECT page_id, site, score, place, place <= CASE WHEN preferred = 'example.org' THEN 8 WHEN preferred IS NOT NULL THEN 2 ELSE 1 END AS first FROM r""",
    "interleave_round_robin": """WITH r AS (SELECT o_custkey AS url, o_orderpriority AS query, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS position FROM orders)
SELECT url, position, query FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY position, query) = 1 ORDER BY position, query LIMIT 200""",
    "host_votes": f"{_C} SELECT domain AS host, count(*) AS votes, CAST(sum(10 - rank) AS BIGINT) AS points FROM c GROUP BY 1",
}
