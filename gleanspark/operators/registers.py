"""Registers of files, sources and cached answers, and the small reports over them. "Now" is always a parameter."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions.strings import content_tokens, tokens
from gleanspark.functions.urls import file_type, path_of
from gleanspark.operators.history import history_of_events, latest_reads
from gleanspark.plans.scalars import STOP_SQL, TOKENS_SQL
from gleanspark.sources.tables import table

OWN, PAGE, READABLE = 0.75, 0.15, 0.10  # fixed values: shares of a file's relevance
ON_TOPIC, RESULTS_KEPT = 0.25, 0.20


def file_relevance(name: Column, page_title: Column, terms: Column, readable: Column) -> Column:
    """How much a file's own name, its page and its type speak for it, to 3 places."""
    share = lambda text: F.size(F.array_intersect(tokens(text), terms)) / F.greatest(F.size(terms), F.lit(1))
    return F.round(OWN * share(name) + PAGE * share(page_title) + READABLE * readable.cast("double"), 3)


def register_files(found: DataFrame, known: DataFrame, limit: int = 50) -> DataFrame:
    """The register after a run: known files with their relevance refreshed, and the `limit` most relevant new ones.

    Both have file_id, relevance, status. The limit is per run; ties go to the smaller id.
    """
    best = found.groupBy("file_id").agg(F.max("relevance").alias("_now"))
    kept = known.join(best, "file_id", "left").withColumn("relevance", F.coalesce("_now", "relevance")).drop("_now")
    new = best.join(known.select("file_id"), "file_id", "left_anti").orderBy(F.desc("_now"), "file_id").limit(limit)
    return kept.select("file_id", "relevance", "status").unionByName(new.select("file_id", F.col("_now").alias("relevance"), F.lit("found").alias("status")))


def rank_links(links: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """Links by terms in their title, then primary ones, then shorter titles; others than primary need a term."""
    hits = F.size(F.array_intersect(tokens(F.col("title")), F.array(*map(F.lit, terms)).cast("array<string>")))
    scored = links.withColumn("hits", hits.cast("long")).where("hits > 0 OR is_primary")
    return scored.orderBy(F.desc("hits"), F.desc("is_primary"), F.length("title"), "link_id").limit(limit)


def on_topic(rows: DataFrame, group: str, text: str, terms: list[str]) -> DataFrame:
    """(group, share, on_topic): groups of which a quarter of the rows mention a term, by its first five letters.

    Without terms every group passes.
    """
    starts = F.array(*[F.lit(t[:5]) for t in terms]).cast("array<string>")
    words = F.transform(content_tokens(F.col(text)), lambda w: F.substring(w, 1, 5))
    share = F.avg(F.arrays_overlap(words, starts).cast("double"))
    found = rows.groupBy(group).agg(F.coalesce(share, F.lit(0.0)).alias("share"))
    return found.withColumn("on_topic", (F.col("share") >= ON_TOPIC) | F.lit(not terms))


def useful_results(results: DataFrame, query: str, text: str, terms: list[str]) -> DataFrame:
    """Results that share a term with the request, of queries that kept a fifth of theirs (one at least)."""
    hit = F.arrays_overlap(content_tokens(F.col(text)), F.array(*map(F.lit, terms)).cast("array<string>"))
    counts = results.groupBy(query).agg(F.count("*").alias("_all"), F.sum(hit.cast("long")).alias("_kept"))
    good = counts.where(F.col("_kept") >= F.greatest(F.lit(1.0), RESULTS_KEPT * F.col("_all"))).select(query)
    return results.where(hit).join(good, query, "left_semi")


def fill_titles(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows without a title get their source's; a source read more than once gives the largest."""
    titles = sources.where(F.coalesce("title", F.lit("")) != "").groupBy("url").agg(F.max("title").alias("_title"))
    return rows.join(titles, rows["source_url"] == titles["url"], "left").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "_title")).drop("url", "_title")


def visited(candidates: DataFrame, reads: DataFrame, as_of: datetime, revisit_hours: float = 24.0) -> DataFrame:
    """Candidates with what their address gave when last read (a closing slash aside), and whether that is recent."""
    key = lambda c: F.regexp_replace(c, "/+$", "")
    last = reads.groupBy(key(F.col("url")).alias("_key")).agg(F.max_by(F.struct("accepted", "fetched_at"), "id").alias("_last"))
    joined = candidates.join(last, key(candidates["url"]) == last["_key"], "left")
    since = F.lit(as_of - timedelta(hours=revisit_hours)).cast("timestamp_ntz")
    return joined.withColumns({"accepted": F.col("_last.accepted"), "recent": F.coalesce(F.col("_last.fetched_at") > since, F.lit(False))}).drop("_key", "_last")


def cached(answers: DataFrame, as_of: datetime, minutes: int | None) -> DataFrame:
    """Answers young enough to use; None: of any age."""
    return answers if minutes is None else answers.where(F.col("created_at") >= F.lit(as_of - timedelta(minutes=minutes)).cast("timestamp_ntz"))


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows with new ones in the place of those with the same key."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_scope(stored: DataFrame, scope: str, entries: DataFrame) -> DataFrame:
    """A scope's whole list replaced; an entry named twice stays once, at its first place. Entries: domain, pos."""
    first = entries.groupBy("domain").agg(F.min("pos").alias("pos"))
    return stored.where(F.col("scope") != scope).unionByName(first.select(F.lit(scope).alias("scope"), "domain", "pos"))


def learned(entries: DataFrame, as_of: datetime, days: int = 14, failed_days: int = 1, most_failures: int = 2) -> DataFrame:
    """Learned structures still valid: recipes for `days`, failed attempts for a day, none with too many failures."""
    age = lambda n: F.lit(as_of - timedelta(days=n)).cast("timestamp_ntz")
    lasts = F.when(F.col("recipe").isNotNull(), F.col("learned_at") >= age(days)).otherwise(F.col("learned_at") >= age(failed_days))
    return entries.where(lasts & (F.col("failures") < most_failures))


def active_runs(runs: DataFrame) -> DataFrame:
    """Runs that wait or run, oldest first."""
    return runs.where(F.col("status").isin("queued", "running")).orderBy("created_at", "id")


def parse_datetime(value: Column) -> Column:
    """A moment in UTC from ISO, HTTP-date or human texts; null for others. Texts without a zone count as UTC."""
    text = F.trim(value)
    iso = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})[tT ]", "$1T").try_cast("timestamp")
    http = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    human = F.regexp_replace(F.regexp_replace(text, r"(\d)(st|nd|rd|th)\b", "$1"), r"[,.]", "")
    tries = [F.try_to_timestamp(http, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z")]
    tries += [F.try_to_timestamp(human, F.lit(f)) for f in ("d MMMM yyyy", "MMMM d yyyy", "d MMM yyyy", "MMM d yyyy")]
    return F.coalesce(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), iso), *tries)


# --- queries


def _register(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    known = o.where("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("file_id")).distinct().select("file_id", F.lit(0.0).alias("relevance"), F.lit("parsed").alias("status"))
    return register_files(o.select(F.col("o_custkey").alias("file_id"), F.col("o_totalprice").alias("relevance")), known)


def _visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history_of_events(spark, sf_dir)
    now = h.agg(F.max("fetched_at")).first()[0]
    candidates = h.select(F.concat("url", F.when(F.col("id") % 2 == 0, "/").otherwise("")).alias("url"), F.col("id").alias("nth"))
    return visited(candidates, latest_reads(h, "url").where("accepted > 0"), now).select("nth", "accepted", "recent")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the addresses that pages have."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.regexp_extract(F.col("url"), "^[^?#]*", 0), F.when(F.col("page_id") % 3 == 0, ".csv").when(F.col("page_id") % 3 == 1, ".PDF").otherwise("")).alias("url"))
    return p.groupBy(file_type(F.col("url")).alias("file_type")).agg(F.count("*").alias("n"), F.max(F.length(path_of(F.col("url")))).cast("long").alias("longest"))


def _topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_topic(table(spark, sf_dir, "documents").select("source", "text"), "source", "text", ["thing", "erent"]).select("source", F.round("share", 6).alias("share"), "on_topic")


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return upsert(p, p.where("p_size <= 15").select("p_partkey", (F.col("p_size") * 0).alias("p_size")), "p_partkey")


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("source_url"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("title"))
    return fill_titles(o, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("url"), F.col("c_name").alias("title"))).select("o_orderkey", "source_url", "title")


QUERIES = {
    "register_files": _register,
    "visited_candidates": _visited,
    "file_types": _files,
    "topic_of_sources": _topic,
    "upsert_rows": _upsert,
    "fill_titles": _titles,
}
_H = """WITH h AS (SELECT event_id AS id, 'https://s' || (user_id % 40) || '.example/p' || (event_id % 23) AS url,
  CASE WHEN event_type IN ('purchase', 'view') THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS accepted, ts AS fetched_at FROM events)"""
ORACLE = {
    "topic_of_sources": f"""WITH t AS (SELECT source, {TOKENS_SQL} AS t FROM documents),
c AS (SELECT source, list_transform(list_filter(t, lambda x: NOT list_contains([{STOP_SQL}], x) AND NOT regexp_matches(x, '^[0-9]')), lambda x: x[:5]) AS k FROM t)
SELECT source, round(avg(CAST(coalesce(list_has_any(k, ['thing', 'erent']), false) AS INT)), 6) AS share, avg(CAST(coalesce(list_has_any(k, ['thing', 'erent']), false) AS INT)) >= 0.25 AS on_topic FROM c GROUP BY 1""",
    "register_files": """WITH k AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 20 = 0), b AS (SELECT o_custkey AS id, max(o_totalprice) AS r FROM orders GROUP BY 1)
SELECT id AS file_id, r AS relevance, 'parsed' AS status FROM b WHERE id IN (SELECT id FROM k)
UNION ALL (SELECT id, r, 'found' FROM b WHERE id NOT IN (SELECT id FROM k) ORDER BY r DESC, id LIMIT 50)""",
    "visited_candidates": f"""{_H}, l AS (SELECT * FROM h WHERE id IN (SELECT max(id) FROM h GROUP BY url) AND accepted > 0)
SELECT c.id AS nth, l.accepted, coalesce(l.fetched_at > (SELECT max(fetched_at) FROM h) - INTERVAL 24 HOUR, false) AS recent FROM h c LEFT JOIN l USING (url)""",
    "file_types": """WITH p AS (SELECT regexp_extract(url, '^[^?#]*') || CASE page_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.PDF' ELSE '' END AS url FROM pages),
x AS (SELECT *, regexp_extract(url, '^[A-Za-z]+://[^/]*(.*)$', 1) AS path FROM p)
SELECT CASE WHEN ends_with(url, '.csv') THEN 'csv' WHEN ends_with(url, '.PDF') THEN 'pdf' ELSE '' END AS file_type, count(*) AS n, max(length(path)) AS longest FROM x GROUP BY 1""",
    "upsert_rows": "SELECT p_partkey, CASE WHEN p_size <= 15 THEN 0 ELSE p_size END AS p_size FROM part",
    "fill_titles": """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS source_url, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority WHEN c_acctbal > 0 THEN c_name END AS title
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
}
