"""Queries that show the scalar functions on whole tables, each beside its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions import numbers, strings, temporal, urls
from gleanspark.sources.tables import table

TODAY = date(2026, 9, 30)


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items' quantities written in six ways, typed and read back."""
    li = table(spark, sf_dir, "lineitem")
    n, form = F.col("l_quantity").cast("int").cast("string"), F.col("l_orderkey") % 6
    text = (
        F.when(form == 0, F.concat(F.lit("$"), n, F.lit(",500")))
        .when(form == 1, F.concat(n, F.lit("%")))
        .when(form == 2, F.concat(F.lit("Rs. "), n, F.lit(" Lakh")))
        .when(form == 3, F.concat(F.lit("down "), n, F.lit("%")))
        .when(form == 4, F.concat(n, F.lit(" million")))
        .otherwise(F.concat(F.lit("Best cars under $"), n))
    )
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("value"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "value", numbers.value_kind(F.col("value"), TODAY).alias("kind"), numbers.to_number(F.col("value")).alias("number"))


def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in eight ways, read back as periods."""
    o = table(spark, sf_dir, "orders")
    y, d, form = F.year("o_orderdate").cast("string"), F.col("o_orderdate"), F.col("o_orderkey") % 8
    text = (
        F.when(form == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(form == 1, F.date_format(d, "MMM yyyy"))
        .when(form == 2, F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), y))
        .when(form == 3, F.concat(F.lit("FY"), y))
        .when(form == 4, F.date_format(d, "d MMMM yyyy"))
        .when(form == 5, F.concat(y, F.lit("-"), F.lpad(((F.year(d) + 1) % 100).cast("string"), 2, "0")))
        .when(form == 6, F.date_format(d, "M/yyyy"))
        .otherwise(F.concat(F.lit("about "), y))
    )
    p = temporal.parse_period(F.col("value"), TODAY)
    return o.select("o_orderkey", text.alias("value")).withColumn("p", p).select("o_orderkey", "value", F.col("p.label").alias("label"), F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"), F.col("p.granularity").alias("granularity"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of tokens, of content tokens and of different ones; each list is made once."""
    words = table(spark, sf_dir, "documents").select("doc_id", strings.tokens(F.col("text")).alias("words"))
    content = words.select("doc_id", F.size("words").cast("long").alias("n_tokens"), strings.content_of(F.col("words")).alias("content"))
    return content.select("doc_id", "n_tokens", F.size("content").cast("long").alias("n_content"), F.size(F.array_distinct("content")).cast("long").alias("n_distinct"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, u = table(spark, sf_dir, "pages").select("page_id", "url"), F.col("url")
    return p.select("page_id", urls.host_of(u).alias("host"), urls.domain_of(u).alias("domain"), urls.path_of(u).alias("path"), urls.strip_session(F.concat(F.split(u, "#")[0], F.lit(";jsessionid=A1"))).alias("clean"), F.size(urls.host_suffixes(urls.host_of(u))).cast("long").alias("n_suffixes"))


def period_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periods that each document mentions, none in most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", temporal.find_periods(F.col("text"), TODAY).alias("periods"))


def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", strings.request_key(F.col("text")).alias("key"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON column, summed by type."""
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.max("k").alias("max_k"), F.count("k").alias("n"))


def conversation_replay(spark: SparkSession, sf_dir: str, after: int = 20, limit: int = 500) -> DataFrame:
    """The log after a position, in order, a page of it."""
    c = table(spark, sf_dir, "conversations").where(F.col("conv_id") > after)
    return c.orderBy("conv_id", "turn").limit(limit).select("conv_id", "turn", "role")


TOKENS_SQL = """list_transform(regexp_extract_all(lower(replace(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), 'ß', 'ss')), '[a-z]+|[0-9]+'), lambda t:
  CASE WHEN length(t) <= 3 OR regexp_matches(t, '(ss|us|is)$') THEN t WHEN ends_with(t, 'ies') AND length(t) > 4 THEN t[:-4] || 'y'
  WHEN regexp_matches(t, '(ches|shes|xes|sses)$') THEN t[:-3] WHEN ends_with(t, 's') THEN t[:-2] ELSE t END)"""
STOP_SQL = ", ".join(f"'{w}'" for w in strings.STOPWORDS)
QUERIES = {
    "typed_values": typed_values,
    "period_labels": period_labels,
    "token_counts": token_counts,
    "url_parts": url_parts,
    "period_mentions": period_mentions,
    "request_keys": request_keys,
    "json_prop_extract": json_props,
    "conversation_replay": conversation_replay,
}
ORACLE = {
    "typed_values": """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey % 6 AS f, CAST(trunc(l_quantity) AS INT) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE f WHEN 0 THEN '$' || n || ',500' WHEN 1 THEN n || '%' WHEN 2 THEN 'Rs. ' || n || ' Lakh' WHEN 3 THEN 'down ' || n || '%' WHEN 4 THEN n || ' million' ELSE 'Best cars under $' || n END AS value,
  CASE f WHEN 0 THEN 'money' WHEN 1 THEN 'percent' WHEN 2 THEN 'text' WHEN 3 THEN 'percent' WHEN 4 THEN 'number' ELSE 'text' END AS kind,
  CAST(CASE f WHEN 0 THEN n * 1000 + 500 WHEN 1 THEN n WHEN 2 THEN n * 100000 WHEN 3 THEN -n WHEN 4 THEN n * 1000000::BIGINT ELSE n END AS DOUBLE) AS number FROM v""",
    "period_labels": """WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS f, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y FROM orders),
v AS (SELECT *, CASE f WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%b %Y') WHEN 2 THEN 'Q' || quarter(d) || ' ' || y WHEN 3 THEN 'FY' || y WHEN 4 THEN strftime(d, '%-d %B %Y')
  WHEN 5 THEN y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') WHEN 6 THEN month(d) || '/' || y ELSE 'about ' || y END AS value,
  CASE WHEN f = 5 AND (y + 1) % 100 BETWEEN 1 AND 12 THEN 9 WHEN f = 5 AND (y + 1) % 100 = 0 THEN 10 ELSE f END AS g FROM o)
SELECT o_orderkey, value,
  CASE g WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m') WHEN 2 THEN y || '-Q' || quarter(d) WHEN 3 THEN value WHEN 4 THEN strftime(d, '%Y-%m-%d') WHEN 5 THEN value WHEN 6 THEN strftime(d, '%Y-%m')
    WHEN 9 THEN y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') END AS label,
  CAST(CASE g WHEN 0 THEN d WHEN 1 THEN date_trunc('month', d) WHEN 2 THEN date_trunc('quarter', d) WHEN 3 THEN make_date(y, 1, 1) WHEN 4 THEN d WHEN 5 THEN make_date(y, 1, 1) WHEN 6 THEN date_trunc('month', d)
    WHEN 9 THEN make_date(y, (y + 1) % 100, 1) END AS DATE) AS period_start,
  CAST(CASE g WHEN 0 THEN d WHEN 1 THEN last_day(d) WHEN 2 THEN date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY WHEN 3 THEN make_date(y, 12, 31) WHEN 4 THEN d WHEN 5 THEN make_date(y + 1, 12, 31)
    WHEN 6 THEN last_day(d) WHEN 9 THEN last_day(make_date(y, (y + 1) % 100, 1)) END AS DATE) AS period_end,
  CASE g WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'quarter' WHEN 3 THEN 'year' WHEN 4 THEN 'day' WHEN 5 THEN 'range' WHEN 6 THEN 'month' WHEN 9 THEN 'month' END AS granularity FROM v""",
    "token_counts": f"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents),
c AS (SELECT doc_id, t, list_filter(t, lambda x: NOT list_contains([{STOP_SQL}], x) AND NOT regexp_matches(x, '^[0-9]')) AS k FROM t)
SELECT doc_id, len(t) AS n_tokens, len(k) AS n_content, len(list_distinct(k)) AS n_distinct FROM c""",
    "url_parts": """WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, host, regexp_replace(host, '^www\\.', '') AS domain, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
  CASE WHEN contains(split_part(url, '#', 1), '?') THEN split_part(url, '#', 1) || ';jsessionid=A1' ELSE split_part(url, '#', 1) END AS clean, len(string_split(host, '.')) AS n_suffixes FROM p""",
    "request_keys": "SELECT conv_id, turn, substr(sha256(array_to_string(regexp_extract_all(lower(text), '[0-9a-z]+'), ' ')), 1, 32) AS key FROM conversations",
    "json_prop_extract": """SELECT event_type, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS sum_k, max(CAST(props ->> '$.k' AS BIGINT)) AS max_k, count(props ->> '$.k') AS n FROM events GROUP BY 1""",
    "conversation_replay": "SELECT conv_id, turn, role FROM conversations WHERE conv_id > 20 ORDER BY conv_id, turn LIMIT 500",
}
