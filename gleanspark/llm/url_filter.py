"""URL filters by a sort-merge range join (DataFrame operations only).

A rule is (verdict, host, path). It fits its host and every subdomain, if the URL's path starts with the rule's
path; the longest fitting rule (by `host + path`, then by host, then by text) wins.

Host and path become one canonical key, labels reversed: `example.net` with `/en/` is `net.example./en/`. All keys that
start with a rule's key form one interval, and such intervals either nest or are disjoint. The rule list is a parameter
held by the driver; one sorted pass over the interval ends, keeping a stack of open rules, gives at every boundary the
winner among the rules open from there on. A URL has one probe for each domain above it, as deep as the rules go at most
(`blog.example.net/en/a` asks `net./en/a` and `net.example./en/a`). Boundaries and probes are merged in sorted order:
URLs are dealt to buckets by row number, every bucket gets all boundaries, and in each bucket a running "last boundary
seen" hands each probe its winner. The probes of a URL lie in one bucket, so the best of them is found in place, without
another shuffle. Buckets are even whatever the hosts are: a host holding a third of all pages is spread over all of them,
and so are repeated rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import shuffle_partitions, table

Rule = tuple[str, str, str]

RULES: tuple[Rule, ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DEFAULT_VERDICT = "allow"
BUCKETS_PER_PARTITION = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BOUNDARY_SCHEMA = "array<struct<key:string,n:int,h:int,rule:string,verdict:string>>"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without a `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def probe_keys(host: Column, path: Column, depth: int) -> Column:
    """Keys of the path under each of the last 1 to `depth` labels of the host."""
    labels = F.reverse(F.split(host, r"\.", -1))
    under = lambda i: F.encode(F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit("."), path), "utf-8")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), under)


def rule_key(host: str, path: str) -> bytes:
    return ("".join(label + "." for label in reversed(host.split("."))) + path).encode()


def boundaries(rules: Sequence[Rule]) -> list[tuple[bytes, Rule | None]]:
    """(key, the rule that wins from that key on, or None) at every interval end, by a sweep that keeps a stack of open rules."""
    marks: dict[bytes, list[tuple[int, Rule]]] = {}
    for rule in rules:
        low = rule_key(*rule[1:])
        marks.setdefault(low, []).append((1, rule))
        marks.setdefault(low + b"\xff", []).append((-1, rule))  # no UTF-8 text has this byte
    rank = lambda r: (len(r[1] + r[2]), len(r[1]), r[1] + r[2], r[0])
    stack: list[Rule] = []
    found = []
    for key in sorted(marks):
        for step, rule in sorted(marks[key], key=lambda m: (m[0], rank(m[1]))):
            if step < 0:
                stack.remove(rule)
            else:
                stack.append(rule)
        found.append((key, max(stack, key=rank, default=None)))
    return found


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = DEFAULT_VERDICT, url: str = "url") -> DataFrame:
    """`pages` with host, path, rule (null where none fits) and verdict added; columns of those names are replaced.

    Every row is kept, repeated ones too. A null url, or one without `://`, has an empty host and path and gets the
    default verdict. No rules: every page gets the default. An empty table gives an empty result. Other columns may have
    any name: they travel inside one struct.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    n = BUCKETS_PER_PARTITION * shuffle_partitions(spark)
    depth = max((r[1].count(".") + 1 for r in rules), default=1)
    parsed = pages.select(*[F.col(f"`{c}`") for c in kept], url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    names = parsed.columns
    rows = parsed.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.monotonically_increasing_id().alias("id"))
    dealt = rows.select("row", "id", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("bucket"))
    probes = dealt.select("id", "bucket", "row", F.posexplode(probe_keys(F.col("row.host"), F.col("row.path"), depth)).alias("i", "key"))
    probes = probes.select("id", "bucket", F.when(F.col("i") == 0, F.col("row")).alias("row"), "key", F.lit(1).alias("kind"))  # the row travels once
    listed = [{"key": k.hex(), **({"n": len(r[1] + r[2]), "h": len(r[1]), "rule": r[1] + r[2], "verdict": r[0]} if r else {})} for k, r in boundaries(rules)]
    edges = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(listed)), _BOUNDARY_SCHEMA)))
    edges = edges.select(F.unhex("key").alias("key"), F.struct("n", "h", "rule", "verdict").alias("open"), F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"))
    swept = Window.partitionBy("bucket").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = probes.unionByName(edges, allowMissingColumns=True).withColumn("open", F.last("open", ignorenulls=True).over(swept))
    best = merged.where("kind = 1").groupBy("bucket", "id").agg(F.first("row", ignorenulls=True).alias("row"), F.max(F.when(F.col("open.rule").isNotNull(), F.col("open"))).alias("best"))
    return best.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of `pages` judged by RULES; odd rows as in judge_urls."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op7_url_filters": op7_url_filters}
ORACLE = {
    "op7_url_filters": """
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""
}
