"""Entries of a registry that texts name: by an alias, however it is spaced or written, or by an address of one of their sites.

A text becomes the runs of up to RUN words that it holds, joined; an alias is one such run. Only places whose first letters are
those of an alias are written out. So any number of aliases is matched by two equi-joins, and addresses by another, over the
host and the domains above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.functions.urls import host_suffixes
from gleanspark.operators.requests import requests_of_customers
from gleanspark.sources.tables import table

# Words of an alias at most, letters and digits of one at least.
RUN, SHORTEST = 6, 4
# From every word of a text in lower case, with single spaces, the words of the longest alias.
NEAR = rf"(?<![a-z0-9])(?=([a-z0-9]++(?: [a-z0-9]++){{0,{RUN - 1}}}+))"
HOST = r"(?i)\b(?:https?://)?((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,})(?=[/?#:\s,;)]|\.?$|\.\s)"


def phrase(text: Column) -> Column:
    """Letters and digits of a text, in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def places(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, first, near): every word's number in its text, from 0, and the RUN words from there on, with spaces between."""
    words = F.regexp_extract_all(F.replace(F.coalesce(text, F.lit("")), F.lit("."), F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    plain = F.lower(F.array_join(words, " "))  # in lower case once it is ASCII: that is far faster
    return texts.select(key, F.posexplode(F.regexp_extract_all(plain, F.lit(NEAR), F.lit(1))).alias("first", "near"))


def runs(near: DataFrame, key: str) -> DataFrame:
    """(key, phrase, first, words) of the runs of one to RUN words from each of the places."""
    words = near.select(key, "first", F.split("near", " ").alias("w"))
    long = words.select(key, "first", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("words"))
    return long.select(key, F.array_join(F.slice("w", F.lit(1), F.col("words")), "").alias("phrase"), "first", "words").where(F.length("phrase") >= SHORTEST)


def alias_mentions(texts: DataFrame, registry: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, entry, alias, first, words) for every place where a text names an alias of the registry (entry, alias).

    Of aliases that share words the longest stands, of equally long ones the first in the text. Aliases of fewer than
    SHORTEST letters and digits never match. Null texts and aliases name nothing; an entry that has an alias twice is one.
    """
    known = registry.select("entry", "alias", phrase(F.col("alias")).alias("phrase")).where(F.length("phrase") >= SHORTEST).groupBy("entry", "phrase").agg(F.min("alias").alias("alias"))
    # Only places that begin as some alias does are written out as runs.
    heads = known.select(F.substring("phrase", 1, SHORTEST).alias("head")).distinct()
    begun = places(texts, key, text).withColumn("head", F.substring(F.replace("near", F.lit(" "), F.lit("")), 1, SHORTEST)).join(heads, "head", "left_semi")
    met = runs(begun, key).join(known, "phrase")
    # A run within a longer one that matched as well is no mention of its own: one from before it, or a longer one from its place.
    end, order = F.col("first") + F.col("words"), F.col("first") * (RUN + 1) - F.col("words")
    reach = F.max(end).over(Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, -1))
    whole = met.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("reach") < end))
    first = whole.groupBy(key, "entry", "phrase").agg(F.min(F.struct("first", "words", "alias")).alias("m"))
    return first.select(key, "entry", "m.alias", "m.first", "m.words")


def site_mentions(texts: DataFrame, sites: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, entry, host): hosts written in a text that belong to a site of the registry (entry, domain), or above which one lies."""
    hosts = texts.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(HOST), F.lit(1)), F.lower))).alias("host"))
    bare = F.regexp_replace("host", r"^www\.", "")
    up = hosts.select(key, "host", F.explode(host_suffixes(bare)).alias("domain")).join(sites.select("entry", F.lower("domain").alias("domain")), "domain")
    down = hosts.join(sites.select("entry", F.explode(host_suffixes(F.lower("domain"))).alias("above")), F.col("above") == bare).select(key, "host", "entry")
    return up.select(key, "host", "entry").unionByName(down).distinct().select(key, "entry", "host")


# --- queries


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that the requests of customers name."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entry"), F.col("n_name").alias("alias"))
    return alias_mentions(requests_of_customers(spark, sf_dir), nations, "request_id").select("request_id", "entry", "alias")


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the first six words of a benchmark item, in any spelling of spaces and marks."""
    items = table(spark, sf_dir, "benchmark")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z0-9.]+"), F.lit(0)), 1, RUN), " ")
    registry = items.select(F.col("item_id").alias("entry"), first.alias("alias"))
    return alias_mentions(table(spark, sf_dir, "documents").select("doc_id", "text"), registry, "doc_id").select("doc_id", "entry").distinct()


QUERIES = {"nations_of_requests": _nations, "openings_of_items": _phrases}
_WORDS = "list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9.]+'), lambda w: regexp_replace(lower(w), '[^a-z0-9]', '', 'g')), lambda w: w <> '')"
ORACLE = {
    "nations_of_requests": "SELECT c_custkey AS request_id, n_nationkey AS entry, n_name AS alias FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0",
    "openings_of_items": f"""WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents), runs AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
b AS (SELECT item_id AS entry, regexp_replace(lower(array_to_string(list_slice(regexp_extract_all(text, '[A-Za-z0-9.]+'), 1, 6), '')), '[^a-z0-9]', '', 'g') AS p FROM benchmark),
n AS (SELECT doc_id, array_to_string(list_slice(w, i, i + k - 1), '') AS p FROM runs, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k) WHERE i + k - 1 <= len(w))
SELECT DISTINCT doc_id, entry FROM n JOIN b USING (p) WHERE length(p) >= 4""",
}
