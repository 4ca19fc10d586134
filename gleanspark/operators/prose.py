"""Sentences that state a quantity, as rows.

A sentence is cut at its quantities; what stands right before and after each of them, in the pieces between the cuts, tells
a level ("stood at $41") from a change ("down 6%"), a bound ("below $9,000") and a share ("63 percent of timber"). All of it
is column expressions except the reading of periods.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.functions import fixed
from gleanspark.functions.patterns import any_of
from gleanspark.functions.temporal import find_periods, let
from gleanspark.operators.concepts import UNIT_TOKENS
from gleanspark.sources.html import elements, pages_of_customers
from gleanspark.sources.tables import table

SHORTEST, LONGEST, MAX_UNDATED, MAX_ROWS = 25, 320, 15, 60
# Scales, nouns that count page activity, plurals without an s, words before a year.
SCALES = ("trillion", "billion", "million", "thousand", "crore", "lakh", "bn", "mn", "tn")
COUNTERS = (
    "views", "likes", "reviews", "results", "followers", "comments", "shares", "subscribers", "downloads", "votes", "ratings", "replies",
    "retweets", "reactions", "clicks", "hits", "pages", "photos", "images", "videos", "posts", "articles", "stories", "items", "listings",
    "words", "characters", "visits", "impressions", "members", "questions", "answers",
)
PLURALS = ("people", "children", "men", "women", "cattle", "staff", "personnel", "livestock")
NO_NOUNS = ("was", "has", "does", "this", "its", "his", "plus", "thus", "versus", "always")
NAMES_YEAR = ("in", "during", "for", "as of", "by")

_N = r"\d(?:[\d,]*\d)?(?:\.\d+)?"
_FREE = r"(?<![\w.,$€£¥₹])"  # not within a word, a number or an amount
_SCALED = rf"\s?{any_of(SCALES)}\b"
_UNIT = rf"\s?{any_of(sorted(UNIT_TOKENS, key=lambda u: (-len(u), u)))}s?\b"
_PER = r"(?:\s?/\s?[a-z]{1,6}\b)"
MONEY = rf"(?:[$€£¥₹]|\b(?:usd|eur|gbp|inr|rs\.?|us\$)\s?)\s?{_N}{fixed.QUANTITY_SCALE}{_PER}?"
PERCENT = rf"[-+]?{_N}\s?(?:%|{any_of(('percent', 'per cent'))}\b)"
#: 1,000 or more of something: a number, with commas or without, and a plural; no years, no activity.
COUNTED = rf"{_FREE}(?:[1-9]\d{{0,2}},\d{{3}}|[1-9],\d{{3}},\d{{3}}|(?!(?:19|20)\d\d\s)[1-9]\d{{3,6}})\s+(?!{any_of([*COUNTERS, *NO_NOUNS])}\b)(?:{any_of(PLURALS)}|[a-z]+[a-rt-z]s)\b"
DECIMAL = rf"{_FREE}\d[\d,]*\.\d+(?![\w.])"
QUANTITY = rf"(?i)(?:{MONEY}|{PERCENT}|{_FREE}[-+]?{_N}(?:{_SCALED}|{_UNIT}{_PER}?|{_PER})|{COUNTED}|{DECIMAL})"
YEAR = r"(?<![\d$€£¥₹,.])((?:19|20)\d{2})(?!\d)"


def sentences(text: Column) -> Column:
    """The sentences of a text, cut after a mark that a capital, digit or quote follows."""
    return F.transform(F.split(text, r"(?<=[.!?;])\s+(?=[A-Z0-9“\"(])"), F.trim)


def quantities(sentence: Column) -> Column:
    """Array of (text, role) in order; roles: level, change, bound, share. Bare years and activity counters don't count."""

    def role(x: Column) -> Column:
        text, before, after = x["found"], x["before"], x["after"]
        changed = before.rlike(fixed.CHANGE_BEFORE) | after.rlike(fixed.CHANGE_AFTER) | text.rlike("^[-+]")
        shared = text.rlike(r"(?i)(?:%|cent)$") & F.substring(after, 1, 8).rlike(r"\bof\b")
        kind = F.when(before.rlike(fixed.BOUND_BEFORE), "bound").when(changed, "change").when(shared, "share").otherwise("level")
        return F.struct(F.trim(text).alias("text"), kind.alias("role"))

    def told(x: Column) -> Column:
        found, gaps, size = x["found"], x["gaps"], F.size(x["found"])
        around = F.arrays_zip(found.alias("found"), F.slice(gaps, F.lit(1), size).alias("before"), F.slice(gaps, F.lit(2), size).alias("after"))
        return F.when(size > 0, F.transform(around, role)).otherwise(F.array().cast("array<struct<text:string,role:string>>"))

    # Searched once a sentence: named by a lambda, else every mention would search again
    return let(F.struct(F.regexp_extract_all(sentence, F.lit(QUANTITY), F.lit(0)).alias("found"), F.split(sentence, QUANTITY, -1).alias("gaps")), told)


def period_of(sentence: Column, value: Column, periods: Column) -> Column:
    """The one period mentioned; of several the year closest to the value, those after "in", "during", "for", "as of" or "by" first."""
    gaps = F.split(sentence, YEAR, -1)
    place = lambda i: F.aggregate(F.slice(gaps, F.lit(1), i + 1), 4 * i, lambda a, x: a + F.length(x))
    named = lambda i: F.substring(F.element_at(gaps, i + 1), -7, 7).rlike(rf"(?i)\b{any_of(NAMES_YEAR)}\s$")
    at = F.instr(sentence, value) - 1
    years = F.transform(
        F.regexp_extract_all(sentence, F.lit(YEAR), F.lit(1)),
        lambda y, i: F.struct(F.when(named(i), 0).otherwise(1).alias("rank"), F.abs(place(i) - at).alias("far"), i.alias("nth"), y.alias("year")),
    )
    return F.when(F.size(periods) == 1, F.element_at(periods, 1)).otherwise(F.array_min(years)["year"])


def statements(texts: DataFrame, today: date, key: str = "page_id", pos: str = "pos", text: str = "text", at: str | None = None) -> DataFrame:
    """(key, method, statement, value, change, period, place) from (key, pos, text) paragraphs; in `at`, if named, their pos.

    Sentences of 25 to 320 characters with a level or a change, once a page. Undated ones need a level and are kept up to
    15 a page; 60 a page in all, the first in order.
    """
    paragraphs = texts.where(F.length(text) >= 30)
    cut = paragraphs.select(key, pos, F.posexplode(sentences(F.col(text))).alias("nth", "statement"))
    fit = cut.where(F.length("statement").between(SHORTEST, LONGEST) & F.col("statement").rlike(QUANTITY))
    once = fit.groupBy(key, "statement").agg(F.min(F.struct(pos, "nth")).alias("place"))
    first = lambda q, role: F.try_element_at(F.filter(q, lambda x: x["role"] == role), F.lit(1))["text"]
    both = let(quantities(F.col("statement")), lambda q: F.struct(first(q, "level").alias("level"), first(q, "change").alias("change")))
    # Unpacked by a generator, else the test of the two columns would move below and make them again
    told = once.select(key, "statement", "place", F.inline(F.array(both))).where("level IS NOT NULL OR change IS NOT NULL")
    dated = told.withColumn("periods", find_periods(F.col("statement"), today))
    method = F.when(F.size("periods") > 0, "text_statement").otherwise("undated_statement")
    rows = dated.withColumn("method", method).where("method = 'text_statement' OR level IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy(key, "method").orderBy("place"))
    rows = rows.withColumn("_n", nth).where((F.col("method") == "text_statement") | (F.col("_n") <= MAX_UNDATED))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where(F.col("_n") <= MAX_ROWS)
    period = F.when(F.col("method") == "text_statement", period_of(F.col("statement"), F.coalesce("level", "change"), F.col("periods")))
    return rows.select(key, "method", "statement", F.col("level").alias("value"), F.when((F.col("method") == "text_statement"), F.col("change")).alias("change"), period.alias("period"), F.col("_n").alias("place"), *([F.col(f"place.{pos}").alias(at)] if at else []))


def page_statements(e: DataFrame, today: date, key: str = "page_id", at: str | None = None) -> DataFrame:
    """Statements in the paragraphs and items of pages, outside tables and chrome."""
    nodes = e.where("tag IN ('p', 'li', 'figcaption', 'blockquote', 'dd') AND tbl IS NULL AND NOT chrome")
    return statements(nodes.select(key, F.col("n").alias("pos"), "text"), today, key, at=at)


TODAY = date(2026, 9, 30)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of all documents, a line a paragraph."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return statements(docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")), TODAY, "doc_id")


QUERIES = {
    "statements_of_documents": _documents,
    "statements_of_customers": lambda s, d: page_statements(elements(pages_of_customers(s, d)), TODAY).select("page_id", "method", "statement", "value", "period"),
    "statements_of_pages": lambda s, d: page_statements(elements(table(s, d, "pages").select("page_id", "html")), TODAY),
}
ORACLE = {
    "statements_of_customers": """SELECT c_custkey AS page_id, 'text_statement' AS method, 'In ' || y || ' the account reached $' || p || ' for all of its parcels.' AS statement, '$' || p AS value, y AS period
FROM (SELECT c_custkey, CAST(c_nationkey + 1995 AS VARCHAR) AS y, CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR) AS p FROM customer)"""
}
