"""Whole pages as observations: what each extractor finds, in the order of trust, with a fallback for pages that hold nothing.

A page is parsed once; its elements are written to the shared folder and every extractor reads them from there. Extractors
are joins and groups over elements, so their results meet in one union; repeats, the cap on a page's rows and the fallback are
an aggregate, a window and an anti-join by page.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.functions.strings import slug
from gleanspark.functions.temporal import find_periods
from gleanspark.functions.urls import absolute, domain_of, file_extension
from gleanspark.lineage import spool, spread
from gleanspark.operators.prose import page_statements
from gleanspark.operators.verdicts import noise_verdict
from gleanspark.sources.appstate import state_records
from gleanspark.sources.html import GENERIC_LABELS, card_records, elements, is_challenge, is_login_wall, json_records, list_records, pages_of_customers, provenance
from gleanspark.sources.pagetables import CONTEXT, table_observations
from gleanspark.sources.tables import table

# Rows of a page, characters of a value, a short page, what a list item's rest may be.
MAX_ROWS, MAX_VALUE, SHORT_PAGE, DATE_WORDS, REST = 500, 1000, 1500, 8, 300
SEPARATORS = r"[\s–—\-|:;,.()\[\]·•]+"
ORDER = ("json_ld", "hydration_json", "html_table", "repeated_region", "list_item", "text_statement", "undated_statement", "page_summary")
TODAY = date(2026, 9, 30)


def _pair(name: str | Column, value: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), value.cast("string").alias("value"))


def _gathered(cells: DataFrame, key: str, row: list[str], order: list[str], method: str, block: Column, above: Column | None = None) -> DataFrame:
    """Rows of one extractor from its cells (name, value), in the common shape."""
    fields = F.transform(F.array_sort(F.collect_list(F.struct(*order, "name", "value"))), lambda x: _pair(x["name"], x["value"]))
    found = cells.groupBy(key, *row).agg(fields.alias("fields"), F.min(above if above is not None else F.lit(None).cast("int")).alias("above"), F.any_value(block).alias("block_id"))
    return found.select(key, F.lit(method).alias("method"), F.struct(*[F.col(c).cast("long").alias(f"o{i}") for i, c in enumerate((row * 3)[:3])]).alias("at"), "fields", "block_id", "above")


def link_name(text: Column, href: Column, base: Column) -> Column:
    """What a link of a record is: a document, the record's own website (another site under a label that names nothing), or a url."""
    elsewhere = href.rlike("^https?://") & (domain_of(href) != domain_of(base)) & F.lower(F.trim(text)).isin(*GENERIC_LABELS)
    return F.when(file_extension(href) != "", "document").when(elsewhere, "website").otherwise("url")


def list_observations(e: DataFrame, pages: DataFrame, today: date, key: str = "page_id") -> DataFrame:
    """(key, lst, n, above, name, value, place): entries of link lists with their title, link and the rest of the item."""
    entries = list_records(e, key)
    items = e.where("tag = 'li'").select(key, F.col("n").alias("item"), F.col("text").alias("whole"))
    anchors = e.where("tag = 'a'").select(key, "n", F.col("li").alias("item"), "above")
    stamps = e.where("tag = 'time' AND li IS NOT NULL AND content <> ''").groupBy(key, F.col("li").alias("item")).agg(F.min_by("content", "n").alias("stamp"))
    found = spread(entries.join(anchors, [key, "n"]).join(items, [key, "item"]).join(stamps, [key, "item"], "left").join(pages.select(key, "url"), key, "left"))
    rest = F.regexp_replace(F.expr("concat_ws(' ', substring(whole, 1, locate(title, whole) - 1), substring(whole, locate(title, whole) + length(title)))"), f"^{SEPARATORS}|{SEPARATORS}$", "")
    found = found.withColumns({"rest": F.coalesce("stamp", F.regexp_replace(rest, r"\s+", " ")), "href": absolute(F.col("url"), F.col("href"))})
    dated = (F.size(find_periods(F.col("rest"), today)) > 0) & (F.size(F.split("rest", " ")) <= DATE_WORDS)
    told = F.array(_pair("title", F.col("title")), _pair(link_name(F.col("title"), F.col("href"), F.col("url")), F.col("href")), _pair(F.when(dated, "date").otherwise("description"), F.substring("rest", 1, REST)))
    told = F.filter(told, lambda x: F.coalesce(x["value"], F.lit("")) != "")
    return found.select(key, "lst", "n", "above", F.posexplode(told).alias("place", "f")).select(key, "lst", "n", "above", "place", "f.*")


def page_facts(e: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, title, heading, published, modified, description, text, closed) of every page: `closed` are security checks and
    short pages that ask to sign in; the text is that of the main part, an article or the body, whichever comes first."""
    first = lambda what, column="text": F.min_by(column, F.when(what & (F.coalesce(F.col(column), F.lit("")) != ""), F.col("n")))
    of = e.groupBy(key).agg(
        first((F.col("tag") == "meta") & (F.lower("name") == "description"), "content").alias("description"),
        first(F.col("tag").isin("main", "article")).alias("main"), first(F.col("tag") == "body").alias("body"),
    )
    told = provenance(e, key).join(of, key)
    body = F.coalesce("body", F.lit(""))
    closed = is_challenge(F.coalesce("title", F.lit("")), body) | ((F.length(body) < SHORT_PAGE) & is_login_wall(F.lit(""), body))
    return told.select(key, "title", "heading", "published", "modified", "description", F.substring(F.coalesce("main", "body"), 1, MAX_VALUE).alias("text"), closed.alias("closed"))


def tidy_fields(fields: Column) -> Column:
    """Fields under keys of lower-case words, values of MAX_VALUE characters at most, empty ones left out; the last of a name counts."""
    made = F.transform(fields, lambda x: _pair(slug(x["name"]), F.substring(F.trim(F.regexp_replace(x["value"], r"\s+", " ")), 1, MAX_VALUE)))
    made = F.filter(made, lambda x: (F.coalesce(x["name"], F.lit("")) != "") & (F.coalesce(x["value"], F.lit("")) != ""))
    value = lambda m, n: F.element_at(F.filter(m, lambda y: y["name"] == n), -1)["value"]
    # Made once a row: named by a lambda, else every mention within the lambdas would make the fields again
    told = F.transform(F.array(made), lambda m: F.transform(F.array_distinct(F.transform(m, lambda x: x["name"])), lambda n: _pair(n, value(m, n))))
    return F.element_at(told, 1)


def page_observations(pages: DataFrame, today: date, key: str = "page_id", html: str = "html", references: tuple[str, ...] | None = None) -> DataFrame:
    """Observations of pages (key, url, html), ready for `scoring.score_rows`.

    row (key and place), key, place, method, fields, context, context_kind, block_id, title, url, coverage, published_at,
    modified_at, fetched_at, role and noise (the verdict on the row). Of a page's equal rows the first in ORDER stays, and of
    all 500; a page without any has its title, heading, description and text as one row, and so have security checks and
    closed pages, which give nothing else. A null page has no rows. `references`: see `elements`.
    """
    e = spool(elements(pages.where(F.col(html).isNotNull()), key, html, max_text=None, references=references), "elements")
    facts = spool(page_facts(e, key), "page-facts")
    inside = e.join(facts.where("closed").select(key), key, "left_anti")
    urls = pages.select(key, "url")
    state = state_records(inside, key).withColumn("place", F.lit(0))
    cards = card_records(inside, key).join(inside.select(key, F.col("n").alias("card"), "classes", "above"), [key, "card"]).withColumn("place", F.lit(0))
    lists = list_observations(inside, pages, today, key)
    said = page_statements(inside, today, key, at="n").join(inside.select(key, "n", "above"), [key, "n"])
    told = F.filter(F.array(_pair("statement", F.col("statement")), _pair("value", F.col("value")), _pair("change", F.col("change")), _pair("period", F.col("period"))), lambda x: x["value"].isNotNull())
    tables = table_observations(inside, today, urls, key)

    at = lambda *c: F.struct(*[F.col(x).cast("long").alias(f"o{i}") for i, x in enumerate(c)])
    parts = [
        _gathered(json_records(inside, key).withColumn("place", F.lit(0)), key, ["n", "item"], ["place"], "json_ld", F.lit("json_ld")),
        _gathered(state, key, ["n", "list", "item"], ["place"], "hydration_json", F.concat(F.lit("hydration:"), F.col("n").cast("string"), F.lit("/"), F.col("list").cast("string"))),
        _gathered(cards, key, ["card"], ["place"], "repeated_region", F.concat(F.lit("cards:"), F.substring(F.coalesce(F.nullif("classes", F.lit("")), F.lit("article")), 1, 48)), F.col("above")),
        _gathered(lists, key, ["lst", "n"], ["place"], "list_item", F.concat(F.lit("list#"), F.col("lst").cast("string")), F.col("above")),
        said.select(key, "method", at("place", "place", "place").alias("at"), told.alias("fields"), F.lit("").alias("block_id"), "above"),
    ]
    around = inside.where("tag IN ('h1', 'h2', 'h3', 'h4')").select(key, F.col("n").alias("above"), F.substring("text", 1, CONTEXT).alias("context"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.join(around, [key, "above"], "left").select(key, "method", "at", "fields", F.coalesce("context", F.lit("")).alias("context"), F.when(F.coalesce("context", F.lit("")) != "", "heading").otherwise("").alias("context_kind"), "block_id")
    found = found.unionByName(tables.select(key, F.lit("html_table").alias("method"), at("tbl", "place", "place").alias("at"), "fields", "context", "context_kind", "block_id"))

    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("method"))
    clean = found.withColumn("fields", tidy_fields(F.col("fields"))).where(F.size("fields") > 0)
    signature = F.md5(F.lower(F.to_json(F.array_sort("fields"))))
    rest = [c for c in clean.columns if c not in (key, "at")]
    once = clean.groupBy(key, signature.alias("signature")).agg(F.min_by(F.struct(*rest), F.struct(rank, "at")).alias("o"), F.min(F.struct(rank.alias("rank"), "at")).alias("first"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("first"))).where(F.col("place") <= MAX_ROWS).select(key, "place", "o.*")
    placed = spool(placed.withColumn("role", F.lit("data")), "page-rows")

    summary = F.array(*[_pair(c, F.col(c)) for c in ("title", "heading", "description", "text")])
    empty = facts.join(placed.select(key).distinct(), key, "left_anti")
    alone = empty.select(
        key, F.lit(1).alias("place"), F.lit("page_summary").alias("method"), tidy_fields(summary).alias("fields"), F.lit("").alias("context"), F.lit("").alias("context_kind"),
        F.lit("").alias("block_id"), F.when(F.col("closed"), "challenge").otherwise("data").alias("role"),
    ).where(F.size("fields") > 0)
    every = placed.unionByName(alone).join(facts.select(key, "title", "published", "modified"), key).join(urls, key)
    title = F.coalesce(F.try_element_at(F.filter("fields", lambda x: x["name"] == "title"), F.lit(1))["value"], F.lit(""))
    every = every.withColumn("v", noise_verdict(F.col("fields"), F.col("method"), title, today, F.col("role")))
    return every.select(
        F.concat_ws(":", F.col(key).cast("string"), F.col("place").cast("string")).alias("row"), key, "place", "method", "fields", "context", "context_kind", "block_id",
        F.coalesce("title", F.lit("")).alias("title"), "url", F.lit(None).cast("string").alias("coverage"),
        F.col("published").try_cast("date").alias("published_at"), F.col("modified").try_cast("date").alias("modified_at"), F.lit(None).cast("date").alias("fetched_at"),
        F.col("v.role").alias("role"), F.col("v.probability").alias("noise"),
    )


# --- queries


def _told(rows: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("fields", lambda x: F.concat_ws("=", x["name"], x["value"])), "; ")
    return rows.select("page_id", "place", "method", told.alias("told"), "context", "role", "noise")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_of_customers(spark, sf_dir).withColumn("url", F.lit("https://parcels.example/list"))
    return _told(page_observations(pages, TODAY))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = ("&quot;", "&#x27;", "&lt;", "&gt;", "&amp;")  # those that its SQL reads
    return _told(page_observations(table(spark, sf_dir, "pages"), TODAY, references=read))


QUERIES = {"observations_of_customers": _customers, "observations_of_pages": _pages}
_PLAIN = "replace(replace(replace(replace(replace(regexp_replace(trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), '\\s+', ' ', 'g'), '&quot;', chr(34)), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
ORACLE = {
    "observations_of_customers": """WITH c AS (SELECT c_custkey AS page_id, CAST(c_custkey AS VARCHAR) AS k, CAST(c_nationkey + 1995 AS VARCHAR) AS y, CAST(c_nationkey + 1996 AS VARCHAR) AS z,
  CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR) AS p, c_mktsegment AS s FROM customer)
SELECT page_id, place, method, told, context, CASE method WHEN 'list_item' THEN 'navigation' ELSE 'data' END AS role, CASE method WHEN 'list_item' THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS noise
FROM c, LATERAL (VALUES (1, 'html_table', 'year=' || y || '; total_price=$' || p || '; column_3=' || s, ''), (2, 'html_table', 'year=' || z || '; total_price=$' || p || '0', ''),
  (3, 'repeated_region', 'name=Parcel One of ' || k || '; status=' || s, ''), (4, 'repeated_region', 'name=Parcel Two of ' || k || '; status=' || s, 'Parcel One of ' || k),
  (5, 'list_item', 'title=The first notice of ' || k || '; url=https://parcels.example/first/' || k, ''), (6, 'list_item', 'title=The second notice of ' || k || '; url=https://parcels.example/second/' || k, ''),
  (7, 'list_item', 'title=The third notice of ' || k || '; url=https://parcels.example/third/' || k, ''),
  (8, 'text_statement', 'statement=In ' || y || ' the account reached $' || p || ' for all of its parcels.; value=$' || p || '; period=' || y, 'Parcel Two of ' || k)) AS v(place, method, told, context)""",
    "observations_of_pages": f"""WITH t AS (SELECT page_id, {_PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, {_PLAIN.format("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS heading,
  {_PLAIN.format("regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1)")} AS text FROM pages)
SELECT page_id, 1 AS place, 'page_summary' AS method, concat_ws('; ', 'title=' || nullif(title, ''), 'heading=' || nullif(heading, ''), 'text=' || nullif(trim(substring(text, 1, 1000)), '')) AS told, '' AS context, 'data' AS role, 0.55::DOUBLE AS noise FROM t""",
}
