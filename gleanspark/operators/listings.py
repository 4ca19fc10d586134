"""What the columns and links of a listing are: serial numbers, file sizes, keys of records, links of a pager.

Facts of a column are one aggregate over its cells; whether its numbers count up is told by the difference to the cell before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.functions.urls import host_of, path_of
from gleanspark.sources.html import elements, links
from gleanspark.sources.tables import table

# Rows that tell, cells that number rows, file sizes, labels and parameters of pagers, shares that make a pager.
MIN_ROWS = 3
SERIAL = r"^\s*\d+\.?\s*$"
SIZE = r"(?i)^\s*\d+(\.\d+)?\s*(b|kb|mb|gb)\s*$"
PAGER_LABEL = r"(?i)^\s*(page\s*)?\d{1,4}\s*$|^\s*(next|prev|previous|first|last|older|newer|more|back)\b|^[\W]{1,3}$"
PAGE_PARAMS = ("page", "pagenumber", "pageno", "page_no", "pageindex", "p", "pg", "offset", "start", "skip", "from")
LABELLED, PAGED, ADDRESSES = 0.6, 0.7, 2


def column_facts(cells: DataFrame, key: str = "list") -> DataFrame:
    """(key, column, n, serial, size, unique, key_rank) of the columns of listings, from cells (key, row, column, value).

    serial: all cells are numbers that count up by one; size: all filled ones are file sizes; unique: three
    or more, all filled and different. key_rank numbers the columns that could identify a record, the likeliest first: without spaces, of like
    lengths, to the left; null for others. Of repeated cells the order is open; nulls are empty.
    """
    order = Window.partitionBy(key, "column").orderBy("row")
    value = F.coalesce(F.col("value"), F.lit(""))
    number = F.when(value.rlike(SERIAL), F.regexp_replace(value, r"\D", "").cast("long"))
    seen = cells.select(key, "column", "row", value.alias("value"), number.alias("number"))
    seen = seen.withColumn("step", F.col("number") - F.lag("number").over(order)).withColumn("first", F.row_number().over(order) == 1)
    length = F.length("value")
    facts = seen.groupBy(key, "column").agg(
        F.count("*").alias("n"),
        F.bool_and(F.col("number").isNotNull() & (F.col("first") | F.coalesce(F.col("step") == 1, F.lit(False)))).alias("serial"),
        F.bool_and((F.col("value") == "") | F.col("value").rlike(SIZE)).alias("size"),
        ((F.count("*") >= MIN_ROWS) & F.bool_and(F.col("value") != "") & (F.count_distinct("value") == F.count("*"))).alias("unique"),
        F.bool_or(F.col("value").contains(" ")).alias("spaced"),
        F.round((F.max(length) - F.min(length)) / F.greatest(F.lit(1.0), F.avg(length)), 1).alias("spread"),
    )
    fit = F.col("unique") & ~F.col("serial") & ~F.col("size")
    rank = F.row_number().over(Window.partitionBy(key, fit).orderBy("spaced", "spread", "column"))
    return facts.select(key, "column", "n", "serial", "size", "unique", F.when(fit, rank).alias("key_rank"))


def _params(href: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(href, r"\?([^#]*)", 1), "&"), lambda p: p != "")


def _pages(p: Column) -> Column:
    return F.lower(F.substring_index(p, "=", 1)).isin(*PAGE_PARAMS)


def pagers(items: DataFrame, key: str = "list") -> DataFrame:
    """(key, n, labelled, paged, addresses, pager) of lists of links (key, title, href): whether they lead to pages of a listing.

    Either six of ten labels are numbers, "next" and the like, or seven of ten addresses have a page parameter and all are
    two at most without it. Nulls are empty.
    """
    href = F.coalesce(F.col("href"), F.lit(""))
    rest = F.array_join(F.array_sort(F.filter(_params(href), lambda p: ~_pages(p))), "&")
    plain = F.concat_ws("|", host_of(href), F.when(host_of(href) == "", F.regexp_extract(href, "^[^?#]*", 0)).otherwise(path_of(href)), rest)
    found = items.groupBy(key).agg(
        F.count("*").alias("n"),
        F.avg(F.coalesce(F.col("title"), F.lit("")).rlike(PAGER_LABEL).cast("int")).alias("labelled"),
        F.avg(F.exists(_params(href), _pages).cast("int")).alias("paged"),
        F.count_distinct(plain).alias("addresses"),
    )
    return found.withColumn("pager", (F.col("labelled") >= LABELLED) | ((F.col("paged") >= PAGED) & (F.col("addresses") <= ADDRESSES)))


# --- queries


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as listings of their line items."""
    li = table(spark, sf_dir, "lineitem")
    columns = F.array(F.col("l_linenumber").cast("string"), F.concat(F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" KB")), F.col("l_returnflag"))
    cells = li.select(F.col("l_orderkey").alias("list"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("row"), F.posexplode(columns).alias("column", "value"))
    return column_facts(cells)


def _menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menus of pages, and lists of their neighbours by number."""
    e = elements(table(spark, sf_dir, "pages").select("page_id", "html"))
    menus = links(e).where("chrome").select(F.concat(F.lit("menu "), F.col("page_id").cast("string")).alias("list"), F.col("text").alias("title"), "href")
    p = table(spark, sf_dir, "pages")
    near = p.select(F.concat(F.lit("near "), F.col("page_id").cast("string")).alias("list"), "url", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    near = near.select("list", F.concat(F.lit("Result list "), F.col("i").cast("string"), F.lit(" of it")).alias("title"), F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit("?lang=x&page="), F.col("i").cast("string")).alias("href"))
    return pagers(menus.unionByName(near)).select("list", "n", "addresses", "pager")


QUERIES = {"column_facts": _line_items, "pagers_of_pages": _menus}
ORACLE = {
    "column_facts": r"""WITH c AS (SELECT l_orderkey AS list, (l_linenumber, l_partkey, l_suppkey) AS row, unnest([0, 1, 2, 3])::INTEGER AS "column", unnest([l_linenumber::VARCHAR, l_partkey || '-' || l_suppkey, trunc(l_quantity)::INT || ' KB', l_returnflag]) AS value FROM lineitem),
s AS (SELECT *, CASE WHEN "column" = 0 THEN value::BIGINT END AS num, row_number() OVER w AS i, CASE WHEN "column" = 0 THEN value::BIGINT - lag(CASE WHEN "column" = 0 THEN value::BIGINT END) OVER w END AS step FROM c WINDOW w AS (PARTITION BY list, "column" ORDER BY row)),
f AS (SELECT list, "column", count(*) AS n, bool_and(num IS NOT NULL AND (i = 1 OR step = 1)) AS serial, bool_and("column" = 2) AS size, count(*) >= 3 AND count(DISTINCT value) = count(*) AS "unique", bool_or(contains(value, ' ')) AS spaced,
  round((max(length(value)) - min(length(value))) / greatest(1.0, avg(length(value))), 1) AS spread FROM s GROUP BY 1, 2)
SELECT list, "column", n, serial, size, "unique", CASE WHEN "unique" AND NOT serial AND NOT size THEN row_number() OVER (PARTITION BY list, "unique" AND NOT serial AND NOT size ORDER BY spaced, spread, "column")::INTEGER END AS key_rank FROM f""",
    "pagers_of_pages": """WITH m AS (SELECT 'menu ' || page_id AS list, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav.*?</nav>') || regexp_extract(html, '(?s)<footer.*?</footer>'), '<a [^>]*href="([^"]+)"[^>]*>(.*?)</a>', 1)) AS href,
  unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav.*?</nav>') || regexp_extract(html, '(?s)<footer.*?</footer>'), '<a [^>]*href="([^"]+)"[^>]*>(.*?)</a>', 2)) AS title FROM pages)
SELECT list, count(*) AS n, count(DISTINCT split_part(split_part(href, '#', 1), '?', 1)) AS addresses, avg(regexp_matches(title, '(?i)^\\s*(page\\s*)?[0-9]{1,4}\\s*$|^\\s*(next|prev|previous|first|last|older|newer|more|back)\\b|^[^\\p{L}\\p{N}_]{1,3}$')::INT) >= 0.6 AS pager FROM m GROUP BY 1
UNION ALL SELECT 'near ' || page_id, 3, 1, true FROM pages""",
}
