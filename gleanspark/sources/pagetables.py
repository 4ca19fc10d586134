"""Tables of pages as observations: what each row of a table is, is told by windows over the rows around it.

A table becomes one row for each of its own rows, an array of cells; running minima over these find the titles and header
rows at its top, the kinds of the next three rows tell whether a first row of texts is a header that nobody marked. The
shape of the whole table (a sheet of properties, a column for every period, or plain rows) then decides, table by table, how
its body is laid out.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.functions.numbers import QUANTITY_KINDS, value_kind
from gleanspark.functions.strings import slug
from gleanspark.functions.temporal import parse_period
from gleanspark.functions.urls import absolute
from gleanspark.lineage import spool, spread
from gleanspark.sources.html import GENERIC_LABELS, elements, table_cells
from gleanspark.sources.tables import table

# Names of a property column, header rows and titles that count, rows that tell a header, periods that make columns.
PROPERTY_HEADERS = ("field", "property", "attribute", "key", "name", "label", "item", "parameter", "specification", "spec", "metric", "indicator", "characteristic")
HEADER_ROWS, TELLING_ROWS, PERIODS, CONTEXT = 3, 3, 3, 240
FIELDS = "array<struct<name:string,value:string>>"
TODAY = date(2026, 9, 30)


def _at(rows: Column, i: Column | int) -> Column:
    return F.coalesce(F.try_element_at(rows, (F.lit(i) if isinstance(i, int) else i) + 1), F.lit(""))


def table_rows(e: DataFrame, today: date, key: str = "page_id") -> DataFrame:
    """(key, tbl, nth, width, cells, links, kinds, role) of every filled row of a data table; cells by place, empty ones as such.

    Roles: title (a leading row with one text only, as long as two rows follow), header (up to three marked rows after the
    titles, or a first row of distinct texts over values), body. Tables within tables stand alone, page chrome is left out.
    """
    cells = table_cells(e, key)
    rows = cells.groupBy(key, "tbl", "tr").agg(F.array_sort(F.collect_list(F.struct("place", "text", "link"))).alias("c"), F.bool_or("header").alias("marked"))
    rows = rows.where(F.exists("c", lambda x: x["text"] != ""))
    own = Window.partitionBy(key, "tbl")
    order = own.orderBy("tr")
    rows = rows.withColumns({"nth": F.row_number().over(order), "rows": F.count("*").over(own), "width": F.max(F.array_max(F.transform("c", lambda x: x["place"])) + 1).over(own)})
    places = F.sequence(F.lit(0), F.col("width") - 1)
    at = lambda i, what: F.try_element_at(F.filter("c", lambda x: x["place"] == i), F.lit(1))[what]
    rows = rows.withColumns({"cells": F.transform(places, lambda i: F.coalesce(at(i, "text"), F.lit(""))), "links": F.transform(places, lambda i: at(i, "link"))})
    rows = rows.withColumn("kinds", F.transform("cells", lambda x: value_kind(x, today)))
    texts = F.filter("cells", lambda x: x != "")
    alone = (F.size(F.array_distinct(texts)) == 1) & ((F.size(texts) == F.col("width")) | (F.size(texts) == 1)) & F.exists("kinds", lambda k: k == "text")
    entitled = alone & (F.col("width") > 1) & (F.col("rows") - F.col("nth") >= 2)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("title", F.min(entitled.cast("int")).over(so_far) == 1)
    rows = rows.withColumn("titles", F.sum(F.col("title").cast("int")).over(own)).withColumn("after", F.col("nth") - F.col("titles"))
    marked = F.col("title") | (F.col("marked") & (F.col("after") <= HEADER_ROWS))
    rows = rows.withColumn("head", ~F.col("title") & (F.min(marked.cast("int")).over(so_far) == 1))
    telling = F.exists("kinds", lambda k: k.isin("period", *QUANTITY_KINDS))
    ahead = order.rowsBetween(1, TELLING_ROWS)
    periods = F.size(F.filter("kinds", lambda k: k == "period"))
    said = F.forall("kinds", lambda k: k.isin("empty", "text", "period")) & (F.size(F.array_distinct(texts)) == F.size(texts)) & ((periods == 0) | (periods >= PERIODS))
    guess = (F.col("after") == 1) & ~F.max("head").over(own) & (F.col("rows") - F.col("titles") >= 2) & said & (F.max(telling.cast("int")).over(ahead) == 1)
    role = F.when(F.col("title"), "title").when(F.col("head") | guess, "header").otherwise("body")
    return rows.select(key, "tbl", "nth", "width", "cells", "links", "kinds", role.alias("role"))


def _headers(rows: Column, width: Column) -> Column:
    """Names of columns: their header cells joined, unnamed ones called label or column_n, repeated ones numbered."""
    joined = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.array_join(F.array_distinct(F.filter(F.transform(rows, lambda r: _at(r["cells"], i)), lambda x: x != "")), " "))
    named = F.transform(joined, lambda x, i: F.when(x != "", x).when(i == 0, "label").otherwise(F.concat(F.lit("column_"), (i + 1).cast("string"))))
    nth = lambda x, i: F.size(F.filter(F.slice(named, F.lit(1), i + 1), lambda y: y == x))
    return F.transform(named, lambda x, i: F.when(nth(x, i) > 1, F.concat_ws("_", x, nth(x, i).cast("string"))).otherwise(x))


def table_observations(e: DataFrame, today: date, urls: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """(key, tbl, block_id, place, fields, context, context_kind): the observations of data tables, in order.

    A table of two columns that names properties is one observation. One with a column for each of three or more periods
    (half of its columns at least) gives an observation for every value, under period, value and its row's labels. Others give
    one for every body row. A link under a label that names nothing becomes the value, others a field `<name>_url`; `urls`
    (key, url) makes them absolute. The context is the table's title, its caption or the heading above it.
    """
    rows = spool(table_rows(e, today, key), "table-rows")  # read twice below
    if urls is not None:
        rows = rows.join(urls.select(key, F.col("url").alias("_url")), key, "left")
        rows = rows.withColumn("links", F.transform("links", lambda x: absolute(F.col("_url"), x)))
    own = Window.partitionBy(key, "tbl")
    part = lambda role, what: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("nth", what))))
    shape = rows.groupBy(key, "tbl").agg(F.any_value("width").alias("width"), F.count("*").alias("rows"), part("title", "cells").alias("titles"), part("header", "cells").alias("heads"), part("body", "cells").alias("body"))
    first = F.transform(F.col("body"), lambda r: _at(r["cells"], 0))
    labels = F.filter(first, lambda x: x != "")
    headers = F.when(F.size("heads") > 0, _headers(F.col("heads"), F.col("width")))
    keyed = F.transform(headers, slug)
    says = F.size("heads") == 0
    says = says | F.arrays_overlap(keyed, F.array(*map(F.lit, PROPERTY_HEADERS))) | (F.size(F.array_except(keyed, F.array(F.lit("label"), F.lit("column_2")))) == 0)
    sheet = (F.col("width") == 2) & says & (F.size(labels) >= 2) & (F.size(F.array_distinct(labels)) == F.size(labels)) & F.forall(labels, lambda x: value_kind(x, today) == "text")
    title = F.substring(F.array_join(F.transform("titles", lambda r: F.element_at(F.filter(r["cells"], lambda x: x != ""), 1)), " "), 1, CONTEXT)
    plain = F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.concat(F.lit("column_"), i.cast("string")))
    shape = shape.where((F.col("rows") >= 2) | (F.col("width") >= 2)).select(key, "tbl", title.alias("title"), sheet.alias("sheet"), headers.alias("stated"), F.coalesce(headers, plain).alias("names"))
    period = F.transform("names", lambda n: parse_period(n, today).isNotNull())
    n_periods = F.size(F.filter("periods", lambda p: p))
    shape = shape.withColumn("periods", period).withColumn("wide", (n_periods >= PERIODS) & (2 * n_periods >= F.size("names")))
    shape = shape.withColumn("block", F.dense_rank().over(Window.partitionBy(key).orderBy("tbl")))

    body = spool(rows.where("role = 'body'").join(shape, [key, "tbl"]).where("stated IS NULL OR cells <> stated"), "table-bodies")
    # One observation of a sheet: its labels with their values
    pairs = F.array_sort(F.collect_list(F.struct("nth", F.struct(_at(F.col("cells"), 0).alias("name"), _at(F.col("cells"), 1).alias("value")).alias("f"))))
    sheets = body.where("sheet").groupBy(key, "tbl", "block", "title").agg(F.filter(F.transform(pairs, lambda x: x["f"]), lambda f: (f["name"] != "") & (f["value"] != "")).alias("fields")).where(F.size("fields") > 0)
    sheets = sheets.select(key, "tbl", "block", "title", F.lit(0).alias("nth"), F.lit(0).alias("part"), "fields")
    # Others: cells under their names, with links
    generic = lambda x: F.lower(F.trim(x)).isin(*GENERIC_LABELS)
    pair = lambda n, v: F.struct(n.alias("name"), v.alias("value"))

    def named(x: Column) -> Column:
        name, text, link = x["names"], x["cells"], x["links"]
        told = F.when(F.coalesce(link, F.lit("")) == "", F.array(pair(name, text))).when(generic(text), F.array(pair(name, link))).otherwise(F.array(pair(name, text), pair(F.concat(name, F.lit("_url")), link)))
        return F.when(text == "", F.array().cast(FIELDS)).otherwise(told)

    zipped = F.arrays_zip("names", "cells", "links", "periods")
    whole = F.flatten(F.transform(zipped, named))
    described = F.transform(F.filter(whole, lambda f: ~F.array_contains(F.transform(F.filter(F.arrays_zip("names", "periods"), lambda x: x["periods"]), lambda x: x["names"]), f["name"])), lambda f: pair(F.when(f["name"] == "label", "series").otherwise(f["name"]), f["value"]))
    dated = F.filter(zipped, lambda x: x["periods"] & (x["cells"] != ""))
    long = F.transform(dated, lambda x: F.concat(described, F.array(pair(F.lit("period"), x["names"]), pair(F.lit("value"), x["cells"]))))
    laid = body.where("NOT sheet").select(key, "tbl", "block", "title", "nth", F.posexplode(F.when(F.col("wide"), long).otherwise(F.array(whole))).alias("part", "fields")).where(F.size("fields") > 0)

    captions = e.where("tag = 'caption' AND text <> ''").groupBy(key, "tbl").agg(F.min_by("text", "n").alias("caption"))
    heads = e.where("tag IN ('h1', 'h2', 'h3', 'h4')").select(key, F.col("n").alias("above"), F.col("text").alias("heading"))
    around = e.where("tag = 'table'").select(key, F.col("n").alias("tbl"), "above").join(heads, [key, "above"], "left").join(captions, [key, "tbl"], "left")
    found = sheets.unionByName(laid).join(around, [key, "tbl"], "left")
    titled, captioned = F.nullif("title", F.lit("")), F.nullif("caption", F.lit(""))
    context = F.substring(F.coalesce(titled, captioned, "heading", F.lit("")), 1, CONTEXT)
    kind = F.when(F.coalesce(titled, captioned).isNotNull(), "caption").when(F.coalesce("heading", F.lit("")) != "", "heading").otherwise("")
    place = F.row_number().over(own.orderBy("nth", "part"))
    return found.select(key, "tbl", F.concat(F.lit("table#"), F.col("block").cast("string")).alias("block_id"), place.alias("place"), "fields", context.alias("context"), kind.alias("context_kind"))


# --- queries


def pages_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for every part, with a table whose shape goes by its size: a sheet of properties, a column for each of three
    years under a title, rows under a header that is not marked, or rows without any."""
    p = spread(table(spark, sf_dir, "part"))
    k, size, price, name = F.col("p_partkey").cast("string"), F.col("p_size"), F.floor("p_retailprice").cast("string"), F.col("p_brand")
    join = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    row = lambda *cells, tag="td": join("<tr>", *[x for c in cells for x in (f"<{tag}>", c, f"</{tag}>")], "</tr>")
    sheet = join(row("Property", "Value", tag="th"), row("Maker", name), row("Retail price", join("$", price)))
    wide = join("<tr><th colspan=4>Prices of part ", k, "</th></tr>", row("", "2019", "2020", "2021", tag="th"), row("Retail", join("$", price), "", "$7"), row("Whole", "", join("$", price, "1"), "$8"))
    guessed = join(row("Vendor", "List price"), row(name, join("$", price)), row(name, join("$", price, "0")))
    bare = join(row("1", price), row("2", join(price, "5")))
    made = F.when(size % 4 == 0, sheet).when(size % 4 == 1, wide).when(size % 4 == 2, guessed).otherwise(bare)
    html = join("<html><body><main><h2>Part ", k, "</h2><table>", made, "</table></main></body></html>")
    return p.select(F.col("p_partkey").alias("page_id"), join("https://parts.example/list/", k).alias("url"), html.alias("html"))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_of_parts(spark, sf_dir)
    told = F.array_join(F.transform("fields", lambda x: F.concat_ws("=", x["name"], x["value"])), "; ")
    return table_observations(spool(elements(pages, max_text=None), "elements"), TODAY, pages).select("page_id", "place", told.alias("told"), "context", "context_kind")


QUERIES = {"table_observations": _tables}
ORACLE = {
    "table_observations": """WITH p AS (SELECT p_partkey AS page_id, CAST(p_partkey AS VARCHAR) AS k, p_size % 4 AS shape, CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) AS price, p_brand AS b FROM part)
SELECT page_id, place, told, CASE WHEN shape = 1 THEN 'Prices of part ' || k ELSE 'Part ' || k END AS context, CASE WHEN shape = 1 THEN 'caption' ELSE 'heading' END AS context_kind
FROM p, LATERAL (VALUES (0, 1, 'Maker=' || b || '; Retail price=$' || price),
  (1, 1, 'series=Retail; period=2019; value=$' || price), (1, 2, 'series=Retail; period=2021; value=$7'), (1, 3, 'series=Whole; period=2020; value=$' || price || '1'), (1, 4, 'series=Whole; period=2021; value=$8'),
  (2, 1, 'Vendor=' || b || '; List price=$' || price), (2, 2, 'Vendor=' || b || '; List price=$' || price || '0'),
  (3, 1, 'column_1=1; column_2=' || price), (3, 2, 'column_1=2; column_2=' || price || '5')) AS v(of, place, told) WHERE of = shape""",
}
