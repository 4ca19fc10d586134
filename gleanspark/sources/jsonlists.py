"""Lists of records at any place of a JSON document, found by walking VARIANT values level by level.

A level is one explode of the objects (and lists, where asked) of the level above, so no document is ever walked by Python;
what is a list of records, and which of them a document is about, are columns and one aggregate by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.lineage import spool, spread
from gleanspark.sources.tables import table

# Depth of the walk, what makes a list one of records, children of a list that are read, names of the next page.
DEPTH, LEAST, LIKE, COMMON, CHILDREN = 4, 3, 0.9, 2, 50
NEXT_KEY = r"(?i)^(next|next_?page|next_?url|next_?link|nextpageurl)$"
NEXT_DEPTH, NAME, VALUE, FIELDS_OF_RECORD = 3, 60, 2000, 40


def as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_text(v: Column) -> Column:
    """A scalar as text; null for objects, lists and null."""
    return F.when(~F.schema_of_variant(v).rlike("^(?:OBJECT|ARRAY)"), F.try_variant_get(v, "$", "string"))


def levels(docs: DataFrame, key: str, json: str = "json", depth: int = DEPTH, through_lists: bool = False) -> list[DataFrame]:
    """(key, path, v) of every value, one table a level, the document itself first. Broken JSON and nulls have none."""
    at = docs.select(key, F.array().cast("array<string>").alias("path"), F.try_parse_json(F.col(json)).alias("v")).where("v IS NOT NULL")
    out = [at]
    for _ in range(depth):
        below = at.select(key, "path", F.explode(as_object(F.col("v"))).alias("k", "w")).select(key, F.concat("path", F.array("k")).alias("path"), F.col("w").alias("v"))
        if through_lists:
            items = at.select(key, "path", F.posexplode(F.slice(as_list(F.col("v")), 1, CHILDREN)).alias("k", "w"))
            below = below.unionByName(items.select(key, F.concat("path", F.array(F.col("k").cast("string"))).alias("path"), F.col("w").alias("v")))
        at = below
        out.append(at)
    return out


def record_lists(docs: DataFrame, key: str, json: str = "json", through_lists: bool = False, least: int = LEAST, common: int = COMMON, depth: int = DEPTH) -> DataFrame:
    """(key, path, items, n, common): of each document the list with the most records times names that all of them share.

    A list counts if it has `least` objects or more, nine of ten of its items are objects, and these share `common` names.
    Of equal lists the one at the least path. Documents without such a list, broken JSON and nulls have no row.
    """
    every = reduce(DataFrame.unionByName, levels(docs, key, json, depth, through_lists))
    lists = every.select(key, "path", as_list(F.col("v")).alias("all")).where("all IS NOT NULL")
    lists = lists.withColumn("items", F.filter("all", lambda x: as_object(x).isNotNull())).where((F.size("items") >= least) & (F.size("items") >= LIKE * F.size("all")))
    names = F.transform("items", lambda x: F.map_keys(as_object(x)))
    shared = F.aggregate(F.slice(names, 2, F.size(names)), F.element_at(names, 1), lambda a, x: F.array_intersect(a, x))
    # Kept, since the choice and the chosen both need them: documents are walked once
    lists = spool(lists.withColumn("common", F.size(shared)).where(F.col("common") >= common).select(key, "path", "items", F.size("items").alias("n"), "common"), "lists")
    first = F.min_by(F.struct("path", "n", "common"), F.struct((-F.col("n") * F.col("common")).alias("w"), "path"))
    best = lists.groupBy(key).agg(first.alias("b")).select(key, "b.*")
    return lists.join(best.select(key, "path"), [key, "path"]).select(key, "path", "items", "n", "common")


def next_pages(docs: DataFrame, key: str, json: str = "json") -> DataFrame:
    """(key, path, address): where a document names the address of its next page, if it does."""
    named = [lv.where(F.col("path").isNotNull() & F.element_at(F.concat("path", F.array(F.lit(""))), F.greatest(F.size("path"), F.lit(1))).rlike(NEXT_KEY)) for lv in levels(docs, key, json, NEXT_DEPTH)[1:]]
    found = reduce(DataFrame.unionByName, named).select(key, "path", as_text(F.col("v")).alias("address")).where("address RLIKE '^(https?://|/)'")
    return found.groupBy(key).agg(F.min_by(F.struct("path", "address"), F.struct(F.size("path").alias("n"), "path")).alias("b")).select(key, "b.*")


def snake(name: Column) -> Column:
    made = F.regexp_replace(F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_")), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(made, "^_+|_+$", ""), 1, NAME), F.lit("")), F.lit("field"))


def record_fields(lists: DataFrame, key: str) -> DataFrame:
    """(key, item, name, value): readable fields of the records of `record_lists`: scalars, lists of them joined, and those of
    inner objects, one level deep, under joined names. Empty ones are left out; of a repeated name the first counts."""
    entries = lambda v: F.coalesce(F.map_entries(as_object(v)), F.array().cast("array<struct<key:string,value:variant>>"))
    named = lambda k, v: F.struct(k.alias("k"), v.alias("w"))
    inner = lambda e: F.transform(entries(e["value"]), lambda g: named(F.concat_ws("_", e["key"], g["key"]), g["value"]))
    scalars = lambda w: F.filter(F.transform(F.filter(as_list(w), lambda x: F.schema_of_variant(x) != "BOOLEAN"), as_text), lambda x: x.isNotNull())
    value = lambda w: F.substring(F.coalesce(F.nullif(F.array_join(scalars(w), "; "), F.lit("")), as_text(w)), 1, VALUE)
    # A record's fields stay in its row until they are read: its names repeat only there, so none is moved to meet its like
    items = spread(lists).select(key, F.posexplode("items").alias("item", "o")).select(key, "item", entries(F.col("o")).alias("e"))
    every = F.concat(F.transform("e", lambda e: named(e["key"], e["value"])), F.flatten(F.transform("e", inner)))
    plain = items.select(key, "item", F.filter(every, lambda f: as_object(f["w"]).isNull()).alias("f"))
    told = plain.select(key, "item", F.transform("f", lambda f: F.struct(snake(f["k"]).alias("name"), f["k"].alias("k"), value(f["w"]).alias("value"))).alias("f"))
    told = told.select(key, "item", F.array_sort(F.filter("f", lambda f: f["value"] != "")).alias("f"))
    first = F.filter("f", lambda f, i: (i == 0) | (f["name"] != F.get("f", i - 1)["name"]))
    return told.select(key, "item", F.explode(first).alias("f")).select(key, "item", "f.name", "f.value")


# --- queries


def answers_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a paged service would say of every customer: its orders deep inside, a shorter list beside them, the next address."""
    o = table(spark, sf_dir, "orders")
    order = F.struct(F.col("o_orderkey").alias("orderId"), F.col("o_orderstatus").alias("status"), F.struct(F.floor("o_totalprice").cast("long").alias("amount"), F.lit("USD").alias("unit")).alias("price"), F.array(F.col("o_orderpriority"), F.lit("sea")).alias("tags"))
    rows = o.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(order)).alias("rows"))
    facets = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(i.alias("code"), F.lit("x").alias("label")))
    following = F.when(F.col("id") % 2 == 0, F.concat(F.lit("/orders?page="), F.col("id").cast("string"))).otherwise("none")
    body = F.struct(F.struct(F.struct("rows", facets.alias("facets")).alias("result"), F.struct(F.size("rows").alias("total"), following.alias("nextUrl")).alias("page")).alias("data"))
    return spread(rows.select("id", F.to_json(body).alias("json")))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_fields(record_lists(answers_of_customers(spark, sf_dir), "id"), "id")


QUERIES = {
    "json_record_fields": _fields,
    "json_record_lists": lambda s, d: record_lists(answers_of_customers(s, d), "id").select("id", F.array_join("path", ".").alias("path"), "n", "common"),
    "json_next_pages": lambda s, d: next_pages(answers_of_customers(s, d), "id").select("id", F.array_join("path", ".").alias("path"), "address"),
}
_SIZES = "WITH c AS (SELECT o_custkey AS id, count(*)::INTEGER AS n FROM orders GROUP BY 1)"
ORACLE = {
    # With fewer than two orders the list of three facets weighs more; two orders never make a list
    "json_record_lists": f"""{_SIZES} SELECT id, CASE WHEN n >= 3 THEN 'data.result.rows' ELSE 'data.result.facets' END AS path, CASE WHEN n >= 3 THEN n ELSE 3 END AS n, CASE WHEN n >= 3 THEN 4 ELSE 2 END AS common FROM c""",
    "json_next_pages": f"{_SIZES} SELECT id, 'data.page.nextUrl' AS path, '/orders?page=' || id AS address FROM c WHERE id % 2 = 0",
    "json_record_fields": f"""{_SIZES}, o AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS item FROM orders JOIN c ON o_custkey = id WHERE n >= 3),
few AS (SELECT id, unnest([0, 1, 2])::INTEGER AS item FROM c WHERE n < 3)
SELECT id, item, 'order_id' AS name, CAST(o_orderkey AS VARCHAR) AS value FROM o UNION ALL SELECT id, item, 'status', o_orderstatus FROM o
UNION ALL SELECT id, item, 'price_amount', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) FROM o UNION ALL SELECT id, item, 'price_unit', 'USD' FROM o
UNION ALL SELECT id, item, 'tags', o_orderpriority || '; sea' FROM o UNION ALL SELECT id, item, 'code', CAST(item + 1 AS VARCHAR) FROM few UNION ALL SELECT id, item, 'label', 'x' FROM few""",
}
