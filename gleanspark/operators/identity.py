"""What identifies a record: key columns, the shape of identifiers, and the parameters by which an address pages."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.sources.tables import table

# Names of counters that shift, names of identifiers, names of paging parameters.
ROW_NUMBER = r"serial|row|index|rank|sr_?no|s_?no$|position"
KEY_NAME = r"(^|_)(id|slno|code|number|no|key)$"
PAGE_NAME = r"(?i)^(page|pageno|page_no|pagenumber|page_number|pageindex|page_index|p|pg)$"
OFFSET_NAME = r"(?i)^(offset|start|skip|from)$"
SIZE_NAME = r"(?i)^(size|limit|pagesize|page_size|perpage|per_page|rows|count|take|max|length)$"
NEARLY = 0.8  # a column whose estimated distinct values are fewer than this share of the rows is no key
ESTIMATE_ERROR = 0.02
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def scalar_columns(df: DataFrame) -> list[str]:
    """Text and whole-number columns, the likeliest keys first: named like an id, then like a key, then whole numbers,
    in the order of the schema; counters of rows come last."""

    def order(column: tuple[str, str]) -> tuple[bool, ...]:
        name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", column[0]).lower()
        return (bool(re.search(ROW_NUMBER, name)), not re.search(r"(^|_)id$", name), not re.search(KEY_NAME, name), column[1] not in INTEGERS)

    return [name for name, kind in sorted((c for c in df.dtypes if c[1] in ("string", *INTEGERS)), key=order)]


def key_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows, n_empty, n_distinct, is_key), one row a column; null and '' are empty. An empty table has no rows.

    Values are counted before they are moved, so a value that most rows share costs no more than another.
    """
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.nullif(_named(c).cast("string"), F.lit("")).alias("value")) for c in columns])))
    counted = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    empty = F.when(F.col("value").isNull(), F.col("n")).otherwise(0)
    found = counted.groupBy("column").agg(F.sum("n").alias("n_rows"), F.sum(empty).cast("long").alias("n_empty"), F.count("value").alias("n_distinct"))
    return found.withColumn("is_key", F.expr("n_rows = n_distinct"))


def identifying_columns(df: DataFrame) -> list[str]:
    """The first column, else the first pair of whole-number columns, that is never empty and differs in every row.

    A scan estimates all distinct counts at once (a small sketch a column); only what may be a key is then grouped
    exactly. Nothing but one row of counts reaches the driver. No such columns, or no rows: an empty list.
    """
    names = scalar_columns(df)
    kinds = dict(df.dtypes)
    numbers = [c for c in names if kinds[c] in INTEGERS]
    choices = [(c,) for c in names] + list(combinations(numbers, 2))
    if not choices:
        return []
    about = [F.approx_count_distinct(F.xxhash64(*map(_named, c)), ESTIMATE_ERROR).alias(f"d{i}") for i, c in enumerate(choices)]
    present = [F.count(F.nullif(_named(c).cast("string"), F.lit(""))).alias(f"n{i}") for i, c in enumerate(names)]
    seen = df.agg(F.count("*").alias("n"), *about, *present).first()
    whole = {c for i, c in enumerate(names) if seen[f"n{i}"] == seen["n"]}
    for i, c in enumerate(choices):
        if seen["n"] and whole.issuperset(c) and seen[f"d{i}"] >= NEARLY * seen["n"]:
            if df.groupBy(*map(_named, c)).count().where("count > 1").isEmpty():
                return sorted(c)
    return []


def shape(value: Column) -> Column:
    """Runs of letters as A, runs of digits as D, everything else as it is."""
    return F.regexp_replace(F.regexp_replace(value, "[A-Za-z]+", "A"), "[0-9]+", "D")


def value_shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, shape, n): how many filled values of each column have each shape."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), shape(_named(c).cast("string")).alias("shape")) for c in columns])))
    return cells.where("shape IS NOT NULL AND shape <> ''").groupBy("column", "shape").agg(F.count("*").alias("n"))


def id_pattern(df: DataFrame, column: str) -> str | None:
    """A regular expression for a column of identifiers, or None if its filled values don't share one shape with digits.

    A run of one length keeps it, unless it is a number that differs in every row: such a counter may grow.
    """
    shapes = value_shapes(df, [column]).limit(2).collect()
    if len(shapes) != 1 or "D" not in shapes[0]["shape"]:
        return None
    values = df.select(_named(column).cast("string").alias("value")).where("value <> ''")
    runs = values.select(F.posexplode(F.regexp_extract_all("value", F.lit("[A-Za-z]+|[0-9]+"), F.lit(0))).alias("place", "text"))
    texts = runs.groupBy("place", "text").agg(F.count("*").alias("n"))
    facts = texts.groupBy("place").agg(
        F.min(F.length("text")).alias("short"),
        F.max(F.length("text")).alias("long"),
        (F.max("n") == 1).alias("counter"),
        F.every(F.col("text") == F.upper("text")).alias("upper"),
        F.every(F.col("text") == F.lower("text")).alias("lower"),
    )
    at = iter(facts.orderBy("place").collect())
    out = []
    for part in re.findall("A|D|[^AD]+", shapes[0]["shape"]):
        if part not in ("A", "D"):
            out.append(re.escape(part))
            continue
        f = next(at)
        letters = "[A-Z]" if f["upper"] else "[a-z]" if f["lower"] else "[A-Za-z]"
        fixed = f["short"] == f["long"] and not (part == "D" and f["counter"])
        out.append((r"\d" if part == "D" else letters) + (f"{{{f['short']}}}" if fixed else "+"))
    return f"^{''.join(out)}$"


def paging(url: Column) -> Column:
    """(page, start, offset, size, size_value) of an address's query: the parameter that counts pages (the last one), or
    else the first that counts rows, with its number, and the one that gives a page's size. Null where nothing pages."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).alias("value")))
    whole = lambda names, number: F.filter(pairs, lambda p: p["name"].rlike(names) & p["value"].rlike(number))
    pages, rows, sizes = whole(PAGE_NAME, "^-?[0-9]{1,18}$"), whole(OFFSET_NAME, "^-?[0-9]{1,18}$"), whole(SIZE_NAME, "^[0-9]{1,18}$")
    of = F.coalesce(F.try_element_at(pages, F.lit(-1)), F.try_element_at(rows, F.lit(1)))
    size = F.try_element_at(sizes, F.lit(-1))
    found = F.struct(of["name"].alias("page"), of["value"].cast("long").alias("start"), (F.size(pages) == 0).alias("offset"), size["name"].alias("size"), size["value"].cast("long").alias("size_value"))
    return F.when(of.isNotNull(), found)


# --- queries


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(name, ",".join(identifying_columns(table(spark, sf_dir, name)))) for name in ("nation", "orders", "lineitem", "events")]
    return spark.createDataFrame(found, "table_name string, columns string")


QUERIES = {
    "key_profile": lambda s, d: key_profile(table(s, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]),
    "identifying_columns": _keys,
    "value_shapes": lambda s, d: value_shapes(table(s, d, "part"), ["p_brand", "p_name", "p_type"]).unionByName(value_shapes(table(s, d, "pages"), ["url"])),
    "paging_of_pages": lambda s, d: table(s, d, "pages").select("page_id", paging(F.col("url")).alias("p")).where("p IS NOT NULL").select("page_id", "p.page", "p.start", "p.offset"),
}
_EMPTY = "CAST(count(*) - count(nullif(CAST({0} AS VARCHAR), '')) AS BIGINT)"
_PAIRS = list(combinations(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), 2))
ORACLE = {
    "key_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, {_EMPTY.format(c)} AS n_empty, count(DISTINCT {c}) AS n_distinct, count(*) = count(DISTINCT {c}) AS is_key FROM customer"
        for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    ),
    "identifying_columns": """SELECT 'nation' AS table_name, CASE WHEN count(*) = count(DISTINCT n_nationkey) THEN 'n_nationkey' ELSE '' END AS columns FROM nation
UNION ALL SELECT 'orders', CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'o_orderkey' ELSE '' END FROM orders
UNION ALL SELECT 'events', CASE WHEN count(*) = count(DISTINCT event_id) THEN 'event_id' ELSE '' END FROM events
UNION ALL SELECT 'lineitem', CASE """
    + " ".join(f"WHEN count(*) = count(DISTINCT ({a}, {b})) THEN '{','.join(sorted((a, b)))}'" for a, b in _PAIRS)
    + " ELSE '' END FROM lineitem",
    "value_shapes": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", regexp_replace(regexp_replace({c}, '[A-Za-z]+', 'A', 'g'), '[0-9]+', 'D', 'g') AS shape, count(*) AS n FROM {t} WHERE {c} <> '' GROUP BY 2"
        for c, t in (("p_brand", "part"), ("p_name", "part"), ("p_type", "part"), ("url", "pages"))
    ),
    "paging_of_pages": r"""SELECT page_id, 'page' AS page, CAST(regexp_extract(url, '^[^?#]*\?([^#]*&)?page=([0-9]+)(&|#|$)', 2) AS BIGINT) AS start, false AS "offset"
FROM pages WHERE regexp_matches(url, '^[^?#]*\?([^#]*&)?page=([0-9]+)(&|#|$)')""",
}
