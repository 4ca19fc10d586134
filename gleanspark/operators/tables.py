"""Dataset tables: from wide files to rows, from rows to tables, and what can be said of them.

Wide tables hold strings; a column `pos` carries the order of arrival wherever order matters.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.functions.numbers import is_quantity
from gleanspark.functions.temporal import overlaps, parse_period
from gleanspark.sources.tables import table

PERIOD_WORDS = ("year", "date", "period", "time", "day", "month", "quarter")
MEASURE_SHARE, MAX_MEASURES, SAMPLE_ROWS = 0.95, 16, 3000
PLACEHOLDER = r"(?i)\b(may contains?|multiple|various|not applicable|not available|n/?a|none|nil|unknown|tbd)\b|^[\s\-–—.]*$"  # fixed value
PLACEHOLDER_SHARE, PLACEHOLDER_LENGTH = 0.6, 120


def filled(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) != ""


def period_headers(spark: SparkSession, headers: list[str], today: date) -> list[str]:
    """The headers that are periods themselves."""
    names = spark.createDataFrame([(i, h) for i, h in enumerate(headers)], "i int, h string")
    return [r.h for r in names.where(parse_period(F.col("h"), today).isNotNull()).orderBy("i").collect()]


def unpivot_periods(df: DataFrame, today: date, columns: list[str] | None = None) -> DataFrame:
    """Files with periods across the top become a row per period: at least three of them, and half of the columns but one."""
    columns = columns or [c for c in df.columns if c != "pos"]
    periods = period_headers(df.sparkSession, columns, today)
    if len(periods) < 3 or len(periods) < 0.5 * (len(columns) - 1):
        return df
    ids = [c for c in df.columns if c not in periods]
    return df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in periods], "period", "value").where(filled("value"))


def unpivot_measures(df: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    """A row (ids, series, value) for each filled measure."""
    return df.unpivot(ids, measures, "series", "value").where(F.col("value").isNotNull())


def period_column(df: DataFrame, columns: list[str], today: date, rows: int = 50) -> str | None:
    """The column whose name starts with a time word, else the first whose first values are all periods."""
    for c in columns:
        words = c.lower().replace("_", " ").split()
        if words and words[0].rstrip("s") in PERIOD_WORDS:
            return c
    first = df.where(F.col("pos") < rows)
    checks = [F.min(F.when(filled(c), parse_period(F.col(f"`{c}`"), today).isNotNull())).alias(f"c{i}") for i, c in enumerate(columns)]
    seen = first.agg(*checks).first()
    return next((c for i, c in enumerate(columns) if seen[i]), None)


def measure_columns(df: DataFrame, columns: list[str], today: date) -> list[str]:
    """Columns that hold quantities in 95 of 100 filled cells of the first rows, at most 16."""
    head = df.where(F.col("pos") < SAMPLE_ROWS)
    shares = head.agg(*[F.avg(F.when(filled(c), is_quantity(F.col(f"`{c}`"), today).cast("int"))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if shares[i] is not None and shares[i] >= MEASURE_SHARE][:MAX_MEASURES]


def parse_matrix(df: DataFrame, today: date, window: tuple[str, str] | None = None, places: list[str] | None = None, limit: int = 1500) -> DataFrame:
    """A wide table of strings (with `pos`) as rows of labels, period, series and value.

    Rows outside the window (ISO dates) or without a readable period go; places filter only if the file has any of them.
    Latest periods, compared as text, come first; source rows are taken until `limit` result rows are reached.
    """
    df = unpivot_periods(df, today)
    columns = [c for c in df.columns if c != "pos"]
    when = period_column(df, columns, today)
    measures = measure_columns(df, [c for c in columns if c != when], today)
    labels = [c for c in columns if c != when and c not in measures]
    rows = df
    if when and window:
        rows = rows.where(overlaps(parse_period(F.col(f"`{when}`"), today), F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date")))
    if places and labels:
        wanted = [p.lower() for p in places]
        here = F.exists(F.array(*[F.lower(f"`{c}`") for c in labels]), lambda x: x.isin(wanted))
        if not df.where(here).isEmpty():
            rows = rows.where(here)
    order = ([F.desc(f"`{when}`")] if when else []) + [F.col("pos")]
    rows = rows.orderBy(*order).limit(limit)
    kept = [F.col(f"`{c}`") for c in ["pos", *labels, *([when] if when else [])]]
    long = rows.unpivot(kept, [F.col(f"`{c}`") for c in measures], "series", "value").where(filled("value"))
    return long.orderBy(*order).limit(limit)


def columns_for(cells: DataFrame, first: list[str] | None = None) -> list[str]:
    """Names of a dataset's columns from (pos, at, name): preferred ones, then by first appearance. A row a column."""
    seen = cells.groupBy("name").agg(F.min(F.struct("pos", "at")).alias("first")).orderBy("first").collect()
    names = [r["name"] for r in seen]
    preferred = [c for c in ["period", "series", *(first or [])] if c in names]
    return preferred + [c for c in names if c not in preferred]


def build_table(cells: DataFrame, columns: list[str]) -> DataFrame:
    """(pos, one column per name) from (pos, name, value); missing cells are empty, of repeated ones the largest stays."""
    return cells.groupBy("pos").pivot("name", columns).agg(F.max("value")).na.fill("", columns)


def stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: counts of rows, columns and repeated rows, share of filled cells, empty cells by column."""
    empty = [F.coalesce(F.sum((~filled(c)).cast("long")), F.lit(0)).alias(f"empty_{c}") for c in columns]
    found = df.agg(F.count("*").alias("row_count"), F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).alias("distinct_rows"), *empty)
    cells = F.greatest(F.lit(1), F.col("row_count") * max(1, len(columns)))
    return found.select(
        "row_count",
        F.lit(len(columns)).alias("column_count"),
        F.round(1 - sum((F.col(f"empty_{c}") for c in columns), F.lit(0)) / cells, 6).alias("fill_rate"),
        (F.col("row_count") - F.col("distinct_rows")).alias("duplicate_rows"),
        *[f"empty_{c}" for c in columns],
    )


def observed_schema(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, nullable, observed_type): number if every filled cell is digits with at most one dot, commas aside."""
    digits = lambda c: F.replace(F.col(c).cast("string"), F.lit(","), F.lit("")).rlike(r"^(?=.*[0-9])[0-9]*\.?[0-9]*$")
    one = df.agg(
        F.count("*").alias("n"),
        *[F.coalesce(F.max(~filled(c)), F.lit(False)).alias(f"e{i}") for i, c in enumerate(columns)],
        *[F.coalesce(F.min(F.when(filled(c), digits(c))), F.lit(True)).alias(f"d{i}") for i, c in enumerate(columns)],
    )
    fields = [F.struct(F.lit(c).alias("name"), F.col(f"e{i}").alias("nullable"), F.when(F.col(f"d{i}") & (F.col("n") > 0), "number").otherwise("string").alias("observed_type")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*fields)))


def blank_placeholders(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells whose value says "nothing here" and fills 60 of 100 rows of its column become null; three rows at least."""
    flat = df.select(*[F.regexp_replace(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), r"\s+", " ").alias(c) for c in columns])
    total = flat.count()
    if total < 3:
        return df
    cells = flat.unpivot([], columns, "name", "value").where((F.col("value") != "") & F.col("value").rlike(PLACEHOLDER) & (F.length("value") <= PLACEHOLDER_LENGTH))
    common = cells.groupBy("name", "value").count().where(F.col("count") >= PLACEHOLDER_SHARE * total).collect()  # one a column at most
    for r in common:
        same = F.regexp_replace(F.trim(F.col(r["name"]).cast("string")), r"\s+", " ") == r["value"]
        df = df.withColumn(r["name"], F.when(~same | F.col(r["name"]).isNull(), F.col(r["name"])))
    return df


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write a table as csv (with header), jsonl or parquet; Spark writes one file a partition."""
    writer = df.write.mode("errorifexists")
    {"csv": lambda: writer.option("header", True).csv(path), "jsonl": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()


def unique_headers(headers: DataFrame) -> DataFrame:
    """(table, place, name) with repeated names of a table numbered from _2 on, empty ones called label or column_n."""
    named = headers.withColumn("name", F.when(filled("name"), F.trim("name")).when(F.col("place") == 0, "label").otherwise(F.concat(F.lit("column_"), (F.col("place") + 1).cast("string"))))
    nth = F.row_number().over(Window.partitionBy("table", "name").orderBy("place"))
    return named.withColumn("_n", nth).withColumn("name", F.when(F.col("_n") > 1, F.concat_ws("_", "name", "_n")).otherwise(F.col("name"))).drop("_n")


# --- queries

TODAY = date(2026, 9, 30)


def _wide_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a file with a size per year across the top."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("brand"), *[F.when(F.col("p_size") % 5 != i, (F.col("p_size") + i).cast("string")).alias(str(2019 + i)) for i in range(4)])


def _window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    label = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string")))
    rows = o.select("o_orderkey", label.alias("label")).withColumn("p", parse_period(F.col("label"), TODAY))
    return rows.where(overlaps(F.col("p"), F.lit("1996-02-15").cast("date"), F.lit("1997-05-10").cast("date"))).select("o_orderkey", "label", F.col("p.label").alias("period"), F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"), F.col("p.granularity").alias("granularity"))


def _placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") <= 40, "Not  Applicable").otherwise(F.col("p_brand")).alias("note"), F.when(F.col("p_size") <= 40, "Fixed").otherwise("x").alias("other"))
    return blank_placeholders(p, ["note", "other"])


def _pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pos"), F.concat(F.lit("item_"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_linenumber").alias("at"), F.col("l_returnflag").alias("value"))
    return build_table(li, columns_for(li))


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]).select(F.col("l_orderkey").alias("table"), (F.col("l_linenumber") - 1).alias("place"), F.when(F.col("l_quantity") < 5, "").otherwise(F.col("l_returnflag")).alias("name"))
    return unique_headers(li)


_PART_COLUMNS = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
QUERIES = {
    "unpivot_measures": lambda s, d: unpivot_measures(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"]),
    "unpivot_periods": lambda s, d: unpivot_periods(_wide_parts(s, d), TODAY),
    "window_overlap_filter": _window_filter,
    "dataset_stats": lambda s, d: stats(table(s, d, "part").select(*_PART_COLUMNS).withColumn("p_brand", F.when(F.col("p_size") > 5, F.col("p_brand"))), _PART_COLUMNS),
    "observed_schema": lambda s, d: observed_schema(table(s, d, "part").withColumn("p_brand", F.when(F.col("p_size") > 5, F.col("p_brand"))), ["p_name", "p_brand", "p_size", "p_partkey"]),
    "placeholder_blanking": _placeholder,
    "pivoted_table": _pivot,
    "unique_headers": _headers,
    "dataset_page": lambda s, d: page(table(s, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], 50, 100),
}
ORACLE = {
    "unpivot_measures": "SELECT l_orderkey, l_linenumber, series, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME series VALUE value)",
    "unpivot_periods": """SELECT p_partkey AS pos, p_brand AS brand, CAST(2019 + i AS VARCHAR) AS period, CAST(p_size + i AS VARCHAR) AS value
FROM part, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE p_size % 5 <> i""",
    "window_overlap_filter": """WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS k, CAST(o_orderdate AS DATE) AS d FROM orders),
p AS (SELECT o_orderkey, CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m') ELSE 'Q' || quarter(d) || ' ' || year(d) END AS label,
  CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m') ELSE year(d) || '-Q' || quarter(d) END AS period,
  CAST(CASE k WHEN 0 THEN d WHEN 1 THEN date_trunc('month', d) ELSE date_trunc('quarter', d) END AS DATE) AS period_start,
  CAST(CASE k WHEN 0 THEN d WHEN 1 THEN last_day(d) ELSE date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY END AS DATE) AS period_end,
  CASE k WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'quarter' END AS granularity FROM o)
SELECT * FROM p WHERE period_start <= DATE '1997-05-10' AND period_end >= DATE '1996-02-15'""",
    "dataset_stats": """WITH p AS (SELECT p_name, CASE WHEN p_size > 5 THEN p_brand END AS p_brand, p_type, p_size, p_retailprice FROM part)
SELECT count(*) AS row_count, 5 AS column_count, round(1 - count(*) FILTER (p_brand IS NULL) / (count(*) * 5.0::DOUBLE), 6) AS fill_rate,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS duplicate_rows, CAST(0 AS BIGINT) AS empty_p_name,
  count(*) FILTER (p_brand IS NULL) AS empty_p_brand, CAST(0 AS BIGINT) AS empty_p_type, CAST(0 AS BIGINT) AS empty_p_size, CAST(0 AS BIGINT) AS empty_p_retailprice FROM p""",
    "observed_schema": """SELECT unnest(['p_name', 'p_brand', 'p_size', 'p_partkey']) AS name, unnest([false, (SELECT count(*) > 0 FROM part WHERE p_size <= 5), false, false]) AS nullable,
  unnest(['string', 'string', 'number', 'number']) AS observed_type""",
    "placeholder_blanking": """WITH p AS (SELECT p_partkey, CASE WHEN p_size <= 40 THEN 'Not  Applicable' ELSE p_brand END AS note, CASE WHEN p_size <= 40 THEN 'Fixed' ELSE 'x' END AS other FROM part)
SELECT p_partkey, CASE WHEN note = 'Not  Applicable' AND (SELECT count(*) FROM p WHERE note = 'Not  Applicable') >= 0.6 * (SELECT count(*) FROM p) THEN NULL ELSE note END AS note, other FROM p""",
    "pivoted_table": f"""SELECT l_orderkey AS pos, {", ".join(f"coalesce(max(l_returnflag) FILTER (l_linenumber = {i}), '') AS item_{i}" for i in range(1, 8))} FROM lineitem GROUP BY 1""",
    "unique_headers": """WITH h AS (SELECT l_orderkey AS "table", l_linenumber - 1 AS place, CASE WHEN l_quantity >= 5 THEN l_returnflag WHEN l_linenumber = 1 THEN 'label' ELSE 'column_' || l_linenumber END AS name FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem)),
n AS (SELECT *, row_number() OVER (PARTITION BY "table", name ORDER BY place) AS k FROM h)
SELECT "table", place, CASE WHEN k > 1 THEN name || '_' || k ELSE name END AS name FROM n""",
    "dataset_page": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100",
}
