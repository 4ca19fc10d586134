"""Chart-ready views of a dataset: its numeric parameters, and lines or bars of each.

Cells come long: (pos, period, series, name, value), `pos` being the row's place in the dataset, with `series` and
`period` empty where a row has none. Row attributes for grouping are cells themselves.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions.numbers import to_number, value_kind
from gleanspark.lineage import spool
from gleanspark.sources.tables import table

MAX_SERIES, MAX_BARS, NUMERIC_SHARE = 8, 30, 0.6
# Names that are no measure and no group.
RESERVED = ("period", "series", "statement", "text", "context", "url", "link", "href", "image")
IDENTIFIERS = r"(?i)(id|_id|code|_no)$|^no$|(^|[^a-z])(rank|ranking|serial|sr|sno|slno|position|pos|pin|pincode|zip|zipcode|postcode|phone|tel|fax|ref|reference)$"
CURRENCY = r"(?i)([$€£¥₹₩₽]|\b(?:usd|eur|gbp|inr|jpy|cny|rs\.?)\b)"


def chartable(name: str = "name") -> Column:
    return ~F.col(name).isin(*RESERVED) & ~F.col(name).rlike(IDENTIFIERS)


def unit_of(value: Column) -> Column:
    """The unit a cell is written in: percent, a currency mark, or the short word after its number; null without one."""
    currency = F.regexp_replace(F.upper(F.regexp_extract(value, CURRENCY, 1)), r"\.$", "")
    tail = F.lower(F.regexp_extract(value, r"-?\d[\d,]*(?:\.\d+)?\s*([A-Za-z]{1,8})(?: |$)", 1))
    return F.when(value.contains("%"), "%").otherwise(F.coalesce(F.nullif(currency, F.lit("")), F.nullif(tail, F.lit(""))))


def numeric_parameters(cells: DataFrame, today: date) -> DataFrame:
    """Columns that mostly hold quantities, with their unit, points and what a chart of them would show.

    Values repeat, so each distinct one of a column is typed once; periods and series are counted among their distinct pairs.
    """
    usable = cells.where(chartable() & (F.col("value") != ""))
    values = usable.groupBy("name", "value").agg(F.count("*").alias("n"))
    typed = values.select("name", "n", value_kind(F.col("value"), today).isin("money", "percent", "number").alias("quantity"), unit_of(F.col("value")).alias("unit"))
    by_unit = typed.groupBy("name", "unit").agg(F.sum("n").alias("filled"), F.sum(F.when(F.col("quantity"), F.col("n")).otherwise(0)).alias("n"))
    shown = F.col("unit").isNotNull() & (F.col("n") > 0)
    found = by_unit.groupBy("name").agg(F.sum("filled").alias("filled"), F.sum("n").alias("points"), F.max(F.when(shown, F.struct("n", "unit"))).alias("modal"))
    found = found.where((F.col("points") >= 2) & (F.col("points") >= NUMERIC_SHARE * F.col("filled")))
    pairs = usable.select("name", F.nullif("period", F.lit("")).alias("period"), "series").distinct()
    spans = pairs.groupBy("name").agg(F.count_distinct("period").alias("periods"), F.min("period").alias("period_min"), F.max("period").alias("period_max"), F.count_distinct("series").alias("series_count"))
    kind = F.when(F.col("periods") >= 2, "period").otherwise("category")
    unit = F.when(F.col("modal.n") * 2 >= F.col("points"), F.col("modal.unit")).otherwise("")
    return found.join(spans, "name").select("name", F.coalesce(unit, F.lit("")).alias("unit"), "points", kind.alias("x_kind"), "period_min", "period_max", "series_count")


def dimensions(cells: DataFrame, numeric: list[str]) -> DataFrame:
    """Text columns that can group rows: two or more distinct values."""
    text = cells.where(chartable() & (F.col("value") != "") & ~F.col("name").isin(*numeric))
    return text.groupBy("name").agg(F.count_distinct("value").alias("distinct_values")).where("distinct_values >= 2")


def group_column(rows: DataFrame, numeric: list[str], limit: int) -> str | None:
    """The dimension with the most distinct values, at most `limit`, among rows that have the parameter (see `parameter_rows`)."""
    found = dimensions(rows.select(F.inline("others")), numeric).where(F.col("distinct_values") <= limit)
    first = found.orderBy(F.desc("distinct_values"), "name").first()
    return first["name"] if first else None


def points(rows: DataFrame, key: list[str]) -> DataFrame:
    """The first row of each key, and how many others there were. Combined before the shuffle. A row stands for `n`, if it has that."""
    body = F.struct("pos", "number", "raw")
    n = F.sum("n") if "n" in rows.columns else F.count("*")
    return rows.groupBy(*key).agg(F.min_by(body, "pos").alias("first"), (n - 1).alias("duplicates")).select(*key, "first.*", "duplicates")


def line_points(rows: DataFrame, most: int = MAX_SERIES) -> DataFrame:
    """(series, period, number, raw, duplicates) of the `most` series with the most points, ties to the first seen.

    Rows: (pos, series, period, number, raw). Rows without a period or a number don't count.
    """
    one = points(rows.where("period <> '' AND number IS NOT NULL"), ["series", "period"])
    size = one.groupBy("series").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    kept = size.orderBy(F.desc("n"), "first_pos").limit(most)
    return one.join(kept.select("series"), "series", "left_semi").select("series", "period", "number", "raw", "duplicates")


def bar_points(rows: DataFrame, most: int = MAX_BARS) -> DataFrame:
    """(label, number, raw, duplicates) of the `most` largest bars, ties to the first seen. Rows: (pos, label, number, raw)."""
    one = points(rows.where("label <> '' AND number IS NOT NULL"), ["label"])
    return one.orderBy(F.desc("number"), "pos").limit(most).select("label", "number", "raw", "duplicates")


def parameter_rows(cells: DataFrame, parameter: str, numeric: list[str]) -> DataFrame:
    """(pos, period, series, raw, others) of each filled cell of a parameter: `others` are the (name, value) in its row that could
    group it. One shuffle brings the cells of a row together."""
    text, mine = chartable() & ~F.col("name").isin(*numeric), F.col("name") == parameter
    wanted = cells.where((F.col("value") != "") & (text | mine))
    rows = wanted.groupBy("pos").agg(
        F.collect_list(F.when(mine, F.struct("period", "series", F.col("value").alias("raw")))).alias("mine"),
        F.collect_list(F.when(text, F.struct("name", "value"))).alias("others"),
    )
    return rows.where(F.size("mine") > 0).select("pos", "others", F.inline("mine")).select("pos", "period", "series", "raw", "others")


def chart_of_rows(rows: DataFrame, parameter: str, numeric: list[str]) -> tuple[str, DataFrame]:
    """As `chart`, of rows (pos, period, series, raw, others) as `parameter_rows` makes them; no row is moved whole.

    Values repeat, so they are counted under each key and read as numbers once.
    """
    filled = rows.where(F.col("raw") != "")
    dated = filled.where("period <> ''").select("period", "raw").distinct()
    # Not a filter, which the optimizer would move below distinct(), to every row
    lines = dated.agg(F.count_distinct(F.when(to_number(F.col("raw")).isNotNull(), F.col("period")))).first()[0] >= 2
    group = group_column(filled, numeric, 3 * MAX_SERIES if lines else 10_000)
    own = F.transform(F.filter("others", lambda c: (c["name"] == group) & (c["value"] != "")), lambda c: c["value"]) if group else F.array(F.lit(None).cast("string"))
    each = (F.explode_outer if lines else F.explode)(own)
    label = "series" if lines else "label"
    key = F.coalesce("own", F.nullif("series", F.lit("")), F.lit(parameter)).alias(label)
    keys = [label, "period"] if lines else [label]
    keyed = filled.select("pos", "period", "series", "raw", each.alias("own")).select("pos", "period", "raw", key)
    # Read twice below, so kept: the rows behind it are read once
    counted = spool(keyed.groupBy(*keys, "raw").agg(F.min("pos").alias("pos"), F.count("*").alias("n")), "counted").withColumn("number", to_number(F.col("raw")))
    return ("line", line_points(counted)) if lines else ("bar", bar_points(counted))


def chart(cells: DataFrame, parameter: str, numeric: list[str]) -> tuple[str, DataFrame]:
    """("line" or "bar", its points) of one parameter."""
    return chart_of_rows(spool(parameter_rows(cells, parameter, numeric), "chart"), parameter, numeric)


# --- queries

TODAY = date(2026, 9, 30)


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    clerk = F.concat(F.lit("c"), (F.col("o_custkey") % 12).cast("string"))
    return o.select(F.col("o_orderkey").alias("pos"), clerk.alias("series"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_totalprice").alias("number"), F.col("o_orderpriority").alias("raw"))


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return bar_points(c.select(F.col("c_custkey").alias("pos"), F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("label"), F.col("c_acctbal").alias("number"), F.col("c_name").alias("raw")))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations in words: a price, a share, a brand-like group, a note that is mostly text."""
    li = table(spark, sf_dir, "lineitem")
    whole = F.col("l_quantity").cast("int").cast("string")
    return li.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pos"),
        F.lpad(F.year("l_shipdate").cast("string"), 4, "0").alias("period"),
        F.col("l_returnflag").alias("series"),
        F.concat(F.lit("$"), whole).alias("price"),
        F.concat((F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("share"),
        F.col("l_linestatus").alias("state"),
        F.when(F.col("l_quantity") > 40, whole).otherwise("about nothing at all").alias("note"),
        F.col("l_partkey").cast("string").alias("part_id"),
    )


NAMES = ("price", "share", "state", "note", "part_id")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).unpivot(["pos", "period", "series"], list(NAMES), "name", "value")


def _price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items already hold their cells side by side, so none is moved to meet another."""
    others = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in NAMES])
    rows = _items(spark, sf_dir).select("pos", "period", "series", F.col("price").alias("raw"), others.alias("others"))
    return chart_of_rows(rows, "price", ["price", "share"])[1]


QUERIES = {
    "numeric_parameters": lambda s, d: numeric_parameters(_cells(s, d), TODAY),
    "chart_dimensions": lambda s, d: dimensions(_cells(s, d), ["price", "share"]),
    "chart_line": lambda s, d: line_points(_order_rows(s, d)),
    "chart_bar": _bars,
    "chart_of_parameter": _price,
}
ORACLE = {
    "numeric_parameters": """WITH li AS (SELECT l_orderkey, strftime(l_shipdate, '%Y') AS period, l_returnflag AS series FROM lineitem)
SELECT unnest(['price', 'share']) AS name, unnest(['$', '%']) AS unit, unnest([n, n]) AS points, 'period' AS x_kind, unnest([a, a]) AS period_min, unnest([b, b]) AS period_max, unnest([k, k]) AS series_count
FROM (SELECT count(*) AS n, min(period) AS a, max(period) AS b, count(DISTINCT series) AS k FROM li)""",
    "chart_dimensions": """SELECT 'state' AS name, count(DISTINCT l_linestatus) AS distinct_values FROM lineitem
UNION ALL SELECT 'note', count(DISTINCT CAST(l_quantity AS INT)) FILTER (l_quantity > 40) + 1 FROM lineitem""",
    "chart_line": """WITH r AS (SELECT o_orderkey AS pos, 'c' || (o_custkey % 12) AS series, strftime(o_orderdate, '%Y-%m') AS period, o_totalprice AS number, o_orderpriority AS raw
  FROM orders),
p AS (SELECT *, count(*) OVER (PARTITION BY series, period) - 1 AS duplicates FROM r QUALIFY row_number() OVER (PARTITION BY series, period ORDER BY pos) = 1),
k AS (SELECT series FROM p GROUP BY series ORDER BY count(*) DESC, min(pos) LIMIT 8)
SELECT series, period, number, raw, duplicates FROM p WHERE series IN (SELECT series FROM k)""",
    "chart_of_parameter": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y') AS period, '$' || CAST(trunc(l_quantity) AS INT) AS raw, trunc(l_quantity) AS number,
  CASE WHEN l_quantity > 40 THEN CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR) ELSE 'about nothing at all' END AS series FROM lineitem),
p AS (SELECT *, count(*) OVER (PARTITION BY series, period) - 1 AS duplicates FROM r
  QUALIFY row_number() OVER (PARTITION BY series, period ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1),
k AS (SELECT series FROM p GROUP BY series ORDER BY count(*) DESC, min((l_orderkey, l_linenumber, l_partkey, l_suppkey)) LIMIT 8)
SELECT series, period, number, raw, duplicates FROM p WHERE series IN (SELECT series FROM k)""",
    "chart_bar": """WITH r AS (SELECT c_custkey AS pos, c_nationkey || '-' || c_mktsegment AS label, c_acctbal AS number, c_name AS raw FROM customer),
p AS (SELECT *, count(*) OVER (PARTITION BY label) - 1 AS duplicates FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY pos) = 1)
SELECT label, number, raw, duplicates FROM p ORDER BY number DESC, pos LIMIT 30""",
}
