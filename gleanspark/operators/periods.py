"""The period that a row speaks of, from its cells, its surroundings or, failing those, the dates of its page."""

from __future__ import annotations

from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions.temporal import FIRST_YEAR, MONTH_NAMES, YEARS_AHEAD, let, may_mention, parse_period, period_mentions
from gleanspark.sources.tables import table

TIME_NAME = r"(?i)(^|[^a-z])(year|date|period|time|day|month|quarter)s?($|[^a-z])"
PAGE_TIME_NAME = r"(?i)(^|[^a-z])(updated|modified|published|created)($|[^a-z])"
LINK_NAME = r"(?i)^(url|link|href|image)$"
FIRST_HEADER_YEAR = 1800
RANGE = r"^\d{4}\D+\d{4}$"
# How far each basis is trusted; a page's date loses a tenth for each year of age after the first.
TRUST = {"field": 0.95, "field_range": 0.85, "within_field": 0.85, "row_value": 0.8, "column_header": 0.85, "table_header": 0.8, "context": 0.6, "page_context": 0.5, "page_metadata": 0.55}
PAGE_DATES = {"modified_at": 0.45, "published_at": 0.4, "fetched_at": 0.25}
LEAST_TRUST, LOSS = 0.1, 0.1


def mentions(texts: Column, today: date) -> Column:
    """For each text of an array the labels of the periods it mentions. Only texts that may hold a year among others reach Python."""

    @F.arrow_udf("array<array<string>>")
    def of(rows: pa.Array) -> pa.Array:
        return pa.array([r and [period_mentions(t, today) for t in r] for r in rows.to_pylist()], pa.list_(pa.list_(pa.string())))

    alone = lambda t: F.coalesce(t.rlike(r"^[0-9]{4}\z"), F.lit(False))
    year = lambda t: F.when(t.between(str(FIRST_YEAR), str(min(2099, today.year + YEARS_AHEAD))), F.array(t)).otherwise(F.array().cast("array<string>"))
    asked = F.transform(texts, lambda t: F.when(~alone(t) & may_mention(t, today), t))
    found = of(F.when(F.exists(asked, lambda t: t.isNotNull()), asked))
    return F.zip_with(texts, F.coalesce(found, F.array().cast("array<array<string>>")), lambda t, f: F.when(alone(t), year(t)).otherwise(F.coalesce(f, F.array().cast("array<string>"))))


def _found(label: Column, basis: str | Column, inferred: bool, trust: float | Column) -> Column:
    """A resolution, or null where there is no label."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return let(label, lambda x: F.when(x.isNotNull(), F.struct(x.alias("period"), lit(basis).alias("basis"), F.lit(inferred).alias("inferred"), lit(trust).cast("double").alias("confidence"))))


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _only(labels: Column) -> Column:
    """The one label of a list; null if it has none or several."""
    return F.when(F.size(labels) == 1, _first(labels))


def year_and_month(fields: Column) -> Column:
    """yyyy-mm of a row with a column for the year and one for the month, which holds a name or a number."""
    value = lambda name, pattern: _first(F.filter(fields, lambda f: f["name"].rlike(rf"(?i)(^|[^a-z]){name}($|[^a-z])") & F.trim(f["value"]).rlike(pattern)))["value"]
    year, month = F.trim(value("year", r"^(19|20)\d\d$")), F.lower(F.trim(value("month", rf"(?i)^(0?[1-9]|1[0-2]|({'|'.join(m[:3] for m in MONTH_NAMES)})[a-z]*\.?)$")))
    number = F.coalesce(month.try_cast("int"), F.array_position(F.array(*[F.lit(m[:3]) for m in MONTH_NAMES]), F.substring(month, 1, 3)).cast("int"))
    return F.concat(year, F.lit("-"), F.lpad(number.cast("string"), 2, "0"))


def header_year(header: Column, today: date) -> Column:
    """The year in a column's name, if it holds just one from 1800 to the next."""
    years = F.array_distinct(F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), F.lit(1)))
    return _only(F.filter(years, lambda y: y.cast("int").between(FIRST_HEADER_YEAR, today.year + 1)))


def resolve_periods(rows: DataFrame, today: date) -> DataFrame:
    """`rows` with period, basis, inferred and confidence; null, 'none', false and 0 where nothing tells.

    Rows have fields (array of name and value), measure (name of the measured column, null if none), context,
    context_kind ('caption' or another), title, coverage, modified_at, published_at and fetched_at (timestamps or dates).
    What the row says goes before its header, that before its surroundings, and those before the dates of the page; a
    row or a page that names several periods has none. Nothing is shuffled, and the search for mentions is one pass.
    """
    cells = F.coalesce("fields", F.array().cast("array<struct<name:string,value:string>>"))
    is_time = lambda f: F.coalesce(f["name"].rlike(TIME_NAME) & ~f["name"].rlike(PAGE_TIME_NAME), F.lit(False))
    times = F.transform(F.filter(cells, is_time), lambda f: f["value"])
    others = F.filter(cells, lambda f: ~is_time(f) & ~F.coalesce(f["name"].rlike(LINK_NAME), F.lit(False)))
    texts = F.concat(F.array(F.array_join(F.transform(others, lambda f: f["value"]), " ¦ "), "context", "title", "coverage"), times)
    seen = rows.withColumn("_seen", mentions(texts, today))
    labels = lambda i: F.coalesce(F.try_element_at("_seen", F.lit(i)), F.array().cast("array<string>"))
    in_row, around, title, covered = map(labels, (1, 2, 3, 4))
    parsed = _first(F.filter(F.transform(times, lambda v: parse_period(v, today)), lambda p: p.isNotNull()))
    within = _first(F.filter(F.transform(F.slice("_seen", F.lit(5), F.greatest(F.size("_seen") - 4, F.lit(0))), _only), lambda x: x.isNotNull()))
    one = F.size(in_row) <= 1
    single = lambda found: F.when(~_only(found).rlike(RANGE), _only(found))
    caption = F.coalesce(F.col("context_kind") == "caption", F.lit(False))
    of_page = [
        _found(F.year(at).cast("string"), at, True, F.round(F.greatest(F.lit(LEAST_TRUST), trust - LOSS * F.greatest(today.year - F.year(at) - 1, F.lit(0))), 2)) for at, trust in PAGE_DATES.items()
    ]
    best = F.coalesce(
        _found(year_and_month(cells), "row_field", False, TRUST["field"]),
        let(parsed, lambda p: _found(p["label"], "row_field", False, F.when(p["granularity"] == "range", TRUST["field_range"]).otherwise(TRUST["field"]))),
        _found(within, "row_field", False, TRUST["within_field"]),
        _found(_only(in_row), "row_value", False, TRUST["row_value"]),
        F.when(one, _found(header_year(F.col("measure"), today), "column_header", False, TRUST["column_header"])),
        F.when(one & caption, _found(single(around), "table_header", False, TRUST["table_header"])),
        F.when(one & ~caption, _found(single(around), "context", True, TRUST["context"])),
        F.when(one & F.col("measure").isNotNull(), _found(single(title), "page_context", True, TRUST["page_context"])),
        F.when(
            one & F.col("measure").isNotNull() & (F.size(title) == 0),
            F.coalesce(_found(F.coalesce(parse_period(F.col("coverage"), today)["label"], _only(covered)), "page_metadata", True, TRUST["page_metadata"]), *of_page),
        ),
    )
    nothing = F.struct(F.lit(None).cast("string").alias("period"), F.lit("none").alias("basis"), F.lit(False).alias("inferred"), F.lit(0.0).alias("confidence"))
    # Unpacked by a generator, else each of the four columns would resolve the period again
    return seen.select(*[F.col(f"`{c}`") for c in rows.columns], F.inline(F.array(F.coalesce(best, nothing))))


# --- queries


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of every event; some have a date cell, some a dated header, the rest only the day they were read."""
    none = F.lit(None).cast("string")
    cell = F.struct(F.lit("day").alias("name"), F.date_format("ts", "yyyy-MM-dd").alias("value"))
    value = F.struct(F.lit("value").alias("name"), F.format_string("%.2f kg", "value").alias("value"))
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "click", F.array(cell, value)).otherwise(F.array(value)).alias("fields"),
        F.when(F.col("event_type") == "view", F.lit("weight 2011")).when(F.col("event_type") != "error", F.lit("weight")).alias("measure"),
        none.alias("context"), none.alias("context_kind"), none.alias("title"), none.alias("coverage"),
        none.cast("date").alias("modified_at"), none.cast("date").alias("published_at"), F.col("ts").alias("fetched_at"),
    )
    return resolve_periods(rows, date(2026, 9, 30)).select("event_id", "period", "basis", "inferred", "confidence")


QUERIES = {"observation_periods": _events}
ORACLE = {
    "observation_periods": """SELECT event_id,
  CASE event_type WHEN 'click' THEN strftime(ts, '%Y-%m-%d') WHEN 'view' THEN '2011' WHEN 'error' THEN NULL ELSE CAST(year(ts) AS VARCHAR) END AS period,
  CASE event_type WHEN 'click' THEN 'row_field' WHEN 'view' THEN 'column_header' WHEN 'error' THEN 'none' ELSE 'fetched_at' END AS basis,
  event_type NOT IN ('click', 'view', 'error') AS inferred,
  CAST(CASE event_type WHEN 'click' THEN 0.95 WHEN 'view' THEN 0.85 WHEN 'error' THEN 0 ELSE round(greatest(0.1, 0.25 - 0.1 * greatest(2026 - year(ts) - 1, 0)), 2) END AS DOUBLE) AS confidence
FROM events"""
}
