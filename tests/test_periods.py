"""Periods of rows, basis by basis."""

from datetime import date

from gleanspark.operators.periods import resolve_periods

TODAY = date(2026, 9, 30)
KINDS = "i int, fields array<struct<name:string,value:string>>, measure string, context string, context_kind string, title string, coverage string, modified_at date, published_at date, fetched_at date"
NONE = (None, "none", False, 0.0)
COST = ("cost", "$5")
CASES = [
    (([("Year", "2019"), ("Month", "March"), COST], "cost"), ("2019-03", "row_field", False, 0.95)),
    (([("Year", "2019"), COST], "cost", None, None, "Costs of 2024"), ("2019", "row_field", False, 0.95)),
    (([("note", "as of 2021"), COST], "cost"), ("2021", "row_value", False, 0.8)),
    (([("note", "from 2021, again in 2023"), COST], "cost 2020", None, None, "Costs of 2024"), NONE),
    (([COST], "cost 2020"), ("2020", "column_header", False, 0.85)),
    (([COST], "cost", "Costs in 2018", "caption"), ("2018", "table_header", False, 0.8)),
    (([COST], "cost", "Costs in 2018", "heading"), ("2018", "context", True, 0.6)),
    (([COST], "cost", None, None, "Costs of 2024"), ("2024", "page_context", True, 0.5)),
    (([COST], "cost", None, None, "Costs of 2022 and 2024", None, date(2026, 1, 1)), NONE),
    (([COST], "cost", None, None, "Costs", "2017"), ("2017", "page_metadata", True, 0.55)),
    (([COST], "cost", None, None, None, None, date(2023, 5, 1), date(2020, 5, 1)), ("2023", "modified_at", True, 0.25)),
    (([("updated date", "2023-05-01"), COST], None, None, None, "Costs of 2024"), ("2023-05-01", "row_value", False, 0.8)),
    (([COST], None, None, None, "Costs of 2024"), NONE),
    ((None, None), NONE),
]


def test_periods_of_rows(spark):
    rows = [(i, *row, *[None] * (9 - len(row))) for i, (row, _) in enumerate(CASES)]
    got = resolve_periods(spark.createDataFrame(rows, KINDS), TODAY).orderBy("i").select("period", "basis", "inferred", "confidence")
    assert [tuple(r) for r in got.collect()] == [want for _, want in CASES]
