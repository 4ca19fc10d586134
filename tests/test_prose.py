"""Quantities in sentences and the rows they make."""

from datetime import date

from pyspark.sql import functions as F

from gleanspark.operators import prose

TODAY = date(2026, 9, 30)
CASES = {
    "The toll stood at $41 in the year 2024 for vans.": [("$41", "level")],
    "Fares were down 6% to $57 in 2024.": [("6%", "change"), ("$57", "level")],
    "Boats under $9,000 are seldom on sale now.": [("$9,000", "bound")],
    "About 63 percent of timber goes to mills today.": [("63 percent", "share")],
    "The valley has 2,150 orchards and 7,300 likes.": [("2,150 orchards", "level")],
    "The herd was 4.5 million strong there.": [("4.5 million", "level")],
    "It cost $700 less than before.": [("$700", "change")],
    "Nothing happened in 2024 at all.": [],
    "There were 4800 hospitals and 12,400 views there.": [("4800 hospitals", "level")],
    "The budget was 1,280 was agreed upon.": [],
    "By 2024 orchards and 950 barns were left.": [],
}


def test_roles_of_quantities(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(CASES)], "i int, s string").orderBy("i")
    got = [[tuple(q) for q in r[0]] for r in rows.select(prose.quantities(F.col("s"))).collect()]
    assert got == list(CASES.values())


def test_of_several_years_the_one_near_the_value_counts(spark):
    cases = {
        "The price in 2019 was low but by 2024 it stood at $41": ("$41", "2024"),
        "In 2019 it was cheap and in 2023 the fare was $9": ("$9", "2023"),
        "It was $7 in 2018, and 2021 was dear": ("$7", "2018"),
        "Between 2018 and 2021 it stood at $5": ("$5", "2021"),
    }
    rows = spark.createDataFrame([(i, s, v) for i, (s, (v, _)) in enumerate(cases.items())], "i int, s string, v string").orderBy("i")
    got = [r[0] for r in rows.select(prose.period_of(F.col("s"), F.col("v"), F.array(F.lit("a"), F.lit("b")))).collect()]
    assert got == [p for _, p in cases.values()]


def test_statements_of_paragraphs(spark):
    text = "In 2023 the ferry fare reached $57 per trip. Fares fell 6% during 2024, from $61 in 2022! The island has 4.5 million sheep grazing there. Under $9,000 nobody finds one any more."
    rows = spark.createDataFrame([(1, 0, text), (1, 1, text), (2, 0, "too short $5")], "page_id long, pos int, text string")
    got = [(r.method, r.value, r.change, r.period) for r in prose.statements(rows, TODAY).orderBy("place").collect()]
    assert got == [("text_statement", "$57", None, "2023"), ("text_statement", "$61", "6%", "2022"), ("undated_statement", "4.5 million", None, None)]
    assert prose.statements(rows.limit(0), TODAY).count() == 0
