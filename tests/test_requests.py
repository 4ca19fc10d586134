"""What requests ask for, what grounds a suggestion, and what registry entries a text names."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import mentions, requests

TODAY = date(2026, 9, 30)
TEXTS = {
    1: "EV car prices over the last 10 years",
    2: "gazette notices from eGazette on fishing",
    3: "number of hospitals by state",
    4: "Agricultural yeild in last 5 years",
    5: "Compare revenue, population, output and rainfall share of Norway since 2019",
    6: "",
    7: None,
    8: "list of AI conferences https://x.org/prices 2026",
}


@pytest.fixture(scope="module")
def told(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "request_id long, text string")
    return {r.request_id: r for r in requests.requirements(df, TODAY, ["Norway"]).collect()}


def test_subjects_measures_and_windows(told):
    one = told[1]
    assert (one.subject, one.required, one.shape) == (["ev", "car", "ev car"], ["price"], "quantities") and (one.start, one.end) == (date(2017, 1, 1), date(2026, 12, 31)) and one.entities == ["EV"]
    assert one.heads == [] and one.queries[:2] == [TEXTS[1], "EV car prices 2017-2026 data table"]
    five = told[5]
    assert five.required == ["revenue", "population", "production"] and five.optional == ["rate"] and five.subject == ["rainfall", "norway"] and five.heads == ["rainfall"]


def test_spelling_and_records(told):
    assert told[4].required == ["yield"] and told[4].corrected == "Agricultural yield in last 5 years" and told[4].aliases["yield"] == ["yeild"]
    two = told[2]
    assert two.shape == "either" and two.mentions[:1] == ["egazette"] and two.required == [] and two.queries[:2] == [TEXTS[2], "egazette official website"]
    assert two.heads[:2] == ["gazette", "notice"]


def test_numbers_without_a_measure_and_empty_requests(told):
    assert told[3].required == ["value"] and told[3].heads == ["hospital"] and told[3].optional == ["geography"]
    assert told[6].shape == told[7].shape == "either" and told[6].subject == [] and told[7].queries == []
    assert "price" not in told[8].required and told[8].start == date(2026, 1, 1)


def test_suggestions_need_the_users_words(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "request_id long, text string")
    rows = [(1, "price", []), (1, "battery capacity", ["pack size"]), (1, "vehicle fee", []), (1, "automobiles", ["cars"]), (3, "hospital beds", []), (3, "hospitals", None), (7, "price", [])]
    got = {(r.request_id, r.name): r.grounded for r in requests.grounded(spark.createDataFrame(rows, "request_id long, name string, aliases array<string>"), df, TODAY).collect()}
    assert got == {(1, "price"): True, (1, "battery capacity"): False, (1, "vehicle fee"): True, (1, "automobiles"): True, (3, "hospital beds"): False, (3, "hospitals"): True, (7, "price"): False}


def test_years_of_a_query_follow_the_window(spark):
    df = spark.createDataFrame([("ev prices 2010-2020", "last 10 years"), ("ev prices 2010 to 2011", "last 3 months"), ("ev prices", "last 10 years")], "q string, w string")
    got = [r.a for r in df.select(requests.aligned_years(F.col("q"), requests.windows(F.col("w"), TODAY)).alias("a")).collect()]
    assert got == ["ev prices 2017-2026", "ev prices 2010 to 2011", "ev prices"]


def test_aliases_in_any_spelling_the_longest_first(spark):
    registry = spark.createDataFrame([("a", "Our World"), ("b", "Our World in Data"), ("c", "eExample"), ("d", "abc"), ("b", "our-world-in-data"), ("e", None)], "entry string, alias string")
    texts = {1: "from OurWorld in DATA, please", 2: "see our world.", 3: "the e-example and E example", 4: "abc", 5: None, 6: "our world and our world in data"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = sorted((r.id, r.entry) for r in mentions.alias_mentions(df, registry, "id").collect())
    assert got == [(1, "b"), (2, "a"), (3, "c"), (6, "a"), (6, "b")]


def test_aliases_are_those_of_trying_each(spark):
    import random
    import re

    rng = random.Random(5)
    words = ["ab", "cd", "ef", "gh"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    aliases = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(30)})
    expected = set()
    for i, t in texts:
        w = t.split()
        met = [(a, k, len(a.split())) for a in aliases if len(re.sub(" ", "", a)) >= 4 for k in range(len(w)) if w[k : k + len(a.split())] == a.split()]
        expected |= {(i, a) for a, k, n in met if not any(m > n and j <= k and j + m >= k + n for _, j, m in met)}
    registry = spark.createDataFrame([(a, a) for a in aliases], "entry string, alias string")
    got = {(r.id, r.entry) for r in mentions.alias_mentions(spark.createDataFrame(texts, "id long, text string"), registry, "id").collect()}
    assert got == expected


def _generated(node):
    """Rows that the generators of an executed plan gave out."""
    name = node.nodeName()
    below = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
    return sum(map(_generated, below)) + (node.metrics().apply("numOutputRows").value() if name == "Generate" else 0)


def test_only_places_where_an_alias_may_begin_become_runs(spark):
    words = ["ferry", "toll", "K\u212am", "v.a.t", "\u0130sland"] * 400
    text = " ".join([*words, "Our", "WORLD.", "in..", "data", *words])
    registry = spark.createDataFrame([("a", "Our World in Data"), ("b", "our world"), ("c", "harbour")], "entry string, alias string")
    df = mentions.alias_mentions(spark.createDataFrame([(1, text), (1, text), (None, text)], "id long, text string"), registry, "id")
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "a", "Our World in Data", 2400, 4), (None, "a", "Our World in Data", 2400, 4)]
    assert _generated(df._jdf.queryExecution().executedPlan()) <= 3 * (4804 + 6)


def test_sites_by_their_hosts(spark):
    sites = spark.createDataFrame([("a", "data.gov.in"), ("b", "Example.org")], "entry string, domain string")
    texts = {1: "use https://www.data.gov.in/x please", 2: "from api.example.org, or so", 3: "gov.in", 4: "notexample.org", 5: None}
    got = sorted((r.id, r.entry) for r in mentions.site_mentions(spark.createDataFrame(list(texts.items()), "id long, text string"), sites, "id").collect())
    assert got == [(1, "a"), (2, "b"), (3, "a")]
