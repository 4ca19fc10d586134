"""Registers of files, sources and answers on small fixtures."""

from datetime import datetime

from pyspark.sql import functions as F

from gleanspark.operators import registers

NOW = datetime(2026, 9, 30)


def test_new_files_are_limited_and_known_ones_refreshed(spark):
    known = spark.createDataFrame([("a", 0.1, "parsed"), ("b", 0.2, "failed")], "file_id string, relevance double, status string")
    found = spark.createDataFrame([("a", 0.9), ("c", 0.5), ("c", 0.7), ("d", 0.6), ("e", 0.1)], "file_id string, relevance double")
    got = {tuple(r) for r in registers.register_files(found, known, 2).collect()}
    assert got == {("a", 0.9, "parsed"), ("b", 0.2, "failed"), ("c", 0.7, "found"), ("d", 0.6, "found")}


def test_relevance_of_files(spark):
    terms = F.array(F.lit("wheat"), F.lit("price"))
    rows = spark.createDataFrame([("wheat_prices.csv", "Page", True), ("other.zip", "Wheat", False)], "name string, page string, ok boolean")
    got = [r[0] for r in rows.select(registers.file_relevance(F.col("name"), F.col("page"), terms, F.col("ok"))).collect()]
    assert got == [0.85, 0.075]


def test_links_need_a_term_or_to_be_primary(spark):
    links = spark.createDataFrame([(1, "Wheat prices by year", False), (2, "Wheat price", False), (3, "About", True), (4, "About", False)], "link_id int, title string, is_primary boolean")
    assert [r.link_id for r in registers.rank_links(links, ["wheat", "price"], 3).collect()] == [2, 1, 3]


def test_topic_of_groups_and_results(spark):
    rows = spark.createDataFrame([("a", "navigational chart"), ("a", "x"), ("a", "y"), ("a", "z"), ("b", "x"), ("b", None)], "g string, t string")
    got = {r.g: (r.share, r.on_topic) for r in registers.on_topic(rows, "g", "t", ["navigation"]).collect()}
    assert got == {"a": (0.25, True), "b": (0.0, False)}
    assert all(r.on_topic for r in registers.on_topic(rows, "g", "t", []).collect())
    results = spark.createDataFrame([("q", "wheat", 1), ("q", "x", 2), ("p", "x", 3)], "q string, t string, n int")
    assert [r.n for r in registers.useful_results(results, "q", "t", ["wheat"]).collect()] == [1]


def test_scopes_and_cached_answers(spark):
    stored = spark.createDataFrame([("mine", "old.org", 0), ("other", "kept.org", 0)], "scope string, domain string, pos int")
    new = spark.createDataFrame([("b.org", 0), ("a.org", 1), ("b.org", 2)], "domain string, pos int")
    assert {tuple(r) for r in registers.replace_scope(stored, "mine", new).collect()} == {("other", "kept.org", 0), ("mine", "b.org", 0), ("mine", "a.org", 1)}
    answers = spark.createDataFrame([("old", datetime(2026, 9, 29)), ("new", datetime(2026, 9, 29, 23, 30))], "k string, created_at timestamp_ntz")
    assert [r.k for r in registers.cached(answers, NOW, 60).collect()] == ["new"] and registers.cached(answers, NOW, None).count() == 2


def test_learned_structures_expire(spark):
    rows = [("ok", "r", datetime(2026, 9, 20), 0), ("old", "r", datetime(2026, 9, 1), 0), ("failed", None, datetime(2026, 9, 28), 0), ("fresh failure", None, datetime(2026, 9, 29, 12), 1), ("broken", "r", datetime(2026, 9, 29), 2)]
    entries = spark.createDataFrame(rows, "host string, recipe string, learned_at timestamp_ntz, failures int")
    assert {r.host for r in registers.learned(entries, NOW).collect()} == {"ok", "fresh failure"}


def test_moments(spark):
    cases = {"2026-01-02": "2026-01-02 00:00", "2026-01-02T03:04:05Z": "2026-01-02 03:04", "Tue, 06 Jan 2026 07:08:09 GMT": "2026-01-06 07:08", "5 March 2024": "2024-03-05 00:00", "March 5th, 2024": "2024-03-05 00:00", "soon": None, None: None}
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, v string")
    got = rows.orderBy("i").select(F.date_format(registers.parse_datetime(F.col("v")), "yyyy-MM-dd HH:mm")).collect()
    assert [r[0] for r in got] == list(cases.values())
