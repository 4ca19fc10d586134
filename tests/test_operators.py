"""Operators on small fixtures: pages, wide files, blocks, charts, streams."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import blocks, charts, merge, ranking, tables
from gleanspark.sources import html
from gleanspark.streaming import live

TODAY = date(2026, 9, 30)

TABLE_PAGE = """<html><head><title>Packs</title><meta property="article:published_time" content="2026-01-02"></head><body>
<nav><table><tr><td>menu</td><td>x</td></tr></table><ul><li><a href="/a">A b c</a></li></ul></nav><h1>Pack <b>prices</b></h1>
<table><thead><tr><th>Year</th><th colspan="2">Average Price</th></tr></thead>
<tr><td>2019</td><td>$5</td><td><a href="/f.pdf">Download</a></td></tr><tr><td>2024</td><td>$7</td><td><a href="/g">Note on it</a></td></tr></table>
<table><tr><td>k</td><td colspan="2">v</td><td>w</td></tr></table></body></html>"""
LIST_PAGE = """<body><ul>""" + "".join(f'<li><a href="/n{i}">Notice number {i} issued</a> <span>2024</span></li>' for i in range(4)) + """</ul>
<ul><li><a href="/x">View</a></li><li>b</li><li>c</li></ul>
<div class="event-card"><h3>Fair one</h3><p class="date">2026-03-01</p></div><div class="event-card"><h3>Fair two</h3><p class="date">2026-04-01</p></div>
<div class="result-lone"><h3>Alone</h3><p>x</p></div>
<script type="application/ld+json">{"@type": "ItemList", "itemListElement": [{"item": {"@type": "Product", "name": "P", "offers": {"price": 5}}}, {"name": "only"}]}</script>
<script type="application/ld+json">{"@type": "Event", "name": "E"}</script><script type="application/ld+json">{broken</script></body>"""


@pytest.fixture(scope="module")
def e(spark):
    pages = spark.createDataFrame([(1, TABLE_PAGE), (2, LIST_PAGE), (3, None), (4, "<p>unclosed <b>text<br>"), (5, "")], "page_id long, html string")
    return html.elements(pages).cache()


def test_tables_outside_chrome(e):
    got = {}
    for r in html.table_records(e).collect():
        got.setdefault((r.block_id, r.tr), {})[r["name"]] = r.value
    rows = [got[k] for k in sorted(got)]
    assert rows == [{"year": "2019", "average_price": "$5", "average_price_2": "/f.pdf"}, {"year": "2024", "average_price": "$7", "average_price_2": "Note on it", "average_price_2_url": "/g"}, {"column_1": "k", "column_2": "v", "column_4": "w"}]


def test_provenance_and_links(e):
    p = {r.page_id: r for r in html.provenance(e).collect()}
    assert (p[1].title, p[1].heading, p[1].published) == ("Packs", "Pack prices", "2026-01-02")
    found = {(r.href, r.chrome, r.file_type) for r in html.links(e).where("page_id = 1").collect()}
    assert ("/a", True, "") in found and ("/g", False, "") in found


def test_lists_cards_and_json(e):
    assert [r.title for r in html.list_records(e).orderBy("n").collect()] == [f"Notice number {i} issued" for i in range(4)]
    cards = {}
    for r in html.card_records(e).collect():
        cards.setdefault(r.card, {})[r["name"]] = r.value
    assert sorted(c["name"] for c in cards.values()) == ["Fair one", "Fair two"] and {c["date"] for c in cards.values()} == {"2026-03-01", "2026-04-01"}
    found = {}
    for r in html.json_records(e).collect():
        found.setdefault((r.n, r.item), {})[r["name"]] = r.value
    assert sorted(sorted(x.items()) for x in found.values()) == [[("name", "E"), ("type", "Event")], [("name", "P"), ("offers_price", "5"), ("type", "Product")]]


def test_wide_files(spark):
    df = spark.createDataFrame([(0, "India", "IND", "2019", "5", "$7"), (1, "India", "IND", "2024", "", "$8"), (2, "Peru", "PER", "2024", "6", ""), (3, "Peru", "PER", "2010", "1", "$1")], "pos int, Entity string, Code string, Year string, wheat string, price string")
    rows = tables.parse_matrix(df, TODAY, window=("2017-01-01", "2026-12-31"), places=["india", "nowhere"])
    assert [(r.Year, r.series, r.value) for r in rows.collect()][0] == ("2024", "price", "$8")
    assert sorted((r.Year, r.series, r.value) for r in rows.collect()) == [("2019", "price", "$7"), ("2019", "wheat", "5"), ("2024", "price", "$8")]
    assert tables.parse_matrix(df, TODAY, places=["nowhere"]).count() == 6
    long = spark.createDataFrame([(0, "a", "1", "2", "")], "pos int, item string, `1/2024` string, `2/2024` string, `3/2024` string")
    assert [(r.item, r.period, r.value) for r in tables.unpivot_periods(long, TODAY).collect()] == [("a", "1/2024", "1"), ("a", "2/2024", "2")]


def test_stats_of_nothing(spark):
    none = spark.createDataFrame([], "a string, b string")
    row = tables.stats(none, ["a", "b"]).first()
    assert (row.row_count, row.fill_rate, row.duplicate_rows) == (0, 1.0, 0)
    assert {(r["name"], r.nullable, r.observed_type) for r in tables.observed_schema(none, ["a"]).collect()} == {("a", False, "string")}
    empty = spark.createDataFrame([("",)], "a string")
    assert tables.observed_schema(empty, ["a"]).first().observed_type == "number"


def test_overlap_goes_to_the_stronger_block(spark):
    def block(name, coverage, values, first):
        return [(first + i, "u", "s", name, coverage, coverage, "number", False, "accepted", "2024", f"x{i}", float(v)) for i, v in enumerate(values)]

    rows = block("strong", 0.9, [1, 2, 3], 0) + block("same", 0.8, [1, 2, 9], 10) + block("other", 0.7, [1, 8, 7], 20) + block("copy of other", 0.6, [4, 8, 7], 30)
    df = spark.createDataFrame(rows, "pos long, source_url string, site string, block_id string, coverage double, relevance double, kind string, is_record boolean, status string, period string, series string, number double")
    got = {r.pos for r in blocks.overlap_suppression(df).where("status = 'partial'").collect()}
    assert got == {10, 11, 31, 32}
    support = {r.block_id: r.support for r in blocks.block_support(df).collect()}
    assert support["strong"] == round((0.9 + 0.9 + 1) / 3, 3)


def test_overlap_needs_no_whole_site_in_one_task(spark):
    rng = random.Random(4)
    rows = []
    for at in range(600):
        site, block = rng.choice(["s", "t", None]), f"b{rng.randrange(6)}"
        rows.append((at, f"u{site}", site, block, int(block[1]) / 8, 0.5, "number", False, rng.choice(["accepted", "rejected"]), "2024", f"x{rng.randrange(2)}", float(rng.randrange(int(block[1]) * 9 + 4))))
    df = spark.createDataFrame(rows, "pos long, source_url string, site string, block_id string, coverage double, relevance double, kind string, is_record boolean, status string, period string, series string, number double")
    support = {(r.source_url, r.block_id): (-r.support, r.first_pos) for r in blocks.block_support(df).collect()}
    held, lost = {}, set()
    for source, block in sorted(support, key=support.get):
        last = {(r[10], r[11]): r[0] for r in rows if (r[1], r[3], r[8]) == (source, block, "accepted")}
        seen = held.setdefault(source, set())
        repeated = [v for v in last if v in seen]
        if seen and last and len(repeated) / len(last) >= blocks.OVERLAP:
            lost |= {last[v] for v in repeated}
        seen |= set(last)
    found = blocks.overlap_suppression(df)
    assert lost and {r.pos for r in found.where("status = 'partial'").collect()} == lost
    assert "Pandas" not in found._jdf.queryExecution().toString()


def test_rows_of_blocks_are_read_once_for_their_support_and_once_for_themselves(spark, sf_dir):
    for name in ("overlap_suppression", "block_support_and_overlap"):
        plan = blocks.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [l_orderkey") <= 2, name


def test_rows_without_a_source_or_block_neither_repeat_nor_are_repeated(spark):
    one = ("s", 0.5, 0.5, "number", True, "accepted", "2024", "x", 1.0)
    rows = [(i, u, b, *one) for i, (u, b) in enumerate([("u", "a"), ("u", "b"), (None, "a"), ("u", None), ("u", "")])]
    df = spark.createDataFrame(rows, "pos int, source_url string, block_id string, site string, coverage double, relevance double, kind string, is_record boolean, status string, period string, series string, number double")
    for suppress in (blocks.overlap_suppression, blocks.apply_block_support):
        assert {r.pos: r.status for r in suppress(df).collect()} == {0: "accepted", 1: "partial", 2: "accepted", 3: "accepted", 4: "accepted"}


def test_charts(spark):
    cells = [(0, "2024", "", "price", "$5"), (0, "2024", "", "city", "A"), (1, "2025", "", "price", "$6"), (1, "2025", "", "city", "A"), (2, "2024", "", "price", "$9"), (2, "2024", "", "city", "B"), (3, "2024", "", "price", "$1"), (3, "2024", "", "city", "A")]
    df = spark.createDataFrame(cells, "pos int, period string, series string, name string, value string")
    kind, points = charts.chart(df, "price", ["price"])
    assert kind == "line"
    assert {(r.series, r.period, r.number, r.duplicates) for r in points.collect()} == {("A", "2024", 5.0, 1), ("A", "2025", 6.0, 0), ("B", "2024", 9.0, 0)}
    bars = df.withColumn("period", F.lit(""))
    kind, points = charts.chart(bars, "price", ["price"])
    assert kind == "bar" and [(r.label, r.number) for r in points.collect()] == [("B", 9.0), ("A", 5.0)]


def test_chart_moves_no_row_to_meet_its_own_cells(spark, sf_dir):
    rows = spark.createDataFrame([(1, "2024", "", "$5", [("city", "A")]), (2, "2024", "", "$5", [("city", "A")]), (3, "2025", "", "$7", []), (4, "2025", "s", "none", [("city", "B")]), (5, "", "", "$9", [("city", "B")])], "pos int, period string, series string, raw string, others array<struct<name:string,value:string>>")
    kind, points = charts.chart_of_rows(rows, "price", ["price"])
    assert kind == "line" and {tuple(r) for r in points.collect()} == {("A", "2024", 5.0, "$5", 1), ("price", "2025", 7.0, "$7", 0)}
    plan = charts.QUERIES["chart_of_parameter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "hashpartitioning(pos" not in plan


def test_merge_is_idempotent_and_ignores_row_order(spark):
    rows = spark.createDataFrame([("a", "partial", 0, 0.5), ("a", "accepted", 5, 0.4), ("b", "rejected", 1, 0.1), ("b", "rejected", 0, 0.9)], "id string, status string, pos int, score double")
    once = merge.merge_buckets(rows)
    assert {tuple(r) for r in once.collect()} == {("a", "accepted", 5, 0.4), ("b", "rejected", 0, 0.9)}
    assert merge.merge_buckets(once).exceptAll(once).count() == 0
    assert merge.merge_buckets(rows.orderBy(F.rand(1))).exceptAll(once).count() == 0


def test_second_save_writes_changed_rows_only(spark):
    old = spark.range(50).withColumn("v", F.col("id") * 2)
    new = old.withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v"))).union(spark.range(50, 51).withColumn("v", F.lit(1)))
    assert sorted(r.id for r in merge.changed_rows(new, old, "id", ["v"]).collect()) == [7, 50]


def test_site_matching_takes_subdomains_in_list_order(spark):
    hosts = spark.createDataFrame([("a.b.org",), ("b.org",), ("xb.org",), ("c.net",)], "domain string")
    sites = spark.createDataFrame([("org", 2), ("b.org", 1)], "site string, nth int")
    got = {r.domain: r.hit for r in ranking.match_site(hosts, sites, "site", "nth", "hit").collect()}
    assert got == {"a.b.org": "b.org", "b.org": "b.org", "xb.org": "org", "c.net": None}


def _files(df, path, parts):
    for i in range(parts):
        df.where(F.col("event_id") % parts == i).coalesce(1).write.mode("append").parquet(path)


def test_stream_counts_equal_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    _files(events, f"{tmp_path}/in", 3)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.event_counts(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").exceptAll(live.event_counts(events)).count() == 0
    assert spark.table("counts").count() == live.event_counts(events).count()


def test_upserts_replace_the_rows_of_a_source(spark, tmp_path):
    rows = [(0, "u", "old"), (1, "u", "old"), (2, "v", "kept")]
    spark.createDataFrame(rows, "event_id long, source_url string, value string").coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    run = lambda: live.run_upserts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    run()
    spark.createDataFrame([(9, "u", "new")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert {(r.event_id, r.value) for r in spark.read.parquet(f"{tmp_path}/out/1").collect()} == {(2, "kept"), (9, "new")}


def test_rate_limiter_rests_and_caps(spark, tmp_path):
    rows = [(i, "a", float(i), False) for i in range(40)] + [(100, "b", 0.0, True), (101, "b", 10.0, False), (102, "b", 901.0, True), (103, "b", 1900.0, False), (104, "b", 2800.0, False)]
    schema = "event_id long, host string, seconds double, blocked boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = live.rate_limited(stream).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id: r.allowed for r in spark.table("limited").collect()}
    assert [got[i] for i in range(40)] == [True] * 30 + [False] * 10
    assert [got[i] for i in range(100, 105)] == [True, False, True, False, True]


def test_new_ids_of_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    _files(events.union(events.where("event_id < 10")), f"{tmp_path}/in", 2)
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = live.new_ids(stream, "event_id", "ts", "60 days").writeStream.format("memory").queryName("new_ids").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("new_ids").count() == events.count()
