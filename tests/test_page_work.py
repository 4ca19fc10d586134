"""How pages are parsed: a few at a time, once, and in as many tasks as a shuffle has."""

import pyarrow as pa
from pyspark.sql import functions as F

from gleanspark.operators import concepts, requests, scoring, templates
from gleanspark.sources import assembly, html, jsonlists, pagetables
from gleanspark.sources.html import PART_ROWS, element_batches, element_rows


def test_elements_leave_the_parser_a_few_pages_at_a_time():
    page = "<body>" + "<p>text</p>" * 999 + "</body>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(10, 30)), pa.array([page, None] * 10)], ["k", "html"])
    parts = list(element_batches(iter([batch])))
    assert max(p.num_rows for p in parts) < PART_ROWS + 1000 and len(parts) == 2
    assert parts[0].schema.names[:2] == ["k", "n"]
    assert [k for p in parts for k in p.column("k").to_pylist()] == [k for k in range(10, 30, 2) for _ in range(1000)]
    assert [t for p in parts for t in p.column("text").to_pylist()] == [r["text"] for r in element_rows(page)] * 10


def test_generated_pages_are_dealt_over_all_partitions(spark, sf_dir):
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert html.pages_of_customers(spark, sf_dir).rdd.getNumPartitions() == most
    assert pagetables.pages_of_parts(spark, sf_dir).rdd.getNumPartitions() == most


def test_queries_that_read_elements_often_parse_pages_once(spark, sf_dir):
    for name in ("table_records_of_customers", "card_records_of_customers", "list_records_of_customers", "page_titles_and_links", "list_records_of_pages"):
        plan = html.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Arrow" not in plan, name
    assert "Arrow" not in pagetables.QUERIES["table_observations"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_tidy_fields_keep_the_last_of_a_name_and_are_made_once(spark):
    rows = spark.createDataFrame([(1, [("A b", " x  y "), ("c", ""), ("a B", "z"), ("D", "1")]), (2, [])], "k int, fields array<struct<name:string,value:string>>")
    made = rows.select("k", assembly.tidy_fields(F.col("fields")).alias("f"))
    assert [[tuple(x) for x in r.f] for r in made.orderBy("k").collect()] == [[("a_b", "z"), ("d", "1")], []]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("substring(trim(") <= 1


def test_requests_and_orders_are_dealt_over_all_partitions(spark, sf_dir):
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scoring.rows_of_orders(spark, sf_dir).rdd.getNumPartitions() == most
    dealt = requests.requests_of_customers(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {most}, true" in dealt


def test_notices_are_dealt_over_all_partitions_and_votes_are_plain_counts(spark, sf_dir):
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert templates.notices_of_customers(spark, sf_dir).rdd.getNumPartitions() == most
    assert "distinct" not in templates.QUERIES["address_templates"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().replace("Distinct", "")


def test_fields_of_records_are_read_within_their_row(spark):
    docs = spark.createDataFrame([(1, '[{"a B":"","a_b":"2","aB":"1","in":{"x":3,"deep":{"y":1}}},{"a B":"5","t":["u",true,null,"v"]},{"a B":"6","z":null}]')], "id int, json string")
    lists = jsonlists.record_lists(docs, "id", least=3, common=1)
    fields = jsonlists.record_fields(lists, "id")
    assert sorted(tuple(r) for r in fields.collect()) == [(1, 0, "a_b", "1"), (1, 0, "in_x", "3"), (1, 1, "a_b", "5"), (1, 1, "t", "u; v"), (1, 2, "a_b", "6")]
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (lists, fields)]
    assert plans[0].count("Aggregate") == plans[1].count("Aggregate") and "parse_json" not in plans[0]


def test_orders_whose_names_differ_are_dealt_over_all_partitions(spark, sf_dir):
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert concepts._cells(spark, sf_dir).rdd.getNumPartitions() == most
