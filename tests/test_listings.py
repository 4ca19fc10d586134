"""Columns and links of listings, case by case."""

import pytest

from gleanspark.operators import listings


@pytest.fixture(scope="module")
def facts(spark):
    columns = {
        "serial": ["1", "2", "3", "4"], "late serial": ["7.", "8.", "9.", "10."], "gap": ["1", "2", "4", "5"], "sizes": ["5 KB", "1.5MB", "", "9 b"], "code": ["AB-1", "AB-2", "CD-1", "CD-2"],
        "title": ["The first of all", "A second", "One more here", "And a fourth"], "same": ["x", "x", "x", "x"], "holes": ["a", None, "c", "d"],
    }
    rows = [("t", i, c, v) for c, values in columns.items() for i, v in enumerate(values)] + [("u", i, "code", v) for i, v in enumerate(["A", "B"])]
    df = spark.createDataFrame(rows, "list string, row int, column string, value string")
    return {(r["list"], r["column"]): r for r in listings.column_facts(df).collect()}


def test_serials_and_sizes(facts):
    assert {c for (_, c), r in facts.items() if r.serial} == {"serial", "late serial"}
    assert {c for (_, c), r in facts.items() if r["size"]} == {"sizes"}


def test_keys_of_records(facts):
    assert {c for (t, c), r in facts.items() if r.unique and t == "t"} == {"serial", "late serial", "gap", "code", "title"}
    assert sorted((r.key_rank, c) for (_, c), r in facts.items() if r.key_rank) == [(1, "code"), (2, "gap"), (3, "title")]
    assert not facts["u", "code"].unique  # two rows tell nothing


def test_pagers(spark):
    lists = {
        "numbers": [("1", "/a"), ("2", "/b"), ("Next", "/c"), ("About us all", "/d")], "parameter": [(f"Results {i} of it", f"https://x.org/l?q=1&page={i}") for i in range(4)],
        "records": [(f"Notice {i} of it", f"https://x.org/n/{i}") for i in range(4)], "other pages": [(f"Part {i} of it", f"https://x.org/{i}?page={i}") for i in range(4)], "empty": [(None, None)],
    }
    df = spark.createDataFrame([(k, *x) for k, items in lists.items() for x in items], "list string, title string, href string")
    assert {r["list"] for r in listings.pagers(df).collect() if r.pager} == {"numbers", "parameter"}
