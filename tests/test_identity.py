"""Keys of records, shapes of identifiers, paging of addresses, delimited files."""

import re

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import identity
from gleanspark.sources.delimited import read_delimited


def test_identifying_columns(spark):
    rows = [(1, "a", 7, 1, None), (2, "b", 7, 2, "x"), (3, "c", 8, 1, "y"), (4, "", 8, 2, "z")]
    wide = spark.createDataFrame(rows, "row_no int, name string, house long, number long, `odd.id` string")
    assert identity.identifying_columns(wide) == ["row_no"]
    assert identity.identifying_columns(wide.withColumn("bill_code", F.col("row_no") + 10)) == ["bill_code"]
    assert identity.identifying_columns(wide.drop("row_no")) == ["house", "number"]
    assert identity.identifying_columns(wide.unionByName(wide)) == []
    assert identity.identifying_columns(wide.limit(0)) == []
    assert identity.identifying_columns(wide.select(F.lit(0.5).alias("x"))) == []
    got = {r["column"]: (r.n_rows, r.n_empty, r.n_distinct, r.is_key) for r in identity.key_profile(wide, ["row_no", "name", "odd.id"]).collect()}
    assert got == {"row_no": (4, 0, 4, True), "name": (4, 1, 3, False), "odd.id": (4, 1, 3, False)}


@pytest.mark.parametrize(
    ("values", "pattern"),
    [
        (["HB-07-2024", "HB-19-2024", "SB-19-2025"], r"^[A-Z]{2}\-\d{2}\-\d{4}$"),
        (["q1", "q2", "q13"], r"^[a-z]{1}\d+$"),
        (["No/1", "Nos/1"], r"^[A-Za-z]+/\d{1}$"),
        (["AB-1", "AB_2"], None),
        (["tea", "milk"], None),
        ([None, ""], None),
    ],
)
def test_patterns_of_identifiers(spark, values, pattern):
    got = identity.id_pattern(spark.createDataFrame([(v,) for v in values], "v string"), "v")
    assert got == pattern
    assert pattern is None or all(re.search(got, v) for v in values)


def test_paging_of_addresses(spark):
    cases = {
        "https://a.example/list?q=tea&page=3&per_page=20#x": ("page", 3, False, "per_page", 20),
        "https://a.example/list?skip=40&take=10": ("skip", 40, True, "take", 10),
        "https://a.example/list?start=9&PG=2": ("PG", 2, False, None, None),
        "https://a.example/list?page=two&limit=5": None,
        "https://a.example/list": None,
        None: None,
    }
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "i int, u string").orderBy("i")
    assert [p and tuple(p) for (p,) in rows.select(identity.paging(F.col("u"))).collect()] == list(cases.values())


def test_delimited_files(spark, tmp_path):
    (tmp_path / "tabs.txt").write_text('Town\t Year \tNote, if any\nUlm\t2020\t"a ""b"""\n\t \t\nBonn\t2021\n')
    got = read_delimited(spark, str(tmp_path / "tabs.txt")).orderBy("pos")
    assert got.columns == ["pos", "Town", "Year", "Note, if any"]
    assert [tuple(r)[1:] for r in got.collect()] == [("Ulm", "2020", 'a "b"'), ("Bonn", "2021", None)]
    (tmp_path / "commas.csv").write_text("a,,c.d\n1,2,3\n")
    assert [tuple(r)[1:] for r in read_delimited(spark, str(tmp_path / "commas.csv")).collect()] == [("1", "2", "3")]
    (tmp_path / "none.csv").write_text("")
    assert read_delimited(spark, str(tmp_path / "none.csv")).count() == 0
