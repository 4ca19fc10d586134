"""Reads of scored observations, case by case."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import output

SCHEMA = (
    "pos long, status string, tier string, score double, fields array<struct<name:string,value:string>>, normalized array<struct<name:string,value:string>>, source_url string, "
    "data_period string, time_inferred boolean, temporal_confidence double, published_at date, modified_at date, fetched_at date"
)


@pytest.fixture(scope="module")
def rows(spark):
    cells = lambda **f: list(f.items())
    made = [
        (3, "partial", "partial", 0.5, cells(a="1"), cells(period="2021", price="$3"), "u1", "2021", False, 0.9),
        (2, "accepted", "high", 0.8, cells(a="1"), cells(city="Ostend", price="$2", period="2020"), "u1", "2020", False, 0.9),
        (1, "accepted", "usable", 0.6, cells(a="raw", price="$1"), None, "u2", None, None, None),
        (4, "rejected", "noise", 0.0, cells(a="1"), [], "u3", None, None, None),
        (5, None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame([(*m, None, None, None) for m in made], SCHEMA)


def test_tidy_cells_before_raw_ones(rows):
    got = {r.pos: r.v and {f.name: f.value for f in r.v} for r in rows.select("pos", output.values(F.col("normalized"), F.col("fields")).alias("v")).collect()}
    assert got == {1: {"a": "raw", "price": "$1"}, 2: {"city": "Ostend", "price": "$2", "period": "2020"}, 3: {"period": "2021", "price": "$3"}, 4: {"a": "1"}, 5: None}


def test_snapshot_in_order(rows):
    assert [r.pos for r in output.snapshot(rows).collect()] == [1, 2, 3, 4]
    assert [r.pos for r in output.snapshot(rows, ("accepted",)).collect()] == [1, 2]


@pytest.mark.parametrize("provenance", [False, True])
def test_exports(rows, tmp_path, provenance):
    names = output.export_rows(rows, str(tmp_path / "c"), "csv", ["price"], include_partial=True, provenance=provenance)
    assert names == ["period", "price", "a", "city", *(output.PROVENANCE if provenance else ())]
    read = [r for f in glob.glob(f"{tmp_path}/c/*.csv") for r in csv.DictReader(open(f))]
    assert sorted((r["period"], r["price"], r["a"], r["city"]) for r in read) == [("", "$1", "raw", ""), ("2020", "$2", "", "Ostend"), ("2021", "$3", "", "")]
    if provenance:
        assert {r["source_url"]: r["data_period"] for r in read if r["tier"] != "partial"} == {"u1": "2020", "u2": ""}
    output.export_rows(rows, str(tmp_path / "j"), "jsonl", ["price"])
    assert sorted(json.loads(x)["price"] for f in glob.glob(f"{tmp_path}/j/*.json") for x in open(f)) == ["$1", "$2"]


def test_tallies_of_some_and_of_no_rows(rows):
    got = output.tallies(rows).first()
    assert got.status == {"accepted": 2, "partial": 1, "rejected": 1} and got.tier == {"high": 1, "usable": 1, "partial": 1, "noise": 1}
    assert (got.explicit_periods, got.inferred_periods, got.period_min, got.period_max, got.mean_score, got.source_count) == (1, 0, "2020", "2020", 0.7, 2)
    none = output.tallies(rows.limit(0)).first()
    assert none.status == {} and none.source_count == 0 and none.mean_score is None
