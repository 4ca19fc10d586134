"""Address templates, list by list."""

import pytest

from gleanspark.operators import templates


@pytest.fixture(scope="module")
def told(spark):
    lists = {
        "whole": [("AB-12", "https://x.org/AB-12/a"), ("CD-345", "https://x.org/CD-345/a")],
        "short id": [("12", "https://x.org/12"), ("13", "https://x.org/13")],
        "two slices": [("N/2024/000123", "https://x.org/2024/000123.pdf"), ("N/2023/000456", "https://x.org/2023/000456.pdf")],
        "part of a run": [("20240512-7", "https://x.org/2024/doc"), ("20230101-8", "https://x.org/2023/doc")],
        "growing": [("no 9999", "https://x.org/d9999"), ("no 10000", "https://x.org/d10000")],
        "one that fails": [("AB-12", "https://x.org/AB-12"), ("CD-34", "https://x.org/CD-34"), ("EF-56", "https://x.org/other")],
        "another path": [("N-20240001", "https://x.org/a/20240001"), ("N-20240002", "https://x.org/b/20240002")],
        "not secure": [("AB-12", "http://x.org/AB-12")],
        "nothing": [(None, "https://x.org/1"), ("AB-12", None)],
        "repeated": [("AB-12", "https://x.org/AB-12"), ("AB-12", "https://x.org/AB-12")],
    }
    df = spark.createDataFrame([(k, *x) for k, rows in lists.items() for x in rows], "list string, id string, url string")
    return {r["list"]: r for r in templates.address_templates(df).collect()}


def test_templates_reproduce_every_address(told):
    assert {k: r.template for k, r in told.items() if r.template} == {
        "whole": "https://x.org/{1}/a", "two slices": "https://x.org/{1}/{2}.pdf", "part of a run": "https://x.org/{1}/doc", "growing": "https://x.org/d{1}", "repeated": "https://x.org/{1}",
    }
    assert set(told) == {"whole", "short id", "two slices", "part of a run", "growing", "one that fails", "another path", "not secure", "nothing", "repeated"}


def test_slices_of_ids(told):
    assert [(s.run, s.start, s["size"]) for s in told["part of a run"].slices] == [(0, 0, 4)] and told["whole"].slices is None
    assert [s.rest for s in told["growing"].slices] == [True] and told["repeated"].n == 1
