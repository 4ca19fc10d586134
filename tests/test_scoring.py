"""Rows to scored, tidy observations, case by case."""

from datetime import date
from functools import cache

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import scoring
from gleanspark.operators.concepts import concept
from gleanspark.operators.scoring import Request

SCHEMA = (
    "row long, fields array<struct<name:string,value:string>>, method string, context string, context_kind string, title string, url string, "
    "coverage string, modified_at date, published_at date, fetched_at date, block_id string"
)
TOLLS = Request(required=(concept("price"),), subject=("harbour", "toll"), window=("2017-01-01", "2026-12-31"))


def _row(fields, method="html_table", title="Harbour tolls", context=None, kind=None, url="https://data.example/list", fetched=None, block=None):
    return list(fields.items()), method, context, kind, title, url, None, None, None, fetched, block


def _score(spark, rows, request, how=scoring.score_rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return {r.row: r for r in how(df, request).collect()}


def _tidy(r):
    return [(f.name, f.value) for f in r.normalized]


SAID = {"method": "text_statement", "title": "Outlook", "context": "Harbour markets"}
FAIR = {"Office": "Harbour office", "subject": "Rules for mooring small boats", "id": "HB-N-20-0117", "issue date": "4 May 2026", "series": "x"}
CASES = {
    "tolls": (
        TOLLS,
        {
            "good": _row({"year": "2024", "average_berth_price": "$115"}),
            "old": _row({"year": "2010", "average_berth_price": "$115"}),
            "astray": _row({"year": "2024", "price": "$4"}, title="Cake recipes"),
            "unmeasured": _row({"year": "2024", "depth": "12 m"}),
            "undated": _row({"name": "Berth X 16", "price": "$599"}, method="repeated_region", title="Harbour berths", fetched=date(2026, 9, 1)),
            "menu": _row({"url": "/about", "text": "About"}, method="repeated_region"),
            "check": _row({"title": "Just a moment...", "text": "Checking your browser before accessing"}, method="page_summary"),
            "foreign": _row({"statement": "Furthermore, petrol prices are much higher than in other countries at USD 2 per litre in 2025.", "value": "USD 2", "period": "2025"}, **SAID),
            "own": _row({"statement": "Harbour berth prices came in at $99 in 2025, below $100 for the second year.", "value": "$99", "period": "2025"}, **SAID),
            "share": _row({"statement": "Harbour traffic rose 14.7% year over year in August 2025.", "value": "14.7%", "period": "2025-08"}, **SAID),
            "scaled": _row({"statement": "The study analysed 1.8 million harbours and their listing prices in 2025.", "value": "1.8 million", "period": "2025"}, **SAID),
            "teaser": _row({"text": "Used berths Under $20,000 Are Getting Much Harder To Find for harbour guests", "url": "/study"}, method="repeated_region"),
            "bound": _row({"name": "Best Harbour Berths Under $25,000", "url": "/best"}, method="repeated_region"),
        },
    ),
    "wheat": (
        Request((concept("yield"),), subject=("wheat",), window=("2022-01-01", "2026-12-31")),
        {
            "named": _row({"year": "2023", "yield_t_ha": "3.6"}, title="Wheat yields"),
            "caption": _row({"column_1": "2023", "column_2": "3.6"}, title="Wheat statistics", context="Wheat yield, tonnes per hectare", kind="caption"),
            "wide": _row({"2021": "3.6", "2022": "3.7", "2023": "3.8"}, title="Wheat yield 2025"),
            "output": _row({"statement": "World wheat production reached 374 million tonnes in 2024 on many fields.", "value": "374 million tonnes", "period": "2024"}, method="text_statement", title="Wheat"),
        },
    ),
    "revenue": (Request((concept("revenue"),), subject=("company",), window=("2019-01-01", "2026-12-31")), {"fiscal": _row({"fiscal_year": "FY2023", "net_revenue": "$211.9 bn"}, title="Company annual report")}),
    "people": (
        Request((concept("population"),), subject=("harbour",), heads=("residents",)),
        {
            "villages": _row({"statement": "The harbour has 3,961 villages and many residents around it.", "value": "3,961 villages"}, method="undated_statement"),
            "residents": _row({"statement": "The harbour has 3,961 residents around it on most days.", "value": "3,961 residents"}, method="undated_statement"),
            "unnamed": _row({"statement": "The population of the harbour reached 3,961 on most of its days.", "value": "3,961"}, method="undated_statement"),
        },
    ),
    "optional": (
        Request((concept("price"),), tuple(concept(n, "dimension") for n in ("make", "model", "trim level")), ("harbour",), window=TOLLS.window),
        {"bare": _row({"year": "2024", "average_berth_price": "$115"}), "full": _row({"year": "2024", "brand": "Zodiac", "price": "$115", "note": "new"})},
    ),
    "records": (
        Request(subject=("harbour",), window=("2026-01-01", "2026-12-31"), shape="records"),
        {"fair": _row(FAIR), "undated": _row({k: v for k, v in FAIR.items() if k != "issue date"}), "lookup": _row({"id": "31", "slug": "harbour-tools", "name": "Harbour Tools", "enabled": "yes"})},
    ),
    "either": (
        Request(subject=("expo",), window=("2026-01-01", "2026-12-31"), shape="either", named_source=True),
        {
            "sentence": _row({"statement": "Cons: the expo floor is sales-heavy, and a full pass costs more", "value": "$2,695", "period": "2026"}, method="text_statement", title="Expos"),
            "counted": _row({"year": "2026", "amount": "12,000"}, title="Expo visitors"),
            "astray": _row({"year": "2026", "amount": "12,000"}, title="Cakes"),
        },
    ),
}


@pytest.fixture(scope="module")
def scored(spark):
    """The rows of a request by case, each request scored once."""

    @cache
    def of(name):
        request, rows = CASES[name]
        got = _score(spark, list(rows.values()), request)
        return {k: got[i] for i, k in enumerate(rows)}

    return of


def test_rows_with_a_measure_a_subject_and_a_period(scored):
    got = scored("tolls")
    assert {k: r.status for k, r in got.items()} == dict.fromkeys(got, "partial") | dict.fromkeys(("good", "undated", "own"), "accepted") | dict.fromkeys(("menu", "check", "teaser", "bound"), "rejected")
    assert [got[k].tier for k in ("menu", "check")] == ["noise", "noise"] and got["check"].score == 0 and got["check"].role == "challenge"
    good, parts = got["good"], got["good"].parts
    assert _tidy(good) == [("period", "2024"), ("series", "average berth price"), ("price", "$115")]
    assert good.matches["price"].credit > 0.9 and good.matches["price"].field == "average_berth_price" and not good.inferred and good.basis == "row_field"
    assert got["old"].tier == "partial" and "outside the window" in got["old"].reasons
    assert (got["undated"].period, got["undated"].inferred) == ("2026", True) and got["undated"].confidence < 0.5
    assert good.score == pytest.approx(0.3 * parts.coverage + 0.22 * parts.relevance + 0.18 * parts.temporal + 0.12 * parts.extraction + 0.1 * parts.completeness + 0.08 * parts.source, abs=6e-4)
    assert (parts.coverage, parts.extraction, parts.source, parts.completeness) == (1.0, 0.9, 0.6, 0.6)
    assert "subject not mentioned" in got["astray"].reasons


def test_vetoes_on_sentences(scored):
    tolls, people = scored("tolls"), scored("people")
    assert "price of the sentence: foreign" in tolls["foreign"].reasons and "price" not in dict(_tidy(tolls["foreign"]))
    assert people["villages"].parts.coverage <= 0.3 and people["residents"].parts.coverage > 0.45 and people["unnamed"].parts.coverage <= 0.3
    assert any(r.endswith("counted") for r in people["villages"].reasons) and any(r.endswith("unnamed") for r in people["unnamed"].reasons)


def test_scores_do_not_depend_on_the_domain(scored):
    wheat = scored("wheat")
    assert [wheat["named"].status, wheat["caption"].status, scored("revenue")["fiscal"].status] == ["accepted"] * 3
    assert (wheat["caption"].period, wheat["caption"].matches["yield"].via) == ("2023", "context")
    assert wheat["wide"].period is None  # a time series has no single period
    assert wheat["output"].status == "partial" and "yield" not in dict(_tidy(wheat["output"]))


def test_optional_concepts_never_cost_a_row_its_place(scored):
    got = scored("optional")
    assert got["bare"].status == got["full"].status == "accepted"
    assert _tidy(got["full"]) == [("period", "2024"), ("price", "$115"), ("entity", "Zodiac"), ("note", "new")]


def test_records_answer_requests_for_them(scored):
    got = scored("records")
    assert [got[k].status for k in ("fair", "undated", "lookup")] == ["accepted", "partial", "partial"]
    assert [n for n, _ in _tidy(got["fair"])] == ["subject", "Office", "id", "issue date"] and got["fair"].matches["record"].field == "subject"
    assert "record without a date of its own" in got["undated"].reasons and "record" not in got["lookup"].matches


def test_either_shape_and_a_named_source(scored):
    got = scored("either")
    assert got["sentence"].status == "partial" and got["counted"].status == "accepted" and got["astray"].status == "rejected"
    assert not any("value" in r for r in got["counted"].reasons)


def test_blocks_are_judged_after_their_rows(spark):
    good = [_row({"year": str(2017 + i), "price": f"${i}00"}, block="table#1") for i in range(4)]
    again = [_row({"year": str(2017 + i), "price": f"${i}00", "note": "same"}, block="table#2", title=None) for i in range(4)]
    weak = [_row({"city": f"Town {i} of it", "remark": "nothing at all to say of it"}, block="table#3", title=None) for i in range(5)] + [_row({"year": "2020", "price": "$7"}, block="table#3", title="Harbour tolls")]
    got = _score(spark, good + again + weak, TOLLS, scoring.classify)
    assert len(got) == 14
    assert [got[i].status for i in range(4)] == ["accepted"] * 4
    assert all(got[i].status == "partial" for i in range(4, 8))


def test_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert scoring.score_rows(empty, TOLLS).count() == 0
    rows = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None, None, None), (None, [("price", None), (None, "x")], *[None] * 10), (3, [("text", "word " * 5000)], "page_summary", *[None] * 9)], SCHEMA)
    got = scoring.score_rows(rows.withColumn("role", F.lit(None).cast("string")).withColumn("prior", F.lit(0.3)), TOLLS).collect()
    assert len(got) == 3 and all(r.status in ("partial", "rejected") for r in got)
