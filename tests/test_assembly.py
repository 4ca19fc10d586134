"""Tables and whole pages as observations, case by case."""

from datetime import date

import pytest

from gleanspark.operators import scoring
from gleanspark.operators.concepts import concept
from gleanspark.sources import assembly, pagetables
from gleanspark.sources.html import elements

TODAY = date(2026, 9, 30)
_TR = lambda *cells, tag="td": "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
TABLES = {
    "wide": "<table>" + _TR("", "1/2024", "2/2024", "3/2024", tag="th") + _TR("Electric", "$55,353", "$53,707", "$54,021") + _TR("All", "$47,401", "", "$47,218") + "</table>",
    "sheet": "<table>" + _TR("Field", "Value", tag="th") + _TR("Last Updated", "July 14, 2026") + _TR("Created", "March 14, 2023") + "</table>",
    "bare sheet": "<table>" + _TR("Price", "$5") + _TR("Maker", "Ann & Co") + "</table>",
    "titled": "<table><tr><th colspan='3'>Berths with the largest rises, June 2026</th></tr>" + _TR("Model", "Average price", "Change", tag="th") + _TR("Small", "$32,395", "-1.3%") + "</table>",
    "two heads": "<table><thead>" + _TR("Port", "Price", "Price") + _TR("", "summer", "winter") + "</thead>" + _TR("Ostend", "5", "6") + "</table>",
    "guessed": "<table>" + _TR("Port", "Fee") + _TR("Ostend", "$5") + _TR("Port", "Fee") + _TR("Split", "$6") + "</table>",
    "headless": "<table><caption>Wheat yield, tonnes per hectare</caption>" + _TR("2023", "3.6") + _TR("2024", "3.8") + "</table>",
    "years in a row": "<table>" + _TR("Ostend", "2023", "5") + _TR("Split", "2024", "6") + "</table>",
    "linked": "<h2>Notices</h2><table>" + _TR("Subject", "File", tag="th") + _TR("<a href='b.html'>Mooring</a>", "<a href='/f/1.pdf'>Download</a>") + "</table>",
    "repeated names": "<table>" + _TR("Fee", "Fee", tag="th") + _TR("5", "6") + "</table>",
    "single cell": "<table>" + _TR("only") + "</table>",
    "chrome": "<nav><table>" + _TR("a", "b", tag="th") + _TR("c", "d") + "</table></nav>",
    "empty": "<table></table>",
}


@pytest.fixture(scope="module")
def tables(spark):
    pages = spark.createDataFrame([(k, "https://port.example/lists/a", f"<html><body>{h}</body></html>") for k, h in TABLES.items()], "page_id string, url string, html string")
    found = {k: [] for k in TABLES}
    for r in sorted(pagetables.table_observations(elements(pages, max_text=None), TODAY, pages).collect(), key=lambda r: (r.page_id, r.place)):
        found[r.page_id].append(({f.name: f.value for f in r.fields}, r.context, r.context_kind))
    return found


def test_periods_across_the_top_become_rows(tables):
    assert [t[0] for t in tables["wide"]] == [
        {"series": "Electric", "period": "1/2024", "value": "$55,353"}, {"series": "Electric", "period": "2/2024", "value": "$53,707"}, {"series": "Electric", "period": "3/2024", "value": "$54,021"},
        {"series": "All", "period": "1/2024", "value": "$47,401"}, {"series": "All", "period": "3/2024", "value": "$47,218"},
    ]


def test_sheets_of_properties_are_one_observation(tables):
    assert [t[0] for t in tables["sheet"]] == [{"Last Updated": "July 14, 2026", "Created": "March 14, 2023"}]
    assert [t[0] for t in tables["bare sheet"]] == [{"Price": "$5", "Maker": "Ann & Co"}]


def test_titles_and_headers(tables):
    assert tables["titled"] == [({"Model": "Small", "Average price": "$32,395", "Change": "-1.3%"}, "Berths with the largest rises, June 2026", "caption")]
    assert [t[0] for t in tables["two heads"]] == [{"Port": "Ostend", "Price summer": "5", "Price winter": "6"}]
    assert [t[0] for t in tables["guessed"]] == [{"Port": "Ostend", "Fee": "$5"}, {"Port": "Split", "Fee": "$6"}]
    assert tables["headless"] == [({"column_1": "2023", "column_2": "3.6"}, "Wheat yield, tonnes per hectare", "caption"), ({"column_1": "2024", "column_2": "3.8"}, "Wheat yield, tonnes per hectare", "caption")]
    assert [t[0] for t in tables["years in a row"]] == [{"column_1": "Ostend", "column_2": "2023", "column_3": "5"}, {"column_1": "Split", "column_2": "2024", "column_3": "6"}]
    assert [t[0] for t in tables["repeated names"]] == [{"Fee": "5", "Fee_2": "6"}]


def test_links_in_cells(tables):
    assert tables["linked"] == [({"Subject": "Mooring", "Subject_url": "https://port.example/lists/b.html", "File": "https://port.example/f/1.pdf"}, "Notices", "heading")]


def test_tables_that_hold_nothing(tables):
    assert tables["single cell"] == tables["chrome"] == tables["empty"] == []


PAGE = """<html><head><title>Harbour berth prices</title><meta name="description" content="Prices of berths"></head><body><nav><ul><li><a href="/">Home of it all</a></li></ul></nav>
<main><h2>Berth prices by year</h2><table><tr><th>Year</th><th>Berth price</th></tr><tr><td>2023</td><td>$139</td></tr><tr><td>2024</td><td>$115</td></tr><tr><td>2024</td><td>$115</td></tr></table>
<p>Harbour berth prices fell to $108 in 2025, a record low and down 8% from 2024.</p>
<ul><li><a href="/n/1.pdf">Notice on mooring fees</a> 12 May 2026</li><li><a href="/n/2">Rules for small boats</a>: all of them</li><li><a href="https://other.example/n/3">Plan of the new pier</a></li></ul></main>
<script type="application/ld+json">{"@type": "Organization", "name": "Port of Ostend", "url": "https://port.example/"}</script></body></html>"""
PAGES = {
    "full": PAGE,
    "plain": "<html><head><title>A page</title></head><body><main>Only one useful value stands on this whole page</main></body></html>",
    "check": "<html><head><title>Just a moment...</title></head><body>Performing security verification<table><tr><td>1</td><td>2</td></tr><tr><td>1</td><td>3</td></tr></table></body></html>",
    "closed": "<html><head><title>News</title></head><body><p>Please log in to continue with this text.</p></body></html>",
    "script only": "<html><head></head><body><script>var t = 1;</script></body></html>",
    "nothing": None,
    "blank": "",
}


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame([(k, "https://port.example/lists/a", h) for k, h in PAGES.items()], "page_id string, url string, html string")
    return assembly.page_observations(df, TODAY).cache()


def test_extractors_of_a_page_in_their_order(pages):
    rows = pages.where("page_id = 'full'").orderBy("place").collect()
    told = [(r.method, {f.name: f.value for f in r.fields}, r.context, r.role) for r in rows]
    assert [t[0] for t in told] == ["json_ld", "html_table", "html_table", "list_item", "list_item", "list_item", "text_statement"]
    assert told[0][3] == "metadata"  # a publisher that describes its own site
    assert told[1][1:] == ({"year": "2023", "berth_price": "$139"}, "Berth prices by year", "data") and told[2][1] == {"year": "2024", "berth_price": "$115"}  # the repeated row once
    assert [t[1] for t in told[3:6]] == [
        {"title": "Notice on mooring fees", "document": "https://port.example/n/1.pdf", "date": "12 May 2026"},
        {"title": "Rules for small boats", "url": "https://port.example/n/2", "description": "all of them"},
        {"title": "Plan of the new pier", "url": "https://other.example/n/3"},
    ]
    assert told[6][1] | {"statement": ""} == {"statement": "", "value": "$108", "change": "8%", "period": "2025"} and told[6][2] == "Berth prices by year"
    assert [r.place for r in rows] == list(range(1, 8)) and rows[1].block_id == "table#1" and rows[3].block_id.startswith("list#")


def test_pages_without_data_and_closed_pages(pages):
    got = {r.page_id: r for r in pages.where("page_id <> 'full'").collect()}
    assert set(got) == {"plain", "check", "closed"} and all(r.method == "page_summary" for r in got.values())
    assert {f.name: f.value for f in got["plain"].fields} == {"title": "A page", "text": "Only one useful value stands on this whole page"} and got["plain"].role == "data"
    assert got["check"].role == got["closed"].role == "challenge"


def test_a_page_from_parsing_to_tiers(pages):
    request = scoring.Request((concept("price"),), subject=("harbour", "berth"), window=("2017-01-01", "2026-12-31"))
    got = scoring.classify(pages.drop("noise"), request).select("page_id", "status", "tier", "period").collect()
    assert sorted(r.period for r in got if r.status == "accepted") == ["2023", "2024", "2025"]
    assert {r.status for r in got if r.page_id in ("check", "closed")} == {"rejected"}


def test_an_empty_table_of_pages(spark):
    assert assembly.page_observations(spark.createDataFrame([], "page_id long, url string, html string"), TODAY).count() == 0
