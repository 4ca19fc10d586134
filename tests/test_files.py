"""Files of every kind that is read, written by the test, and what is refused."""

import json
import zipfile
from datetime import date

import pytest

from gleanspark.sources import files, jsonlists

_CELL = {"s": "<c r='{r}' t='s'><v>{v}</v></c>", "n": "<c r='{r}'><v>{v}</v></c>", "d": "<c r='{r}' s='1'><v>{v}</v></c>", "b": "<c r='{r}' t='b'><v>{v}</v></c>", "i": "<c r='{r}' t='inlineStr'><is><t>{v}</t></is></c>"}


def _workbook(path, sheets, texts):
    with zipfile.ZipFile(path, "w") as z:
        ns = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main' xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'"
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f"<sheet name='{n}' sheetId='{i}' r:id='rId{i}'/>" for i, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f"<Relationship Id='rId{i}' Target='worksheets/sheet{i}.xml'/>" for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {ns}><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/></cellXfs></styleSheet>")
        z.writestr("docProps/core.xml", "<p xmlns:dc='d' xmlns:t='t'><dc:title>Port figures</dc:title><t:created>2024-02-03T10:00:00Z</t:created><t:modified>2025-01-01T00:00:00Z</t:modified></p>")
        for i, (_, rows) in enumerate(sheets, 1):
            body = "".join(f"<row r='{r}'>" + "".join(_CELL[k].format(r=f"{c}{r}", v=v) for c, k, v in cells) + "</row>" for r, cells in rows)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    (at / "a.csv").write_bytes("﻿Year;Fee\n2023;\"5;0\"\n\n2024;ü\n".encode())
    (at / "b.tsv").write_text("Port,x\tFee\nOstend\t5\n")
    (at / "c.csv").write_bytes("Port,Fee\nMálaga,6\n".encode("latin-1"))
    (at / "d.csv").write_bytes("Port,Fee\nSplit,7\n".encode("utf-16"))
    (at / "one.csv").write_text("only\n")
    (at / "empty.csv").write_text("")  # not even listed by the reader
    (at / "page.csv").write_text("  <!DOCTYPE html><html>no</html>")
    (at / "fake.xlsx").write_text("not a zip")
    (at / "broken.xlsx").write_bytes(b"PK\x03\x04 and nothing more")
    (at / "old.doc").write_text("x")
    (at / "list.json").write_text(json.dumps({"meta": {"n": 2}, "data": [{"rows": [{"portName": "Ostend", "fee": {"amount": 5.5}, "tags": ["a", 2, True], "none": None}, {"portName": "Split", "ok": True}]}]}))
    (at / "flat.json").write_text(json.dumps([1, 2, 3]))
    (at / "bad.json").write_text("{")
    texts = ["Fees of ports", "Port", "Fee", "Since", "Open", "Ostend &amp; more"]
    rows = [(1, [("A", "s", 0)]), (3, [("A", "s", 1), ("B", "s", 2), ("C", "s", 3), ("D", "s", 4)]), (4, [("A", "s", 5), ("B", "n", "12.50"), ("C", "d", 45292), ("D", "b", 1)]), (5, [("B", "n", 7), ("E", "i", "note")])]
    _workbook(at / "book.xlsx", [("Rates", rows), ("Empty", []), ("Single", [(1, [("A", "n", 1)])])], texts)
    return at


@pytest.fixture(scope="module")
def read(spark, folder):
    return files.read_files(spark, f"{folder}/*").cache()


def _name(r):
    return r.file.rpartition("/")[2]


def test_what_is_refused(read):
    got = {_name(r): r.refusal for r in read.select("file", "refusal").collect()}
    assert {k: v for k, v in got.items() if v} == {"page.csv": "a web page", "fake.xlsx": "not a workbook", "old.doc": "not supported"}


def test_observations_of_files(read):
    got = {}
    for r in sorted(files.file_observations(read).collect(), key=lambda r: (r.file, r.sheet, r.place)):
        got.setdefault(_name(r), []).append(({f.name: f.value for f in r.fields}, r.method, r.context))
    assert [g[0] for g in got["a.csv"]] == [{"year": "2023", "fee": "5;0"}, {"year": "2024", "fee": "ü"}]
    assert got["b.tsv"] == [({"port_x": "Ostend", "fee": "5"}, "linked_dataset", "")]
    assert got["c.csv"][0][0] == {"port": "Málaga", "fee": "6"} and got["d.csv"][0][0] == {"port": "Split", "fee": "7"}
    assert [g[0] for g in got["book.xlsx"]] == [{"port": "Ostend & more", "fee": "12.5", "since": "2024-01-01 00:00:00", "open": "True"}, {"fee": "7", "column_5": "note"}]
    assert {g[1:] for g in got["book.xlsx"]} == {("spreadsheet", "Fees of ports · Rates")}
    assert [g[0] for g in got["list.json"]] == [{"port_name": "Ostend", "fee_amount": "5.5", "tags": "a; 2"}, {"port_name": "Split", "ok": "true"}]
    assert set(got) == {"a.csv", "b.tsv", "c.csv", "d.csv", "book.xlsx", "list.json"}


def test_properties_of_workbooks(read):
    got = {_name(r): (r.title, r.created, r.modified_in) for r in files.workbook_facts(read).collect()}
    assert got == {"book.xlsx": ("Port figures", date(2024, 2, 3), date(2025, 1, 1)), "broken.xlsx": (None, None, None)}


def test_endings_and_formats(spark):
    cases = {"https://x.org/a.CSV?q=1": "csv", "https://x.org/get?format=xlsx&y=2": "xlsx", "https://x.org/a": "", "https://x.org/a.json#top": "json"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.e for r in df.select("p", files.extension_of(df.p).alias("e")).collect()} == cases


def test_lists_at_any_place(spark):
    row = lambda *keys: dict.fromkeys(keys, 1)
    docs = {
        "deep": {"a": {"b": {"rows": [row("x", "y")] * 4}}, "few": [row("x", "y", "z")] * 2},
        "weight": {"long": [row("x", "y")] * 5, "wide": [row("x", "y", "z", "w")] * 3},
        "mixed": {"rows": [row("x", "y")] * 3 + [1]},
        "mostly": {"rows": [row("x", "y")] * 19 + [1]},
        "unlike": {"rows": [row("a", "b"), row("c", "d"), row("e", "f")]},
        "scalars": {"rows": [1, 2, 3]},
        "too deep": {"a": {"b": {"c": {"d": {"rows": [row("x", "y")] * 4}}}}},
        "in a list": [{"rows": [row("x", "y")] * 4}],
        "top": [row("x", "y")] * 3,
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()] + [("broken", "{"), ("null", None)], "id string, json string")
    got = {r.id: (".".join(r.path), r.n, r.common) for r in jsonlists.record_lists(df, "id").collect()}
    assert got == {"deep": ("a.b.rows", 4, 2), "weight": ("wide", 3, 4), "mostly": ("rows", 19, 2), "top": ("", 3, 2)}
    assert {r.id for r in jsonlists.record_lists(df, "id", through_lists=True).collect()} == set(got) | {"in a list"}
    pages = {"a": {"paging": {"next": "https://x.org/2"}}, "b": {"nextPage": 2}, "c": {"a": {"b": {"next_url": "/3"}}, "next": "no"}, "d": [{"next": "/4"}]}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in pages.items()], "id string, json string")
    assert {r.id: (".".join(r.path), r.address) for r in jsonlists.next_pages(df, "id").collect()} == {"a": ("paging.next", "https://x.org/2"), "c": ("a.b.next_url", "/3")}
