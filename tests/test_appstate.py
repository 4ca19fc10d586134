"""Records of application state."""

import json

from gleanspark.sources import appstate, html

MENU = [{"label": x, "to": f"/{x}"} for x in ("home", "news", "help")]
BOATS = [{"@id": i, "boat": f"boat {i}", "yard": {"town": "Kiel", "owners": [{"name": "Ada"}, {"name": "Bo", "share": 5}]}, "tags": ["old", "red"], "none": None} for i in range(5)]
STATE = json.dumps({"props": {"menu": MENU, "found": [{"page": {"boats": BOATS}}]}})


def _page(script: str, attributes: str = "") -> str:
    return f"<body><script {attributes}>{script}</script></body>"


def test_records_of_state(spark):
    pages = [
        (1, _page(STATE, 'id="__NEXT_DATA__" type="application/json"')),
        (2, _page(f"var a = 1; window.__NUXT__ = {STATE}; b();")),
        (3, _page("window.__DATA__ = {broken")),
        (4, _page("{broken", 'type="application/json"')),
        (5, _page(json.dumps(MENU), 'type="application/ld+json"')),
        (6, _page(json.dumps([{"a": i} for i in range(9)]))),
        (7, None),
    ]
    e = html.elements(spark.createDataFrame(pages, "page_id long, html string"))
    got = {}
    for r in appstate.state_records(e).collect():
        got.setdefault((r.page_id, r["list"], r["item"]), {})[r["name"]] = r["value"]
    boat = lambda i: {"id": str(i), "boat": f"boat {i}", "yard_town": "Kiel", "yard_owners_name": "Ada", "yard_owners_share": "5", "tags": "old, red"}
    assert got == {(p, 0, i): boat(i) for p in (1, 2) for i in range(5)} | {(p, 1, i): m for p in (1, 2) for i, m in enumerate(MENU)}


def test_a_page_gives_its_first_records(spark):
    many = json.dumps([{"a": i, "b": "x"} for i in range(700)])
    e = html.elements(spark.createDataFrame([(1, _page(many) * 2)], "page_id long, html string"))
    got = appstate.state_records(e).where("name = 'a'")
    assert sorted(int(r.value) for r in got.collect()) == list(range(500))


def test_odd_values():
    assert list(appstate.payloads("[" * 100_000)) == []
    assert appstate.object_lists([{"a": 1}, {"a": 2}]) == [] and appstate.object_lists(None) == []
    assert appstate.fields({"a": {"b": {"c": {"d": {"e": 1}}}}, "t": True, "s": " \n "}) == {"t": "True"}
