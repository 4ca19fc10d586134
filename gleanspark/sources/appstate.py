"""Records in the application state that script-drawn pages carry along as JSON."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Global names that hold a page's state, and the limits of what is read.
ASSIGNED = re.compile(r"window\.(?:__INITIAL_STATE__|__PRELOADED_STATE__|__NUXT__|__APOLLO_STATE__|__DATA__)\s*=\s*(?=\{)")
MAX_SCRIPT, MAX_DEPTH, MAX_CHILDREN = 3_000_000, 8, 200
LISTS_OF_SCRIPT, RECORDS_OF_PAGE = 2, 500
FIELD_DEPTH, FIELDS_OF_OBJECT, OBJECTS_OF_FIELD, VALUES_OF_FIELD = 3, 30, 5, 20
_LISTS = pa.list_(pa.list_(pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))))


def payloads(script: str) -> Iterator[object]:
    """The JSON values of a script: its whole text, or else what it assigns to the names of a page's state."""
    try:
        yield json.loads(script)
        return
    except (ValueError, RecursionError):
        pass
    for found in ASSIGNED.finditer(script):
        try:
            yield json.JSONDecoder().raw_decode(script, found.end())[0]
        except (ValueError, RecursionError):
            continue


def object_lists(payload: object) -> list[list[dict]]:
    """Lists of three objects or more at any place of a JSON value, the longest first."""
    found, ahead = [], deque([(payload, 0)])
    while ahead:
        value, depth = ahead.popleft()
        inside = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
        if isinstance(value, list) and len(value) >= 3 and all(isinstance(x, dict) for x in value):
            found.append(value)
        if depth < MAX_DEPTH:
            ahead.extend((x, depth + 1) for x in inside[:MAX_CHILDREN])
    return sorted(found, key=len, reverse=True)


def fields(record: dict) -> dict[str, str]:
    """Filled fields under joined names. Inner lists of objects give the first value of each name, others one text."""
    out: dict[str, str] = {}
    ahead = deque([("", record, 0)])
    while ahead:
        name, value, depth = ahead.popleft()
        if isinstance(value, dict):
            if depth <= FIELD_DEPTH:
                ahead.extend((f"{name}_{k.lstrip('@')}".lstrip("_"), x, depth + 1) for k, x in list(value.items())[:FIELDS_OF_OBJECT])
        elif isinstance(value, list) and any(isinstance(x, dict) for x in value):
            ahead.extend((name, x, depth) for x in value[:OBJECTS_OF_FIELD] if isinstance(x, dict))
        elif value is not None:
            text = ", ".join(map(str, value[:VALUES_OF_FIELD])) if isinstance(value, list) else str(value)
            if text.strip():
                out.setdefault(name, " ".join(text.split()))
    return out


def state_records(e: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, n, list, item, name, value): records of the two longest lists of objects of each script's state.

    `e` is an element table. Objects with fewer than two filled fields are left out, and so are a page's records after
    the first 500, scripts that are too long or hold broken JSON. Pages without state have no rows.
    """

    @F.arrow_udf("array<array<array<struct<name:string,value:string>>>>")
    def of(scripts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in scripts:
            yield pa.array([[[[{"name": k, "value": v} for k, v in fields(r).items()] for r in records[:RECORDS_OF_PAGE]] for p in payloads(s) for records in object_lists(p)[:LISTS_OF_SCRIPT]] for s in part.to_pylist()], _LISTS)

    state = (F.coalesce("name", F.lit("")) != "application/ld+json") & F.ltrim("text").rlike(r"^[\[{]|window\.__[A-Z_]+__\s*=")
    scripts = e.where("tag = 'script'").where(state & (F.length("text") <= MAX_SCRIPT)).select(key, "n", F.posexplode(of("text")).alias("list", "records"))
    records = scripts.select(key, "n", "list", F.posexplode("records").alias("item", "fields")).where(F.size("fields") >= 2)
    nth = F.row_number().over(Window.partitionBy(key).orderBy("n", "list", "item"))
    return records.withColumn("nth", nth).where(F.col("nth") <= RECORDS_OF_PAGE).select(key, "n", "list", "item", F.inline("fields"))
