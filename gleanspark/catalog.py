"""The queries of the library, each beside the SQL that says the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "revenue_per_year"
MODULES = (
    "gleanspark.plans.flagship",
    "gleanspark.plans.scalars",
    "gleanspark.operators.history",
    "gleanspark.operators.tables",
    "gleanspark.operators.merge",
    "gleanspark.operators.charts",
    "gleanspark.operators.ranking",
    "gleanspark.operators.blocks",
    "gleanspark.streaming.live",
    "gleanspark.sources.html",
    "gleanspark.operators.verdicts",
    "gleanspark.operators.registers",
    "gleanspark.operators.prose",
    "gleanspark.operators.identity",
    "gleanspark.operators.periods",
    "gleanspark.operators.concepts",
    "gleanspark.operators.relevance",
    "gleanspark.operators.scoring",
    "gleanspark.sources.pagetables",
    "gleanspark.sources.assembly",
    "gleanspark.sources.jsonlists",
    "gleanspark.operators.requests",
    "gleanspark.operators.mentions",
    "gleanspark.operators.listings",
    "gleanspark.operators.output",
    "gleanspark.operators.templates",
)


def _modules():
    return [importlib.import_module(m) for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _modules():
        found |= m.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _modules():
        found |= m.ORACLE
    return found
