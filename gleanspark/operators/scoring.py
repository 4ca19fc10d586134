"""From raw rows to scored, tidy observations: matches, relevance, period, noise and record verdict in one plan.

A request is small and held by the driver. Its concepts are matched in one aggregate by row; all else is columns of the row:
vetoes on what sentences state, six parts of a score, gates and a tier, and the tidy fields, rebuilt as an ordered array.
Blocks are judged afterwards, by `blocks.apply_block_support`.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions.numbers import QUANTITY_KINDS, to_number, value_kind
from gleanspark.functions.strings import similarity, tokens
from gleanspark.functions.temporal import overlaps, parse_period
from gleanspark.functions.urls import host_of
from gleanspark.lineage import spool, spread
from gleanspark.operators import verdicts
from gleanspark.operators.blocks import apply_block_support
from gleanspark.operators.concepts import GENERIC_NAME, MODIFIERS, UNIT_TOKENS, Concept, concept, matches_by_row, seen_cells, word_class, words_of
from gleanspark.operators.periods import resolve_periods
from gleanspark.operators.relevance import SENTENCES, attribution, with_relevance
from gleanspark.sources.tables import table

# Evidence that counts, what a veto leaves, evidence for an optional concept, a half of relevance.
EVIDENCE, VETOED, OPTIONAL, HALF = 0.45, 0.3, 0.75, 0.5
SERIES = 3  # names that are periods make a row a time series, which has no single period
NEAR = 0.85
FIELDS = verdicts.FIELDS
COUNT = r"(?i)^[\d,]+\s+([a-z]+)$"


@dataclass(frozen=True)
class Request:
    """What is asked for. `shape`: values, records or either; `heads`: nouns that are counted; `window`: first and last day."""

    required: tuple[Concept, ...] = ()
    optional: tuple[Concept, ...] = ()
    subject: tuple[str, ...] = ()
    heads: tuple[str, ...] = ()
    places: tuple[str, ...] = ()
    window: tuple[str, str] | None = None
    shape: str = "values"
    named_source: bool = False
    today: date = field(default=date(2026, 9, 30))

    @property
    def stand_in(self) -> bool:
        """Nothing is named that could be measured, so any number about the subject may answer."""
        return self.shape == "either" and not self.required

    @property
    def wanted(self) -> list[Concept]:
        """Required concepts, each name once."""
        return [concept("value", "measure", ("amount", "figure", "total"))] if self.stand_in else list({c.name: c for c in reversed(self.required)}.values())[::-1]

    @property
    def extras(self) -> list[Concept]:
        """Optional concepts, each name once, without those that are required anyway."""
        known = {c.name for c in self.wanted}
        return [c for c in {c.name: c for c in reversed(self.optional)}.values() if c.name not in known][::-1]


def _names_one(text: Column, heads: Iterable[str]) -> Column:
    """Whether a text has a word that is nearly one of the heads."""
    known = [words_of(h)[-1] for h in heads if words_of(h)]

    @F.arrow_udf("boolean")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([x is not None and any(similarity(w, h) >= NEAR for w in set(words_of(x)) for h in known) for x in texts.to_pylist()], pa.bool_())

    return of(text)


def _counts(noun: Column, c: Concept, heads: Iterable[str]) -> Column:
    """Whether "N nouns" counts what the concept measures; true of a null."""
    said = [c.name, *(w for a in c.aliases for w in a), *(w for h in heads for w in words_of(h)[-1:])]

    @F.arrow_udf("boolean")
    def of(nouns: pa.Array) -> pa.Array:
        heard = ((words_of(n) or (n,))[0] if n else None for n in nouns.to_pylist())
        return pa.array([w is None or (c.group is not None and word_class(w) == c.group) or any(similarity(w, s) >= NEAR for s in said) for w in heard], pa.bool_())

    return F.lit(True) if c.name == "value" and not list(heads) else of(noun)


def _value(fields: Column, name: Column | str) -> Column:
    return F.try_element_at(F.filter(fields, lambda x: x["name"] == name), F.lit(1))["value"]


def with_matches(rows: DataFrame, request: Request) -> DataFrame:
    """`rows` with kinds (of its fields, in order), matches (concept to field, credit, via) and timed_names."""
    wanted, optional = request.wanted, request.extras
    kinds = spool(rows.withColumn("kinds", F.transform("fields", lambda x: value_kind(x["value"], request.today))), "kinds")  # read four times below
    cells = kinds.select("row", "context", F.posexplode(F.arrays_zip("fields", "kinds")).alias("place", "c")).select("row", "context", "place", "c.fields.*", F.col("c.kinds").alias("kind"))
    seen = seen_cells(cells, [*wanted, *optional], request.today, request.heads)
    measured = seen.where("NOT timed")
    timed = seen.where("timed").groupBy("row").agg(F.collect_set("name").alias("timed_names"))
    found = matches_by_row(measured, [*wanted, *optional], wanted).drop("timed_names")
    if optional:  # a field that shows a required concept can't show another
        used = found.select("row", F.transform(F.filter(F.map_values("matches"), lambda m: m["credit"] >= EVIDENCE), lambda m: m["field"]).alias("used"))
        free = measured.join(used, "row", "left").where("used IS NULL OR NOT array_contains(used, name)").drop("used")
        more = matches_by_row(free, [*wanted, *optional], optional).select("row", F.col("matches").alias("more"))
        no_more = F.create_map().cast("map<string,struct<field:string,credit:double,via:string>>")
        found = found.join(more, "row", "left").select("row", F.map_concat("matches", F.coalesce("more", no_more)).alias("matches"))
    nothing = F.create_map().cast("map<string,struct<field:string,credit:double,via:string>>")
    joined = kinds.join(found, "row", "left").join(timed, "row", "left")
    return joined.withColumns({"matches": F.coalesce("matches", nothing), "timed_names": F.coalesce("timed_names", F.array().cast("array<string>"))})


def _vetoes(request: Request, c: Concept, match: Column) -> dict[str, Column]:
    """Reasons why a match of a measure in a sentence doesn't count, each true where it holds."""
    said = F.when(F.col("method").isin(*SENTENCES), F.nullif(_value(F.col("fields"), "statement"), F.lit("")))
    around = F.concat_ws(" ", F.coalesce("context", F.lit("")), F.coalesce("title", F.lit("")))
    out = {}
    if c.kind != "measure":
        return out
    if request.subject:
        out["foreign"] = said.isNotNull() & (attribution(said, around, c, request.subject) == "foreign")
    if request.heads:
        out["unnamed"] = (F.col("method") == "undated_statement") & ~_names_one(F.when(F.col("method") == "undated_statement", F.coalesce(said, F.lit(""))), request.heads)
    noun = F.when(said.isNotNull(), F.nullif(F.regexp_extract(F.trim(_value(F.col("fields"), match["field"])), COUNT, 1), F.lit("")))
    out["counted"] = noun.isNotNull() & ~_counts(noun, c, request.heads)
    return out


def score_rows(rows: DataFrame, request: Request) -> DataFrame:
    """`rows` with status, tier, score and its parts, matches, period, reasons, and normalized (ordered fields).

    Rows: row (an id), fields (array of name and value), method, context, context_kind, title, url, coverage (in time), modified_at,
    published_at, fetched_at; also declared role and prior (confidence of the extractor) where there are such columns. Nulls
    are empty. Rows that aren't data are rejected as noise, unscored. A row outside the window, about something else, or
    without what was asked for is partial at best. Repeated ids share their matches.
    """
    wanted, today = request.wanted, request.today
    declared = F.col("role") if "role" in rows.columns else None
    given = F.col("prior") if "prior" in rows.columns else F.lit(None).cast("double")
    full = F.filter(F.coalesce("fields", F.array().cast(FIELDS)), lambda x: x["name"].isNotNull())
    told = with_matches(rows.withColumn("fields", full), request)
    told = told.withColumn("_noise", verdicts.noise_verdict(F.col("fields"), F.col("method"), F.coalesce(_value(F.col("fields"), "title"), F.lit("")), today, declared, F.col("kinds")))

    # What each required concept is worth, and which matches are left
    strong = lambda c: F.try_element_at("matches", F.lit(c.name))
    vetoes = {}
    for i, c in enumerate(wanted):
        matched = F.coalesce(strong(c)["credit"] >= EVIDENCE, F.lit(False))
        for why, holds in _vetoes(request, c, strong(c)).items():
            vetoes[f"_{why}{i}"] = matched & holds
    told = told.withColumns(vetoes)
    vetoed = lambda i: reduce(lambda a, b: a | b, [F.col(k) for k in vetoes if k.endswith(str(i)) and k.strip("_abcdefghijklmnopqrstuvwxyz") == str(i)], F.lit(False))
    credits = [F.when(vetoed(i), F.least(strong(c)["credit"], F.lit(VETOED))).otherwise(F.coalesce(strong(c)["credit"], F.lit(0.0))) for i, c in enumerate(wanted)]
    lost = F.array(*[F.when(vetoed(i), F.lit(c.name)) for i, c in enumerate(wanted)]) if wanted else F.array().cast("array<string>")
    optional = [c.name for c in request.extras]
    shown = F.map_filter("matches", lambda k, m: (m["credit"] >= F.when(k.isin(*optional), OPTIONAL).otherwise(EVIDENCE) if optional else m["credit"] >= EVIDENCE) & ~F.coalesce(F.array_contains(F.array_compact("_lost"), k), F.lit(False)))
    told = told.withColumns({"_credits": F.array(*credits) if credits else F.array().cast("array<double>"), "_lost": lost}).withColumn("_shown", shown)

    cells = F.arrays_zip("fields", "kinds")
    quantity = F.exists(cells, lambda x: x["kinds"].isin(*QUANTITY_KINDS) & ~F.array_contains("timed_names", x["fields"]["name"]))
    measures = [i for i, c in enumerate(wanted) if c.kind == "measure"]
    mean = F.aggregate("_credits", F.lit(0.0), lambda a, x: a + x) / max(len(wanted), 1)
    told = told.withColumn("_quantity", quantity)
    measured = reduce(and_, [F.col("_credits")[i] >= EVIDENCE for i in measures], F.col("_quantity")) if wanted else F.col("_quantity") & F.lit(request.shape != "records")
    if request.shape == "either":
        measured = measured & ~F.col("method").isin(*SENTENCES)  # nobody asked for a number, so one in a sentence is no answer
    record = verdicts.record_verdict(F.col("fields"), today, F.col("kinds"))
    nothing = F.lit(None).cast("struct<ok:boolean,partial:boolean,coverage:double,title_field:string>")
    told = told.withColumns({"_coverage": mean if wanted else F.when(F.col("_quantity"), 1.0).otherwise(0.4), "_measured": measured})
    told = told.withColumn("_record", F.when(~F.col("_measured"), record) if request.shape != "values" else nothing)

    # Period and relevance
    series = F.size(F.filter("fields", lambda x: parse_period(F.replace(x["name"], F.lit("_"), F.lit("/")), today).isNotNull())) >= SERIES
    first = F.coalesce(*[F.try_element_at("_shown", F.lit(wanted[i].name))["field"] for i in measures]) if measures else F.lit(None).cast("string")
    told = told.withColumn("measure", F.when(F.col("_quantity") & ~series, F.coalesce(first, F.lit(""))))
    told = with_relevance(resolve_periods(told, today), request.subject, request.places, "_hit")
    told = told.withColumn("_span", parse_period(F.col("period"), today))
    window = request.window
    inside = overlaps(F.col("_span"), *(F.lit(w).cast("date") for w in window)) if window else F.lit(True)
    told = told.withColumn("_out", F.coalesce(F.col("_span").isNotNull() & ~inside, F.lit(False)) if window else F.lit(False))
    ok = F.coalesce(F.col("_record.ok"), F.lit(False))
    undated = ok & (F.col("_span").isNull() | F.col("inferred")) if window else F.lit(False)
    told = told.withColumns({"_undated": undated, "_recorded": ok & ~undated})

    # Parts, score, gates
    generic = F.size(F.filter("fields", lambda x: x["name"].rlike(GENERIC_NAME))) / F.greatest(F.lit(1), F.size("fields"))
    filled = F.size(F.filter("fields", lambda x: F.coalesce(F.trim(x["value"]), F.lit("")) != ""))
    rich = F.least(F.lit(1.0), filled / 4)
    extra = [F.coalesce(F.try_element_at("matches", F.lit(c.name))["credit"], F.lit(0.0)) for c in request.extras]
    parts = {
        "coverage": F.round(F.when(F.col("_recorded"), F.greatest("_coverage", "_record.coverage")).otherwise(F.col("_coverage")), 3),
        "relevance": F.col("relevance"),
        "temporal": F.round(verdicts.temporal_score(F.col("_span"), F.col("confidence"), window), 3),
        "extraction": F.round(verdicts.extraction_score(F.col("method"), F.size("fields"), generic, given), 3),
        "completeness": F.round(0.5 * sum(extra[1:], extra[0]) / len(extra) + 0.5 * rich if extra else 0.2 + 0.8 * rich, 3),
        "source": F.round(F.least(F.lit(1.0), verdicts.source_score(F.coalesce(host_of(F.col("url")), F.lit("")), F.col("published_at").isNotNull() | F.col("modified_at").isNotNull(), F.coalesce("title", F.lit("")) != "")), 3),
    }
    told = told.withColumn("parts", F.struct(*[c.cast("double").alias(k) for k, c in parts.items()], F.round("_noise.probability", 3).alias("noise")))
    total = sum((w * F.col(f"parts.{k}") for k, w in verdicts.WEIGHTS.items()), F.lit(0.0)) - verdicts.NOISE_WEIGHT * F.col("_noise.probability")
    data, answered = F.col("_noise.role") == "data", F.col("_measured") | F.col("_recorded")
    told = told.withColumn("score", F.when(data, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3)).otherwise(0.0))
    about = F.col("relevance") >= verdicts.RELEVANT if request.subject else F.lit(True)
    gates = answered & ~F.col("_out") & about
    partial = (F.col("score") >= verdicts.PARTIAL) & (F.col("_quantity") | F.coalesce(F.col("_record.partial"), F.lit(False))) & (answered | (F.col("relevance") >= HALF))
    tier = F.when(~data, "noise").when(gates & (F.col("score") >= verdicts.HIGH), "high").when(gates & (F.col("score") >= verdicts.USABLE), "usable").when(partial, "partial").otherwise("low")
    astray = ~F.col("_hit") if request.subject and request.named_source else F.lit(False)
    told = told.withColumn("tier", tier)
    status = F.when(F.col("tier").isin("high", "usable"), "accepted").when(~data | astray, "rejected").otherwise("partial")

    reasons = F.array_compact(F.array(
        F.when(~data, F.concat(F.lit("not data: "), F.col("_noise.role"))),
        *[F.when(data & F.col(k), F.lit(f"{wanted[int(k.strip('_abcdefghijklmnopqrstuvwxyz'))].name} of the sentence: {k.strip('_0123456789')}")) for k in vetoes],
        *[F.when(data & ~F.map_contains_key("_shown", F.lit(c.name)), F.lit(f"no value for {c.name}")) for c in ([] if request.stand_in else wanted)],
        F.when(data & ~F.col("_hit"), F.lit("subject not mentioned")),
        F.when(data & F.col("_undated"), F.lit("record without a date of its own")),
        F.when(data & F.col("_out"), F.lit("outside the window")),
        F.when(data & F.col("period").isNull() & F.lit(window is not None), F.lit("no period")),
    ))
    as_record = F.struct(F.col("_record.title_field").alias("field"), F.col("_record.coverage").alias("credit"), F.lit("record").alias("via"))
    matches = F.when(F.col("_recorded"), F.map_concat("_shown", F.create_map(F.lit("record"), as_record))).otherwise(F.col("_shown"))
    tidy = F.when(F.col("_recorded"), _tidy_record()).otherwise(_tidy(request))
    done = told.withColumns({
        "status": status,
        "reasons": reasons,
        "matches": F.when(data, matches).otherwise(F.create_map().cast("map<string,struct<field:string,credit:double,via:string>>")),
        "normalized": F.when(data, tidy).otherwise(F.array().cast(FIELDS)),
        "role": F.col("_noise.role"),
        "noise": F.col("_noise.probability"),
        **{k: F.col(f"_span.{v}") for k, v in (("period_start", "start"), ("period_end", "end"), ("granularity", "granularity"))},
    })
    out = ("status", "tier", "score", "relevance", "parts", "matches", "normalized", "reasons", "role", "noise", "period", "period_start", "period_end", "granularity", "basis", "inferred", "confidence")
    return done.select(*[F.col(f"`{c}`") for c in rows.columns if c not in out], *out)


def _tidy_record() -> Column:
    """A record's own fields, the one that names it first; empty ones and its series left out."""
    title = F.col("_record.title_field")
    rest = F.filter("fields", lambda x: (x["name"] != title) & (x["name"] != "series") & (F.coalesce(F.trim(x["value"]), F.lit("")) != ""))
    return F.concat(F.filter("fields", lambda x: x["name"] == title), rest)


def _humane(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"[_\s]+", " "))


def _tidy(request: Request) -> Column:
    """Period, series, required concepts, optional ones, and what is left of the row, each name once.

    Without a series of its own, a row takes the name of a measured column that says more than the concept.
    """
    fields = F.col("fields")
    pair = lambda name, value: F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), value.alias("value"))
    match = lambda c: F.try_element_at("_shown", F.lit(c.name))
    own = F.coalesce(F.nullif(_value(fields, "series"), F.lit("")), F.nullif(_value(fields, "label"), F.lit("")))
    says_more = lambda c: F.when(match(c).isNotNull() & ~match(c)["via"].isin("value_type", "text") & ~match(c)["field"].rlike(GENERIC_NAME) & (F.array_join(tokens(match(c)["field"]), " ") != c.name), _humane(match(c)["field"]))
    series = F.coalesce(own, *[says_more(c) for c in request.wanted])
    asked = [*request.wanted, *request.extras]
    head = F.array_compact(F.array(F.when(F.col("period").isNotNull(), pair("period", F.col("period"))), F.when(series.isNotNull(), pair("series", series)), *[F.when(match(c).isNotNull(), pair(c.name, _value(fields, match(c)["field"]))) for c in asked]))
    used = F.concat(F.col("timed_names"), F.array(F.lit("series"), F.lit("label")), F.array_compact(F.array(F.lit(None).cast("string"), *[match(c)["field"] for c in asked])), F.transform(head, lambda x: x["name"]))
    kept = F.transform(F.filter(F.arrays_zip(fields.alias("fields"), F.col("kinds")), lambda x: ~F.array_contains(used, x["fields"]["name"]) & (x["kinds"] != "empty")), lambda x: x["fields"])
    return F.concat(head, kept)


def classify(rows: DataFrame, request: Request) -> DataFrame:
    """`score_rows`, then the blocks of each page judged as a whole: rows of weak or repeating ones are partial at best.

    Rows need a block_id as well; null or empty where a row stands alone.
    """
    scored = spool(score_rows(rows, request), "scored")  # read three times below
    first = F.coalesce(*[F.try_element_at("matches", F.lit(c.name))["field"] for c in request.wanted]) if request.wanted else F.lit(None).cast("string")
    measured = _value(F.col("fields"), first)
    of = lambda name: F.coalesce(_value(F.col("normalized"), name), F.lit(""))
    judged = scored.select(
        F.col("row").alias("pos"), F.col("url").alias("source_url"), F.coalesce(host_of(F.col("url")), F.col("url")).alias("site"), "block_id", "status",
        F.col("parts.coverage").alias("coverage"), "relevance", F.when(F.coalesce(measured, F.lit("")) != "", value_kind(measured, request.today)).alias("kind"),
        F.map_contains_key("matches", F.lit("record")).alias("is_record"), of("period").alias("period"), of("series").alias("series"), to_number(measured).alias("number"),
    )
    after = apply_block_support(judged).select(F.col("pos").alias("row"), F.col("status").alias("_status"))
    demoted = F.col("_status").isNotNull() & (F.col("status") != F.col("_status"))
    joined = scored.join(after, "row", "left")
    return joined.withColumns({"tier": F.when(demoted, "partial").otherwise(F.col("tier")), "status": F.coalesce("_status", "status")}).drop("_status")


# --- queries

ASKED = Request((concept("price"),), subject=("parcel",), window=("1993-01-01", "1995-12-31"))


def rows_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows whose columns, subject, period and surroundings vary; customers are their blocks."""
    o = spread(table(spark, sf_dir, "orders"))
    whole, urgent = F.floor("o_totalprice").cast("string"), F.substring("o_orderpriority", 1, 1)
    pair = lambda name, value: F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), value.alias("value"))
    name = F.when(urgent == "1", "price").when(urgent == "2", "listed_cost").when(urgent == "3", "amount").when(urgent == "4", "weight").otherwise("remark")
    value = F.when(urgent.isin("1", "2", "3"), F.concat(F.lit("$"), whole)).when(urgent == "4", F.concat(F.lit("12"), F.lit(" kg"))).otherwise("nothing to say of it")
    year = pair("year", F.when(F.col("o_orderkey") % 5 > 0, F.year("o_orderdate").cast("string")))
    topic = pair("topic", F.when(F.col("o_orderstatus") == "F", "parcel post").otherwise("some other post"))
    none = F.lit(None).cast("string")
    return o.select(
        F.col("o_orderkey").alias("row"), F.array(year, pair(name, value), topic).alias("fields"),
        F.when(F.col("o_custkey") % 2 == 0, "html_table").otherwise("repeated_region").alias("method"),
        F.when(F.col("o_orderstatus") == "O", "Parcels of the north").alias("context"), none.alias("context_kind"),
        F.when(F.col("o_orderkey") % 3 == 0, "Parcels").alias("title"), F.lit("https://post.example.org/list").alias("url"), none.alias("coverage"),
        none.cast("date").alias("modified_at"), none.cast("date").alias("published_at"), none.cast("date").alias("fetched_at"),
        F.col("o_custkey").cast("string").alias("block_id"),
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy = F.array_join(F.transform("normalized", lambda x: F.concat_ws("=", x["name"], x["value"])), "; ")
    return score_rows(rows_of_orders(spark, sf_dir), ASKED).select(F.col("row").alias("o_orderkey"), "status", "tier", "score", "relevance", "period", tidy.alias("tidy"))


QUERIES = {"scored_observations": _scored}
ORACLE = {
    "scored_observations": """WITH r AS (
  SELECT o_orderkey, substring(o_orderpriority, 1, 1) AS u, '$' || CAST(floor(o_totalprice) AS BIGINT) AS money, CAST(year(o_orderdate) AS VARCHAR) AS y, o_orderkey % 5 > 0 AS dated,
    CASE o_orderstatus WHEN 'F' THEN 'parcel post' ELSE 'some other post' END AS topic, o_custkey % 2 = 0 AS tabular, o_orderkey % 3 = 0 AS titled,
    CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE WHEN o_orderstatus = 'O' THEN 0.9::DOUBLE WHEN o_orderkey % 3 = 0 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS relevance FROM orders),
p AS (SELECT *, dated AND (y < '1993' OR y > '1995') AS outside, u IN ('1', '2', '3') AS measured, u <> '5' AS quantity,
    CASE u WHEN '1' THEN 1.0::DOUBLE WHEN '2' THEN 0.9::DOUBLE WHEN '3' THEN 0.62::DOUBLE ELSE 0.0::DOUBLE END AS coverage,
    CASE WHEN NOT dated THEN 0.2::DOUBLE WHEN y < '1993' OR y > '1995' THEN 0.0::DOUBLE ELSE 0.98::DOUBLE END AS temporal,
    CASE WHEN tabular THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS extraction, CASE WHEN dated THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS completeness,
    CASE WHEN titled THEN 0.7::DOUBLE ELSE 0.65::DOUBLE END AS source FROM r),
s AS (SELECT *, round(greatest(0.0::DOUBLE, 0.30::DOUBLE * coverage + 0.22::DOUBLE * relevance + 0.18::DOUBLE * temporal + 0.12::DOUBLE * extraction + 0.10::DOUBLE * completeness + 0.08::DOUBLE * source), 3) AS score FROM p),
t AS (SELECT *, CASE WHEN measured AND NOT outside AND relevance >= 0.35 AND score >= 0.72 THEN 'high' WHEN measured AND NOT outside AND relevance >= 0.35 AND score >= 0.55 THEN 'usable'
    WHEN score >= 0.38 AND quantity AND (measured OR relevance >= 0.5) THEN 'partial' ELSE 'low' END AS tier FROM s)
SELECT o_orderkey, CASE WHEN tier IN ('high', 'usable') THEN 'accepted' ELSE 'partial' END AS status, tier, score, relevance, CASE WHEN dated THEN y END AS period,
  CASE WHEN dated THEN 'period=' || y || '; ' ELSE '' END || CASE u WHEN '2' THEN 'series=listed cost; ' ELSE '' END ||
  CASE WHEN measured THEN 'price=' || money WHEN u = '4' THEN 'weight=12 kg' ELSE 'remark=nothing to say of it' END || '; topic=' || topic AS tidy FROM t""",
}
