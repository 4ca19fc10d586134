"""Audit of filters in every order: what each removes, what it repeats, what it costs in good documents.

Every document is reduced to a mask of the filters that it fails. Four of them are conditions on its own text; the last
one, identical to the text of a smaller id, comes from partition refinement:
- documents are split by code-point length, then by the hashes of successive blocks of their texts, each block
  GROWTH times as long as all before it. After every step the classes of one document are dropped, so most documents
  are gone after their first FIRST code points, and a text of any length is read in few steps;
- the whole texts of what survives are compared: equal ones are merged by an aggregate that combines rows before the
  shuffle, and each class keeps its smallest id. A class of unequal texts (hashes that collide) is split by its texts.
The steps move hashes only, never texts; those are moved once, for survivors, dealt over SALTS so that no group of copies
is one task's work. Masks are then counted by part, and every count of the audit follows from those few sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm.common import quoted, spool, table

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
FIRST, GROWTH = 64, 16
SALTS = 8


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text, by letter."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def block_hashes(text: Column, longest: int) -> Column:
    """Hashes of the successive blocks of a text of at most `longest` code points."""
    found, begin, end = [], 0, FIRST
    while not found or begin < longest:
        found.append(F.xxhash64(F.substring(text, begin + 1, end - begin)))
        begin, end = end, end * GROWTH
    return F.array(*found)


def refined(marked: DataFrame, steps: int) -> DataFrame:
    """(class, n): the classes of more than one row after splitting by length, then by each of `steps` block hashes.

    `marked` has `length`, `hashes` and `class` (the hash of both).
    """
    key, alive = F.xxhash64("length"), marked.select("length", "hashes", "class")
    for step in range(steps + 1):
        if step:
            key = F.xxhash64(F.col("key"), F.element_at("hashes", step))
        alive = alive.withColumn("key", key)
        shared = alive.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        alive = spool(alive.join(shared, "key", "left_semi"), "alive")
    return alive.groupBy("class").agg(F.count("*").alias("n")).where("n > 1")


def _salted(df: DataFrame) -> DataFrame:
    """A row of `df` for every salt. What is salted here grows with the documents, so it is never broadcast."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(*of: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("salt"), *of), F.lit(SALTS)).cast("int")


def with_copies(docs: DataFrame, keep: Sequence[str] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, copy, *keep): one row per row of `docs`; `copy` is true where a row of a smaller id has the same text.

    `keep` names columns to carry. A null text counts as empty. Rows that repeat an id are no copies of each other by
    that alone. A null id is never smaller nor larger, so such rows are no copies and make none. Long texts are compared
    whole. An empty table gives an empty one.
    """
    whole = docs.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"), *[quoted(k) for k in keep])
    longest = whole.agg(F.max(F.length("text"))).first()[0] or 0
    hashed = whole.withColumns({"length": F.length("text"), "hashes": block_hashes(F.col("text"), longest)})
    hashed = hashed.withColumn("class", F.xxhash64("length", "hashes"))
    marked = spool(hashed.drop("text"), "block-hashes")
    steps = marked.select(F.size("hashes")).first()
    shared = spool(refined(marked, steps[0] if steps else 0).select("class"), "shared-classes")

    texts = hashed.where("doc_id IS NOT NULL").select("class", "doc_id", "text").withColumn("salt", _salt("doc_id"))
    survivors = texts.join(_salted(shared).hint("merge"), ["class", "salt"], "left_semi")
    same = spool(survivors.groupBy("class", "text").agg(F.min("doc_id").alias("least")), "equal-texts")
    one = same.groupBy("class").agg(F.count("*").alias("texts"), F.min("least").alias("least"))
    mixed = spool(one.where("texts > 1").select("class"), "mixed-classes")
    salted = marked.withColumn("salt", _salt("doc_id")).join(_salted(one.where("texts = 1").select("class", "least")).hint("merge"), ["class", "salt"], "left")
    rows = salted.join(mixed, "class", "left_anti") if (few := mixed.limit(1).count()) else salted
    found = rows.select("doc_id", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copy"), *[quoted(k) for k in keep])
    if few:  # classes that hash alike but differ: their rows are told apart by the text itself
        apart = hashed.join(mixed, "class").withColumn("salt", _salt("doc_id")).join(_salted(same.join(mixed, "class")), ["class", "text", "salt"], "left")
        found = found.unionByName(apart.select("doc_id", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copy"), *[quoted(k) for k in keep]))
    return found


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit's rows from (part, mask, good, toxic, n): documents of a part that fail the filters of `mask` (bit i: filter i).

    One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    orders = F.array(*[F.lit("".join(o)) for o in permutations(filters)])
    bit = {f: 1 << i for i, f in enumerate(filters)}
    each = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    mine = F.substring("filter_order", F.col("step"), F.lit(1))
    fails = lambda f: F.col("mask").bitwiseAND(F.lit(bit[f])) != 0
    gone = reduce(or_, ((F.instr("filter_order", f) < F.col("step")) & fails(f) for f in filters))
    own = F.coalesce(*[F.when(mine == f, fails(f)) for f in filters])
    only = F.coalesce(*[F.when(mine == f, F.col("mask") == bit[f]) for f in filters])
    each = each.withColumns({"filter": mine, "own": own, "gone": gone, "only": only})
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("long")
    here = F.col("own") & ~F.col("gone")
    rows = each.groupBy("part", "filter_order", "step", "filter").agg(
        total(~F.col("own") & ~F.col("gone")).alias("kept"),
        total(here).alias("removed"),
        total(F.col("own") & F.col("gone")).alias("redundant"),
        total(F.col("only")).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"),
        total(here & F.col("toxic")).alias("toxic_lost"),
    )
    shapley = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))  # a row for each part and filter
    return rows.join(shapley, ["part", "filter"]).drop("filter")


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of `docs` (doc_id, text and `part`) with `labels` (doc_id, quality, toxic).

    A null text counts as empty, a null part as the empty string. A document labelled more than once is good or toxic if
    one label says so; one without labels, or with null ones, is neither. Rows that repeat an id count as often as given.
    Long texts are read whole. Other columns may have any name. An empty table gives no rows, as it has no parts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = sum((c.cast("int") * (1 << i) for i, c in enumerate(conditions(text).values())), F.lit(0))
    masked = docs.select("doc_id", "text", F.coalesce(quoted(part), F.lit("")).alias("part"), bits.alias("mask"))
    marked = with_copies(masked, ("part", "mask"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    whole = F.col("mask") + F.col("copy").cast("int") * (1 << FILTERS.index("E"))
    sums = marked.join(known, "doc_id", "left").groupBy(
        "part", whole.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )
    return audit(spool(sums.agg(F.count("*").alias("n")), "masks"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of `documents` by language, with all 120 orders of five filters; odd rows as in `filter_audit`."""
    return filter_audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLE = {
    "op12_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
masks AS (
  SELECT part,
    [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
     coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM texts LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
sums AS (SELECT part, fails, good, toxic, count(*) AS n FROM masks GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM orders),
each AS (
  SELECT part, filter_order, step, substring(filter_order, step, 1) AS f, n, good, toxic,
    fails[ascii(substring(filter_order, step, 1)) - 64] AS own,
    len(list_filter([1, 2, 3, 4, 5], lambda i: i < step AND fails[ascii(substring(filter_order, i::INTEGER, 1)) - 64])) > 0 AS gone,
    len(list_filter(fails, lambda x: x)) = 1 AND fails[ascii(substring(filter_order, step, 1)) - 64] AS alone
  FROM sums, steps),
rows AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE NOT own AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE own AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE own AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (WHERE own AND NOT gone AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (WHERE own AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM each GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM rows"""
}
