"""Support of page blocks, and suppression of blocks that repeat a stronger one of their site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.lineage import spool
from gleanspark.sources.tables import table

MIN_SUPPORT, OVERLAP = 0.30, 0.6  # fixed values
BLOCK = ("source_url", "block_id")


def block_support(rows: DataFrame) -> DataFrame:
    """(source_url, block_id, support, first_pos): mean of coverage, relevance and consistency over a block's rows.

    Rows: source_url, block_id, pos, coverage, relevance, kind (of the measured value, null without one), is_record.
    Consistency is the larger of the share of the commonest kind and the share of records, both of all rows.
    """
    key = ["source_url", "block_id"]
    named = rows.where(F.coalesce("block_id", F.lit("")) != "")
    by_kind = named.groupBy(*key, "kind").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("coverage", "relevance")], F.sum(F.col("is_record").cast("long")).alias("records"), F.min("pos").alias("pos"))
    all_kinds = by_kind.groupBy(*key).agg(
        F.sum("n").alias("n"),
        F.sum("coverage").alias("coverage"),
        F.sum("relevance").alias("relevance"),
        F.sum("records").alias("records"),
        F.max(F.when(F.col("kind").isNotNull(), F.col("n"))).alias("modal"),
        F.min("pos").alias("first_pos"),
    )
    consistency = F.greatest(F.coalesce("modal", F.lit(0)), "records") / F.col("n")
    support = (F.col("coverage") / F.col("n") + F.col("relevance") / F.col("n") + consistency) / 3
    return all_kinds.select(*key, F.round(support, 3).alias("support"), "first_pos")


def demote_unsupported(rows: DataFrame) -> DataFrame:
    """Rows with their block's support; accepted ones of blocks below MIN_SUPPORT become partial."""
    return _demoted(rows.join(block_support(rows).drop("first_pos"), list(BLOCK), "left"))


def _demoted(known: DataFrame) -> DataFrame:
    weak = (F.col("status") == "accepted") & (F.col("support") < MIN_SUPPORT)
    return known.withColumn("status", F.when(weak, "partial").otherwise(F.col("status")))


def _suppressed(known: DataFrame) -> DataFrame:
    """What `overlap_suppression` says, of rows that have their block's support and first_pos.

    Values are made and compared by one shuffle each: those of a block where its rows are, those of a site by signature (one row a
    block meets there). Then they are kept, since their blocks' shares and the rows that are lost both need them.
    """
    accepted = known.where("status = 'accepted' AND number IS NOT NULL AND source_url IS NOT NULL AND block_id <> ''")
    signature = F.xxhash64("period", F.lower("series"), F.round("number", 6)).alias("signature")
    values = accepted.select("site", *BLOCK, "support", "first_pos", signature, "pos").groupBy("site", *BLOCK, "support", "first_pos", "signature").agg(F.max("pos").alias("pos"))
    place = F.struct(F.col("support").isNull().alias("none"), (-F.col("support")).alias("support"), "first_pos", *BLOCK)
    earliest = F.min(place).over(Window.partitionBy("site", "signature"))
    seen = spool(values.select("site", *BLOCK, "pos", (earliest < place).alias("repeated")), "values")
    share = seen.groupBy("site", *BLOCK).agg(F.avg(F.col("repeated").cast("int")).alias("share")).where(F.col("share") >= OVERLAP)
    same = F.col("v.site").eqNullSafe(F.col("b.site")) & F.col("v.source_url").eqNullSafe(F.col("b.source_url")) & (F.col("v.block_id") == F.col("b.block_id"))
    lost = seen.where("repeated").alias("v").join(share.alias("b"), same, "left_semi").select("pos", F.lit(True).alias("_lost"))
    return known.join(lost, "pos", "left").withColumn("status", F.when(F.col("_lost"), "partial").otherwise(F.col("status"))).drop("_lost")


def overlap_suppression(rows: DataFrame) -> DataFrame:
    """Accepted rows that repeat a stronger block of their site become partial.

    Blocks of a site are taken by falling support, then by first row. A block of whose distinct values (period, series,
    number to 6 places) 60 of 100 are held by blocks before it loses those rows; its values count for the later ones either
    way. So a value is a repeat where the first block of its site that holds it comes before this one, and no walk over a
    site's values is needed. Of rows of a block that share a value, the last stands for it.
    """
    return _suppressed(rows.join(block_support(rows), list(BLOCK), "left")).select(*rows.columns)


def apply_block_support(rows: DataFrame) -> DataFrame:
    """Both steps in their order: rows of weak blocks are demoted first, so they neither repeat nor are repeated.

    Demotion changes no support, so both read it from one join.
    """
    return _suppressed(_demoted(rows.join(block_support(rows), list(BLOCK), "left"))).drop("first_pos")


# --- queries


def rows_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations: suppliers are sites, orders modulo 9 their blocks."""
    li = table(spark, sf_dir, "lineitem")
    whole = F.col("l_quantity").cast("int")
    return li.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pos"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_url"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("site"),
        F.concat(F.lit("table#"), (F.col("l_orderkey") % 9).cast("string")).alias("block_id"),
        (F.floor(F.col("l_discount") * 100) / 16).alias("coverage"),
        (F.floor(F.col("l_tax") * 100) / 16).alias("relevance"),
        F.when(whole % 3 == 0, "number").when(whole % 3 == 1, "money").alias("kind"),
        (whole % 10 == 0).alias("is_record"),
        F.when(whole % 4 > 0, "accepted").otherwise("rejected").alias("status"),
        F.year("l_shipdate").cast("string").alias("period"),
        F.col("l_returnflag").alias("series"),
        (whole % 3).cast("double").alias("number"),
    )


QUERIES = {
    "block_support": lambda s, d: block_support(rows_of_items(s, d)).drop("first_pos"),
    "demote_unsupported": lambda s, d: demote_unsupported(rows_of_items(s, d)).groupBy("source_url", "status").agg(F.count("*").alias("n")),
    "overlap_suppression": lambda s, d: overlap_suppression(rows_of_items(s, d)).groupBy("site", "status").agg(F.count("*").alias("n")),
    "block_support_and_overlap": lambda s, d: apply_block_support(rows_of_items(s, d)).groupBy("site", "status").agg(F.count("*").alias("n")),
}
_B = """WITH r AS (SELECT concat_ws('-', lpad(l_orderkey::VARCHAR, 19, '0'), lpad(l_linenumber::VARCHAR, 19, '0'), lpad(l_partkey::VARCHAR, 19, '0'), lpad(l_suppkey::VARCHAR, 19, '0')) AS pos,
  year(l_shipdate) AS period, l_returnflag AS series, CAST(trunc(l_quantity) AS INT) % 3 AS number, 's' || l_suppkey AS source_url, 'table#' || (l_orderkey % 9) AS block_id, floor(l_discount * 100) / 16 AS coverage, floor(l_tax * 100) / 16 AS relevance,
  CASE CAST(trunc(l_quantity) AS INT) % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'money' END AS kind, CAST(trunc(l_quantity) AS INT) % 10 = 0 AS is_record,
  CASE WHEN CAST(trunc(l_quantity) AS INT) % 4 > 0 THEN 'accepted' ELSE 'rejected' END AS status FROM lineitem),
k AS (SELECT source_url, block_id, kind, count(*) AS n, sum(coverage) AS c, sum(relevance) AS v, count(*) FILTER (is_record) AS recs, min(pos) AS p FROM r GROUP BY ALL),
b AS (SELECT source_url, block_id, round((sum(c) / sum(n) + sum(v) / sum(n) + greatest(coalesce(max(n) FILTER (kind IS NOT NULL), 0), sum(recs)) / sum(n)) / 3, 3) AS support, min(p) AS first_pos FROM k GROUP BY 1, 2)"""


def _overlap_sql(rows: str) -> str:
    """Rows of the relation `rows` by site and status after the walk over blocks, strongest first."""
    return f"""v AS (SELECT source_url, block_id, support, first_pos, period, series, number, max(pos) AS pos FROM {rows} JOIN b USING (source_url, block_id) WHERE status = 'accepted' GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY source_url, period, series, number ORDER BY support DESC, first_pos, block_id) > 1 AS again FROM v),
x AS (SELECT *, avg(again::INT) OVER (PARTITION BY source_url, block_id) AS share FROM w),
lost AS (SELECT pos FROM x WHERE again AND share >= 0.6)
SELECT source_url AS site, CASE WHEN pos IN (SELECT pos FROM lost) THEN 'partial' ELSE status END AS status, count(*) AS n FROM {rows} GROUP BY 1, 2"""


ORACLE = {
    "block_support": f"{_B} SELECT source_url, block_id, support FROM b",
    "demote_unsupported": f"""{_B} SELECT source_url, CASE WHEN status = 'accepted' AND support < 0.3 THEN 'partial' ELSE status END AS status, count(*) AS n
FROM r JOIN b USING (source_url, block_id) GROUP BY 1, 2""",
    "overlap_suppression": f"{_B}, {_overlap_sql('r')}",
    "block_support_and_overlap": f"""{_B}, d AS (SELECT r.* REPLACE (CASE WHEN status = 'accepted' AND support < 0.3 THEN 'partial' ELSE status END AS status) FROM r JOIN b USING (source_url, block_id)), {_overlap_sql('d')}""",
}
