"""Address templates: which part of a record's id its address is made of, if one rule explains every record of a list.

Every slice of digits that occurs in its own record's address votes; a slice counts if all records of the list voted for it. The
addresses with their slices taken out must then be one and the same text, which is the template. So no record is special, and
a rule that fails for one record of millions is no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.lineage import spread
from gleanspark.sources.tables import table

LEAST = 4  # fixed value: characters of a slice, and of an id that is taken whole


def _taken(url: Column, piece: Column, number: Column) -> Column:
    """`url` with the first place of a piece, between other than digits, as {number}."""
    return F.regexp_replace(url, F.concat(F.lit(r"^(.*?)(?<!\d)"), piece, F.lit(r"(?!\d)")), F.concat(F.lit("$1{"), number.cast("string"), F.lit("}")))


def _piece(id_: Column, slice_: Column) -> Column:
    run = F.try_element_at(F.regexp_extract_all(id_, F.lit(r"\d+"), F.lit(0)), slice_["run"] + 1)
    return F.when(slice_["rest"], F.substring(run, slice_["start"] + 1, F.length(run))).otherwise(F.substring(run, slice_["start"] + 1, slice_["size"]))


def address_templates(observed: DataFrame, key: str = "list") -> DataFrame:
    """(key, n, template, slices) of lists of records (key, id, url): how addresses follow from ids.

    A whole id of four characters or more is {1}. Else slices of its runs of digits are {1}, {2} and so on: run and start
    count from 0; size is that of the slice, and rest says that it reaches to the run's end, whatever its length. Only https
    addresses count. Without a rule that gives every address the template is null. Rows with a null id or address make their
    list one without a rule; repeated rows count once.
    """
    rows = observed.select(key, F.col("id").cast("string").alias("id"), "url").distinct()
    whole = F.when((F.length("id") >= LEAST) & F.expr("instr(url, id) > 0"), F.concat(F.expr("substring(url, 1, instr(url, id) - 1)"), F.lit("{1}"), F.expr("substring(url, instr(url, id) + length(id))")))
    rows = rows.withColumn("whole", whole)
    # Texts are counted before the least of them is taken: counts need no sort of all rows, and a list has few of them or no rule
    wholes = rows.groupBy(key, "whole").agg(F.count("*").alias("n"))
    sizes = wholes.groupBy(key).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("whole").isNotNull(), F.col("n"))), F.lit(0)).alias("said"), F.min("whole").alias("one"), F.max("whole").alias("other"))
    runs = rows.select(key, "id", "url", F.posexplode(F.regexp_extract_all("id", F.lit(r"\d+"), F.lit(0))).alias("run", "digits")).where(F.length("digits") >= LEAST)
    starts = runs.select("*", F.explode(F.sequence(F.lit(0), F.length("digits") - LEAST)).alias("start"))
    cut = starts.select("*", F.explode(F.sequence(F.lit(LEAST), F.length("digits") - F.col("start"))).alias("size"))
    met = cut.where(F.rlike("url", F.concat(F.lit(r"(?<!\d)"), F.expr("substring(digits, start + 1, size)"), F.lit(r"(?!\d)"))))
    ends = F.col("start") + F.col("size") == F.length("digits")
    votes = met.withColumn("rest", F.explode(F.when(ends, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    # A slice to the end is one rule whatever its size. Rows are different and meet a rule once, so votes are plain counts
    size = F.when(F.col("rest"), F.lit(0)).otherwise(F.col("size"))
    agreed = votes.withColumn("least", F.col("size")).groupBy(key, "run", "start", size.alias("size"), "rest").agg(F.count("*").alias("votes"), F.min("least").alias("least")).join(sizes.select(key, "n"), key).where("votes = n")
    best = agreed.groupBy(key, "run").agg(F.max_by(F.struct("run", "start", "size", "rest"), F.struct("least", ~F.col("rest"), -F.col("start"))).alias("s"))
    chosen = best.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("slices"))
    made = rows.join(chosen, key)
    numbered = F.transform("slices", lambda s, i: F.struct(s.alias("s"), (i + 1).alias("i")))
    built = made.withColumn("template", F.aggregate(numbered, F.col("url"), lambda a, x: _taken(a, _piece(F.col("id"), x["s"]), x["i"])))
    sliced = built.groupBy(key, "template").agg(F.count("*").alias("of")).groupBy(key).agg(F.count("template").alias("templates"), F.min("template").alias("sliced"))
    told = sizes.join(sliced, key, "left").join(chosen, key, "left")
    by_id = (F.col("said") == F.col("n")) & (F.col("one") == F.col("other"))
    template = F.when(by_id, F.col("one")).when((F.col("templates") == 1), F.col("sliced"))
    secure = F.when(template.startswith("https://"), template)
    return told.select(key, "n", secure.alias("template"), F.when(secure.isNotNull() & ~F.coalesce(by_id, F.lit(False)), F.col("slices")).alias("slices"))


# --- queries


def notices_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notices with an id of year and number; the address holds all of it, both parts, none, or isn't secure."""
    o = table(spark, sf_dir, "orders")
    year, number, k = F.date_format("o_orderdate", "yyyy"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.col("o_custkey")
    id_ = F.concat(F.lit("N-"), year, F.lit("/"), number, F.lit("-x"))
    url = (
        F.when(k % 4 == 0, F.concat(F.lit("https://x.org/n?doc="), id_))
        .when(k % 4 == 1, F.concat(F.lit("https://x.org/"), number, F.lit("/of/"), year, F.lit(".html")))
        .when(k % 4 == 2, F.lit("https://x.org/about"))
        .otherwise(F.concat(F.lit("http://x.org/"), id_))
    )
    return spread(o.select("o_orderdate", "o_orderkey", "o_custkey")).select(k.alias("list"), id_.alias("id"), url.alias("url"))


QUERIES = {"address_templates": lambda s, d: address_templates(notices_of_customers(s, d)).select("list", "n", "template")}
ORACLE = {
    "address_templates": """SELECT o_custkey AS list, count(DISTINCT o_orderkey) AS n, CASE o_custkey % 4 WHEN 0 THEN 'https://x.org/n?doc={1}' WHEN 1 THEN 'https://x.org/{2}/of/{1}.html' END AS template FROM orders GROUP BY 1"""
}
