"""Requests in words to requirements: subject, measures, dimensions, sources, window and the kind of answer.

A request is a table of words. What a word is (a measure, a dimension, a word of time, a filler) is worked out once for every
distinct word and joined; words that are none of these run together into phrases, found as islands between the others by one
running count. Everything a request says is then an aggregate by request, so a day's requests are read like one.
"""

from __future__ import annotations

from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.functions.strings import STOPWORDS, similarity
from gleanspark.functions.temporal import resolve_window, without_windows
from gleanspark.lineage import spread
from gleanspark.operators.concepts import IDENTIFIER_HEADS, LEXICON, UNIT_TOKENS, corrected, word_class, words_of
from gleanspark.sources.tables import table

# Words that rank, words that a window leaves behind, words before a source, months, wordings that ask for numbers.
QUALIFIERS = ("top", "best", "worst", "most", "least", "major", "leading", "largest", "biggest", "smallest", "highest", "lowest", "popular", "famous", "main", "total", "overall")
DANGLING = ("in", "of", "for", "from", "over", "during", "since", "between", "the", "by", "to", "and")
SOURCE_MARKERS = ("from", "on", "at", "via", "using", "within", "site", "portal", "website", "database")
MONTH_WORDS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
QUANTITATIVE = (
    r"(?i)\b(?:number of|how many|count of|counts? by|total (?:number|count|of)|percentage|percent(?:age)? of|"
    r"share of|proportion of|ratio|average|mean|median|per capita|per (?:person|household|state|district|"
    r"year|month|day)|by (?:year|month|quarter|week|day|season|decade|state|district|region)|year[- ]on[- ]year|"
    r"over time|time series|trend|growth|statistics|stats)\b"
)
HEAD_CLASSES = ("value", "quantity", "production", "population")
SUBJECTS, MENTIONS, ENTITIES, HEADS, MEASURES, QUERIES_OF = 12, 4, 8, 12, 3, 4
WORD = r"[A-Za-z][A-Za-z0-9&+.'-]*"
NEAR = 0.85
TODAY = date(2026, 9, 30)


def windows(text: Column, today: date) -> Column:
    """(expression, start, end, granularity, relative, rest) of each request; rest is its text without words of time."""
    kind = pa.struct([("expression", pa.string()), ("start", pa.date32()), ("end", pa.date32()), ("granularity", pa.string()), ("relative", pa.bool_()), ("rest", pa.string())])

    @F.arrow_udf("struct<expression:string,start:date,end:date,granularity:string,relative:boolean,rest:string>")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            w = resolve_window(t or "", today)
            said = {"expression": w.expression, "start": w.start, "end": w.end, "granularity": w.granularity, "relative": w.relative} if w else {}
            out.append(said | {"rest": without_windows(t or "")})
        return pa.array(out, kind)

    return of(text)


def word_facts(words: DataFrame) -> DataFrame:
    """(lowered, token, corrected, class, filler) of the distinct values of column lowered."""

    @F.arrow_udf("struct<token:string,corrected:string,class:string,filler:boolean>")
    def of(given: pa.Array) -> pa.Array:
        out = []
        for w in given.to_pylist():
            parts = words_of(w)
            token = parts[0] if len(parts) == 1 else w
            filler = not token or token in STOPWORDS or w in STOPWORDS or token in UNIT_TOKENS or w in MONTH_WORDS
            out.append({"token": token, "corrected": corrected(token), "class": None if filler else word_class(token), "filler": filler})
        return pa.array(out, pa.struct([("token", pa.string()), ("corrected", pa.string()), ("class", pa.string()), ("filler", pa.bool_())]))

    return words.select("lowered").distinct().withColumn("f", of.asNondeterministic()("lowered")).select("lowered", "f.*")


def request_words(requests: DataFrame, today: date, key: str = "request_id", text: str = "text") -> DataFrame:
    """(key, pos, word, lowered, before, token, corrected, class, filler, run): the words of each request without its time."""
    plain = requests.select(key, windows(F.regexp_replace(F.coalesce(text, F.lit("")), r"https?://\S+", " "), today)["rest"].alias("rest"))
    words = plain.select(key, F.regexp_extract_all("rest", F.lit(WORD), F.lit(0)).alias("words")).select(key, "words", F.posexplode("words").alias("pos", "raw"))
    words = words.withColumn("word", F.regexp_replace("raw", r"^[.'\-]+|[.'\-]+$", ""))
    before = F.when(F.col("pos") > 0, F.lower(F.element_at("words", F.greatest(F.col("pos"), F.lit(1)))))
    words = words.select(key, "pos", "word", F.lower("word").alias("lowered"), before.alias("before"))
    known = words.join(word_facts(words), "lowered")
    free = ~F.col("filler") & F.col("class").isNull()
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return known.withColumn("run", F.when(free, F.sum((~free).cast("int")).over(so_far)))


def requirements(requests: DataFrame, today: date, countries: list[str] = (), key: str = "request_id", text: str = "text") -> DataFrame:
    """One row a request: window, subject, heads, required, optional, aliases, mentions, entities, shape, corrected, queries.

    Subject: the words between fillers and concepts, and runs of them as phrases, in order of their ends. Required: up to
    three classes of measures that are named, "value" where only the wording asks for numbers; further ones and dimensions
    are optional. Shape: quantities, or either where no number is asked for. Heads: single words of the subject that could be
    counted. Empty and null texts ask for nothing of either shape.
    """
    given = requests.select(key, F.coalesce(text, F.lit("")).alias("text")).withColumn("w", windows(F.col("text"), today))
    words = request_words(requests, today, key, text)
    kinds = F.create_map(*[F.lit(x) for k, (kind, _) in LEXICON.items() for x in (k, kind)])
    kind = F.when(F.col("class") == "period", "time").otherwise(F.element_at(kinds, F.col("class")))
    words = words.withColumn("kind", F.when(F.col("class").isNotNull(), kind))

    free = words.where("run IS NOT NULL")
    singles = free.select(key, F.col("token").alias("term"), F.struct(F.col("pos"), F.lit(0).alias("b")).alias("at"))
    runs = free.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("r")).where(F.size("r") > 1)
    phrases = runs.select(key, F.array_join(F.transform("r", lambda x: x["token"]), " ").alias("term"), F.struct(F.element_at("r", -1)["pos"].alias("pos"), F.lit(1).alias("b")).alias("at"))
    ordered = lambda rows, what, most: rows.groupBy(key, what).agg(F.min("at").alias("at")).groupBy(key).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(what).alias("x")))), lambda x: x["x"]), 1, most).alias("o"))
    subject = ordered(singles.unionByName(phrases), "term", SUBJECTS).withColumnRenamed("o", "subject")
    marked = free.where(F.col("before").isin(*SOURCE_MARKERS) & (F.length("token") >= 3)).select(key, "token", F.col("pos").alias("at"))
    acronym = (F.col("word") == F.upper("word")) & F.length("word").between(2, 6) & F.col("word").rlike("[A-Z]")
    proper = F.col("word").rlike("^[A-Z]") & (F.col("word") != F.upper("word")) & (F.col("pos") > 0)
    named = free.where(acronym | proper).select(key, "word", F.col("pos").alias("at"))
    concepts = words.where("kind IN ('measure', 'dimension')").select(key, "class", "kind", F.col("pos").alias("at"), F.array_except(F.array_distinct(F.array("corrected", "token")), F.array("class")).alias("said"))
    classes = concepts.groupBy(key, "class", "kind").agg(F.min("at").alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("said")))).alias("aliases"))
    by_kind = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("at", "class")))), lambda x: x["class"])
    asked = classes.groupBy(key).agg(by_kind("measure").alias("measures"), by_kind("dimension").alias("dimensions"), F.map_from_entries(F.collect_list(F.struct("class", "aliases"))).alias("aliases"))
    fixed = words.where("token <> corrected").groupBy(key).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "corrected")))).alias("fixes"))

    told = given
    for part in (subject, ordered(marked, "token", MENTIONS).withColumnRenamed("o", "mentions"), ordered(named, "word", ENTITIES).withColumnRenamed("o", "entities"), asked, fixed):
        told = told.join(part, key, "left")
    none = F.array().cast("array<string>")
    told = told.withColumns({c: F.coalesce(c, none) for c in ("subject", "mentions", "entities", "measures", "dimensions")})
    numbers = (F.size("measures") == 0) & F.col("text").rlike(QUANTITATIVE)
    required = F.when(numbers, F.array(F.lit("value"))).otherwise(F.slice("measures", 1, MEASURES))
    told = told.withColumns({"required": required, "optional": F.array_except(F.concat("dimensions", F.slice("measures", MEASURES + 1, 99)), required)})
    told = told.withColumn("shape", F.when(F.size("required") > 0, "quantities").otherwise("either"))
    places = F.concat(F.transform("entities", F.lower), F.array(*map(F.lit, map(str.lower, countries))).cast("array<string>"))
    counted = F.filter("subject", lambda t: ~t.contains(" ") & (F.length(t) >= 3) & ~F.array_contains(places, t) & ~t.isin(*sorted(IDENTIFIER_HEADS), *QUALIFIERS))
    heads = F.when((F.col("shape") == "either") | F.arrays_overlap("required", F.array(*map(F.lit, HEAD_CLASSES))), F.slice(counted, 1, HEADS)).otherwise(none)
    text_of = F.trim(F.regexp_replace("text", r"\s+", " "))
    spelt = F.aggregate(F.map_entries(F.coalesce("fixes", F.create_map().cast("map<string,string>"))), text_of, lambda a, x: F.regexp_replace(a, F.concat(F.lit(r"\b"), x["key"], F.lit(r"\b")), x["value"]))
    return told.select(
        key, F.col("w.expression").alias("expression"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.granularity").alias("granularity"),
        "subject", heads.alias("heads"), "required", "optional", "aliases", "mentions", "entities", "shape", spelt.alias("corrected"),
        default_queries(text_of, F.col("w"), F.col("shape"), F.col("mentions")).alias("queries"),
    )


def _trimmed(text: Column) -> Column:
    """A text without the words at its ends that a removed window leaves dangling."""
    loose = "|".join(DANGLING)
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"(?i)(?:(?:^|\s+)(?:{loose}))+\s*$", ""), rf"(?i)^\s*(?:(?:{loose})(?:\s+|$))+", ""))


def _years(window: Column) -> Column:
    first, last = F.year(window["start"]).cast("string"), F.year(window["end"]).cast("string")
    return F.when((window["granularity"] == "year") & (first != last), F.concat_ws("-", first, last)).otherwise(last)


def default_queries(text: Column, window: Column, shape: Column, mentions: Column) -> Column:
    """Up to four search queries in the request's own words: as written, then with its window and words for data or for lists.

    An empty request has none.
    """
    plain = F.coalesce(F.nullif(_trimmed(window["rest"]), F.lit("")), text)
    dated = F.concat_ws(" ", plain, F.when(window["end"].isNotNull(), _years(window)))
    with_words = lambda *ends: [F.concat_ws(" ", dated, F.lit(e)) for e in ends]
    numbers = F.array(text, *with_words("data table", "statistics", "dataset"))
    lists = F.concat(F.array(text), F.transform(F.slice(mentions, 1, 2), lambda m: F.concat(m, F.lit(" official website"))), F.array(*with_words("official", "list", "latest")))
    made = F.when(text == "", F.array().cast("array<string>")).when(shape == "quantities", numbers).otherwise(lists)
    return F.slice(F.array_distinct(F.filter(made, lambda q: F.trim(q) != "")), 1, QUERIES_OF)


def aligned_years(query: Column, window: Column) -> Column:
    """A query whose range of years is that of the request's window, where that is one of years."""
    return F.when(window["granularity"] == "year", F.regexp_replace(query, F.lit(r"\b(?:19|20)\d{2}\s*(?:-|–|to|\.\.)\s*(?:19|20)\d{2}\b"), _years(window))).otherwise(query)


def grounded(suggestions: DataFrame, requests: DataFrame, today: date, key: str = "request_id") -> DataFrame:
    """(key, name, grounded) of suggested concepts (key, name, aliases): whether the request's own words mention them.

    They do if they name its class, or hold, nearly spelt, every word of the name or of one of its aliases.
    """
    words = request_words(requests, today, key)
    ways = suggestions.select(key, "name", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("way", "said"))

    @F.arrow_udf("array<string>")
    def parts(names: pa.Array) -> pa.Array:
        return pa.array([[w for w in words_of(n or "") if w not in UNIT_TOKENS] for n in names.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similarity(x, y) >= NEAR for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    @F.arrow_udf("string")
    def group(names: pa.Array) -> pa.Array:
        return pa.array([next((c for c in map(word_class, reversed(words_of(n or ""))) if c), None) for n in names.to_pylist()], pa.string())

    needed = ways.select(key, "name", "way", F.explode(parts("said")).alias("part")).distinct()
    pairs = needed.join(words.select(key, F.col("corrected").alias("w")).distinct(), key)
    met = pairs.where(near.asNondeterministic()("part", "w")).select(key, "name", "way", "part").distinct().groupBy(key, "name", "way").agg(F.count("*").alias("met"))
    whole = needed.groupBy(key, "name", "way").agg(F.count("*").alias("all")).join(met, [key, "name", "way"], "left").groupBy(key, "name").agg(F.bool_or(F.col("all") == F.coalesce("met", F.lit(0))).alias("said"))
    classed = suggestions.select(key, "name", group("name").alias("class")).join(words.where("class IS NOT NULL").select(key, "class").distinct().withColumn("same", F.lit(True)), [key, "class"], "left")
    return classed.join(whole, [key, "name"], "left").select(key, "name", (F.coalesce("said", F.lit(False)) | F.coalesce("same", F.lit(False))).alias("grounded"))


# --- queries


def requests_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request of every customer: something in their market, in a country, over some years, or a list from a site."""
    c = spread(table(spark, sf_dir, "customer")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    goods, land, k = F.lower("c_mktsegment"), F.initcap("n_name"), F.col("c_custkey")
    n = (k % 4 + 2).cast("string")
    text = (
        F.when(k % 3 == 0, F.concat(goods, F.lit(" zorbel prices by region in "), land, F.lit(" over the last "), n, F.lit(" years")))
        .when(k % 3 == 1, F.concat(F.lit("Number of "), goods, F.lit(" depots since 201"), n))
        .otherwise(F.concat(F.lit("Zorbel fairs from Kontoor for "), goods, F.lit(" makers")))
    )
    return c.select(k.alias("request_id"), text.alias("text"))


def _requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = requirements(requests_of_customers(spark, sf_dir), TODAY)
    flat = lambda c: F.array_join(c, "|").alias(c)
    return told.select("request_id", "expression", "start", "end", *[flat(c) for c in ("subject", "heads", "required", "optional", "mentions", "entities")], "shape", F.element_at("queries", 2).alias("query"))


QUERIES = {"requirements_of_requests": _requirements}
ORACLE = {
    # "building" is a likely misspelling of "billing", a word of revenue, and so no subject
    "requirements_of_requests": """WITH r AS (SELECT c_custkey AS id, c_custkey % 3 AS kind, CAST(c_custkey % 4 + 2 AS BIGINT) AS n, lower(c_mktsegment) AS g, c_mktsegment = 'BUILDING' AS b, n_name AS land FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT id AS request_id, CASE kind WHEN 0 THEN 'last ' || n || ' years' WHEN 1 THEN 'since 201' || n END AS expression,
  CASE kind WHEN 0 THEN make_date(2027 - n, 1, 1) WHEN 1 THEN make_date(2010 + n, 1, 1) END AS start, CASE WHEN kind < 2 THEN DATE '2026-12-31' END AS "end",
  CASE kind WHEN 0 THEN CASE WHEN b THEN 'zorbel' ELSE g || '|zorbel|' || g || ' zorbel' END WHEN 1 THEN CASE WHEN b THEN 'depot' ELSE g || '|depot|' || g || ' depot' END
    ELSE 'zorbel|fair|zorbel fair|kontoor' || CASE WHEN b THEN '' ELSE '|' || g END END AS subject,
  CASE WHEN b OR kind = 0 THEN '' WHEN kind = 1 THEN g || '|depot' ELSE 'zorbel|fair|' || g END AS heads,
  CASE kind WHEN 0 THEN CASE WHEN b THEN 'revenue|price' ELSE 'price' END WHEN 1 THEN CASE WHEN b THEN 'revenue' ELSE 'value' END ELSE CASE WHEN b THEN 'revenue' ELSE '' END END AS required,
  CASE kind WHEN 0 THEN 'geography' WHEN 1 THEN '' ELSE 'entity' END AS optional, CASE kind WHEN 2 THEN 'kontoor' ELSE '' END AS mentions, CASE kind WHEN 2 THEN 'Kontoor' ELSE '' END AS entities,
  CASE WHEN kind = 2 AND NOT b THEN 'either' ELSE 'quantities' END AS shape,
  CASE kind WHEN 0 THEN g || ' zorbel prices by region in ' || upper(land[1]) || lower(land[2:]) || ' ' || (2027 - n) || '-2026 data table' WHEN 1 THEN 'Number of ' || g || ' depots ' || (2010 + n) || '-2026 data table'
    ELSE CASE WHEN b THEN 'Zorbel fairs from Kontoor for building makers data table' ELSE 'kontoor official website' END END AS query FROM r""",
}
