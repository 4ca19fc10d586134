"""Personal data in texts, with DataFrame operations only.

Patterns propose spans, leftmost and without overlaps per kind. Validators confirm them: address parts up to 255,
Luhn for cards, digit counts for phones, mod-97 for account numbers (iban). Words near a span raise or lower its
score. The four base kinds stay whatever their score; the added kinds (iban, secret) need ADDED_SCORE. Everything
happens inside the row: no shuffle, so neither skew nor size of groups matters.

The patterns match exactly what the plain forms in the comments match, but possessive repeats and a look-behind on
the start of a run keep them linear and free of deep recursion on very long runs of digits or letters. `\\G` (the
end of the previous match) keeps the starts that a plain pattern would find right after another match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm.common import columns, free_prefix, quoted, table


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a cheap test; a text without it has no match
    base: float
    near: str  # words that raise the score
    far: str = ""  # words that lower it


KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write|kontakt|correo|courriel"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "ip|addr|host|server|adresse", "version|release|section"),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.7, "card|visa|credit|karte|tarjeta|carte", "order|invoice|isbn"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, "phone|call|tel|fax|mobile|whatsapp"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.8, "iban|bank|account|konto|cuenta|compte"),
    Kind("secret", r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+", "[0-9]", 0.3, "password|passwd|token|secret|api.?key|bearer"),
)
BASE_KINDS = ("email", "ip", "card", "phone")
CONTEXT = 32  # code points before a span that are searched for context words
NEAR, FAR, ADDED_SCORE = 0.3, 0.3, 0.6
_KEY_ID = r"^(AKIA|ASIA)[0-9A-Z]{16}$"
_CHUNK = 256
_PIECE = 4096  # code points of a text that are cut out together when it is rebuilt
_TRIMS = 3  # words behind an account number that its pattern may have taken along


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """True where the digits, at most 19, pass the Luhn checksum."""
    doubled = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(_characters(F.reverse(digits)), doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """True where an account number passes the mod-97 checksum."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(_characters(moved), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1


def _valid(kind: str, found: Column) -> Column:
    n = F.length(_digits(found))
    if kind == "ip":
        return F.forall(F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", "")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(_digits(found))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        return mod97(found)
    return F.lit(True)


def _without_tail(found: Column) -> Column:
    """The longest account number at the start of `found` that passes its checksum, words behind it left out; else `found`."""
    trimmed = [found]
    for _ in range(_TRIMS):
        trimmed.append(F.regexp_replace(trimmed[-1], r"\x20[A-Z0-9]{1,4}$", ""))
    return F.coalesce(*[F.when((F.length(t) > 14) & mod97(t), t) for t in trimmed], found)


def running_totals(values: Column, plus: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """For each element the sum (or what `plus` makes, from 0 on) of those before it; by chunks, so that long arrays don't cost their square in copies."""
    total = lambda part: F.aggregate(part, F.lit(0), plus)

    def chunk(c: Column) -> Column:
        start = F.struct(total(F.slice(values, 1, c * _CHUNK)).alias("sum"), F.array().cast("array<int>").alias("out"))
        add = lambda a, x: F.struct(plus(a["sum"], x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out"))
        return F.aggregate(F.slice(values, c * _CHUNK + 1, _CHUNK), start, add, lambda a: a["out"])

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")), chunk))


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _confirm(k: Kind, m: str):
    return lambda x: _valid(k.name, _without_tail(x[m]) if k.name == "iban" else x[m])


def _span(k: Kind, t: str, m: str, g: str, s: str):
    """From (match, gap before it, total before that gap) to the span with its score."""

    def of(x: Column) -> Column:
        start = x[s] + x[g]
        before = F.lower(F.substring(F.col(t), F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))))
        score = F.lit(k.base) + F.when(before.rlike(k.near), NEAR).otherwise(0.0)
        if k.far:
            score = score - F.when(before.rlike(k.far), FAR).otherwise(0.0)
        if k.name == "secret":
            score = F.when(x[m].rlike(_KEY_ID), 0.9).otherwise(score)
        length = F.length(_without_tail(x[m]) if k.name == "iban" else x[m])
        return F.struct(F.lit(k.name).alias("kind"), start.alias("start"), (start + length).alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    return of


def with_spans(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """`docs` with a column `out`: array of (kind, start, end, score), by kind in the order of KINDS, then by start.

    Positions count code points, ends are exclusive. A null or empty text has no spans; a very long one is searched as a
    whole. Every row is kept as it is, repeated ones too, with its columns of any name; one called `out` is replaced. An
    empty table gives an empty one.
    """
    p = free_prefix(docs)
    t, df, found = f"{p}t", docs.select(*columns(docs, out), F.coalesce(quoted(text), F.lit("")).alias(f"{p}t")), []
    for k in KINDS:
        m, g, s = f"{p}m_{k.name}", f"{p}g_{k.name}", f"{p}s_{k.name}"
        empty = F.array().cast("array<string>")
        df = df.withColumn(m, F.when(F.col(t).rlike(k.hint), F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))).otherwise(empty))
        df = df.withColumn(g, F.when(F.size(m) > 0, F.transform(F.slice(F.split(t, k.pattern, -1), 1, F.size(m)), F.length)).otherwise(F.array().cast("array<int>")))
        df = df.withColumn(s, F.when(F.size(m) > 0, running_totals(F.zip_with(m, g, lambda a, b: F.length(a) + b))).otherwise(F.array().cast("array<int>")))
        confirmed = F.filter(F.arrays_zip(m, g, s), _confirm(k, m))
        spans = F.transform(confirmed, _span(k, t, m, g, s))
        if k.name not in BASE_KINDS:
            spans = F.filter(spans, lambda x: x["score"] >= ADDED_SCORE)
        df = df.withColumn(f"{p}p_{k.name}", F.when(F.size(m) > 0, spans).otherwise(F.array().cast(_SPAN)))
        found.append(F.col(f"{p}p_{k.name}"))
    return df.select(*columns(docs, out), F.concat(*found).alias(out))


def mask(docs: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """`docs` with every span of its text replaced by `<KIND>`; overlapping spans become one mark, that of the first.

    A text without spans, a null or empty one stays as it is, and so do all rows, repeated ones too, and all other columns,
    whatever their names. An empty table gives an empty one.
    """

    p = free_prefix(docs)
    ordered, at, chunks = f"{p}ordered", f"{p}at", f"{p}chunks"
    size, empty = F.size(quoted(spans)), F.array().cast("array<string>")
    by_place = F.array_sort(F.transform(quoted(spans), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    df = docs.select(*columns(docs), by_place.alias(ordered)).withColumn(ordered, F.when(size > 0, F.col(ordered)))
    df = df.withColumn(at, running_totals(F.transform(ordered, lambda x: x["end"]), lambda a, x: F.greatest(a, x)))
    df = df.withColumn(chunks, F.when(size > 0, F.regexp_extract_all(quoted(text), F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))).otherwise(empty))

    def between(a: Column, b: Column) -> Column:
        """Code points a to b of the text, from the pieces that hold them only."""
        first = F.floor(a / _PIECE).cast("int")
        held = F.slice(chunks, first + 1, F.greatest(F.ceil(b / _PIECE).cast("int") - first, F.lit(0)))
        return F.substring(F.array_join(held, ""), a - first * _PIECE + 1, b - a)

    def piece(x: Column, done: Column) -> Column:
        return F.when(x["start"] >= done, F.concat(between(done, x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise("")

    last = F.array_max(F.transform(ordered, lambda x: x["end"]))
    rebuilt = F.concat(F.array_join(F.zip_with(ordered, at, piece), ""), between(last, F.length(quoted(text))))
    masked = F.when(size > 0, rebuilt).otherwise(quoted(text)).alias(text)
    return df.select(*[masked if c.lower() == text.lower() else quoted(c) for c in docs.columns])


def _joined(spans: Column, score: bool = False) -> Column:
    parts = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), (F.format_number(x["score"], 2) if score else x["end"].cast("string")))
    return F.array_join(F.transform(spans, parts), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of `documents`: counts of the base kinds, digest of the base spans, all spans and their scores.

    Null and empty texts have none (the digest is that of the empty text); whole texts are read, however long; repeated
    rows are returned as often as given. No shuffle, so nothing depends on ties or groups. Only doc_id and text are read.
    """
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("pii_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("pii_spans")).alias("spans"),
        _joined(F.col("pii_spans"), score=True).alias("scores"),
    )


QUERIES = {"op3_pii": op3_pii}
ORACLE: dict[str, str] = {}
